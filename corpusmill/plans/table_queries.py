"""Graph, join, validation and sink queries over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import references, text
from ..operators import collection, containment, graph, postprocess, provisions, quality
from ..session import shared_path, table
from ..sources import readers, sinks, tables
from .registry import query

EDGES = """edges AS (SELECT DISTINCT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'IN_NATION' AS type FROM supplier
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'IN_REGION' FROM nation)"""
NODES = """nodes AS (SELECT 'S' || s_suppkey AS id, 'Supplier' AS label, s_name AS name FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Region', r_name FROM region)"""


def _key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(spark, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return graph.merge_edges(s.select(_key("S", "s_suppkey").alias("src"), _key("N", "s_nationkey").alias("dst"), F.lit("IN_NATION").alias("type")), n.select(_key("N", "n_nationkey").alias("src"), _key("R", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type")))


def nodes(spark, sf_dir: str) -> DataFrame:
    parts = [("S", "Supplier", "supplier", "s_suppkey", "s_name"), ("N", "Nation", "nation", "n_nationkey", "n_name"), ("R", "Region", "region", "r_regionkey", "r_name")]
    return graph.merge_nodes(*(table(spark, sf_dir, t).select(_key(p, k).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name")) for p, label, t, k, name in parts))


@query(f"WITH {EDGES} SELECT n AS node, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT dst AS x FROM edges WHERE src = n AND type = 'IN_REGION' UNION SELECT src FROM edges WHERE dst = n AND type = 'IN_REGION')) AS both_ways, (SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE src = n AND type = 'IN_NATION') AS onward FROM (SELECT DISTINCT src AS n FROM edges)")
def graph_expand_onehop(spark, sf_dir):
    e = edges(spark, sf_dir)
    start = e.select(F.col("src").alias("query_id"), F.col("src").alias("node")).distinct()
    out = graph.expand(start, e, corresponds="IN_REGION", refers="IN_NATION")
    join = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return out.select(F.col("query_id").alias("node"), join("corresponds").alias("both_ways"), join("refers").alias("onward"))


@query(f"""WITH RECURSIVE {EDGES}, step AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), start AS (SELECT 'R' || r_regionkey AS q FROM region),
walk AS (SELECT q, q AS node, 0 AS hop FROM start UNION SELECT q, dst, hop + 1 FROM walk JOIN step ON node = src WHERE hop < 3)
SELECT q AS query_id, node, min(hop)::INT AS hop FROM walk WHERE node <> q GROUP BY q, node""")
def graph_reach3(spark, sf_dir):
    start = table(spark, sf_dir, "region").select(_key("R", "r_regionkey").alias("query_id"), _key("R", "r_regionkey").alias("node"))
    return graph.reach(start, edges(spark, sf_dir), 3)


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def graph_left_chain(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    orders = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return graph.chain_counts(c, "c_custkey", (orders, "c_custkey", {"n_orders": "o_orderkey"}), (lines, "o_orderkey", {"n_parts": "l_partkey", "n_suppliers": "l_suppkey"}))


_STEPS = "SELECT DISTINCT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem"


@query(
    f"""WITH RECURSIVE e AS ({_STEPS} UNION SELECT dst, src FROM ({_STEPS})), r(query_id, node, hop) AS (SELECT c_custkey, 'C' || c_custkey, 0 FROM customer WHERE c_custkey % 50 = 0
  UNION SELECT query_id, dst, hop + 1 FROM r JOIN e ON src = node WHERE hop < 6), f AS (SELECT query_id, node, min(hop) AS hop FROM r GROUP BY query_id, node)
SELECT query_id, CAST(hop AS INT) AS hop, count(*) AS n_nodes, min(node) AS first_node, max(node) AS last_node FROM f WHERE hop > 0 GROUP BY query_id, hop"""
)
def graph_reach6(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    edges = o.select(_key("C", "o_custkey").alias("src"), _key("O", "o_orderkey").alias("dst")).unionByName(li.select(_key("O", "l_orderkey").alias("src"), _key("P", "l_partkey").alias("dst")))
    start = c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), _key("C", "c_custkey").alias("node"))
    return graph.reach_sizes(start, edges, 6, shared_path(spark, "reach"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, TRY_CAST(nullif(regexp_extract(p_name, '^(\\d+)', 1), '') AS BIGINT) ASC NULLS LAST, p_partkey) AS BIGINT) AS nth FROM part")
def multikey_sort(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    return collection.ranked(p, "p_size", "p_name", "p_partkey", shared_path(spark, "ranked")).select("p_partkey", "nth")


@query("""WITH c AS (SELECT conv_id, turn, length(trim(coalesce(text, ''))) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'blank' WHEN n < 10 THEN 'too short' WHEN n > 400 THEN 'too long' ELSE 'accepted' END AS state FROM c""")
def request_rules(spark, sf_dir):
    taken, refused = collection.acceptable(table(spark, sf_dir, "conversations"), "text", 10, 400)
    both = taken.withColumn("reason", F.lit("accepted")).unionByName(refused)
    return both.select("conv_id", "turn", F.col("reason").alias("state"))


@query("""WITH w AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9_]+'), lambda x: length(x) > 2))) AS word FROM (VALUES (1, 'a red widget'), (2, 'Small ring or bolt')) v(query_id, q)),
h AS (SELECT DISTINCT query_id, p_partkey FROM part JOIN w ON contains(lower(p_name), word)) SELECT query_id, id, 'concept' AS route FROM (SELECT query_id, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(p_partkey AS VARCHAR)) AS n FROM h) WHERE n <= 20""")
def graph_anchor_contains(spark, sf_dir):
    asked = spark.createDataFrame([(1, "a red widget"), (2, "Small ring or bolt")], "query_id int, q string").withColumn("words", text.query_words(F.col("q")))
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    return graph.anchors(asked, n, limit=20)


@query(f"WITH {EDGES}, {NODES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def node_edge_counts(spark, sf_dir):
    n = nodes(spark, sf_dir).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    e = edges(spark, sf_dir).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e).select("kind", "name", "n")


@query(f"WITH {EDGES}, {NODES} SELECT coalesce(a.name, a.id) AS source, type, coalesce(b.name, b.id) AS target FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst ORDER BY 1, 2, 3 LIMIT 15")
def triples_topn(spark, sf_dir):
    return graph.triples(edges(spark, sf_dir), nodes(spark, sf_dir), 15)


@query(f"WITH {EDGES}, b AS (SELECT * FROM edges UNION SELECT DISTINCT 'C' || c_custkey, 'N' || c_nationkey, 'IN_NATION' FROM customer UNION SELECT DISTINCT 'O' || o_orderkey, 'C' || o_custkey, 'OF_CUSTOMER' FROM orders) SELECT type, count(*) AS n, count(DISTINCT dst) AS n_targets FROM b GROUP BY type")
def graph_build_edges(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    all_ = graph.merge_edges(edges(spark, sf_dir), c.select(_key("C", "c_custkey").alias("src"), _key("N", "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("type")), o.select(_key("O", "o_orderkey").alias("src"), _key("C", "o_custkey").alias("dst"), F.lit("OF_CUSTOMER").alias("type")))
    return all_.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("n_targets"))


@query("SELECT 'BRAND:' || p_brand_n AS provision, count(DISTINCT l_suppkey) AS case_count FROM (SELECT regexp_extract(p_brand, '([0-9]+)', 1) AS p_brand_n, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey) GROUP BY 1")
def provision_frequency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", references.canonical_id(F.lit("BRAND"), F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("provision"))
    both = p.join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey"), "p_partkey")
    return both.groupBy("provision").agg(F.count_distinct("l_suppkey").alias("case_count"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def type_counts_pivot(spark, sf_dir):
    return collection.counts_by_kind(table(spark, sf_dir, "events"), ["user_id"], "event_type", {"views": "view", "purchases": "purchase", "errors": "error"})


_FINDINGS = """f AS (SELECT doc_id, source, 'issue' AS severity, 'short' AS message FROM documents WHERE length(text) < 200
  UNION ALL SELECT doc_id, source, 'warning', 'no full stop' FROM documents WHERE NOT regexp_matches(trim(text), '[.!?]$')
  UNION ALL SELECT d.doc_id, source, 'info', 'toxic' FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)"""


def _findings(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.findings(d, ["doc_id", "source"], [("issue", F.length("text") < 200, "short"), ("warning", ~F.trim("text").rlike("[.!?]$"), "no full stop"), ("info", F.col("toxic") == 1, "toxic")])


@query(f"WITH {_FINDINGS} SELECT severity, message, count(*) AS n, count(DISTINCT source) AS n_sources FROM f GROUP BY severity, message")
def validator_rules(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("severity", "message").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


@query(f"WITH {_FINDINGS} SELECT source, doc_id, message, CAST(nth AS INT) AS nth, more FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, message) AS nth, greatest(count(*) OVER (PARTITION BY source) - 5, 0) AS more FROM f) WHERE nth <= 5")
def warnings_top5(spark, sf_dir):
    return quality.first_and_rest(_findings(spark, sf_dir), "source", ["doc_id", "message"], 5).select("source", "doc_id", "message", "nth", F.col("more").cast("long").alias("more"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN CAST(d.doc_id % 2 AS INT) <> l.quality THEN 'q_differ' ELSE 'complete' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status")
def completeness_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("q"))
    out = provisions.completeness(d, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q")), "doc_id", ["q"])
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id, list_filter(['D' || doc_id, 'D' || (doc_id + 1), 'X'], lambda s: list_contains(['D' || doc_id, 'D' || (doc_id - doc_id % 3)], s)) AS s FROM documents)
SELECT doc_id, array_to_string(s, ',') AS sources, doc_id % 5 = 0 OR len(s) = 0 AS out_of_scope FROM a""")
def allowlist_sources(spark, sf_dir):
    d, k = F.lit("D"), F.col("doc_id")
    of = lambda x: F.concat(d, x.cast("string"))
    a = table(spark, sf_dir, "documents").select("doc_id", F.array(of(k), of(k + 1), F.lit("X")).alias("sources"), F.array(of(k), of(k - k % 3)).alias("valid_ids"), (k % 5 == 0).alias("out_of_scope"))
    return postprocess.validate_answers(a).select("doc_id", F.array_join("sources", ",").alias("sources"), "out_of_scope")


@query("SELECT d.doc_id, l.doc_id AS label_id FROM documents d LEFT JOIN labels l USING (doc_id)")
def fk_nullify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("label_id"))
    return postprocess.nullify_dangling(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")), "label_id", "k")


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.source END, 'q' || l.quality) AS title FROM documents d JOIN labels l USING (doc_id)")
def enrich_defaults(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"))
    known = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("title"))
    return postprocess.enrich(d, known, "doc_id", ["title"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT CAST(o_orderkey AS VARCHAR) IN ('1', '5', '7', '32') AND NOT contains(lower(o_orderpriority), 'urgent') AND NOT contains(lower(o_orderpriority), 'low')")
def blocklist_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("source_id", F.col("o_orderkey").cast("string"))
    return postprocess.drop_procedural(o, "source_id", "o_orderpriority", ("1", "5", "7", "32"), ("urgent", "low")).select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id) AS newer FROM events) WHERE NOT (newer AND event_type IN ('view', 'click'))")
def prefer_current(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return postprocess.prefer_current(e, "user_id", F.col("event_type"), ("purchase",), ("view", "click"))


@query("SELECT item_id, count(doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY item_id")
def contains_join(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("title"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    hits = containment.contained(d, b, key="doc_id", text="t", title_key="item_id", title="title").groupBy("item_id").agg(F.count("*").alias("n"))
    return b.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("""SELECT r.o_orderkey, r.pos, p.p_partkey, p.p_name FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, [o_orderkey, o_orderkey + 1, 0][unnest([1, 2, 3])] AS id FROM orders) r JOIN part p ON p.p_partkey = r.id""")
def related_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    csv = F.concat_ws(",", F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 1).cast("string"), F.lit("0"))
    ids = o.select("o_orderkey", F.posexplode(text.split_list(csv)).alias("pos", "id"))
    return ids.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("id").cast("long")).select("o_orderkey", "pos", "p_partkey", "p_name")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'unknown') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_left_join(spark, sf_dir):
    known = readers.last_by_key(table(spark, sf_dir, "labels"), "doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("unknown")).alias("toxic"))


@query("SELECT o_custkey, count(*)::INT AS n_orders, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders, coalesce(max(nullif(o_orderstatus, 'X')), '') AS status, CAST(sum(o_totalprice) > 0 AS BOOLEAN) AS has_total FROM orders GROUP BY o_custkey")
def payload_flatten(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.array_sort(F.collect_list("o_orderkey")).alias("orders"), F.max(F.nullif("o_orderstatus", F.lit("X"))).alias("status"), (F.sum("o_totalprice") > 0).alias("has_total"))
    return collection.payload(o, "o_custkey", texts=("status",), numbers=("n_orders",), flags=("has_total",), lists=("orders",))


def _delta(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") * F.when(F.col("o_orderkey") % 20 == 0, -1).otherwise(1)).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return o, new


_DELTA = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), d AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 0)"


@query(f"WITH {_DELTA} SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT * FROM d")
def upsert_merge(spark, sf_dir):
    return sinks.upsert(*_delta(spark, sf_dir), "o_orderkey")


@query(f"WITH {_DELTA} SELECT * FROM o UNION ALL SELECT * FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def insert_if_absent(spark, sf_dir):
    return sinks.insert_if_absent(*_delta(spark, sf_dir), "o_orderkey")


@query(f"WITH {_DELTA} SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)")
def delete_ids(spark, sf_dir):
    return sinks.delete(*_delta(spark, sf_dir), "o_orderkey")


@query(
    """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS version FROM orders
  UNION ALL SELECT -o_orderkey, o_totalprice, 3 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 11 = 0)
SELECT k, price, version FROM o WHERE k < 0 OR k % 13 <> 0"""
)
def durable_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    path = shared_path(spark, "durable_merge")
    of = lambda df, v: df.withColumn("price", F.col("price") + v).withColumn("version", F.lit(v))
    tables.upsert_table(path, of(o, 0), "k", buckets=8)
    some = o.where("k % 7 = 0")
    for _ in range(2):  # the second changes nothing
        tables.upsert_table(path, of(some, 1).unionByName(of(some, 2)), "k", order="version")
    new = o.where("k > 0 and k % 11 = 0").withColumns({"k": -F.col("k"), "version": F.lit(3)})
    tables.insert_into_table(path, new.unionByName(of(o.where("k % 5 = 0"), 9)), "k")
    tables.delete_from_table(path, o.where("k >= 0 and k % 13 = 0").select("k"), "k")
    return tables.read_table(spark, path)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    said = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text.json_object(said), "k int")["k"].alias("k"))


@query("""WITH p AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS a, list_sort(list_distinct(list(l_partkey % 100))) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a, len(list_distinct(list_concat(a, b))) AS n_union FROM p""")
def array_set_ops(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_partkey") % 100).alias("b"))
    return p.select("l_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both_"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only_a"), F.size(F.array_union("a", "b")).cast("long").alias("n_union"))


@query("SELECT o_orderkey, CAST(nth AS INT) AS nth FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, CAST(substr(o_orderpriority, 1, 1) AS INT), o_orderkey) AS nth FROM orders) WHERE nth <= 25")
def multikey_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return collection.by_count_and_number(o, 25, "o_totalprice", "o_orderpriority", "o_orderkey").select("o_orderkey", "nth")


@query("""SELECT page_id, 'section' AS unit_type, '0' AS unit_number, md5(url) AS text_md5 FROM pages UNION ALL
SELECT page_id, 'subsection', CAST(i AS VARCHAR), md5(x[i]) FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS x FROM pages))""")
def atomic_units(spark, sf_dir):
    items = F.transform(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>")), lambda x: F.struct(F.lit("").alias("label"), x.alias("text")))
    sections = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"), items.alias("subsections"))
    return provisions.atomic_units(sections, "page_id").select("page_id", "unit_type", "unit_number", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT conv_id, count(*) AS n, count(DISTINCT role) AS n_roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def json_roundtrip(spark, sf_dir):
    path = shared_path(spark, "json")
    sinks.write_json(table(spark, sf_dir, "conversations").withColumn("part", F.col("conv_id") % 4), path, "part")
    back = readers.json_lines(spark, path, "conv_id long, turn long, role string, text string, part int")
    return back.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("n_roles"), F.sum(F.length("text")).alias("chars"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) > 0 AS found FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3 GROUP BY c_mktsegment")
def keyed_lookup_exists(spark, sf_dir):
    return collection.exists_by(table(spark, sf_dir, "customer"), "c_mktsegment", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}, "c_nationkey": {"$eq": 3}, "c_phone": None})


@query("""WITH v AS (SELECT doc_id, text, doc_id % 10 = 0 AS fresh FROM documents)
SELECT doc_id, CASE WHEN fresh THEN 'new' ELSE 'old' END AS version, count(*) AS n_chunks FROM (SELECT doc_id, fresh, unnest(string_split(CASE WHEN fresh THEN text || chr(10) || 'added' ELSE text END, chr(10))) AS l FROM v) WHERE trim(l) <> '' GROUP BY ALL""")
def document_upsert(spark, sf_dir):
    # blank updates are refused; documents of any length are taken
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = lambda df, v: df.select("doc_id", F.explode(F.split("text", "\n")).alias("line"), F.lit(v).alias("version")).where("trim(line) <> ''")
    delta = d.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit("\nadded")))
    new, refused = sinks.rejected(delta, (F.trim("text") == "", "blank"))
    out = sinks.replace_documents(chunks(d, "old"), chunks(new, "new"), "doc_id")
    return out.groupBy("doc_id", "version").agg(F.count("*").alias("n_chunks"))


@query("SELECT o_orderkey, upper(replace(o_orderstatus, 'O', 'open')) AS status, upper(replace(o_orderpriority, 'O', 'open')) AS priority, 'COURT:ONE' AS court FROM orders")
def nested_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority")).alias("inner")).alias("m"))
    o = o.withColumn("m", text.map_strings(o.schema["m"].dataType, F.col("m"), lambda c: F.upper(F.replace(c, F.lit("O"), F.lit("open")))))
    return o.withColumn("m", F.col("m").withField("court", F.lit("COURT:ONE"))).select("o_orderkey", "m.status", "m.inner.priority", "m.court")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(['P:' || (p_partkey % 7), 'P:' || (p_partkey % 5), 'P:' || p_partkey], lambda r: r <> 'P:' || (p_partkey % 7)))), ',') AS refs FROM part")
def self_reference_exclusion(spark, sf_dir):
    k = F.col("p_partkey")
    ref = lambda x: F.concat(F.lit("P:"), x.cast("string"))
    own = F.concat(ref(k % 7), F.lit("(2)"))
    refs = F.array_sort(F.array_distinct(references.without_self(F.array(ref(k % 7), ref(k % 5), ref(k)), own)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(refs, ",").alias("refs"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, '12') OR contains(p_brand, '12') OR contains(p_type, '12') OR contains(CAST(p_size AS VARCHAR), '12')")
def any_property_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").where(graph.contains_any(F.lit("12"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size"))).select("p_partkey")


@query("SELECT d.doc_id, array_to_string(list_filter([CASE WHEN d.text <> '' THEN 'text' END, CASE WHEN l.quality IS NOT NULL THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS fields FROM documents d LEFT JOIN labels l USING (doc_id)")
def nonempty_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.array_join(collection.present(text=F.col("text"), quality=F.col("quality"), toxic=F.col("toxic") == 1), ",").alias("fields"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (l_returnflag = 'R') = 0 AS passes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def point_assertion(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return collection.without_items(o, li, "o_orderkey", F.col("l_returnflag") == "R")


@query("SELECT p_partkey, 'Section ' || p_size || ' - ' || p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || 'Explanation 1: ' || p_brand || chr(10) || chr(10) || 'Explanation 2: x' AS assembled FROM part")
def record_assembly(spark, sf_dir):
    item = lambda x: F.struct(F.lit("Explanation").alias("label"), x.alias("text"))
    notes = F.array(item(F.col("p_brand")), item(F.lit("x")), item(F.lit(" ")))
    kept = F.filter(notes, lambda x: F.trim(x["text"]) != "")
    return table(spark, sf_dir, "part").select("p_partkey", provisions.assembled(F.col("p_size").cast("string"), F.col("p_name"), F.col("p_type"), provisions.labelled(kept, ("explanation", "explanations"), "Explanation")).alias("assembled"))


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def directed_lookup(spark, sf_dir):
    e, n = edges(spark, sf_dir).where("type = 'IN_REGION'"), nodes(spark, sf_dir)
    return graph.triples(e, n).select(F.col("source").alias("n_name"), F.col("target").alias("r_name"))


@query("WITH s AS (SELECT n_regionkey, s_suppkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS nth FROM nation JOIN supplier ON s_nationkey = n_nationkey) SELECT r_name, count(s_suppkey) AS n_suppliers, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FILTER (nth <= 20), '') AS suppliers FROM region LEFT JOIN s ON n_regionkey = r_regionkey GROUP BY r_name")
def context_with_links(spark, sf_dir):
    r, n, sup = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    homes = n.join(sup, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "s_suppkey")
    out = graph.linked_context(r.withColumn("n_regionkey", F.col("r_regionkey")), "n_regionkey", homes, "n_regionkey", "s_suppkey", 20)
    return out.select("r_name", F.col("n").alias("n_suppliers"), F.col("items").alias("suppliers"))


@query("SELECT coalesce(CAST(o_custkey AS VARCHAR), '-') || ': orders=' || count(*) || ', open=' || count(*) FILTER (o_orderstatus = 'O') || ', last=' || coalesce(max(o_orderpriority), '-') AS value FROM orders GROUP BY o_custkey")
def text_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max("o_orderpriority").alias("last"))
    path = shared_path(spark, "report")
    sinks.text_report(o, "o_custkey").write.text(path)
    return spark.read.text(path)


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id AS query_id, 'BNS:' || (doc_id % 97) AS section_id, 'BNS' AS act, CAST(doc_id % 97 AS VARCHAR) AS section, source AS title, md5(substr(text, 1, 80)) AS excerpt, CASE WHEN doc_id % 3 = 0 THEN 'IPC:' || doc_id WHEN doc_id % 3 = 1 THEN 'IPC:' || doc_id || ',CRPC:1' ELSE '' END AS related FROM d""")
def provision_cards(spark, sf_dir):
    from ..operators import search

    none = F.expr("cast(array() as array<string>)")
    ipc = F.array(F.concat(F.lit("IPC:"), F.col("doc_id").cast("string")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.concat(F.lit("BNS:"), F.col("doc_id") % 97).alias("section_id"), F.lit("").alias("act"), F.col("source").alias("title"), "text", F.when(F.col("doc_id") % 3 < 2, ipc).alias("successors"), F.when(F.col("doc_id") % 3 == 1, F.concat(ipc, F.array(F.lit("CRPC:1"), F.lit("")))).otherwise(none).alias("predecessors"))
    out = search.provision_cards(d, 80, ("successors", "predecessors"))
    return out.select("query_id", "section_id", "act", "section", "title", F.md5(F.col("excerpt").cast("binary")).alias("excerpt"), F.array_join("related_sections", ",").alias("related"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS name, count(*) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS variants FROM orders GROUP BY 1")
def alias_group(spark, sf_dir):
    out = quality.by_alias(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": "final", "O": "open"}, "other")
    return out.select("name", "n", F.array_join("variants", ",").alias("variants"))


@query("SELECT p_partkey, 'LEGAL_CONCEPT:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS concept FROM part")
def concept_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.concept_id(F.col("p_name")).alias("concept"))


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' ELSE CAST(p_size AS VARCHAR) END AS numeral, CAST(p_size AS VARCHAR) AS exception FROM part")
def numeral_map(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", text.roman_part(size).alias("numeral"), text.exception_number(F.concat(F.lit("("), size, F.lit(")"))).alias("exception"))


@query("SELECT p_partkey, 'P:' || p_size || '(Part ' || CASE p_partkey % 3 WHEN 0 THEN 'III' WHEN 1 THEN 'I' ELSE 'II' END || ')' AS canonical_id, CAST(p_size AS VARCHAR) AS section, CASE p_partkey % 3 WHEN 0 THEN 'III' WHEN 1 THEN 'I' ELSE 'II' END AS part, 'P Section ' || p_size || ' Part ' || CASE p_partkey % 3 WHEN 0 THEN 'III' WHEN 1 THEN 'I' ELSE 'II' END AS display_name FROM part")
def canonical_struct(spark, sf_dir):
    k = F.when(F.col("p_partkey") % 3 == 0, "3").otherwise((F.col("p_partkey") % 3).cast("string"))
    c = references.canonical(F.lit("P"), F.concat(F.col("p_size").cast("string"), F.lit("  (part "), k, F.lit(")")))
    return table(spark, sf_dir, "part").withColumn("c", c).select("p_partkey", "c.canonical_id", "c.section", "c.part", "c.display_name")


@query("SELECT chunk_type, count(*) AS n, count(*) FILTER (valid) AS n_valid FROM (SELECT role AS chunk_type, conv_id IS NOT NULL AND role <> '' AND text IS NOT NULL AS valid FROM conversations) GROUP BY chunk_type")
def chunk_validity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("chunk_type"), quality.valid_chunk(F.col("conv_id").cast("string"), F.col("role"), F.col("text")).alias("valid"))
    return c.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))
