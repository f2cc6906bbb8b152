"""Retrieval queries over ``embeddings``; labels are sections.

A search takes every vector whose id is divisible by 20 as a query against all
rows; only the pair of a vector with itself is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import collection, evaluate, graph, index, postprocess, retrieval, search, vector
from ..session import shared_path, table
from .registry import query

BOTH = "CAST(embedding AS DOUBLE[])"
#: All pairs of a query and a corpus vector, ranked.
HITS = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
hits AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id, c.label, list_cosine_similarity(q.v, c.v) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS vector_rank
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)"""
_FIRST = "CASE WHEN label = query_label THEN 2.0::DOUBLE ELSE 0.0 END"
_SECOND = "CASE WHEN label = (query_label + 1) % 10 THEN 1.0::DOUBLE WHEN abs(label - query_label) <= 2 THEN 0.5 ELSE 0.0 END"
RANKED = HITS + f""",
scored AS (SELECT *, {_FIRST} + {_SECOND} AS boost_applied, round(1.0 / (60 + vector_rank) + {_FIRST} + {_SECOND}, 6) AS rrf_score FROM hits WHERE vector_rank <= {{fetch}}),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_rank, vec_id) AS final_rank FROM scored)"""


def ranked(e: DataFrame, k: int, corpus: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``k`` best of the corpus, or of the part of it where ``corpus`` holds, for every query."""
    asking = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("query_vec"))
    rows = e if corpus is None else e.where(corpus)
    # one more, as a query may meet itself
    found = vector.top_k(asking, rows, k + 1, keep=keep or [], queries_keep=["query_label"], bulk=True).where("vec_id <> query_id")
    return vector.rank_by_score(found, "query_id", "score", "vec_id").where(F.col("vector_rank") <= k)


def hits(spark, sf_dir: str, k: int) -> DataFrame:
    return ranked(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), k, keep=["label"])


def hybrid(spark, sf_dir: str, k: int, limit: int | None = None) -> DataFrame:
    """Over-fetched candidates in their final order."""
    found = hits(spark, sf_dir, retrieval.fetch_size(k))
    same, asked = F.col("label") == F.col("query_label"), F.lit(False)
    near = (F.col("label") == (F.col("query_label") + 1) % 10, F.abs(F.col("label") - F.col("query_label")) <= 2)
    return retrieval.rerank(found, same, asked, *near, limit=limit)


@query(RANKED.format(fetch=10) + " SELECT query_id, vec_id, CAST(vector_rank AS INT) AS vector_rank, round(1 - score, 6) AS vector_distance, boost_applied, rrf_score, CAST(final_rank AS INT) AS final_rank FROM hybrid WHERE final_rank <= 3")
def hybrid_retrieve_topk(spark, sf_dir):
    out = hybrid(spark, sf_dir, 3, limit=3)
    return out.select("query_id", "vec_id", "vector_rank", "vector_distance", "boost_applied", "rrf_score", "final_rank")


@query(HITS + " SELECT query_id, vec_id, CAST(vector_rank AS INT) AS vector_rank, round(1 - score, 6) AS vector_distance, round(1.0 / (60 + vector_rank), 6) AS rrf_score FROM hits WHERE vector_rank <= 3")
def vector_topk_plain(spark, sf_dir):
    return retrieval.neutral(hits(spark, sf_dir, 3)).select("query_id", "vec_id", "vector_rank", "vector_distance", "rrf_score")


@query(HITS + " SELECT query_id, vec_id, label, CAST(vector_rank AS INT) AS vector_rank, round(score, 6) AS score, true AS audited FROM hits WHERE vector_rank <= 10")
def indexed_topk(spark, sf_dir):
    """Exact search of an index of inverted lists; ``audited`` tells whether its approximate search reached a recall of 0.95."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    lists = index.build(e, shared_path(spark, "index"))
    probes, recall = index.calibrated(asked, lists, 11)
    found = index.search(asked, lists, 11, probes=probes, exact=True, keep=("label",)).where("vec_id <> query_id")
    best = vector.rank_by_score(found.drop("vector_rank"), "query_id", "score", "vec_id").where("vector_rank <= 10")
    return best.select("query_id", "vec_id", "label", "vector_rank", F.round("score", 6).alias("score"), F.lit(recall >= 0.95).alias("audited"))


@query(RANKED.format(fetch=10) + " SELECT query_id, vec_id, label FROM hybrid WHERE final_rank <= 3 AND (query_id, vec_id) NOT IN (SELECT (query_id, vec_id) FROM hits WHERE vector_rank <= 3)")
def compare_additions(spark, sf_dir):
    plain = hits(spark, sf_dir, 3)
    return retrieval.additions(hybrid(spark, sf_dir, 3, limit=3), plain, ["query_id", "vec_id"]).select("query_id", "vec_id", "label")


@query(RANKED.format(fetch=10) + """, fused AS (SELECT *, round(rrf_score + CASE WHEN label % 3 = query_label % 3 THEN 0.5 ELSE 0.0 END, 6) AS final_score FROM hybrid)
SELECT query_id, vec_id, final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vector_rank) AS INT) AS fused_rank,
  CASE WHEN bool_or(label % 3 = query_label % 3) OVER (PARTITION BY query_id) THEN 'hybrid' ELSE 'vector' END AS source FROM fused""")
def fusion_rerank(spark, sf_dir):
    found = hybrid(spark, sf_dir, 3)
    out = retrieval.fuse(found, F.col("label") % 3 == F.col("query_label") % 3, F.lit("a question"))
    return out.select("query_id", "vec_id", "final_score", "fused_rank", "source")


@query(HITS + """ SELECT query_id, vec_id, 0.5::DOUBLE * len(list_intersect([query_label, (query_label + 1) % 10], [label, (label + 3) % 10])) AS boost FROM hits WHERE vector_rank <= 5""")
def judgment_match_boost(spark, sf_dir):
    asked = F.array(F.col("query_label").cast("string"), ((F.col("query_label") + 1) % 10).cast("string"))
    named = F.array(F.col("label").cast("string"), ((F.col("label") + 3) % 10).cast("string"))
    return hits(spark, sf_dir, 5).select("query_id", "vec_id", retrieval.matched_sections_boost(asked, named).alias("boost"))


_RANKS = """ranks AS (SELECT query_id, min(CASE WHEN label = query_label THEN {rank} END) AS rank FROM {hits} WHERE {rank} <= 5 GROUP BY query_id)"""
_METRICS = "count(*) AS n_queries, count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 3) AS hits_3, round(100 * avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 2) AS hit_1, round(100 * avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 2) AS hit_3, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr"


@query(HITS + ", " + _RANKS.format(rank="vector_rank", hits="hits") + f" SELECT {_METRICS} FROM ranks")
def retrieval_metrics(spark, sf_dir):
    ranks = evaluate.first_relevant(hits(spark, sf_dir, 5), F.col("label") == F.col("query_label"))
    return evaluate.metrics(ranks)


def _modes(spark, sf_dir) -> DataFrame:
    same = F.col("label") == F.col("query_label")
    b = hybrid(spark, sf_dir, 5)
    c = retrieval.fuse(b, F.col("label") % 3 == F.col("query_label") % 3, F.lit("a question"))
    return evaluate.of_modes(same, 5, a=(b, "vector_rank"), b=(b, "final_rank"), c=(c, "fused_rank"))


@query(RANKED.format(fetch=15) + f""", fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score + CASE WHEN label % 3 = query_label % 3 THEN 0.5 ELSE 0.0 END, 6) DESC, vector_rank) AS fused_rank FROM hybrid),
ranks AS (
  SELECT 'a' AS mode, query_id, min(CASE WHEN label = query_label THEN vector_rank END) AS rank FROM hybrid WHERE vector_rank <= 5 GROUP BY query_id
  UNION ALL SELECT 'b', query_id, min(CASE WHEN label = query_label THEN final_rank END) FROM hybrid WHERE final_rank <= 5 GROUP BY query_id
  UNION ALL SELECT 'c', query_id, min(CASE WHEN label = query_label THEN fused_rank END) FROM fused WHERE fused_rank <= 5 GROUP BY query_id),
m AS (SELECT mode, {_METRICS} FROM ranks GROUP BY mode)
SELECT m.*, round(m.hit_1 - b.hit_1, 2) AS d_hit_1, round(m.hit_3 - b.hit_3, 2) AS d_hit_3, round(m.mrr - b.mrr, 4) AS d_mrr FROM m, (SELECT * FROM m WHERE mode = 'a') b""")
def mode_ablation(spark, sf_dir):
    return evaluate.against(_modes(spark, sf_dir), "a")


@query(HITS + ", " + _RANKS.format(rank="vector_rank", hits="hits") + " SELECT query_id, round(coalesce(1.0 / rank, 0), 6) AS reciprocal_rank FROM ranks")
def reciprocal_rank(spark, sf_dir):
    ranks = evaluate.first_relevant(hits(spark, sf_dir, 5), F.col("label") == F.col("query_label"))
    return ranks.select("query_id", F.round(evaluate.reciprocal(F.col("rank")), 6).alias("reciprocal_rank"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS norm, round(v[1] / n, 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vector.l2_normalized(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(vector.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query(HITS + """ SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, 'L' || label AS section_id, CAST(vector_rank AS INT) AS vector_rank, round(1 - score, 6) AS vector_distance, CASE WHEN label = 0 THEN 'Unknown case' ELSE 'case ' || label END AS case_id FROM hits WHERE vector_rank <= 4""")
def candidate_projection(spark, sf_dir):
    found = hits(spark, sf_dir, 4).withColumn("chunk_id", F.col("vec_id"))
    label = F.col("label").cast("string")
    laws = retrieval.statute_candidates(found, F.concat(F.lit("L"), label))
    cases = retrieval.judgment_candidates(found, F.when(F.col("label") != 0, F.concat(F.lit("case "), label)).otherwise(""))
    return laws.join(cases.select("query_id", "chunk_id", "case_id"), ["query_id", "chunk_id"])


@query(HITS + " SELECT query_id, vec_id, vec_id % 2 = 0 AND vector_rank <= 2 AS cited FROM hits WHERE vector_rank <= 4")
def cited_partition(spark, sf_dir):
    from pyspark.sql import Window

    found = hits(spark, sf_dir, 4)
    sources = F.collect_list(F.when((F.col("vec_id") % 2 == 0) & (F.col("vector_rank") <= 2), F.col("vec_id"))).over(Window.partitionBy("query_id"))
    return found.withColumn("sources", sources).select("query_id", "vec_id", postprocess.cited_flag(F.col("sources"), F.col("vec_id")).alias("cited"))


@query("""WITH e AS (SELECT vec_id, label, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS collection, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT * FROM (SELECT collection, query_id, vec_id, CAST(row_number() OVER (PARTITION BY collection, query_id ORDER BY score DESC, vec_id) AS INT) AS vector_rank
FROM (SELECT c.collection, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)) WHERE vector_rank <= 2""")
def multi_collection_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    parts = [ranked(e, 2, c).withColumn("collection", F.lit(name)) for name, c in (("low", F.col("label") < 5), ("high", F.col("label") >= 5))]
    return parts[0].unionByName(parts[1]).select("collection", "query_id", "vec_id", "vector_rank")


@query(HITS + """, gold(id, query_id, targets) AS (VALUES ('Q1', 0, [0, 1]), ('Q2', 20, [2]), ('Q3', 40, [3, 4, 5]), ('Q4', 99, [1]))
SELECT g.id, count(h.vec_id) AS n_hits, count(*) FILTER (list_contains(g.targets, h.label)) AS n_relevant FROM gold g LEFT JOIN hits h ON h.query_id = g.query_id AND h.vector_rank <= 5 GROUP BY g.id""")
def inline_gold_join(spark, sf_dir):
    gold = spark.createDataFrame([("Q1", 0, [0, 1]), ("Q2", 20, [2]), ("Q3", 40, [3, 4, 5]), ("Q4", 99, [1])], "id string, query_id long, targets array<int>")
    both = gold.join(hits(spark, sf_dir, 5), "query_id", "left")
    return both.groupBy("id").agg(F.count("vec_id").alias("n_hits"), F.count_if(F.array_contains("targets", F.col("label"))).alias("n_relevant"))


@query("SELECT CAST(vec_id AS VARCHAR) AS point_id, CAST(len(embedding) AS INT) AS dim, label, CASE WHEN label < 5 THEN 'statutes' ELSE 'judgments' END AS collection FROM embeddings")
def collection_rebuild(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("home", F.when(F.col("label") < 5, "statutes").otherwise("judgments"))
    made = collection.points(e, "vec_id", "embedding", F.col("home"), ("label",))
    return collection.rebuild(made, shared_path(spark, "collection"), "collection").select("point_id", "dim", "label", "collection")


#: Acts, sections and graph of the composite searches: ids name a section, every fourth chunk is a judgment's.
LEGAL = """a AS (SELECT vec_id, label, (CASE WHEN vec_id % 2 = 0 THEN 'IPC' ELSE 'BNS' END) || ':' || label AS section_id, vec_id % 4 = 3 AS is_case, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, label, 'IPC:' || label AS named, 'BNS:' || ((label + 1) % 10) AS counterpart, 'BNS:' || ((label + 2) % 10) AS referred, v FROM a WHERE vec_id % 20 = 0),
laws AS (SELECT query_id, vec_id, section_id, named, counterpart, referred, list_cosine_similarity(q.v, a.v) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.v, a.v) DESC, CAST(vec_id AS VARCHAR)) AS vector_rank FROM q JOIN a ON NOT is_case),
boosted AS (SELECT *, round(1.0 / (60 + vector_rank) + CASE WHEN section_id = named THEN 2.0::DOUBLE ELSE 0.0 END + CASE WHEN section_id = counterpart THEN 1.0::DOUBLE WHEN section_id IN (named, referred) THEN 0.5 ELSE 0.0 END, 6) AS rrf_score FROM laws WHERE vector_rank <= 10),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_rank, CAST(vec_id AS VARCHAR)) AS rank FROM boosted)"""


def legal(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Queries that name a section, statutes, judgments and the sections' graph, made of ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    n = F.col("label").cast("string")
    act = F.when(F.col("vec_id") % 2 == 0, "IPC").otherwise("BNS")
    is_case = F.col("vec_id") % 4 == 3
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("what does Section "), n, F.lit(" of the IPC say")).alias("query_text"), F.col("embedding").alias("query_vec"))
    key = F.col("vec_id").cast("string").alias("chunk_id")
    statutes = e.where(~is_case).select(key, F.concat_ws(":", act, n).alias("section_id"), act.alias("act"), F.concat(F.lit("Title "), n).alias("title"), F.concat(F.lit("Text of "), n).alias("text"), "embedding")
    judgments = e.where(is_case).select(key, F.concat(F.lit("case "), n).alias("case_id"), F.array(F.concat(F.lit("IPC:"), n)).alias("legal_references"), F.concat(F.lit("Said of "), n).alias("text"), "embedding")
    some = spark.range(10).select(F.concat(F.lit("IPC:"), "id").alias("src"), F.concat(F.lit("BNS:"), (F.col("id") + 1) % 10).alias("c"), F.concat(F.lit("BNS:"), (F.col("id") + 2) % 10).alias("r"))
    edges = some.select("src", F.col("c").alias("dst"), F.lit("CORRESPONDS_TO").alias("type")).unionByName(some.select("src", F.col("r").alias("dst"), F.lit("REFERS_TO").alias("type")))
    nodes = graph.with_endpoints(spark.createDataFrame([], "id string, label string, name string"), edges, "StatuteSection")
    return {"queries": queries, "statutes": statutes, "judgments": judgments, "edges": edges, "nodes": nodes}


@query("WITH " + LEGAL + " SELECT query_id, CAST(rank AS INT) AS rank, section_id, rrf_score, split_part(section_id, ':', 2) AS section, 'Title ' || split_part(section_id, ':', 2) AS title FROM hybrid WHERE rank <= 3")
def research_laws(spark, sf_dir):
    t = legal(spark, sf_dir)
    laws, _ = search.research(t["queries"], t["statutes"], None, t["edges"], t["nodes"], bulk=True)
    cards = search.provision_cards(laws)
    return cards.join(laws.select("query_id", "rank", "rrf_score"), ["query_id", "rank"]).select("query_id", "rank", "section_id", "rrf_score", "section", "title")


@query("WITH " + LEGAL + """, f AS (SELECT *, section_id IN (SELECT unnest([named, 'BNS:' || ((label + 1) % 10), 'BNS:' || ((label + 2) % 10), 'IPC:' || ((label + 1) % 10), 'IPC:' || ((label + 9) % 10), 'BNS:' || ((label + 3) % 10), 'BNS:' || label])) AS held FROM hybrid JOIN (SELECT query_id, label FROM q) USING (query_id)),
g AS (SELECT *, round(rrf_score + CASE WHEN held THEN 0.5 ELSE 0.0 END, 6) AS final_score FROM f)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, g.rank) AS INT) AS rank, section_id, vec_id AS chunk, final_score, CASE WHEN bool_or(held) OVER (PARTITION BY query_id) THEN 'hybrid' ELSE 'vector' END AS source FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, g.rank) <= 3""")
def research_fused(spark, sf_dir):
    """Mode C: the hybrid search, its candidates ordered by what the graph around the query's anchors supports too."""
    t = legal(spark, sf_dir)
    laws, _ = search.research(t["queries"], t["statutes"], None, t["edges"], t["nodes"], fused=True, bulk=True)
    return laws.select("query_id", "rank", "section_id", F.col("chunk_id").cast("long").alias("chunk"), "final_score", "source")


@query("WITH " + LEGAL + """, cases AS (SELECT query_id, vec_id, a.label, q.label AS asked, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.v, a.v) DESC, CAST(vec_id AS VARCHAR)) AS vector_rank FROM q JOIN a ON is_case),
b AS (SELECT *, round(1.0 / (60 + vector_rank) + CASE WHEN label = asked THEN 0.5::DOUBLE ELSE 0.0 END, 6) AS rrf_score FROM cases WHERE vector_rank <= 3)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_rank) AS INT) AS rank, CAST(vec_id AS VARCHAR) AS source_id, 'case ' || label AS case_id, 'Said of ' || label AS excerpt FROM b""")
def research_judgments(spark, sf_dir):
    t = legal(spark, sf_dir)
    _, cases = search.research(t["queries"], t["statutes"], t["judgments"], t["edges"], t["nodes"], bulk=True)
    return search.judgment_cards(cases).select("query_id", "rank", "source_id", "case_id", "excerpt")


@query("WITH " + LEGAL + " SELECT query_id, CAST(vector_rank AS INT) AS rank, section_id, round(1 - score, 6) AS vector_distance FROM laws WHERE vector_rank <= 3")
def plain_laws(spark, sf_dir):
    t = legal(spark, sf_dir)
    laws, _ = search.plain(t["queries"], t["statutes"], None, bulk=True)
    return laws.select("query_id", "rank", "section_id", "vector_distance")


@query("WITH " + LEGAL + " SELECT query_id, section_id, CAST(rank AS INT) AS rank FROM hybrid WHERE rank <= 3 AND (query_id, section_id) NOT IN (SELECT (query_id, section_id) FROM laws WHERE vector_rank <= 3)")
def compare_searches(spark, sf_dir):
    t = legal(spark, sf_dir)
    return search.compare(t["queries"], t["statutes"], t["edges"], t["nodes"], bulk=True)


@query("WITH " + LEGAL.replace("vector_rank <= 10", "vector_rank <= 15") + """, f AS (SELECT query_id, section_id, rank FROM hybrid WHERE rank <= 5), g AS (SELECT query_id, named, counterpart FROM q),
r AS (SELECT g.query_id, min(rank) AS rank FROM g LEFT JOIN f ON f.query_id = g.query_id AND section_id IN (named, counterpart) GROUP BY g.query_id)
SELECT r.query_id, (SELECT string_agg(section_id, ',' ORDER BY rank) FROM f WHERE f.query_id = r.query_id) AS found, CAST(rank AS INT) AS rank, round(coalesce(1.0 / rank, 0), 6) AS reciprocal_rank FROM r""")
def baseline_snapshot(spark, sf_dir):
    t = legal(spark, sf_dir)
    number = F.regexp_extract("query_text", r"(\d+)", 1)
    gold = t["queries"].select("query_id", "query_text", F.array(F.concat(F.lit("IPC:"), number), F.concat(F.lit("BNS:"), ((number.cast("int") + 1) % 10).cast("string"))).alias("expected"))
    laws, _ = search.research(t["queries"], t["statutes"], None, t["edges"], t["nodes"], k_statutes=5, bulk=True)
    out = evaluate.baseline(gold, laws)
    return out.select("query_id", F.array_join("found", ",").alias("found"), "rank", "reciprocal_rank")


@query("WITH " + LEGAL + """, l AS (SELECT query_id, section_id FROM hybrid WHERE rank <= 3)
SELECT query_id, string_agg(DISTINCT section_id, ',' ORDER BY section_id) AS sources, false AS out_of_scope FROM l GROUP BY query_id""")
def grounded_answers(spark, sf_dir):
    t = legal(spark, sf_dir)
    out = search.ask(t["queries"], t["statutes"], None, t["edges"], t["nodes"], bulk=True)
    return out.select("query_id", F.array_join("sources", ",").alias("sources"), "out_of_scope")


@query("WITH q AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0) SELECT query_id, 'IPC:' || label AS sections, 'explicit=IPC:' || label AS anchors, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT x FROM (SELECT unnest(['BNS:' || ((label + 1) % 10), 'BNS:' || ((label + 2) % 10), 'IPC:' || ((label + 1) % 10), 'IPC:' || ((label + 9) % 10), 'BNS:' || ((label + 3) % 10), 'BNS:' || (label % 10)]) AS x) WHERE x <> 'IPC:' || label)) AS statutes FROM q")
def graph_trace(spark, sf_dir):
    t = legal(spark, sf_dir)
    out = search.trace(t["queries"], t["edges"], t["nodes"])
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("query_id", join("sections"), join("anchors"), join("statutes"))


@query("WITH " + LEGAL.replace("vector_rank <= 10", "vector_rank <= 36") + """, h AS (SELECT query_id, CAST(rank AS INT) AS rank, section_id, bool_or(section_id LIKE 'BNS:%') OVER (PARTITION BY query_id) AS newer FROM hybrid WHERE rank <= 12)
SELECT query_id, rank, section_id, 'Title ' || split_part(section_id, ':', 2) AS title FROM h WHERE NOT (newer AND section_id LIKE 'IPC:%')""")
def triage(spark, sf_dir):
    """Offence candidates of reported facts: retrieved, without procedure, current law before superseded."""
    t = legal(spark, sf_dir)
    return search.triage(t["queries"], t["statutes"], t["edges"], t["nodes"], bulk=True).select("query_id", "rank", "section_id", "title")
