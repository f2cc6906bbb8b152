import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.operators import chunking as C
from corpusmill.operators import evaluate as E
from corpusmill.operators import graph as G
from corpusmill.operators import postprocess as P
from corpusmill.operators import provisions as V
from corpusmill.operators import quality as Q
from corpusmill.operators import retrieval as R
from corpusmill.operators import structure as S
from corpusmill.operators import vector as X
from corpusmill.sources import readers, sinks


def packs(spark, paras, **kw):
    df = spark.createDataFrame([(paras,)], "paras array<struct<t:int,refs:array<string>>>")
    return df.select(C.greedy_packs(links=("refs",), **kw).alias("x")).first().x


@pytest.mark.parametrize(
    "tokens,refs,want",
    [
        ([300, 250, 100, 600, 1200, 50], [[]] * 6, [[0, 1], [2, 3], [4], [5]]),
        ([450, 100, 200], [[], ["a"], ["a"]], [[0, 1], [1, 2]]),
        ([450, 100, 200], [[], ["a"], ["b"]], [[0, 1], [2]]),
        ([10] * 9, [[]] * 9, [[0, 1, 2, 3, 4, 5, 6, 7], [8]]),
        ([], [], []),
    ],
)
def test_greedy_packs(spark, tokens, refs, want):
    assert packs(spark, list(zip(tokens, refs))) == want


def test_simple_and_sentence_packs(spark):
    df = spark.createDataFrame([([(300,), (300,), (1,), (700,)],)], "paras array<struct<t:int>>")
    assert df.select(C.simple_packs().alias("x")).first().x == [[0, 1], [2], [3]]
    text = "One two three. Four five. Six seven eight nine."
    got = spark.range(1).select(C.sentence_packs(F.lit(text), cap=7).alias("x")).first().x
    assert got == ["One two three. Four five.", "Six seven eight nine."]
    assert spark.range(1).select(C.sub_part(F.lit(5), F.lit(1)).alias("x")).first().x == "5-B"


def test_mending(spark):
    df = spark.createDataFrame([(["seen by (PW-", "5) who ran", "x (PW-", "2) y (PW-", "3) z"],)], "t array<string>")
    assert df.select(C.mended("t", *C.WITNESS).alias("x")).first().x == ["seen by (PW-) who ran", "x (PW-) y (PW-", "3) z"]


def test_stitching(spark):
    df = spark.createDataFrame([(["The first section", "of this act.", "", "Second one-", "part", "Third"],)], "t array<string>")
    assert df.select(C.stitched("t", C.SUBSECTION).alias("x")).first().x == ["The first section of this act.", "Second one-part", "Third"]


def test_sequential_paragraphs(spark):
    lines = [(1, "intro"), (1, "1. first"), (1, "7 apples"), (2, "more"), (2, "2 second"), (3, ""), (3, "4. not next")]
    df = spark.createDataFrame([(lines,)], "lines array<struct<page:int,text:string>>")
    got = [tuple(r) for r in df.select(C.sequential_paragraphs().alias("x")).first().x]
    assert got == [(1, 1, 1, "intro"), (1, 1, 2, "first 7 apples more"), (2, 2, 3, "second 4. not next")]


def test_headnotes_and_headings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    got = one(S.propositions(F.lit("A – b. [Paras 3, 5-7] C – d. [Para 9] tail")))
    assert [r.related_paragraphs for r in got] == [[3, 5, 6, 7], [9], []]
    assert [r.heading for r in got] == ["A – b. [Paras 3, 5-7]", "C – d. [Para 9]", "tail"]
    assert one(S.topics(F.lit("One  two [Paras 1] three [Para 2] rest"))) == ["One two [Paras 1]", "three [Para 2]"]
    assert one(S.heading(F.lit("Judgment / Order of the Supreme Court"))) == "judgment"
    assert one(S.heading(F.lit("List of Acts"))) == "acts_cited" and one(S.heading(F.lit("In order to"))) is None
    assert one(S.list_items(F.lit("• A v. B\n1877\nDigital Supreme Court Reports\n- C"))) == ["A v. B", "C"]


def test_section_buckets(spark):
    lines = ["noise", "Headnotes", "h1", "h2", "List of Acts", "a1", "JUDGMENT", "j1", "Headnotes", "j2", "Result of the case: x", "after", "List of Keywords", "k1"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, at int, line string")
    got = [(r.line, r.section) for r in S.section_buckets(df, "doc", ["at"]).orderBy("at").collect()]
    assert got == [("h1", "headnotes"), ("h2", "headnotes"), ("a1", "acts_cited"), ("j1", "judgment"), ("Headnotes", "judgment"), ("j2", "judgment"), ("k1", "keywords")]


def test_repeated_edge_lines(spark):
    rows = [(1, p, i, x) for p in range(1, 5) for i, x in enumerate((["A header of twenty c"] if p < 4 else []) + ["short", f"body {p} long enough line", "more"])]
    got = S.repeated_edge_lines(spark.createDataFrame(rows, "doc int, page int, at int, line string"), "doc", "page", "at", "line").collect()
    assert [(r.line, r.n) for r in got] == [("A header of twenty c", 3)]


def test_rerank_ladder(spark):
    df = spark.createDataFrame([(1, "IPC:304", 1, 0.9), (1, "IPC:302", 2, 0.8), (1, "BNS:103", 3, 0.7)], "query_id int, vec_id string, vector_rank int, score double")
    sec, graph = F.col("vec_id"), ["BNS:103", "IPC:302"]
    got = R.rerank(df, sec == "BNS:103", sec.isin("BNS:103", "IPC:302"), sec.isin(*graph), sec.isin(*graph)).orderBy("final_rank").collect()
    assert [(r.vec_id, r.boost_applied, r.rrf_score) for r in got] == [("BNS:103", 3.0, 3.015873), ("IPC:302", 2.5, 2.516129), ("IPC:304", 0.0, 0.016393)]


def test_fusion(spark):
    df = spark.createDataFrame([(1, "IPC:300", 0.5, 1), (1, "IPC:304", 0.45, 2), (1, "IPC:302", 0.6, 3)], "query_id int, sid string, rrf_score double, vector_rank int")
    got = R.fuse(df, F.col("sid").isin("IPC:300", "IPC:304"), F.lit("general homicide inquiry")).orderBy("fused_rank").collect()
    assert [(r.sid, r.final_score) for r in got] == [("IPC:300", 1.0), ("IPC:304", 0.95), ("IPC:302", 0.6)]
    alone = R.fuse(df.limit(1), F.lit(False), F.lit("What does IPC:300 say?")).first()
    assert alone.final_score == 0.7 and alone.source == "vector" and alone.fusion_boosts == {"statute_id": 0.2}


def test_graph(spark):
    edges = spark.createDataFrame([("IPC:300", "BNS:101", "CORRESPONDS_TO"), ("IPC:300", "IPC:299", "REFERS_TO"), ("C1", "IPC:300", "REFERS_TO"), ("C1", "murder", "DISCUSSES"), ("K", "C1", "HAS_CHUNK"), ("K", "X", "CITES_CASE")], "src string, dst string, type string")
    start = spark.createDataFrame([(1, "IPC:300"), (2, "BNS:101"), (3, "none")], "query_id int, node string")
    got = {r.query_id: r for r in G.expand(start, edges).collect()}
    assert (got[1].corresponds, got[1].refers, got[1].all_sections) == (["BNS:101"], ["IPC:299"], ["BNS:101", "IPC:299", "IPC:300"])
    assert (got[2].corresponds, got[2].refers) == (["IPC:300"], []) and got[3].all_sections == ["none"]
    hops = {(r.query_id, r.node): r.hop for r in G.reach(start, edges, 3).collect()}
    assert hops[(1, "C1")] == 1 and hops[(1, "K")] == 2 and hops[(1, "X")] == 3 and (1, "IPC:300") not in hops and hops[(2, "K")] == 3
    nodes = spark.createDataFrame([("n1", "Concept", "murder trial"), ("n2", "Concept", "theft")], "id string, label string, name string")
    queries = spark.createDataFrame([(1, ["murder", "law"])], "query_id int, words array<string>")
    assert [(r.id, r.route) for r in G.anchors(queries, nodes).collect()] == [("n1", "concept")]


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 5)], "query_id int, rank int")
    r = E.metrics(ranks).first()
    assert (r.hit_1, r.hit_3, r.mrr) == (25.0, 50.0, 0.425)


def test_post_filters(spark):
    df = spark.createDataFrame([(1, "BNS", "BNS:103", "Murder"), (1, "IPC", "IPC:302", "Murder"), (2, "crpc", "CrPC:1", "x"), (2, "BNSS", "BNSS:193", "y"), (3, "IPC", "IPC:302", "Dismissal of complaint")], "q int, act string, source_id string, title string")
    assert sorted((r.q, r.source_id) for r in P.prefer_current(df, "q", F.col("act")).collect()) == [(1, "BNS:103"), (2, "BNSS:193"), (3, "IPC:302")]
    assert sorted(r.source_id for r in P.drop_procedural(df).collect()) == ["BNS:103", "CrPC:1", "IPC:302"]
    ans = spark.createDataFrame([(["IPC:302", "IPC:999"], ["IPC:302"], False), (["z"], ["IPC:302"], None), (None, [], False)], "sources array<string>, valid_ids array<string>, out_of_scope boolean")
    assert [(r.sources, r.out_of_scope) for r in P.validate_answers(ans).collect()] == [(["IPC:302"], False), ([], True), ([], True)]
    known = spark.createDataFrame([("k1", "T")], "source_id string, title string")
    cand = spark.createDataFrame([("k1", None, "j1"), ("k2", "a", "j2")], "source_id string, title string, judgment_id string")
    assert [(r.source_id, r.title) for r in P.enrich(cand, known, "source_id", ["title"]).collect()] == [("k1", "T")]
    assert sorted((r.source_id, r.judgment_id) for r in P.nullify_dangling(cand, spark.createDataFrame([("j1",)], "case_id string"), "judgment_id", "case_id").collect()) == [("k1", "j1"), ("k2", None)]


def test_provisions(spark):
    df = spark.createDataFrame([("A:1", 2, None, "more", ["y"]), ("A:1", 1, "T", "text", ["x"]), ("A:1", 3, "U", "text", ["x"])], "section_id string, at int, title string, text string, c array<string>")
    r = V.merge_sections(df, "section_id", "at", ["title"], "text", ["c"]).first()
    assert (r.title, r.text, r.c) == ("T", "text\nmore", ["x", "y"])
    items = spark.createDataFrame([([("Explanation 2", "t"), ("x", "7 text"), ("", "(a) one (b) two")],)], "i array<struct<label:string,text:string>>")
    assert items.select(V.label_numbers(F.col("i")).alias("x")).first().x == ["2", "7", "3"]
    assert items.select(V.label_numbers(F.col("i"), letters=True).alias("x")).first().x == ["2", "a", "b"]
    sec = spark.createDataFrame([("A:1", "main", [("e", "t1"), ("e", "t2")])], "section_id string, text string, explanations array<struct<label:string,text:string>>")
    assert [(u.unit_type, u.unit_number) for u in V.atomic_units(sec).collect()] == [("section", "0"), ("explanation", "1"), ("explanation", "2")]
    assert spark.range(1).select(V.cleaned(F.lit("the\npublicservant,or")).alias("x")).first().x == "the public servant, or"
    done = V.completeness(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n int"), spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), "k", ["n"])
    assert {r.k: r.status for r in done.collect()} == {"a": "complete", "b": "n_differ", "c": "missing"}


def test_quality(spark):
    df = spark.createDataFrame([(1, "", "t"), (2, "x", None)], "id int, chunk_id string, text string")
    got = Q.findings(df, ["id"], [("issue", F.col("chunk_id") == "", "no id"), ("warning", F.col("text").isNull(), F.concat(F.lit("no text in "), F.col("chunk_id")))]).collect()
    assert sorted(map(tuple, got)) == [(1, "issue", "no id"), (2, "warning", "no text in x")]


def test_vector_top_k(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [0.0, 0.0]), (8, None)], "vec_id int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, query_vec array<float>")
    for block in (4096, 1):
        got = X.top_k(queries, corpus, 2, block=block).collect()
        assert sorted((r.query_id, r.vec_id, r.vector_rank) for r in got) == [(1, 4, 2), (1, 5, 1), (2, 0, 1), (2, 1, 2)]
    r = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(X.l2_normalized(F.col("v")).alias("x")).first().x
    assert r == [0.6, 0.8]


def test_bulk_top_k_is_the_same(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(500, 8)).astype(np.float32)
    v[100:140] = v[7]  # ties
    rows = [(i, v[i].tolist(), f"t{i}") for i in range(500)] + [(900, [0.0] * 8, "z"), (901, None, "n"), (902, [1.0, None] + [0.0] * 6, "x"), (903, [1.0], "short")]
    corpus = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in (7, 3, 499)] + [("zero", [0.0] * 8)], "query_id string, query_vec array<float>")
    pick = lambda df: sorted((r.query_id, r.vec_id, r.vector_rank, r.label, round(r.score, 9)) for r in df.collect())
    full = corpus.where("vec_id < 900")
    for cells in (60, 4_000_000):
        X.CELLS = cells
        assert pick(X.top_k(queries, full, 3, bulk=True, keep=["label"])) == pick(X.top_k(queries, full, 3, keep=["label"]))
    want = pick(X.top_k(queries, full, 20, keep=["label"]))
    assert want == pick(X.top_k(queries, corpus, 20, keep=["label"], bulk=True)) and len(want) == 60
    assert X.top_k(queries, corpus.limit(0), 3, bulk=True).count() == 0 and X.top_k(queries.limit(0), corpus, 3, bulk=True).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "id int, x string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.upsert(t, s, "id")) == [(1, "a"), (2, "B"), (3, "C")] == rows(sinks.upsert(sinks.upsert(t, s, "id"), s, "id"))
    assert rows(sinks.insert_if_absent(t, s, "id")) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(sinks.delete(t, s, "id")) == [(1, "a")] and rows(sinks.delete(t, s.limit(0), "id")) == rows(t)
    ok, bad = sinks.rejected(t, (F.length("x") < 1, "blank"), (F.col("x") == "b", "b"))
    assert rows(ok) == [(1, "a")] and rows(bad) == [(2, "b", "b")]
    sinks.write_json(t, str(tmp_path / "j"))
    assert rows(readers.json_lines(spark, str(tmp_path / "j"), "id int, x string")) == rows(t)
    assert readers.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "j")) == str(tmp_path / "j")
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two")], "doc string, page int, text string")
    dump = sinks.page_dump(pages, "doc", "page", "text")
    assert dump.first().text == "--- PAGE 1 ---\none\n\n--- PAGE 2 ---\ntwo"
    assert [(r.page_number, r.text.strip()) for r in readers.text_pages(dump, "doc", "text").collect()] == [(1, "one"), (2, "two")]


def test_stream_upsert(spark, tmp_path):
    from corpusmill.streaming.ingest import upsert_stream

    spark.createDataFrame([(1, "a")], "id int, x string").write.json(str(tmp_path / "in"))
    state = {"df": spark.createDataFrame([(1, "old"), (2, "b")], "id int, x string")}

    def write(df, n):
        df.write.mode("overwrite").parquet(str(tmp_path / f"out{n}"))
        state["df"] = spark.read.parquet(str(tmp_path / f"out{n}"))

    upsert_stream(spark.readStream.schema("id int, x string").json(str(tmp_path / "in")), lambda: state["df"], write, "id", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, state["df"].collect())) == [(1, "a"), (2, "b")]


def test_fixed_values():
    assert len(rules.CHUNK_CONCEPTS) == 16 and len(rules.STATUTE_CONCEPTS) == 21 and len(rules.CASE_CONCEPTS) == 14


def test_traversal_does_not_fan_out_from_a_common_concept(spark, tmp_path):
    """The last step goes only to what is told: of the chunks that share a concept none is met on the way to sections."""
    from corpusmill.operators import graph

    nodes = spark.createDataFrame([("S:1", "StatuteSection"), ("S:2", "StatuteSection"), ("L", "LegalConcept"), *((f"K{i}", "Chunk") for i in range(50))], "id string, label string").selectExpr("id", "label", "id as name")
    edges = spark.createDataFrame([("K0", "S:1", "REFERS_TO"), ("K0", "S:2", "REFERS_TO"), *((f"K{i}", "L", "DISCUSSES") for i in range(50))], "src string, dst string, type string")
    start = spark.createDataFrame([(1, "S:1")], "query_id int, node string")
    near = graph.reach(start, edges, 3, into=nodes.where("label = 'StatuteSection'").selectExpr("id as node"))
    assert [tuple(r) for r in near.select("query_id", "node", "hop").collect()] == [(1, "S:2", 2)]
    kept = graph.stored(graph.Graph(nodes, edges), str(tmp_path / "g"))
    for g in (graph.Graph(nodes, edges), kept):
        r = graph.traverse(start, g.nodes, g.edges).first()
        assert (r.statutes, r.judgments, r.cited_cases) == (["S:2"], ["K0"], [])
    assert {f.name for f in (tmp_path / "g" / "edges").iterdir() if f.is_dir()} == {"type=REFERS_TO", "type=DISCUSSES"}


def test_triage_in_bulk(spark, monkeypatch):
    """Triage of a large table goes by matrix products, with the rows of the plain search."""
    from corpusmill.operators import vector
    from corpusmill.plans import vector_queries

    asked = []
    plain = vector.top_k
    monkeypatch.setattr(vector, "top_k", lambda *a, **k: asked.append(k.get("bulk")) or plain(*a, **k))
    got = sorted(map(tuple, vector_queries.triage(spark, "/root/testdata/sf0.001").collect()))
    assert asked == [True] and got
    monkeypatch.setattr(vector, "top_k", lambda *a, **k: plain(*a, **(k | {"bulk": False})))
    assert got == sorted(map(tuple, vector_queries.triage(spark, "/root/testdata/sf0.001").collect()))


def test_bulk_gives_pairs_in_small_batches(spark, monkeypatch):
    """What a task has found goes out in bounded batches, and a row that many queries want is held once."""
    from pyspark.sql import functions as F

    from corpusmill.operators import vector as X

    monkeypatch.setattr(X, "ROWS_OUT", 50)
    monkeypatch.setattr(X, "CELLS", 4000)
    rows = spark.range(0, 600, 1, 2).select(F.col("id").alias("vec_id"), F.array(*(F.cos((F.col("id") % 97) * (i + 1.3)).cast("float") for i in range(6))).alias("embedding"))
    asked = rows.where("vec_id < 80").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pick = lambda df: sorted((r.query_id, r.vector_rank, r.vec_id) for r in df.collect())
    assert pick(X.top_k(asked, rows, 9, bulk=True)) == pick(X.top_k(asked, rows, 9))


def test_anchors_build_the_graph_of_their_cases_alone(spark, monkeypatch, tmp_path):
    """The graph that is written for a few cases doesn't grow with the tables, and the walk in it is that in the whole graph."""
    from corpusmill.operators import graph
    from corpusmill.plans import legal_queries

    written = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda g, path: written.append(stored(g, str(tmp_path / "g"))) or written[-1])
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, legal_queries.anchor_traversal(spark, d).collect()))
    whole = graph.judgment_graph(legal_queries._chunks(spark, d))
    assert written[0].nodes.where("label = 'Case'").count() <= 6 < whole.nodes.where("label = 'Case'").count()
    start = whole.nodes.where("(label = 'Case' and id in ('C1', 'C2', 'C4', 'C25')) or id in ('O1', 'O32')").selectExpr("id as query_id", "id as node")
    want = graph.traverse(start, whole.nodes, whole.edges)
    assert got == sorted((r.query_id, ",".join(r.statutes), ",".join(r.judgments), ",".join(r.cited_cases)) for r in want.collect())
    rows, wanted = spark.range(20), spark.range(3, 6)
    few = graph.only_of(rows, "id", wanted)
    monkeypatch.setattr(graph, "FEW", 1)
    assert [r.id for r in few.orderBy("id").collect()] == [r.id for r in graph.only_of(rows, "id", wanted).orderBy("id").collect()] == [3, 4, 5]


def test_far_traversal_takes_each_step_once(spark, tmp_path, monkeypatch):
    """In numbers and in blocks of queries the sets are those of the plain traversal, and what queries share is moved once for a block."""
    from corpusmill.operators import graph

    asked = 70  # more than a word has bits
    monkeypatch.setattr(graph, "WORDS", 1)
    nodes = [(f"S{i}", "StatuteSection") for i in range(asked)] + [(f"K{i}", "Chunk") for i in range(30)] + [(f"C{i}", "Case") for i in range(5)] + [(f"X{i}", "CitedCase") for i in range(4)] + [("L", "LegalConcept")]
    edges = [(f"K{i % 30}", f"S{i}", "REFERS_TO") for i in range(asked)] + [(f"K{i}", f"S{i + 1}", "REFERS_TO") for i in range(5)] + [(f"C{i % 5}", f"K{i}", "HAS_CHUNK") for i in range(30)]
    edges += [(f"C{i % 5}", f"X{i % 3}", "CITES_CASE") for i in range(15)] + [("K3", "L", "DISCUSSES"), ("K3", "X3", "DISCUSSES_CASE")]
    g = graph.Graph(spark.createDataFrame(nodes, "id string, label string").selectExpr("id", "label", "id as name"), spark.createDataFrame(edges, "src string, dst string, type string"))
    start = spark.createDataFrame([(i, f"S{i}") for i in range(asked)] + [(100, "L"), (101, "C2"), (102, "nowhere"), (103, "K4")], "query_id int, node string")
    pick = lambda df: sorted((r.query_id, r.statutes, r.judgments, r.cited_cases) for r in df.collect())
    assert pick(graph.traverse_far(start, g, str(tmp_path / "w"))) == pick(graph.traverse(start, g.nodes, g.edges))
    assert spark.read.parquet(str(tmp_path / "w" / "edges")).dtypes[:2] == [("src", "bigint"), ("dst", "bigint")]
