import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import collection, containment, evaluate, graph, ingest, judgments, postprocess, search, statutes, structure
from corpusmill.sources import readers, sinks

NODES, EDGES = "id string, label string, name string", "src string, dst string, type string"


def test_numbers_from_1000_on(spark):
    ids = spark.range(998, 1002).select(text.numbered_id(F.lit("X"), "JUDGMENT", F.col("id")).alias("c"))
    assert [r.c for r in ids.orderBy("c").collect()] == ["X_JUDGMENT_1000", "X_JUDGMENT_1001", "X_JUDGMENT_998", "X_JUDGMENT_999"]


def test_upserts(spark):
    held = spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], "k string, text string, at int")
    new = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("c", " ", 1), ("", "no id", 1), ("", "nor this", 1), (None, "none", 1), ("d", "new", 1)], held.schema)
    got = sinks.upsert(held, new, "k", order="at", text="text").collect()
    by_key = {r.k: r.text for r in got}
    assert len(got) == 6 and by_key["a"] == "last" and by_key["b"] == "old" and by_key["d"] == "new" and "c" not in by_key
    assert {r.text for r in got if len(r.k) == 36} == {"no id", "nor this", "none"}
    assert sorted(r.text for r in sinks.merged(held, new.where("k in ('a', 'd')"), "k", overwrite=False, order="at").collect()) == ["new", "old", "old"]
    assert sinks.inserted(new, "k", "text") == 5


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [2.0]), (3, None, None)], "k int, act string, v array<double>")
    assert [r.k for r in collection.scroll(df, {"act": {"$in": ["x", "y"]}, "k": None}, 5, "k").collect()] == [1, 2]
    assert collection.scroll(df, {"none": 1}).count() == 0 and collection.scroll(df, {"act": "y"}).first().k == 2
    path = str(tmp_path / "c")
    assert collection.create_if_absent(spark, path, "k int") and not collection.create_if_absent(spark, path, "k int")
    assert collection.rebuild(df, path).count() == 3 and collection.read(spark, path).columns == df.columns
    flat = collection.payload(df, "k", texts=("act",), lists=("v",)).orderBy("k").collect()
    assert [(r.act, r.v) for r in flat] == [("x", "1.0"), ("y", "2.0"), ("", "")]
    top = collection.by_count_and_number(spark.createDataFrame([("10a", 1), ("9", 1), ("x", 1), ("7", 3)], "s string, n int"), 3, "n", "s", "s").collect()
    assert [(r.s, r.nth) for r in sorted(top, key=lambda r: r.nth)] == [("7", 1), ("9", 2), ("10a", 3)]


def test_statutes_conflict_and_replace(spark):
    held = spark.createDataFrame([("h1", "IPC", "IPC:1", "", "old", "", 1), ("h2", "IPC", "IPC:2", "", "old", "", 1)], "chunk_id string, act_id string, section_id string, title string, text string, legal_concepts string, token_count int")
    rows = [(1, "ipc", "1", "T", "one two", None, None, None, False), (2, " ipc", "2 ", "T", "new", "IEA:9", "BNS:5", ["a", "b"], True), (3, "IPC", "3", "T", "  ", None, None, None, True), (4, "IPC", "4", "T", "first", None, None, None, None), (5, "IPC", "4", "T", "last", None, None, None, None)]
    requests = spark.createDataFrame(rows, "request_id int, act string, section string, title string, text string, predecessor string, successor string, legal_concepts array<string>, overwrite boolean")
    out = ingest.statutes(requests, held, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert {r.request_id: r.status for r in out.report.collect()} == {1: "conflict", 2: "replaced", 3: "blank", 4: "repeated", 5: "new"}
    assert sorted((r.section_id, r.text, r.legal_concepts) for r in out.collection.collect()) == [("IPC:1", "old", ""), ("IPC:2", "new", "a,b"), ("IPC:4", "last", "")]
    edges = {(r.src, r.dst, r.type) for r in out.edges.collect()}
    assert {("IEA:9", "IPC:2", "CORRESPONDS_TO"), ("IPC:2", "BNS:5", "CORRESPONDS_TO"), ("IPC", "IPC:4", "HAS_SECTION")} <= edges
    assert graph.violations(out.nodes).count() == 0


def test_judgments_replace_all_chunks(spark):
    held = spark.createDataFrame([("o1", "c", "old", "", 1), ("o2", "c", "old", "", 1), ("o3", "d", "old", "", 1)], "chunk_id string, case_id string, text string, legal_references string, token_count int")
    requests = spark.createDataFrame([(1, "c", "One two.\n\nUnder Section 302 of the IPC.", True), (2, "d", "x", False)], "request_id int, case_id string, text string, overwrite boolean")
    out = ingest.judgments(requests, held, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), cap=5)
    assert {(r.request_id, r.status, r.chunks_created) for r in out.report.collect()} == {(1, "replaced", 2), (2, "conflict", 0)}
    assert sorted((r.chunk_id, r.legal_references) for r in out.collection.collect()) == [("c_JUDGMENT_001", ""), ("c_JUDGMENT_002", "IPC:302"), ("o3", "")]
    assert ("c_JUDGMENT_002", "IPC:302", "REFERS_TO") in {tuple(r) for r in out.edges.select("src", "dst", "type").collect()}


def test_traversal_from_sections(spark):
    edges = [("K1", "S1", "REFERS_TO"), ("K1", "S2", "REFERS_TO"), ("K2", "S2", "REFERS_TO"), ("S1", "S3", "CORRESPONDS_TO"), ("C1", "K1", "HAS_CHUNK"), ("C2", "K2", "HAS_CHUNK"), ("C2", "X", "CITES_CASE"), ("K2", "L", "DISCUSSES")]
    nodes = [("S1", "StatuteSection"), ("S2", "StatuteSection"), ("S3", "StatuteSection"), ("K1", "Chunk"), ("K2", "Chunk"), ("C1", "Case"), ("C2", "Case"), ("X", "CitedCase"), ("L", "LegalConcept")]
    n = spark.createDataFrame([(i, k, i) for i, k in nodes], NODES)
    start = spark.createDataFrame([("a", "S1"), ("b", "L"), ("c", "C2"), ("d", "nothing")], "query_id string, node string")
    got = {r.query_id: (r.statutes, r.judgments, r.cited_cases) for r in graph.traverse(start, n, spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {"a": (["S2", "S3"], ["K1", "K2"], ["X"]), "b": (["S2"], ["K2"], ["X"]), "c": (["S2"], ["K2"], ["X"]), "d": ([], [], [])}


def test_titles_in_texts(spark):
    texts = spark.createDataFrame([(1, "a longer title and another title"), (2, None), (3, "ANOTHER")], "k int, t string")
    titles = spark.createDataFrame([("p", "longer title"), ("q", "another title"), ("q2", "another title"), ("r", "short"), ("s", None), ("u", "r title")], "id string, title string")
    for longer, more in ((5, []), (2, [(1, "v")])):
        got = containment.contained(texts, titles.unionByName(spark.createDataFrame([("v", "and")], titles.schema)), key="k", text="t", title_key="id", title="title", longer_than=longer)
        assert sorted((r.k, r.id) for r in got.collect()) == [(1, "p"), (1, "q"), (1, "q2"), (1, "u"), *more]
    assert containment.contained(texts, titles.limit(0), key="k", text="t", title_key="id", title="title").count() == 0


def test_exceptions_topics_pages(spark):
    item = "array<struct<label:string,text:string>>"
    one = spark.createDataFrame([([("", "and so on"), ("Exception 1", "first"), ("Exception", "goes on"), ("", " "), ("", "2. second")], "Main")], f"x {item}, m string")
    s = one.select(statutes.stitched_exceptions(F.col("x"), F.col("m")).alias("s")).first().s
    assert s["main"] == "Main and so on" and [tuple(x) for x in s["items"]] == [("Exception 1", "first goes on"), ("", "2. second")]
    t = spark.createDataFrame([("Evidence – of it\nmore\nAppeal: Costs",)], "t string").select(structure.topics(F.col("t")).alias("t")).first().t
    assert t == ["Evidence – of it more", "Appeal: Costs"]
    dump = spark.createDataFrame([("d", "--- PAGE 3 ---\nthree\n\n--- PAGE 7 ---\n")], "d string, t string")
    assert [tuple(r) for r in readers.text_pages(dump, "d", "t").collect()] == [("d", 3, "three"), ("d", 7, "")]
    found = spark.createDataFrame([("c", 1, "b", None), ("c", 0, "a", None), ("c", 2, None, [("h", "t")])], "doc_id string, at int, text string, items array<struct<heading:string,text:string>>")
    assert judgments.case_text(found).first().text == "a\nb\nh\nt"


def test_fallback_providers():
    calls = []

    def broken(pdf):
        calls.append("broken")
        raise OSError("down")

    run = postprocess.with_fallback(broken, lambda pdf: pdf + "!", tries=2, delay=0)
    assert list(run(["a", "b"])) == ["a!", "b!"] and len(calls) == 4
    with pytest.raises(OSError):
        list(postprocess.with_fallback(broken, delay=0)(["a"]))


def test_triage_results(spark):
    reports = spark.createDataFrame([("a",), ("b",)], "query_id string")
    known = spark.createDataFrame([("BNS:1", "Theft", "BNS"), ("IPC:2", "Theft", "IPC"), ("CrPC:154", "Reports", "CrPC")], "source_id string, title string, act string")
    said = spark.createDataFrame([("a", "BNS:1", "gone"), ("a", "IPC:2", "BNS:1"), ("b", "CrPC:154", None), ("b", "made up", None)], "query_id string, source_id string, related_id string").withColumns({"title": F.lit(None).cast("string"), "act": F.lit(None).cast("string")})
    got = {r.query_id: (r.offences, r.out_of_scope) for r in search.judged(reports, said, known).collect()}
    assert got == {"a": (["BNS:1"], False), "b": ([], True)}


def test_health_and_latencies(spark):
    good, bad = spark.range(1), spark.range(1).select(F.raise_error(F.lit("no")))
    assert search.health(good=good, bad=bad) == {"good": True, "bad": False}
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.5)], "mode string, seconds double")
    assert {r["mode"]: r.d_seconds for r in evaluate.latencies(runs, "a").collect()} == {"a": 0.0, "b": 0.5}
