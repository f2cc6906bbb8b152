"""Substring search by postings against the plain operator."""

import random

import pytest

from corpusmill.operators import graph, postings


def hits(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cé🙂") for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, "", "🙂", "same", "same"]
    phrases = [(i, "".join(rng.choice("ab cé🙂") for _ in range(rng.randrange(0, 7)))) for i in range(60)] + [(100, None), (101, ""), (102, "same"), (103, "same"), (104, texts[5]), (105, "zzz")]
    rows = [*((f"k{i}", t) for i, t in enumerate(texts)), (None, "same"), ("k0", "second row of a key")]
    return spark.createDataFrame(phrases, "q int, phrase string"), spark.createDataFrame(rows, "id string, t string"), phrases, rows


def brute(phrases, rows):
    return sorted({(q, p, k) for q, p in phrases for k, t in rows if p and t is not None and k is not None and p in t}, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_against_brute_force(tables, n):
    asked, rows, phrases, texts = tables
    assert hits(postings.containing(asked, rows, phrase="phrase", key="id", text="t", n=n)) == brute(phrases, texts)


@pytest.mark.parametrize("one_in", [2, 7, 1000])
def test_few_of_the_grams(tables, one_in):
    asked, rows, phrases, texts = tables
    assert hits(postings.containing(asked, rows, phrase="phrase", key="id", text="t", n=2, one_in=one_in)) == brute(phrases, texts)


def test_saved_postings(spark, tables, tmp_path):
    asked, rows, phrases, texts = tables
    postings.save(rows, str(tmp_path / "p"), key="id", text="t", n=3)
    saved = postings.opened(spark, str(tmp_path / "p"))
    assert saved.n == 3 and saved.table.count() == saved.table.distinct().count()
    assert hits(postings.containing(asked, rows, phrase="phrase", key="id", text="t", saved=saved)) == brute(phrases, texts)


def test_empty_sides(tables):
    asked, rows, _, _ = tables
    for a, r in ((asked.limit(0), rows), (asked, rows.limit(0))):
        assert postings.containing(a, r, phrase="phrase", key="id", text="t").count() == 0


def test_repeated_questions_stay(spark, tables):
    _, rows, _, _ = tables
    asked = spark.createDataFrame([(1, "same"), (1, "same")], "q int, phrase string")
    assert postings.containing(asked, rows, phrase="phrase", key="id", text="t").count() == 4


def test_plans_have_no_nested_loops(spark):
    nodes = spark.createDataFrame([("L:1", "LegalConcept", "Murder"), ("K1", "Chunk", "It was murder"), ("C murder", "Case", None), ("X", "CitedCase", "murder v. state")], "id string, label string, name string")
    asked = spark.createDataFrame([(1, "murder", ["murder"], [])], "query_id int, text string, words array<string>, sections array<string>")
    out = graph.anchor_routes(asked, nodes)
    assert {(r.id, r.route) for r in out.collect()} == {("L:1", "concept"), ("K1", "fulltext"), ("C murder", "case"), ("X", "case")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_anchors_by_a_saved_index(spark, tmp_path):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(f"K{i}", "Chunk", f"Text {i} of it") for i in range(30)], "id string, label string, name string")
    postings.save(nodes.select("id", F.lower("name").alias("t")), str(tmp_path / "p"), key="id", text="t")
    asked = spark.createDataFrame([(1, ["text 1", "xt 29 o"])], "query_id int, words array<string>")
    saved = postings.opened(spark, str(tmp_path / "p"))
    want = hits(graph.anchors(asked, nodes))
    assert len(want) == 12 and hits(graph.anchors(asked, nodes, saved=saved)) == want
    assert len(hits(graph.anchors(asked, nodes, saved=saved, limit=5))) == 5


def test_far_reach_meets_each_node_once(spark, tmp_path):
    ring = spark.range(40).selectExpr("concat('n', id) as src", "concat('n', (id + 1) % 40) as dst", "'NEXT' as type")
    start = spark.createDataFrame([(1, "n0"), (2, "n5"), (3, "nowhere")], "query_id int, node string")
    want = hits(graph.reach(start, ring, 4).select("query_id", "node", "hop"))
    assert hits(graph.reach_far(start, ring, 4, str(tmp_path / "a")).select("query_id", "node", "hop")) == want
    far = graph.reach_far(start, ring, 100, str(tmp_path / "b"))
    assert far.count() == 78 and far.agg({"hop": "max"}).first()[0] == 20
    assert not (tmp_path / "b" / "hop=22").exists()


def test_acceptable_requests(spark):
    from corpusmill.operators import collection

    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "short"), (4, "x" * 12_000), (5, "x" * 12_001)], "id int, t string")
    taken, refused = collection.acceptable(rows, "t", least=10)
    assert [r.id for r in taken.collect()] == [4]
    assert {r.id: r.reason for r in refused.collect()} == {1: "blank", 2: "blank", 3: "too short", 5: "too long"}


def test_phrases_go_to_the_texts(spark, tables, tmp_path, monkeypatch):
    """So many phrases need no table of all n-grams, in one pass over the texts or in several."""
    from pyspark.sql import functions as F

    from corpusmill.plans import text_queries

    asked, rows, phrases, texts = tables
    assert hits(postings.containing(asked, rows, phrase="phrase", key="id", text="t", block=7)) == brute(phrases, texts)
    monkeypatch.setattr(postings, "save", lambda *a, **k: pytest.fail("a table of all n-grams"))
    spark.createDataFrame([(i, f"Text number {i} of some") for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert text_queries.text_search(spark, str(tmp_path)).where(F.length("phrase") > 0).count() > 3


def test_far_reach_of_many_queries(spark, tmp_path):
    """More queries than a block has bits meet the same nodes as one by one, and their numbers are not those of rows."""
    from pyspark.sql import functions as F

    edges = spark.range(3000).selectExpr("concat('n', id % 700) as src", "concat('n', pmod(hash(id), 700)) as dst", "'E' as type")
    start = spark.range(700).selectExpr("id as query_id", "concat('n', id) as node")
    want = graph.reach(start, edges, 3)
    assert hits(graph.reach_far(start, edges, 3, str(tmp_path / "a")).select(*want.columns)) == hits(want)
    rows = spark.read.parquet(str(tmp_path / "a")).count()
    assert rows * 5 < want.count()
    sizes = want.groupBy("query_id", "hop").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))
    assert hits(graph.reach_sizes(start, edges, 3, str(tmp_path / "b")).select(*sizes.columns)) == hits(sizes)


def test_a_word_of_all_nodes_is_not_one_task(spark):
    """Nodes that share a word are not dealt by it: hits are told where the node's text is."""
    nodes = spark.range(0, 300, 1, 3).selectExpr("cast(id as string) as id", "'a red widget' as name")
    asked = spark.createDataFrame([(1, ["red"])], "query_id int, words array<string>")
    each = asked.selectExpr("query_id", "explode(words) as word")
    plan = postings.containing(each, nodes, phrase="word", key="id", text="name")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "SortMergeJoin [word#" in x or ("SortMergeJoin" in x and "LeftSemi" in x)]
    assert hits(graph.anchors(asked, nodes, limit=3)) == [(1, "0", "concept"), (1, "1", "concept"), (1, "10", "concept")]


def test_only_the_first_nodes_are_gathered(spark):
    """Of a word of all nodes each batch tells the first few; what is sorted doesn't grow with the hits."""
    nodes = spark.range(0, 3000, 1, 2).selectExpr("cast(id as string) as id", "'a red ring' as name")
    asked = spark.createDataFrame([(1, ["red", "ring"]), (None, ["red"]), (3, ["none"])], "query_id int, words array<string>")
    every = asked.selectExpr("query_id", "explode(words) as word").crossJoin(nodes).where("word <> 'none'").select("query_id", "id")
    few = graph._pruned(every, "query_id", 5)
    assert few.count() <= 2 * 5 * every.rdd.getNumPartitions() * 2
    want = sorted(str(i) for i in range(3000))[:5]
    assert sorted({r.id for r in few.where("query_id = 1").collect()})[:5] == want
    assert hits(graph.anchors(asked, nodes, limit=5).where("query_id = 1")) == [(1, i, "concept") for i in want]


def test_windows_of_texts_are_looked_up(spark, monkeypatch):
    """Each phrase of any length is met once in each text, long texts in pieces; n-grams of texts are not made into rows."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    phrases = sorted({t[i : i + n] for t in texts for n in (1, 2, 7, 23, 24, 25, 60, 130) for i in [rng.randrange(0, 300)]} - {""} | {texts[0][:90] + "!", "a" * 30})
    want = [[i for i, p in enumerate(phrases) if p in t] for t in texts]
    held = postings._Phrases(phrases)
    assert [x.tolist() for x in held.of(texts)] == want
    monkeypatch.setattr(postings, "PIECE", 50)
    assert [held.of_one(t).tolist() for t in texts if t] == [x for x, t in zip(want, texts, strict=True) if t]
    held.tables[7][3][:] = 0  # as if all were other texts of these hashes
    assert not any(len(phrases[i]) == 7 for x in held.of(texts) for i in x)
    rows = spark.createDataFrame(list(enumerate(texts)), "_id int, t string")
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "_hits int, _t string")
    out = postings.containing(asked, rows, phrase="_t", key="_id", text="t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Generate explode") == 1
    assert sorted((r[2], r[0]) for r in out.collect()) == [(t, i) for t, x in enumerate(want) for i in x]


def test_sizes_of_a_reach_are_counted_in_tasks(spark, tmp_path, monkeypatch):
    """What is written is the graph and the sizes, not the nodes that queries meet; a graph too large for a task is walked by joins."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "PACK", 100)
    edges = spark.range(900).selectExpr("concat('n', id % 400) as src", "if(id % 9 = 0, 'n7', concat('n', pmod(hash(id), 400))) as dst")
    edges = edges.unionByName(spark.createDataFrame([("x1", "x2"), (None, "x2"), ("x3", None), ("x4", "x4")], "src string, dst string"))
    start = spark.range(400).selectExpr("id as query_id", "concat('n', id) as node").unionByName(spark.createDataFrame([(1, "n3"), (500, "x1"), (501, "nowhere"), (502, "x4"), (None, "x2")], "query_id long, node string"))
    start = start.where("query_id is not null")
    want = graph.reach(start, edges.where("src is not null and dst is not null"), 5)
    want = hits(want.groupBy("query_id", "hop").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"), F.max("node").alias("last_node")))
    assert hits(graph.reach_sizes(start, edges, 5, str(tmp_path / "a"))) == want
    assert {f.name for f in tmp_path.iterdir()} == {f"a-{x}" for x in ("names", "asked", "pairs", "packs", "starts", "sizes")}
    assert hits(graph.reach_sizes(start, edges, 5, str(tmp_path / "b"), held=100)) == want and (tmp_path / "b").exists()


def test_the_steps_of_a_node_are_in_one_pack(monkeypatch):
    import numpy as np
    import pyarrow as pa

    batch = lambda *src: pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array([x + 1 for x in src], pa.int64())], ["src", "dst"])
    monkeypatch.setattr(graph, "PACK", 2)
    packs = list(graph._packed([batch(1, 1, 2), batch(2, 2, 3), batch(3, 3), batch(3, 4, 5), batch(), batch(6)]))
    of = lambda name, kind: [np.frombuffer(b.column(name)[0].as_buffer(), kind).tolist() for b in packs]
    assert len(packs) > 1 and sum(of("ids", np.uint32), []) == [1, 2, 3, 4, 5, 6]
    assert sum(of("counts", np.int64), []) == [2, 3, 4, 1, 1, 1]
    assert sum(of("ends", np.uint32), []) == [2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 6, 7]
