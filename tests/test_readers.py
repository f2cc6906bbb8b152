"""Readers of lines and dumps, malformed ones too."""

from corpusmill.sources import readers, sinks


def test_malformed_lines_are_told(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n  \n{"id": 2, "t"\nnot json\n{"id": "three", "t": "y"}\n')
    got = readers.json_lines(spark, str(tmp_path), "id long, t string", malformed="bad").collect()
    assert sorted((r.id, r.t, r.bad) for r in got if r.bad is None) == [(1, "x", None)]
    assert sorted(r.bad for r in got if r.bad) == ["not json", '{"id": "three", "t": "y"}', '{"id": 2, "t"']
    assert readers.json_lines(spark, str(tmp_path), "id long, t string").where("id = 1").count() == 1


def test_dumps_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("d1", 2, "second\npage"), ("d1", 1, "first"), ("d2", 7, "--- not a mark ---")], "doc string, page int, t string")
    for doc in ("d1", "d2"):
        sinks.page_dump(pages.where(f"doc = '{doc}'"), "doc", "page", "t").select("text").coalesce(1).write.option("lineSep", "\n").text(str(tmp_path / doc))
    got = readers.page_dumps(spark, str(tmp_path / "*")).collect()
    assert sorted((r.page_number, r.text) for r in got) == [(1, "first"), (2, "second\npage"), (7, "--- not a mark ---")]
    assert len({r.file_name for r in got}) == 2


def test_lines_of_text_reports(spark):
    df = spark.createDataFrame([("a", 1, None), (None, 2, "x")], "k string, n int, s string")
    assert sorted(r.value for r in sinks.text_report(df, "k").collect()) == ["-: n=2, s=x", "a: n=1, s=-"]
