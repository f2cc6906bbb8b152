"""Columns with odd and clashing names pass through every stage; empty tables give empty results."""

import public_tokenizers as P
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusmill.llm import align, byte_bpe, decontaminate, heap_bpe, html_extract, license_scan, line_dedup, ngram_join, quality_model, reshard  # noqa: E402

ODD = ["_text_", "a.b", "Text2", "kept", "gone", "cuts", "th", "d", "nth", "score", "stats", "spans", "n_words", "w0_", "s0_", "x`y", "licenses2", "fold", "label"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD)
PATH = P.path("byte_bpe_50k.tiktoken")


def row(i, text):
    return (i, text, "en", "s", 0 if text is None else len(text), *(f"v{k}" for k in range(len(ODD))))


@pytest.fixture(scope="module")
def docs(spark):
    long = "some words of a line, again and again. " * 30_000
    return spark.createDataFrame([row(1, "one two three"), row(1, "one two three"), row(2, None), row(None, ""), row(3, long)], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i", "nothing of that kind stands there at all, is it so or not")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_keep_columns(spark, docs, tables):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        assert all(tuple(r)[5:] == row(1, "")[5:] for r in out.collect())
    assert corpus_pipeline.run(spark, tables).count() == 4


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, docs, tables, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{tables}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == (0 if empty == "documents" else 4)


def test_operators(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    none = spark.createDataFrame([], "item_id string, text string")
    assert byte_bpe.bpe_encode(docs, PATH).columns == [*docs.columns, "ids"]
    both = byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs, PATH), PATH)
    assert both.where("cast(decoded as string) <=> coalesce(text, '')").count() == 5
    with pytest.raises(ValueError):
        byte_bpe.bpe_decode(both, PATH)
    assert len(license_scan.scan_licenses(docs).collect()) == 5  # long texts are scanned too
    json, model = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert heap_bpe.heap_decode(heap_bpe.heap_encode(docs, json), json).where("decoded <=> coalesce(text, '')").count() == 5
    assert align.align_tokens(docs, json, model).columns == [*docs.columns, "groups"]
    assert len(align.alignment_report(docs, json, model).where("n_links = n_groups").collect()) == 5
    assert decontaminate.drop_contaminated(docs, none).columns == docs.columns
    assert ngram_join.ngram_jaccard_join(docs).count() == 5
    assert quality_model.quality_report(docs, labels).count() == 5
    assert reshard.reshard_report(docs).count() == 5
    pages = docs.withColumnRenamed("text", "html")
    assert html_extract.extract_main_text(pages).columns == [*[c for c in pages.columns if c != "html"], "main_text"]


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (line_dedup.dedup_lines, ngram_join.keep_one_of_each_group):
        with pytest.raises(ValueError, match="integer"):
            f(df)
    assert ngram_join.ngram_jaccard_join(df).first().component_id == "a"


def test_copies_share_a_shard_unless_dealt(spark):
    df = spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)] + [(1000 + i, "hot") for i in range(3000)], "doc_id long, text string")
    rows = reshard.reshard_report(df, 4).collect()
    homes = {}
    for r in rows:
        homes.setdefault(r.text_crc32, []).append(r)
    assert all(len({r.shard for r in g}) == 1 or all(r.group_dealt for r in g) for g in homes.values())
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
