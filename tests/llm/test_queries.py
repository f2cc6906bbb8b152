"""The registered queries on the smallest tables, against their SQL where there is some."""

import duckdb
import pytest

from corpusmill.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def cell(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    df = queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in oracle_sql():
        db = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
        res = db.execute(oracle_sql()[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_contract_columns(spark):
    want = {
        "op1": "doc_id n_shingles component_id",
        "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op5": "page_id url text n_chars",
        "op6": "doc_id held_out score predicted",
        "op7": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op8": "doc_id size text_crc32 law shard slot grown_shard",
        "op9": "vec_id n_links component_id kept",
        "op10": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    kinds = {"doc_id": "bigint", "page_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_tokens": "bigint", "n_chars": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "vec_id": "bigint", "n_links": "bigint", "kept": "boolean", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "contaminated": "boolean"} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint")
    for name, f in queries().items():
        if (op := name.split("_")[0]) in want:
            types = dict(f(spark, FOLDER).dtypes)
            for c in want[op].split():
                assert types[c] == kinds.get(c, "string"), (name, c, types[c])
