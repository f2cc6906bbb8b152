import random

import pytest

from corpusmill.llm.license_scan import TEMPLATES, license_report, scan_licenses

GPL = TEMPLATES["GPL-3.0"][0]


def names(spark, texts):
    rows = license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)]


def test_a_statement_without_its_first_or_last_word(spark):
    w = GPL.split()
    assert names(spark, [" ".join(w[:-1]), " ".join(w[1:])]) == ["GPL-3.0"] * 2
    rng = random.Random(1)
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    assert names(spark, [f"{filler(i % 13)} {' '.join(w[:-1])} {filler(i % 7 + 1)}" for i in range(300)]) == ["GPL-3.0"] * 300


@pytest.mark.parametrize("license", sorted(TEMPLATES))
def test_rows_of_shingles_always_collide(spark, license):
    texts = []
    for t in TEMPLATES[license]:
        w = t.split()
        n, lost = len(w) - 4, (len(w) - 4) // 5
        texts += [" ".join(["before it"] + w[a : len(w) - lost + a] + ["and", "after"]) for a in range(lost + 1)]
        texts += [" ".join(w[:i] + ["added"] + w[i:]) for i in range(len(w) + 1) if n >= 20]
    assert all(license in x.split(",") for x in names(spark, texts))


def test_a_text_shorter_than_a_window(spark):
    words = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(words[:11]))], "doc_id long, text string")
    assert scan_licenses(df, {"X": [" ".join(words)]}, least=0.4).first().licenses == ["X"]
