import random
import re

import pytest

from corpusmill.llm.license_scan import TEMPLATES, license_report, scan_licenses

SCHEMA = "doc_id long, text string, sh string, keys string"


def shingle_set(text):
    w = [x for x in re.split("[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(text):
    sh = shingle_set(text)
    return ",".join(sorted({name for name, texts in TEMPLATES.items() for t in texts if len((s := shingle_set(t)) & sh) >= 0.8 * len(s)}))


def make(seed):
    rng = random.Random(seed)
    statements = [t for texts in TEMPLATES.values() for t in texts]
    filler = lambda n: " ".join(rng.choice(["the", "license", "under", "é", "Version", "software", "x9"]) for _ in range(n))
    rows = []
    for i in range(120):
        t = filler(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(statements).split()
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 12])):
                w[rng.randrange(len(w))] = "changed"
            t += "\n" + rng.choice([" ", "  ", "\n"]).join(w).upper() + " " + filler(rng.randrange(0, 9))
        rows.append((i, t, None, "k"))
    return rows + [(None, None, None, None), (200, "", "x", None), (7, rows[7][1], None, None), (7, rows[7][1], None, None), (201, "word " * 40000 + statements[1], None, None)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = make(seed)
    got = license_report(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((i, len(b.split(",")) if (b := brute(t)) else 0, b) for i, t, *_ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(bool(w[2]) for w in want) > 30


def test_plan_and_empty_table(spark):
    df = spark.createDataFrame(make(1), SCHEMA)
    plan = scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert license_report(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(df, into="sh")
    with pytest.raises(ValueError):
        scan_licenses(df, {"short": ["two words"]})
