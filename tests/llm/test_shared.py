import random
import re

import numpy as np
import pytest

from corpusmill.llm import shared, words
from corpusmill.llm.components import components


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "odd"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(100)],
        "random": [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(180)],
        "odd": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5)],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == roots(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\t", "-", "7", "日"]) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    for gaps, pattern in ((words.WHITE, r"[^\x20\x09-\x0D]+"), (words.ALNUM_GAP, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        want = [re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in t)) for t in texts]
        for piece in (1 << 20, 16):
            monkeypatch.setattr(words, "PIECE", piece)
            h, off = words.hash_words([t.encode() for t in texts], gaps)
            assert np.diff(off).tolist() == [len(w) for w in want]
            seen = {}
            for i, w in enumerate(want):
                for word, x in zip(w, h[off[i] : off[i + 1]].tolist(), strict=True):
                    assert seen.setdefault(word, x) == x
            assert len(set(seen.values())) == len(seen)


def test_tables_and_bitmap(spark):
    df = spark.createDataFrame([(i * 7919,) for i in range(-50, 50)] + [(None,)], "k long")
    back = shared.materialize(df)
    assert back.count() == 101 and shared.fingerprint(back) == shared.fingerprint(df)
    bits = shared.bloom(df)
    assert all(bits[i * 7919 & (shared.BLOOM_BITS - 1)] for i in range(-50, 50)) and sum(bits) == 100
    assert shared.fresh("Text", ["text", "text_"]) == "Text__"
    with pytest.raises(ValueError):
        shared.extend(spark.createDataFrame([("a",)], "text string"), lambda t: t, [("text", "string")])
