"""License scan of whole texts by MinHash bands and exact containment (DataFrame functions only).

Texts and templates become sequences of hashes of five-word shingles. Windows of
a few widths slide over them; of every window, each band is the smallest of its
shingles under one of ``BANDS`` hash functions (one row a band, so windows of
similarity ``s`` collide with probability ``1 - (1 - s) ** BANDS``: 0.9999 at 0.8).
A template that shares a band with a text is verified: it matches when at least
``least`` of its shingles stand in the text.

Windows slide by one shingle over both, so as many shingles in a row as a window
has always collide. A statement with words changed, added or left out, of which
0.8 still stand, has such a row: templates of fewer than 12 shingles take windows
of 4, so that one without its first or last words has one too. Only a statement
whose parts are repeated in pieces rests on the probability. A text of fewer
shingles than a window is one window. All of it is one expression per row: nothing is shuffled. Texts without
any shingle of a template, which no band could retrieve, skip the windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 6
#: Widths of windows in shingles, with the step at which they slide over texts; and
#: the shingles of a template from which on it takes a width.
WIDTHS = {1: 1, 4: 1, 8: 1}
FROM = {1: 1, 4: 4, 8: 12}

# Public license statements and grants.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0 International."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Distinct hashes of a text's shingles in order; a text of fewer than five words has none.
_WORDS = r"filter(split(lower({text}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), w -> w <> '')"
_SHINGLES = "transform(array({words}), w -> if(size(w) < 5, cast(array() as array<bigint>), transform(sequence(1, size(w) - 4), i -> xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2), element_at(w, i + 3), element_at(w, i + 4)))))[0]"


def shingles(text: str) -> str:
    """SQL for the shingle hashes of a text column, in order."""
    return _SHINGLES.format(words=_WORDS.format(text=text))


def bands(sh: str, width: int, step: int) -> str:
    """SQL for the band keys of all windows of ``width`` over the shingles ``sh``."""
    starts = f"if(size({sh}) < {width}, if(size({sh}) = 0, cast(array() as array<int>), array(1)), array_distinct(concat(sequence(1, size({sh}) - {width} + 1, {step}), array(size({sh}) - {width} + 1))))"
    band = f"transform(sequence(1, {BANDS}), b -> xxhash64({width}, b, array_min(transform(slice({sh}, i, {width}), x -> xxhash64(b, x)))))"
    return f"flatten(transform({starts}, i -> {band}))"


def compile_templates(spark: SparkSession, templates: dict[str, list[str]]) -> list[dict]:
    """Shingles and band keys of each template statement; a few hundred numbers each."""
    rows = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
    df = spark.createDataFrame(rows, "license string, text string").withColumn("sh", F.expr(shingles("text")))
    df = df.withColumn("width", F.expr("case " + " ".join(f"when size(sh) >= {FROM[w]} then {w}" for w in sorted(WIDTHS, reverse=True)) + " else 1 end"))
    keys = F.expr("case width " + " ".join(f"when {w} then {bands('sh', w, 1)}" for w in WIDTHS) + " end")
    out = []
    for r in df.select("license", F.array_distinct("sh").alias("sh"), "width", F.array_distinct(keys).alias("keys")).collect():
        if not r.sh:
            raise ValueError(f"a template of {r.license} has fewer than five words")
        out.append(r.asDict())
    return out


def _longs(values: list[int]) -> F.Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with an array of the licenses whose statements occur, sorted by name.

    A statement occurs when at least ``least`` of its distinct five-word shingles
    stand in the text; words are runs of letters, digits and characters beyond
    ASCII, in lower case. Null, empty and short texts have none. Rows are taken
    one by one, repeated rows too; the column ``into`` must be new. An empty
    table gives an empty result.
    """
    if into in docs.columns:
        raise ValueError(f"there is a column {into}")
    found = compile_templates(docs.sparkSession, templates or TEMPLATES)
    any_shingle = ", ".join(f"{v}L" for v in sorted({v for t in found for v in t["sh"]}))
    widths = {w: s for w, s in WIDTHS.items() if any(t["width"] == w for t in found)}
    keys = "concat(" + ", ".join(bands("sh", w, s) for w, s in widths.items()) + ")"
    literal = ", ".join(f"named_struct('name', '{t['license']}', 'sh', array({', '.join(f'{v}L' for v in t['sh'])}), 'keys', array({', '.join(f'{v}L' for v in t['keys'])}), 'need', {-int(-len(t['sh']) * least // 1)})" for t in found)
    hits = f"filter(array({literal}), t -> arrays_overlap(t.keys, keys) and size(array_intersect(t.sh, sh)) >= t.need)"
    match = f"transform(array({keys}), keys -> array_sort(array_distinct(transform({hits}, t -> t.name))))[0]"
    none = "cast(array() as array<string>)"
    expr = f"transform(array({shingles(f'`{text}`')}), sh -> if(exists(sh, x -> x in ({any_shingle})), {match}, {none}))[0]"
    return docs.withColumn(into, F.expr(f"if(`{text}` is null, {none}, {expr})"))


def license_report(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_licenses, licenses`` (names joined by commas).

    Null, empty and short texts have none; repeated rows get equal rows, a null
    ``doc_id`` passes, texts are taken whole, further columns are ignored. An
    empty table gives an empty result.
    """
    out = scan_licenses(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _sql_templates() -> str:
    quote = lambda s: s.replace("'", "''")
    return ", ".join(f"({i}, '{name}', '{quote(text)}')" for i, (name, text) in enumerate((n, t) for n, ts in sorted(TEMPLATES.items()) for t in ts))


REPORT_SQL = f"""
WITH t(id, license, text) AS (VALUES {_sql_templates()}),
tw AS (SELECT id, license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS w FROM t),
ts AS (SELECT DISTINCT id, license, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT id, license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
need AS (SELECT id, license, count(*) AS n FROM ts GROUP BY id, license),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hit AS (SELECT doc_id, need.license FROM (SELECT ds.doc_id, ts.id, count(*) AS k FROM ds JOIN ts USING (s) GROUP BY ALL) h JOIN need USING (id) WHERE k >= 0.8 * n),
names AS (SELECT doc_id, count(DISTINCT license) AS n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN names USING (doc_id)
"""
