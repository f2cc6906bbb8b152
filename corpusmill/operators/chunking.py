"""Order-dependent packing of paragraphs, as folds over one array per document.

The arrays hold one document each. The folds are exact where windows are not:
what is merged or packed depends on what was before. Packing goes through Arrow
batches of documents, in one pass over each; nothing is rebuilt at a step.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "x.page"
_NONE = "cast(array() as array<int>)"


def paragraphs(df: DataFrame, group: str, order: str, fields: dict[str, Column], into: str = "paras") -> DataFrame:
    """One row per group with its paragraphs in order, as structs."""
    item = F.struct(F.col(order).alias("_at"), *(c.alias(k) for k, c in fields.items()))
    return df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias(into))


def greedy_packs(paras: str = "paras", tokens: str = "t", cap: int = 1000, most: int = 8, target: int = 500, overlap_tokens: int = 150, overlap_sum: int = 800, links: tuple[str, ...] = ()) -> Column:
    """Places of the paragraphs of each pack, as ``array<array<int>>``.

    A pack closes before a paragraph that would exceed ``cap`` tokens or
    ``most`` paragraphs, or once it has ``target`` tokens. Its last paragraph
    begins the next pack too if it is short and shares an entry of one of the
    arrays ``links`` with what follows. Paragraphs above ``cap`` stand alone.
    Each paragraph is looked at once, whatever the length of the document.
    """

    @F.arrow_udf("array<array<int>>")
    def packed(sizes: pa.Array, *shared: pa.Array) -> pa.Array:
        out = []
        for row, said in enumerate(sizes.to_pylist()):
            entries = [[{*(x or ())} for x in column[row].as_py() or ()] for column in shared]
            packs: list[list[int]] = []
            held, tok, t = [], 0, [x or 0 for x in said or ()]
            for i, size in enumerate(t):
                if size > cap:
                    packs += [held, [i]] if held else [[i]]
                    held, tok = [], 0
                elif held and (tok + size > cap or len(held) >= most or tok >= target):
                    packs.append(held)
                    last = held[-1]
                    carry = t[last] <= overlap_tokens and t[last] + size <= overlap_sum and any(e[last] & e[i] for e in entries)
                    held, tok = ([last, i], t[last] + size) if carry else ([i], size)
                else:
                    held.append(i)
                    tok += size
            out.append(packs + [held] if held else packs)
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return packed(F.col(paras)[tokens], *(F.col(paras)[x] for x in links))


def simple_packs(paras: str = "paras", tokens: str = "t", cap: int = 600) -> Column:
    """Places of paragraphs packed up to ``cap`` words; one that is longer stands alone."""

    @F.arrow_udf("array<array<int>>")
    def packed(sizes: pa.Array) -> pa.Array:
        out = []
        for said in sizes.to_pylist():
            packs: list[list[int]] = []
            held = 0
            for i, size in enumerate(said or ()):
                if not packs or held + (size or 0) > cap:
                    packs.append([])
                    held = 0
                packs[-1].append(i)
                held += size or 0
            out.append(packs)
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return packed(F.col(paras)[tokens])


def packs_of_lines(tokens: Column, lines: Column, cap: int, joint: str = "\n") -> Column:
    """Texts of lines packed in order up to ``cap`` tokens, as ``array<string>``; one that is longer stands alone.

    The same packs as :func:`simple_packs`, in time linear in the lines: Arrow
    batches of whole documents go through a running sum each. Null arrays have no packs.
    """
    @F.arrow_udf("array<string>")
    def packed(tokens: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for sizes, texts in zip(tokens.to_pylist(), lines.to_pylist(), strict=True):
            packs: list[list[str]] = []
            held = 0
            for size, text in zip(sizes or (), texts or (), strict=True):
                if not packs or held + size > cap:
                    packs.append([])
                    held = 0
                packs[-1].append(text)
                held += size
            out.append([joint.join(p) for p in packs])
        return pa.array(out, pa.list_(pa.string()))

    return packed(tokens, lines)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=\.)\s+")


def sentence_packs(text: Column, cap: int = 800, factor: float = 1.33) -> Column:
    """Parts of an oversized paragraph: whole sentences up to ``cap`` tokens."""
    from ..functions.text import estimated_tokens

    parts = sentences(text)
    return packs_of_lines(F.transform(parts, lambda x: estimated_tokens(x, factor)), parts, cap, " ")


def sub_part(number: Column, i: Column) -> Column:
    """``7-A``, ``7-B``, ... for parts 0, 1, ... of paragraph 7."""
    return F.concat(number.cast("string"), F.lit("-"), F.char(i + 65))


def mended(texts: str, open_: str, close: str, join: str = "concat(a.last, x)") -> Column:
    """Texts where one that ends like ``open_`` and a next that begins like ``close`` are one.

    A merged pair consumes both, so it doesn't merge again. ``join`` is SQL over
    ``a.last`` and ``x``.
    """
    state = lambda d, last, some, fresh: f"named_struct('done', {d}, 'last', {last}, 'some', {some}, 'fresh', {fresh})"
    both = f"a.some and a.fresh and a.last rlike '{open_}' and x rlike '{close}'"
    step = f"if({both}, {state('a.done', join, 'true', 'false')}, {state('if(a.some, concat(a.done, array(a.last)), a.done)', 'x', 'true', 'true')})"
    begin = state("cast(array() as array<string>)", "''", "false", "false")
    return F.expr(f"aggregate({texts}, {begin}, (a, x) -> {step}, a -> if(a.some, concat(a.done, array(a.last)), a.done))")


#: A witness number cut off by a page break, its rest, and how they are put together.
WITNESS = (r"(?i)\\(\\s*PW\\s*[-–—]?$", r"^\\s*\\d*\\s*\\)", r"concat(a.last, regexp_replace(x, '^\\s*\\d*\\s*\\)\\s*', ') '))")


def stitched(texts: str, continues: str) -> Column:
    """Fragments for which ``continues`` (SQL over the merged text ``p`` and the fragment ``x``) holds joined to what is before."""
    cond = continues.replace("{p}", "element_at(a, -1)")
    step = f"if(size(a) > 0 and ({cond}), concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), if(element_at(a, -1) like '%-', '', ' '), x))), concat(a, array(x)))"
    return F.expr(f"aggregate(filter({texts}, x -> trim(x) <> ''), cast(array() as array<string>), (a, x) -> {step})")


#: A subsection's fragment continues it after an open reference, or where it begins in lower case or with a closing mark.
SUBSECTION = r"{p} rlike '(sub-section|section|clause)$' or x rlike '^[,.;)\\]a-z]'"


def sequential_paragraphs(lines: str = "lines") -> Column:
    """Numbered paragraphs out of lines ``struct<page, text>``.

    A line opens paragraph ``n`` if it begins with the number that comes next
    (up to 3 at the start); other lines go on with the current one. What a line
    begins with is told by expressions, so that one pass joins the lines.
    """
    number, rest = r"^(\d{1,4})\s*[.\t]?\s*", r"^\d{1,4}\s*[.\t]?\s*(.*)$"
    told = F.transform(
        F.filter(lines, lambda x: F.trim(x["text"]) != ""),
        lambda x: F.struct(x["page"].cast("int").alias("page"), F.trim(x["text"]).alias("text"), F.regexp_extract(F.trim(x["text"]), number, 1).try_cast("int").alias("n"), F.trim(F.regexp_extract(F.trim(x["text"]), rest, 1)).alias("rest")),
    )
    kind = pa.list_(pa.struct([("paragraph_number", pa.int32()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("text", pa.string())]))

    @F.arrow_udf("array<struct<paragraph_number:int,page_start:int,page_end:int,text:string>>")
    def joined(told: pa.Array) -> pa.Array:
        out = []
        for found in told.to_pylist():
            paras, due = [], 1
            for x in found or ():
                if x["n"] is not None and (x["n"] == due or due == 1 and x["n"] <= 3):
                    paras.append((x["n"], x["page"], [x["page"]], [x["rest"]]))
                    due = x["n"] + 1
                elif paras:
                    paras[-1][2][0] = x["page"]
                    paras[-1][3].append(x["text"])
                else:
                    paras.append((1, x["page"], [x["page"]], [x["text"]]))
            out.append([{"paragraph_number": n, "page_start": first, "page_end": last[0], "text": " ".join(texts).strip(" ")} for n, first, last, texts in paras])
        return pa.array(out, kind)

    return joined(told)


def roll_up(chunks: DataFrame, keys: list[str], order: str, text: str, arrays: tuple[str, ...] = (), page_start: str | None = None, page_end: str | None = None, number: str | None = None) -> DataFrame:
    """Chunks out of their paragraphs: texts joined, page range, distinct numbers and united arrays."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    out = [F.array_join(F.transform(ordered, lambda x: x[text]), "\n\n").alias("text")]
    if page_start:
        out.append(F.min(page_start).alias("page_start"))
    if page_end:
        out.append(F.max(page_end).alias("page_end"))
    if number:
        out.append(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(number) > 0, F.struct(order, number)))), lambda x: x[number])).alias("paragraphs"))
    out += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias(a) for a in arrays]
    return chunks.groupBy(*keys).agg(*out)
