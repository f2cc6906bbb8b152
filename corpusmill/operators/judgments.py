"""Judgments: pages to sections and paragraphs, paragraphs to chunks, all as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import judgment_references
from ..functions.rules import ACT_PATTERNS, CASE_CONCEPTS, CHUNK_CONCEPTS, JUDGMENT_REWRITES, OFFENCES
from ..functions.text import estimated_tokens, judge_names, numbered_id, occurring, rewritten, slug, spacing, squeezed, tagged, title_case_versus
from . import chunking, structure
from .collection import totals, united


def clean_lines(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_number, at, line)`` without noise and lines repeated on many pages."""
    each = pages.select("doc_id", "page_number", F.posexplode(F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r", "\n"), "\n"), squeezed)).alias("at", "line"))
    repeated = structure.repeated_edge_lines(each, "doc_id", "page_number", "at", "line").select("doc_id", "line")
    kept = each.join(repeated, ["doc_id", "line"], "left_anti")
    return kept.where((F.col("line") != "") & ~structure.noisy(F.col("line"), F.col("page_number"), F.col("at"))).select("doc_id", "page_number", "at", "line")


def sections(lines: DataFrame) -> DataFrame:
    """``(doc_id, section, text)`` of each section that has lines."""
    s = structure.section_buckets(lines, "doc_id", ["page_number", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "at", "line"))), lambda x: x["line"]), "\n")
    return s.groupBy("doc_id", "section").agg(text.alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_number, page_start, page_end, text)`` of the judgment's numbered paragraphs, cut-off ones mended."""
    j = structure.section_buckets(lines, "doc_id", ["page_number", "at"]).where("section = 'judgment'")
    item = F.struct("page_number", "at", "line")
    arr = j.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["page_number"].alias("page"), x["line"].alias("text"))).alias("lines"))
    found = arr.select("doc_id", chunking.sequential_paragraphs("lines").alias("p"))
    return found.select("doc_id", F.inline(mended(F.col("p"))))


def mended(paras: Column) -> Column:
    """Paragraphs of which the next begins with the rest of a cut-off witness number joined with it, in pairs."""
    open_, close = r"(?i)\(\s*PW\s*[-–—]?$", r"^\s*\d*\s*\)"
    begin = F.struct(F.lit(False).alias("joined"), F.expr("cast(array() as array<struct<paragraph_number:int,page_start:int,page_end:int,text:string>>)").alias("done"))

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a["done"], F.lit(-1))
        join = (F.size(a["done"]) > 0) & ~a["joined"] & F.coalesce(last["text"].rlike(open_), F.lit(False)) & x["text"].rlike(close)
        merged = F.struct(last["paragraph_number"].alias("paragraph_number"), last["page_start"].alias("page_start"), x["page_end"].alias("page_end"), F.concat(last["text"], F.regexp_replace(x["text"], r"^\s*\d*\s*\)\s*", ") ")).alias("text"))
        done = F.when(join, F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(a["done"], F.array(x)))
        return F.struct(join.alias("joined"), done.alias("done"))

    return F.aggregate(paras, begin, step, lambda a: a["done"])


def citations_in(text: Column, citations: Column) -> Column:
    """Citations whose title (before a bracket, longer than 5) occurs in the text, sorted."""
    title = lambda c: F.lower(F.trim(F.regexp_extract(c, r"^([^\[(]*)", 1)))
    none = F.expr("cast(array() as array<string>)")
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(citations, none), lambda c: (F.length(title(c)) > 5) & F.contains(F.lower(text), title(c)))))


def cited_cases(text: Column) -> Column:
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.regexp_replace(squeezed(x), "^[ .]+|[ .]+$", ""))
    return F.filter(items, lambda x: x != "")


def normalised(text: Column) -> Column:
    return rewritten(text, JUDGMENT_REWRITES)


def metadata(cases: DataFrame, text: str = "text") -> DataFrame:
    """Appeal number, High Court, judges and title of each case, out of its whole text and raw fields."""
    number = F.regexp_extract(text, r"(?i)((?:Criminal|Civil) Appeal No(?:s)?\.?\s*[^\n]+?of\s+\d{4})", 1)
    court = F.regexp_extract(text, r"High Court of ([A-Z][A-Za-z&]+(?: (?:and |& )?[A-Z][A-Za-z]+)*)", 1)
    return cases.withColumns({"appeal_number": F.nullif(squeezed(number), F.lit("")), "high_court": F.nullif(F.trim(court), F.lit("")), "judges": judge_names(F.col("judge")), "title": title_case_versus(F.col("title"))})


def enriched(paras: DataFrame, compat: bool = False) -> DataFrame:
    t = spacing(F.col("text"))
    return paras.withColumn("text", t).withColumns({"t": estimated_tokens(F.col("text")), "refs": judgment_references(F.col("text"), compat), "concepts": tagged(F.col("text"), CHUNK_CONCEPTS)})


def judgment_chunks(paras: DataFrame, citations: DataFrame | None = None, **sizes: int) -> DataFrame:
    """Chunks of the judgments' paragraphs, in order; oversized paragraphs by whole sentences.

    ``citations(doc_id, citations)`` are the cases that may be cited.
    """
    p = enriched(paras)
    item = F.struct("paragraph_number", "page_start", "page_end", "text", "t", "refs", "concepts")
    doc = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("paras"))
    cap = sizes.get("cap", 1000)
    doc = doc.withColumn("pack", F.explode(F.transform(chunking.greedy_packs(links=("refs", "concepts"), **sizes), lambda x, i: F.struct(i.alias("nth"), x.alias("at")))))
    doc = doc.withColumn("own", F.transform("pack.at", lambda i: F.get(F.col("paras"), i))).select("doc_id", "pack.nth", "own")
    first = F.col("own")[0]
    big = (F.size("own") == 1) & (first["t"] > cap)
    whole = F.array(F.array_join(F.transform("own", lambda x: x["text"]), "\n\n"))
    parts = doc.select("doc_id", "nth", "own", big.alias("big"), F.posexplode(F.when(big, chunking.sentence_packs(first["text"])).otherwise(whole)).alias("sub", "text"))
    numbers = F.array_distinct(F.filter(F.transform("own", lambda x: x["paragraph_number"]), lambda n: n > 0))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "sub"))
    united = lambda name: F.array_sort(F.array_distinct(F.flatten(F.transform("own", lambda x: x[name]))))
    out = parts.select(
        numbered_id(slug(F.col("doc_id")), "JUDGMENT", seq).alias("chunk_id"),
        F.col("doc_id").alias("case_id"),
        F.lit("judgment").alias("document_type"),
        F.lit("judgment").alias("chunk_type"),
        "text",
        F.struct(
            F.lit("judgment.paragraphs").alias("field"),
            numbers.alias("paragraphs"),
            F.when(F.col("big"), first["paragraph_number"]).alias("parent_paragraph"),
            F.when(F.col("big"), chunking.sub_part(first["paragraph_number"], F.col("sub"))).alias("sub_part"),
            F.array_min(F.transform("own", lambda x: x["page_start"])).alias("page_start"),
            F.array_max(F.transform("own", lambda x: x["page_end"])).alias("page_end"),
        ).alias("source"),
        F.when(F.col("big"), judgment_references(F.col("text"))).otherwise(united("refs")).alias("legal_references"),
        F.when(F.col("big"), tagged(F.col("text"), CHUNK_CONCEPTS)).otherwise(united("concepts")).alias("legal_concepts"),
        estimated_tokens(F.col("text")).alias("token_count"),
    )
    if citations is not None:
        out = out.join(citations.select(F.col("doc_id").alias("case_id"), "citations"), "case_id", "left").withColumn("cited_cases", citations_in(F.col("text"), F.col("citations"))).drop("citations")
    return out


def section_chunks(found: DataFrame) -> DataFrame:
    """Issue, headnote and topic chunks out of ``(doc_id, section, text)``.

    A topic that repeats a headnote, or is contained in one, is left out.
    """
    none = F.expr("cast(array() as array<int>)")
    issue = found.where("section = 'issue_for_consideration'").select("doc_id", F.lit("ISSUE").alias("kind"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("topic_heading"), spacing(F.col("text")).alias("text"), none.alias("related_paragraphs"))
    heads = found.where("section = 'headnotes'").select("doc_id", "text", structure.propositions(F.col("text")).alias("p"))
    notes = heads.select("doc_id", F.lit("HEADNOTE").alias("kind"), F.posexplode("p").alias("n", "x")).select("doc_id", "kind", "n", F.col("x.heading").alias("topic_heading"), "x.text", "x.related_paragraphs")
    known = F.transform("p", lambda x: x["text"])
    new = lambda t: ~F.exists(known, lambda h: F.contains(h, t) | F.contains(t, F.substring(h, 1, 100)))
    topics = heads.select("doc_id", F.lit("LEGAL_TOPIC").alias("kind"), F.posexplode(F.filter(structure.topics(F.col("text")), new)).alias("n", "text")).select("doc_id", "kind", "n", F.col("text").alias("topic_heading"), "text", none.alias("related_paragraphs"))
    all_ = issue.unionByName(notes).unionByName(topics)
    seq = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("n"))
    padded = F.concat(slug(F.col("doc_id")), F.lit("_"), F.col("kind"), F.lit("_"), F.format_string("%03d", seq))
    return all_.select(padded.alias("chunk_id"), F.col("doc_id").alias("case_id"), F.lit("judgment").alias("document_type"), F.lower("kind").alias("chunk_type"), "topic_heading", "text", "related_paragraphs", judgment_references(F.col("text")).alias("legal_references"), tagged(F.col("text"), CHUNK_CONCEPTS).alias("legal_concepts"), estimated_tokens(F.col("text")).alias("token_count"))


def all_chunks(found: DataFrame, paras: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """Issue, headnote, topic and judgment chunks of all cases in one table."""
    return united(section_chunks(found), judgment_chunks(paras, citations))


def case_text(found: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text)``: the sections of each case in the order of ``at``, then its judgment, joined by line feeds.

    A section's text is its ``text``, or its items' headings and texts.
    """
    items = F.flatten(F.transform(F.coalesce("items", F.expr("cast(array() as array<struct<heading:string,text:string>>)")), lambda x: F.array(F.concat(F.coalesce(x["heading"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit(""))))))
    rows = found.select("doc_id", F.lit(0).alias("last"), "at", F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(F.col("text")).alias("text"))
    if judgments is not None:
        rows = rows.unionByName(judgments.select("doc_id", F.lit(1).alias("last"), F.lit(0).cast(found.schema["at"].dataType).alias("at"), F.coalesce("text", F.lit("")).alias("text")))
    parts = F.array_sort(F.collect_list(F.struct("last", "at", "text")))
    return rows.where("text is not null").groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def qa_totals(found: DataFrame, by: str = "section") -> DataFrame:
    """Per section how many there are, their characters, and the tables that they mark."""
    return totals(found, by, {"chars": F.length("text"), "n_tables": F.regexp_count("text", F.lit(r"\[TABLE\]"))})


def case_analysis(cases: DataFrame, text: str = "text") -> DataFrame:
    """Per case the acts it names, its provisions, concepts and offences."""
    acts = occurring(F.col(text), [(p, F.lit(a)) for a, p in ACT_PATTERNS.items()])
    return cases.withColumns({"acts": acts, "provisions": judgment_references(F.col(text)), "concepts": tagged(F.col(text), CASE_CONCEPTS), "offences": tagged(F.col(text), OFFENCES)})


def extraction_report(found: DataFrame, mandatory: list[str]) -> DataFrame:
    """Per document the mandatory sections that are missing; it passes if none is and it has a judgment."""
    s = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.trim("text") != "", F.col("section")))).alias("sections_found"), F.sum(F.length("text")).alias("chars"))
    missing = F.array_except(F.array(*map(F.lit, mandatory)), F.col("sections_found"))
    return s.withColumn("missing", missing).withColumn("passed", (F.size("missing") == 0) & F.array_contains("sections_found", "judgment"))
