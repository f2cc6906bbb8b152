"""Statutes: act files to sections, units and chunks, with the checks of their structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.references import statute_references
from ..functions.rules import STATUTE_CONCEPTS
from ..functions.text import concept_id, estimated_tokens, tagged
from . import provisions, quality

ITEMS = ["explanations", "illustrations", "exceptions", "provisos"]


def raw_sections(acts: DataFrame) -> DataFrame:
    """One row per section fragment of files ``(act, sections)``, in their order."""
    return acts.select(F.col("act.act_id").alias("act_id"), F.posexplode("sections").alias("at", "s")).select("act_id", "at", "s.*")


def consolidated(raw: DataFrame) -> DataFrame:
    """Fragments of a section as one, split subsections stitched."""
    arrays = ["subsections", *ITEMS, "legal_concepts"]
    filled = raw.withColumns({a: F.coalesce(a, F.expr(f"cast(array() as {raw.schema[a].dataType.simpleString()})")) for a in arrays})
    out = provisions.merge_sections(filled, "section_id", "at", ["act_id", "section_number", "title", "predecessor_act", "successor_act"], "text", arrays)
    out = out.withColumn("subsections", stitched(F.col("subsections"))).withColumn("explanations", joined(F.col("explanations")))
    kept = stitched_exceptions(F.col("exceptions"), F.col("text"))
    return out.withColumn("_x", kept).withColumns({"exceptions": F.col("_x.items"), "text": F.col("_x.main")}).drop("_x")


def stitched(subs: Column) -> Column:
    """Subsections with fragments joined to what they continue, and numbers once."""
    begin = F.expr("cast(array() as array<struct<section_id:string,subsection_number:string,text:string>>)")

    def step(a: Column, x: Column) -> Column:
        last, t = F.try_element_at(a, F.lit(-1)), F.trim(x["text"])
        goes_on = (F.size(a) > 0) & (F.coalesce(last["text"].rlike("(sub-section|section|clause)$"), F.lit(False)) | t.rlike(r"^[,.;)\]a-z]"))
        text = F.when(last["text"].endswith("-"), F.concat(last["text"], t)).otherwise(F.concat(last["text"], F.lit(" "), t))
        merged = F.struct(last["section_id"].alias("section_id"), last["subsection_number"].alias("subsection_number"), text.alias("text"))
        own = F.struct(x["section_id"].alias("section_id"), x["subsection_number"].alias("subsection_number"), t.alias("text"))
        known = F.exists(a, lambda y: y["subsection_number"] == x["subsection_number"])
        head = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        return F.when(F.coalesce(t, F.lit("")) == "", a).when(goes_on, F.concat(head, F.array(merged))).when(known, a).otherwise(F.concat(a, F.array(own)))

    return F.aggregate(subs, begin, step)


def joined(items: Column) -> Column:
    """Explanations with unlabelled or lower-case fragments joined to the one before."""
    begin = F.expr("cast(array() as array<struct<label:string,text:string>>)")

    def step(a: Column, x: Column) -> Column:
        last, t, label = F.try_element_at(a, F.lit(-1)), F.trim(x["text"]), F.trim(F.coalesce(x["label"], F.lit("")))
        plain = F.lower(label).isin("explanation", "explanations") & ~t.rlike(r"^\s*\d+[.\-]")
        goes_on = (F.size(a) > 0) & (plain | t.rlike("^[a-z]"))
        merged = F.struct(last["label"].alias("label"), F.concat(last["text"], F.lit(" "), t).alias("text"))
        head = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        return F.when(F.coalesce(t, F.lit("")) == "", a).when(goes_on, F.concat(head, F.array(merged))).otherwise(F.concat(a, F.array(F.struct(label.alias("label"), t.alias("text")))))

    return F.aggregate(items, begin, step)


def stitched_exceptions(items: Column, main: Column) -> Column:
    """``struct<items, main>``: exceptions with unnumbered fragments joined to the one before; leading ones go to the main text."""
    begin = F.struct(F.expr("cast(array() as array<struct<label:string,text:string>>)").alias("items"), F.coalesce(main, F.lit("")).alias("main"))

    def step(a: Column, x: Column) -> Column:
        label, t = F.trim(F.coalesce(x["label"], F.lit(""))), F.trim(F.coalesce(x["text"], F.lit("")))
        numbered = label.rlike(r"\b\d+\b") | t.rlike(r"^\s*\d+[.\-]")
        last = F.try_element_at(a["items"], F.lit(-1))
        more = F.struct(last["label"].alias("label"), F.trim(F.concat(last["text"], F.lit(" "), t)).alias("text"))
        head = F.slice(a["items"], F.lit(1), F.greatest(F.size(a["items"]) - 1, F.lit(0)))
        none = F.size(a["items"]) == 0
        listed = F.when((t == "") | (~numbered & none), a["items"]).when(~numbered, F.concat(head, F.array(more))).otherwise(F.concat(a["items"], F.array(F.struct(label.alias("label"), t.alias("text")))))
        text = F.when((t != "") & ~numbered & none, F.trim(F.concat(a["main"], F.lit(" "), t))).otherwise(a["main"])
        return F.struct(listed.alias("items"), text.alias("main"))

    return F.aggregate(F.coalesce(items, F.expr("cast(array() as array<struct<label:string,text:string>>)")), begin, step)


def section_counts(sections: DataFrame) -> DataFrame:
    """Per act its sections, how many have each kind of part, and all units."""
    have = {f"with_{c}": F.count_if(F.size(c) > 0) for c in ("subsections", *ITEMS)}
    units = F.sum(sum((F.greatest(F.size(c), F.lit(0)) for c in ("subsections", *ITEMS)), F.lit(1)))
    return sections.groupBy("act_id").agg(F.count("*").alias("sections"), *(c.alias(name) for name, c in have.items()), units.alias("units"))


def chunks(sections: DataFrame) -> DataFrame:
    """One chunk per section: assembled and cleaned text, references but to itself, concepts declared and found."""
    numbered = F.transform("subsections", lambda s: F.when(s["text"].startswith(F.concat(F.lit("("), s["subsection_number"], F.lit(")"))), s["text"]).otherwise(F.concat(F.lit("("), s["subsection_number"], F.lit(") "), s["text"])))
    items = F.filter(F.transform("illustrations", lambda x: F.regexp_replace(F.trim(x["text"]), r"(?i)^(?:Illustrations?|llustrations?)\s*", "")), lambda x: x != "")
    shown = F.when(F.size(items) > 0, F.concat(F.array(F.lit("Illustrations:")), items)).otherwise(F.expr("cast(array() as array<string>)"))
    body = provisions.assembled(F.col("section_number"), F.col("title"), F.col("text"), numbered, provisions.labelled(F.col("explanations"), ("explanation", "explanations"), "Explanation"), provisions.labelled(F.col("exceptions"), ("exception", "exceptions"), "Exception"), provisions.labelled(F.col("provisos"), ("proviso", "provisos"), "Provided that"), shown)
    s = sections.withColumn("body", provisions.cleaned(body))
    declared = F.transform(F.filter("legal_concepts", lambda c: c != ""), concept_id)
    single = lambda c: F.array_compact(F.array(c))
    return s.select(
        F.concat_ws("_", "act_id", F.upper(F.replace("section_number", F.lit(" "), F.lit(""))), F.lit("SECTION_001")).alias("chunk_id"),
        "act_id",
        "section_id",
        F.lit("statute").alias("document_type"),
        F.lit("section").alias("chunk_type"),
        F.col("body").alias("text"),
        F.struct("section_number", (F.trim("text") != "").alias("has_main_text"), F.array_distinct(F.transform("subsections", lambda x: x["subsection_number"])).alias("subsections"), *(provisions.label_numbers(F.col(c), letters=c == "illustrations").alias(c) for c in ITEMS)).alias("source"),
        statute_references(F.col("body"), F.col("act_id"), F.col("section_id")).alias("legal_references"),
        F.array_sort(F.array_union(declared, tagged(F.col("body"), STATUTE_CONCEPTS))).alias("legal_concepts"),
        single(F.col("successor_act")).alias("successor_references"),
        single(F.col("predecessor_act")).alias("predecessor_references"),
        estimated_tokens(F.col("body")).alias("token_count"),
    )


def findings(raw: DataFrame, inventory: list[str] | None = None) -> DataFrame:
    """Issues, warnings and notes on section fragments, one row each."""
    text, subs = F.trim(F.coalesce("text", F.lit(""))), F.size(F.coalesce("subsections", F.expr("cast(array() as array<struct<section_id:string,subsection_number:string,text:string>>)")))
    rows = quality.findings(
        raw,
        ["act_id", "at", "section_id"],
        [
            ("issue", F.coalesce("section_id", F.lit("")) == "", "no section id"),
            ("issue", F.coalesce("section_number", F.lit("")) == "", "no section number"),
            ("issue", F.col("title").isNull(), "no title"),
            ("warning", (F.col("section_id") != "") & ~F.col("section_id").rlike(r"^[A-Z]+:\d+[A-Za-z]*(?:\([^)]+\))?$"), "unusual section id"),
            ("info", (text == "") & (subs > 0), "no main text, but subsections"),
            ("warning", (text == "") & (subs == 0), "no text at all"),
            ("warning", (text != "") & ~text.rlike(r'[.!?";:)]$') & (subs == 0), "text seems cut off"),
        ],
    )
    again = quality.duplicates(raw.where("section_id <> ''"), ["section_id"], "at").select("act_id", "at", "section_id", F.lit("issue").alias("severity"), F.lit("section id is there already").alias("message"))
    out = rows.unionByName(again)
    if inventory is not None:
        other = raw.select("act_id", "at", "section_id", F.explode("legal_concepts").alias("c")).where(~F.lower(F.trim("c")).isin(*inventory))
        out = out.unionByName(other.select("act_id", "at", "section_id", F.lit("info").alias("severity"), F.concat(F.lit("other concept: "), "c").alias("message")))
    return out


def summary(found: DataFrame) -> DataFrame:
    """Findings by severity and act, and whether there is no issue."""
    return found.groupBy("act_id").agg(F.count_if(F.col("severity") == "issue").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("notes")).withColumn("valid", F.col("issues") == 0)


def correspondence_edges(maps: DataFrame) -> DataFrame:
    """Edges of files ``(mapping, mappings)``; :func:`graph.with_endpoints` makes their ends."""
    return maps.select(F.explode("mappings").alias("m")).select(F.col("m.source_section").alias("src"), F.col("m.target_section").alias("dst"), F.lit("CORRESPONDS_TO").alias("type"))


