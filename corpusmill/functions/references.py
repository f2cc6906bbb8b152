"""Provision identifiers: canonical forms and extraction from text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ACT_ALIASES, ACT_CODES, ACT_PATTERNS, DEFAULT_ACTS, PROVISION_EXCEPTION, PROVISION_EXCEPTION_OF, PROVISION_LETTER, PROVISION_SUBSECTION, SECTION_EXCEPTION, SECTION_MENTION
from .text import exception_number, lookup, roman_part, squeezed


def canonical(act: Column, raw: Column, allow_comma: bool = True) -> Column:
    """Struct of the parts of a provision as written: exception before part, number, letters, plain number."""
    v = F.regexp_replace(squeezed(raw), r"(?i)Part\s+IIPC\b", "Part I IPC")
    code = F.replace(act, F.lit(" "), F.lit(""))
    part = rf"(?i)(\d+)\s*[-–—{',' if allow_comma else ''}]?\s*(?:\(\s*)?part\s*([ivx0-9]+)"
    pick = lambda p, i: F.regexp_extract(v, p, i)
    plain = F.when(v.rlike(r"^\d+"), pick(r"^(\d+)", 1)).otherwise(v)
    cases = [
        (v.rlike(PROVISION_EXCEPTION), "exception", pick(PROVISION_EXCEPTION, 1), exception_number(pick(PROVISION_EXCEPTION, 2))),
        (v.rlike(PROVISION_EXCEPTION_OF), "exception", pick(PROVISION_EXCEPTION_OF, 2), exception_number(pick(PROVISION_EXCEPTION_OF, 1))),
        (v.rlike(part), "part", pick(part, 1), roman_part(pick(part, 2))),
        (v.rlike(PROVISION_SUBSECTION), "subsection", pick(PROVISION_SUBSECTION, 1), pick(PROVISION_SUBSECTION, 2)),
        (v.rlike(PROVISION_LETTER), "letter", pick(PROVISION_LETTER, 1), F.upper(pick(PROVISION_LETTER, 2))),
    ]
    none = F.lit(None).cast("string")
    chain = lambda f, last: _case([(c, f(kind, sec, x)) for c, kind, sec, x in cases], last)
    tail = {"exception": ("(Exception ", ")"), "part": ("(Part ", ")"), "subsection": ("(", ")"), "letter": ("", "")}
    say = {"exception": (" Exception ", ""), "part": (" Part ", ""), "subsection": ("(", ")"), "letter": ("", "")}
    wrap = lambda head, sec, x, ends: F.concat(head, sec, F.lit(ends[0]), x, F.lit(ends[1]))
    own = lambda name: chain(lambda kind, sec, x: x if kind == name or (name == "subsection" and kind == "letter") else none, none)
    return F.struct(
        chain(lambda kind, sec, x: wrap(F.concat(code, F.lit(":")), sec, x, tail[kind]), F.concat(code, F.lit(":"), plain)).alias("canonical_id"),
        act.alias("act"),
        chain(lambda kind, sec, x: F.concat(sec, x) if kind == "letter" else sec, plain).alias("section"),
        own("part").alias("part"),
        own("subsection").alias("subsection"),
        own("exception").alias("exception"),
        chain(lambda kind, sec, x: wrap(F.concat(act, F.lit(" Section ")), sec, x, say[kind]), F.concat(act, F.lit(" Section "), plain)).alias("display_name"),
    )


def _case(cases: list[tuple[Column, Column]], last: Column) -> Column:
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out.otherwise(last)


def canonical_id(act: Column, raw: Column, allow_comma: bool = True) -> Column:
    return canonical(act, raw, allow_comma)["canonical_id"]


def act_code(act: Column) -> Column:
    """One code for all spellings of an act, so that ids of different sources join."""
    upper = F.upper(act)
    return F.coalesce(lookup(ACT_CODES, upper), upper)


def section_key(section_id: Column) -> Column:
    """A section id with its act's code."""
    return F.concat(act_code(F.substring_index(section_id, ":", 1)), F.lit(":"), F.substring_index(section_id, ":", -1))


def base_section(section_id: Column) -> Column:
    return F.substring_index(section_id, "(", 1)


def without_self(references: Column, own: Column) -> Column:
    """References but to the section itself or another part of it."""
    return F.filter(references, lambda r: base_section(r) != base_section(own))


def _clause_references(clause: Column, act: str) -> Column:
    sections = F.transform(F.regexp_extract_all(clause, F.lit(SECTION_MENTION)), lambda m: canonical_id(F.lit(act), m))
    numbers = F.regexp_extract_all(clause, F.lit(SECTION_EXCEPTION), F.lit(1))
    bases = F.regexp_extract_all(clause, F.lit(SECTION_EXCEPTION), F.lit(2))
    exceptions = F.zip_with(bases, numbers, lambda s, n: canonical_id(F.lit(act), F.concat(s, F.lit(" Exception "), n)))
    return F.concat(sections, exceptions)


def judgment_references(text: Column, compat: bool = False) -> Column:
    """Sorted provisions that a judgment's text names, clause by clause.

    A clause's sections go to every act that it names, and to the IPC if it
    names none; ``compat`` credits them to the IPC as well unless all acts are named.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)Part\s+IIPC\b", "Part I IPC")
    none = F.expr("cast(array() as array<string>)")

    def of(clause: Column) -> Column:
        named = {act: clause.rlike(f"(?i){p}") for act, p in ACT_PATTERNS.items()}
        own = [F.when(c, _clause_references(clause, act)).otherwise(none) for act, c in named.items()]
        every = some = None
        for c in named.values():
            every = c if every is None else every & c
            some = c if some is None else some | c
        sections = F.transform(F.regexp_extract_all(clause, F.lit(SECTION_MENTION)), lambda m: canonical_id(F.lit("IPC"), m))
        return F.concat(*own, F.when(~(every if compat else some), sections).otherwise(none))

    clauses = F.filter(F.split(t, "[\n.;]"), lambda c: c.rlike("[0-9]"))  # others name no section
    found = F.flatten(F.transform(clauses, of))
    two = t.rlike(r"(?i)\b304\b.*?\bPart\s*(?:II|2)\b")
    one = t.rlike(r"(?i)\b304\b.*?\bPart\s*(?:I|1)\b") & ~two
    parts = F.when(two, F.array(F.lit("IPC:304(Part II)"), F.lit("IPC:304"))).when(one, F.array(F.lit("IPC:304(Part I)"), F.lit("IPC:304"))).otherwise(none)
    altered = F.when(t.rlike(r"(?i)302.*?304|altered to.*?304"), F.array(F.lit("IPC:302"), F.lit("IPC:304"))).otherwise(none)
    return F.array_sort(F.array_distinct(F.concat(found, parts, altered)))


def statute_references(text: Column, act: Column, own: Column | None = None) -> Column:
    """Sorted sections that a statute's text names, as sections of the act itself, and of the IPC where it is named."""
    t = F.coalesce(text, F.lit(""))
    numbers = F.regexp_extract_all(t, F.lit(r"(?i)\b(?:sections?|s(?:ec)?\.)\s*(\d+[A-Za-z]*(?:\s*\(\s*\d+\s*\))?)"))
    refs = F.transform(numbers, lambda n: F.concat(act, F.lit(":"), F.replace(n, F.lit(" "), F.lit(""))))
    plain = F.regexp_extract_all(t, F.lit(r"(?i)\b(?:section|s(?:ec)?\.)\s*(\d+[A-Za-z]*)"))
    penal = F.when(F.lower(t).rlike("penal code|ipc"), F.transform(plain, lambda n: F.concat(F.lit("IPC:"), n))).otherwise(F.expr("cast(array() as array<string>)"))
    refs = F.array_sort(F.array_distinct(F.concat(refs, penal)))
    return refs if own is None else without_self(refs, own)


def short_references(text: Column) -> Column:
    """``ACT 123`` mentions of eight acts, act in upper case, sorted; looked for only where a part of an act's name stands."""
    p = r"(?i)(IPC|BNS|CrPC|BNSS|IEA|BSA|POCSO|CPC)[§:s.\s]*(\d+[A-Za-z]?)"
    t = F.coalesce(text, F.lit(""))
    may = reduce(or_, (F.contains(F.lower(t), F.lit(x)) for x in ("pc", "bns", "iea", "bsa", "pocso")))
    found = F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda m: F.concat(F.upper(F.regexp_extract(m, p, 1)), F.lit(":"), F.regexp_extract(m, p, 2)))
    return F.when(may, F.array_sort(F.array_distinct(found))).otherwise(F.expr("cast(array() as array<string>)"))


def numbers_before(text: Column, anchor: str, lead: str = r"(?:Sections?|S(?:ec)?\.)\s+", within: int = 100) -> Column:
    """Numbers listed after the last ``lead`` in the ``within`` characters before each ``anchor``; no years.

    The list ends at a bracket.
    """
    before = F.transform(F.split(text, f"(?i){anchor}", -1), lambda x: F.right(x, F.lit(within)))
    before = F.slice(before, F.lit(1), F.size(before) - 1)
    lists = F.transform(before, lambda x: F.when(x.rlike(f"(?i)\\b{lead}"), F.regexp_extract(x, f"(?is)^.*\\b{lead}(.*)$", 1)).otherwise(F.lit("")))
    numbers = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(F.regexp_extract(x, r"^([^\[(]*)", 1), F.lit(r"\b(\d{1,4}[A-Za-z]*)\b"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: ~n.rlike(r"^(18|19|20)\d{2}$"))))


def parsed_query(text: Column) -> Column:
    """Acts, section numbers and section ids that a query names, and the smallest id as its target."""
    upper = F.upper(text)
    acts = F.array_compact(F.array(*(F.when(upper.rlike(r"\b(" + "|".join(names) + r")\b"), act) for act, names in ACT_ALIASES.items())))
    codes = "|".join(ACT_ALIASES)
    named = rf"\b(?:({codes})\s*[:\-\s]?\s*)?(?:SECTION|SEC\.?|S\.)\s*([0-9]+[A-Z]?)\b"
    direct = rf"\b({codes})\s*[:\-\s]?\s*([0-9]+[A-Z]?)\b"
    both = lambda p: F.arrays_zip(F.regexp_extract_all(upper, F.lit(p), F.lit(1)).alias("act"), F.regexp_extract_all(upper, F.lit(p), F.lit(2)).alias("n"))
    first, second = both(named), both(direct)
    given = F.filter(F.transform(F.concat(first, second), lambda x: x["act"]), lambda a: a != "")
    acts = F.array_sort(F.array_distinct(F.concat(acts, given)))

    def ids(x: Column) -> Column:
        alone = F.when(lookup(DEFAULT_ACTS, x["n"]).isNotNull(), F.array(lookup(DEFAULT_ACTS, x["n"]))).otherwise(acts)
        return F.transform(F.when(x["act"] != "", F.array(x["act"])).otherwise(alone), lambda a: F.concat(a, F.lit(":"), x["n"]))

    sections = F.array_sort(F.array_distinct(F.flatten(F.concat(F.transform(first, ids), F.transform(second, ids)))))
    numbers = F.array_sort(F.array_distinct(F.transform(F.concat(first, second), lambda x: x["n"])))
    return F.struct(sections.alias("sections"), acts.alias("acts"), numbers.alias("numbers"), F.array_min(sections).alias("primary"))
