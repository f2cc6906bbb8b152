"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ARABIC, COURTS, DEFAULT_COURT, ROMAN

#: The DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table; null for other keys."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def squeezed(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def spacing(text: Column) -> Column:
    """Line wraps inside paragraphs as spaces; blank lines keep paragraphs apart, empty ones go."""
    parts = F.filter(F.split(text, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")) != "")
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)\s*\n\s*", " "), r"(?U)^\s+|\s+$", "")), "\n\n")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+")).cast("int")


def estimated_tokens(text: Column, factor: float = 1.33) -> Column:
    return F.floor(word_count(text) * F.lit(factor)).cast("int")


def concept_id(name: Column) -> Column:
    return F.concat(F.lit("LEGAL_CONCEPT:"), F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def concept_name(key: Column) -> Column:
    return F.initcap(F.replace(F.replace(key, F.lit("LEGAL_CONCEPT:"), F.lit("")), F.lit("_"), F.lit(" ")))


def roman_part(value: Column) -> Column:
    v = F.upper(value)
    return F.coalesce(lookup(ROMAN, v), v)


def exception_number(value: Column) -> Column:
    found = F.lower(F.regexp_extract(value, "(?i)([ivx]+|\\d+)", 1))
    found = F.when(found == "", "1").otherwise(found)
    return F.coalesce(lookup(ARABIC, found), found)


def court_name(value: Column) -> Column:
    return F.coalesce(lookup(COURTS, F.lower(squeezed(value))), F.lit(DEFAULT_COURT))


def slug(name: Column, keep: str = "") -> Column:
    """Letters, digits, ``_`` and ``keep``; all else as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, f"[^A-Za-z0-9_{keep}]+", "_"), "_+", "_"), "^_+|_+$", "")


def statute_chunk_id(act: Column, section: Column) -> Column:
    return F.concat_ws("_", act, F.translate(section, ". ", "__"), F.lit("SECTION_001"))


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def numbered_id(prefix: Column, kind: str, n: Column) -> Column:
    """``prefix_KIND_007``; numbers from 1000 on stand as they are."""
    return F.concat(prefix, F.lit(f"_{kind}_"), F.format_string("%03d", n.cast("long")))


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(chunk_id: Column, prefix: str = "") -> Column:
    """Id of a chunk's point; ``prefix`` sets apart the ids of a deployment."""
    return uuid5(F.concat(F.lit(prefix), chunk_id))


def split_list(value: Column, separator: str = ",") -> Column:
    """Parts of a joined list, trimmed, without empty ones; empty for null."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def title_from_text(text: Column, fallback: Column) -> Column:
    """Heading out of the first line that isn't blank: after `` - ``, up to a word that begins the body, 160 characters."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    line = F.when(F.contains(line, F.lit(" - ")), F.trim(F.regexp_replace(line, "^.*? - ", ""))).otherwise(line)
    line = F.regexp_replace(line, r"\s+(Description:|\(|If,|Whoever|When|Where|In every)\b.*$", "")
    line = F.regexp_replace(F.substring(line, 1, 160), "^[ :-]+|[ :-]+$", "")
    return F.when(line == "", fallback).otherwise(line)


def title_case_versus(title: Column) -> Column:
    t = F.replace(F.replace(F.coalesce(title, F.lit("")), F.lit("versus"), F.lit("v.")), F.lit("VERSUS"), F.lit("v."))
    return squeezed(t)


def judge_names(value: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\[|\bJJ\.?|\bJ\.?|\*|\]", ""))
    return F.filter(F.transform(F.split(cleaned, ",| and | & "), lambda x: F.trim(x)), lambda x: x != "")


def query_words(text: Column, longer_than: int = 2) -> Column:
    """Distinct words of a query in lower case, without very short ones."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)")), lambda w: F.length(w) > longer_than))


def json_object(text: Column) -> Column:
    """From the first brace to the last, without code fences; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def cleaned_lines(text: Column) -> Column:
    """Lines with unified ends and single blanks."""
    t = F.regexp_replace(text, "\r\n|\r", "\n")
    return F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))


#: What patterns are made of; other constructs are not told apart.
_TOKEN = re.compile(r"\\[bBdDsSwW]|\\[^A-Za-z0-9]|\[(?:\\.|[^\]\\\[])+\]|\(\?(?:[:=!]|<[=!])|\((?!\?)|[^\\\[(]", re.S)


def _tokens(pattern: str) -> list[str] | None:
    """The parts of a pattern, None where it has others than the known ones."""
    pattern = pattern.removeprefix("(?i)")
    parts = _TOKEN.findall(pattern)
    return parts if "".join(parts) == pattern and "{" not in re.sub(r"\{\d+(,\d*)?\}", "", pattern) else None


def literals(pattern: str) -> list[str]:
    """Strings in lower case of which every match has one, the longest of each alternative; none where that can't be told."""
    depth, braces, found = 0, False, [[""]]
    for t in _tokens(pattern) or ():
        runs = found[-1]
        if braces:
            braces = t != "}"
        elif t == ")" or t[0] == "(":
            depth += 1 if t[0] == "(" else -1
            runs.append("")
        elif depth:
            continue
        elif t == "|":
            found.append([""])
        elif t in ("?", "*", "{"):  # what is before may be missing
            runs[-1], braces = runs[-1][:-1], t == "{"
            runs.append("")
        elif t in ("+", "^", "$", ".") or t[0] == "[" or t[0] == "\\" and t[1].isalpha() or not t.isascii():
            runs.append("")
        else:
            runs[-1] += t[-1].lower()
    best = {max(runs, key=len) for runs in found}
    return sorted(best) if all(best) else []


def _may_have(lower: Column, pattern: str) -> Column | None:
    """Whether a text, given in lower case, has a literal that the pattern takes; far cheaper to see than its matches."""
    out = None
    for x in literals(pattern):
        has = F.contains(lower, F.lit(x))
        out = has if out is None else out | has
    return out


def occurring(text: Column, patterns: list[tuple[str, Column]]) -> Column:
    """The values of those patterns that occur, in order and without regard to case.

    A pattern is tried only where the text has one of its literals.
    """

    def found(x: Column) -> Column:
        each = []
        for p, value in patterns:
            may, does = _may_have(x["lower"], p), x["text"].rlike(f"(?i){p}")
            each.append(F.when(does if may is None else may & does, value))
        return F.array(*each)

    # an array of one holds the text as it is and in lower case for all patterns
    held = F.array(F.struct(text.alias("text"), F.lower(text).alias("lower")))
    return F.array_compact(F.flatten(F.transform(held, found))) if patterns else F.expr("cast(array() as array<string>)")


#: Marks what is left out of a text while rules are applied to the rest.
_CUT = "\u0001"


def _foreign(rules) -> str:
    """Characters that no pattern of the rules can match, as a class; empty where a pattern may match any."""
    used = set()
    for pattern, _ in rules:
        for t in _tokens(pattern) or ["."]:
            if t == "." or t in (r"\w", r"\W", r"\S", r"\D", r"\B") or t[0] == "[" and not re.fullmatch(r"\[[A-Za-z0-9 .]+\]", t):
                return ""
            used |= set((t[-1] if t[0] == "\\" and not t[1].isalpha() else "" if t[0] == "\\" else t).lower())
    return "".join(x for x in "abcdefghijklmnopqrstuvwxyz,;:!" if x not in used)


def rewritten(text: Column, rules) -> Column:
    """The rules ``(pattern, replacement)`` applied in order.

    A rule about a number is tried only where the text has that number, which is
    far cheaper to see than that its pattern does not match. No match of such a rule
    goes beyond a character that none of them takes, so what is between the first
    and the last of these in a run without digits is left out while they are applied.
    """
    needs = [max(re.findall(r"(?<![\\{\d])\d{2,}(?![?\d}])", pattern), key=len, default="") for pattern, _ in rules]
    numbered = next((i for i, need in enumerate(needs) if not need), len(needs))
    foreign = _foreign(rules[:numbered])
    if not numbered or not foreign:
        return _stepwise(text, rules, needs)
    short = _stepwise(shortened(text, foreign), rules[:numbered], needs[:numbered])
    return _stepwise(_lengthened(short, text, foreign), rules[numbered:], needs[numbered:])


def _stretch(text: Column, foreign: str) -> tuple[Column, Column]:
    """What is left out of a text, and the mark that stands for it, as patterns; a text with the mark in it stays whole."""
    whole, ends = F.contains(text, F.lit(_CUT)), f"[{foreign}{foreign.upper()}]"
    either = lambda p: F.when(whole, F.lit("(?!)")).otherwise(F.lit(p))
    return either(rf"({ends})(\D+)(?={ends})"), either(_CUT)


def shortened(text: Column, foreign: str) -> Column:
    """The text with a mark for what stands between the first and the last ``foreign`` character of each run without digits."""
    return F.regexp_replace(text, _stretch(text, foreign)[0], F.lit(rf"$1{_CUT}"))


def _lengthened(short: Column, text: Column, foreign: str) -> Column:
    """The shortened text with what was left out of ``text`` in the places of the marks."""
    stretch, mark = _stretch(text, foreign)
    parts = F.zip_with(F.split(short, mark), F.regexp_extract_all(text, stretch, F.lit(2)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(parts, "")


def _stepwise(text: Column, rules, needs: list[str]) -> Column:
    if not rules:
        return text

    def step(t: Column, i: Column) -> Column:
        """Rule ``i``; patterns are literals, so each is compiled once, and rules are found in blocks."""
        at, out = list(enumerate(zip(needs, rules, strict=True))), None
        for low in range(0, len(at), 9):
            block = None
            for k, (need, (pattern, replacement)) in at[low : low + 9]:
                may = F.contains(t, F.lit(need)) if need else _may_have(F.lower(t), pattern)
                applies = i == k if may is None else (i == k) & may
                done = F.regexp_replace(t, pattern, replacement)
                block = F.when(applies, done) if block is None else block.when(applies, done)
            out = F.when(i < low + 9, block.otherwise(t)) if out is None else out.when(i < low + 9, block.otherwise(t))
        return out

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), text, step)


def first_nonblank(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(v != "", v) for v in values))


def excerpt(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def tagged(text: Column, patterns: dict[str, str]) -> Column:
    """Sorted concept ids of the patterns that occur, without regard to case."""
    return F.array_sort(occurring(text, [(p, concept_id(F.lit(name))) for name, p in patterns.items()]))


def map_strings(kind, column, f):
    """``f`` applied to every string inside a nested value."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StringType):
        return f(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: map_strings(kind.elementType, x, f))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda k, v: map_strings(kind.valueType, v, f))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(map_strings(x.dataType, column[x.name], f).alias(x.name) for x in kind.fields)))
    return column
