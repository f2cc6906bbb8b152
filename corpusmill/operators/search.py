"""Composite retrieval: one lazy plan over a table of queries.

Tables: ``queries(query_id, query_text, query_vec)``, ``statutes(section_id,
chunk_id, act, title, text, embedding)``, ``judgments(chunk_id, case_id,
legal_references, text, embedding)``, ``nodes(id, label, name)`` and
``edges(src, dst, type)``. Section ids join by the code of their act, so that
different spellings of an act meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.references import parsed_query, section_key
from ..functions.text import excerpt, first_nonblank, query_words, split_list, title_from_text
from . import graph, index, postprocess, retrieval, vector


def parse(queries: DataFrame) -> DataFrame:
    """The queries with what they name, as a struct ``intent``."""
    return queries.withColumn("intent", parsed_query(F.col("query_text")))


def expansion(parsed: DataFrame, edges: DataFrame | None, nodes: DataFrame | None = None) -> DataFrame:
    """Per query the sections that it names and their neighbours in the graph, by key; without a graph, the named ones."""
    named = parsed.select("query_id", F.explode("intent.sections").alias("node"))
    if edges is None:
        own = F.array_sort(F.collect_set(section_key(F.col("node"))))
        none = F.expr("cast(array() as array<string>)")
        return named.groupBy("query_id").agg(none.alias("corresponds"), none.alias("refers"), none.alias("concepts"), own.alias("all_sections"))
    key = lambda c: F.when(F.col(c).contains(":"), section_key(F.col(c))).otherwise(F.col(c))
    keyed = edges.select(key("src").alias("src"), key("dst").alias("dst"), "type")
    return graph.expand(named.select("query_id", section_key(F.col("node")).alias("node")), keyed, nodes=nodes)


def graph_sections(parsed: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Per query the section keys that its anchors reach: anchors are named sections, and nodes whose names hold its words."""
    words = parsed.select("query_id", query_words(F.col("query_text")).alias("words"))
    found = graph.anchors(words, nodes).select("query_id", F.col("id").alias("node"))
    named = parsed.select("query_id", F.explode("intent.sections").alias("k")).join(nodes.select("id", section_key(F.col("id")).alias("k")).where(F.col("id").contains(":")), "k").select("query_id", F.col("id").alias("node"))
    start = found.unionByName(named).distinct()
    pairs = edges.where(F.col("type").isin("CORRESPONDS_TO", "REFERS_TO", "DISCUSSES"))
    reached = graph.reach(start, pairs, depth).select("query_id", "node").unionByName(start)
    sections = reached.where(F.col("node").rlike("^[A-Za-z]+:\\d"))
    return sections.select("query_id", section_key(F.col("node")).alias("key")).distinct().groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("graph_sections"))


def research(queries: DataFrame, statutes: DataFrame, judgments: DataFrame | None, edges: DataFrame | None = None, nodes: DataFrame | None = None, *, k_statutes: int = 3, k_judgments: int = 3, fused: bool = False, bulk: bool = False, lists: index.Index | None = None, probes: int = 8, exact: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Hybrid search: statutes reranked by what the query and the graph say, judgments by the sections they refer to.

    ``bulk`` scores large corpora by matrix products first; see :func:`vector.top_k`.
    ``lists`` is an index of the statutes by ``chunk_id``, with all their columns,
    of which each query reads ``probes`` lists, or all that matter with ``exact``.
    """
    parsed = parse(queries)
    told = expansion(parsed, edges, nodes)
    fetch, columns = retrieval.fetch_size(k_statutes), ["section_id", "act", "title", "text"]
    if lists is not None:
        hits = index.search(queries, lists, fetch, probes=probes, exact=exact, keep=tuple(columns))
    else:
        hits = vector.top_k(queries, statutes, fetch, key="chunk_id", keep=columns, bulk=bulk)
    keys = parsed.select("query_id", "query_text", F.transform("intent.sections", section_key).alias("named"), section_key(F.col("intent.primary")).alias("primary"))
    hits = hits.join(keys, "query_id").join(told.select("query_id", "corresponds", "all_sections"), "query_id", "left").withColumn("section_key", section_key(F.col("section_id")))
    # a section that corresponds to a named one, or is named and has a counterpart
    key = F.col("section_key")
    within = lambda c: F.array_contains(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")), key)
    ranked = retrieval.rerank(hits, key == F.col("primary"), within("named"), within("corresponds"), within("all_sections"), key="chunk_id")
    rank = "final_rank"
    if fused and edges is not None and nodes is not None:
        ranked = ranked.join(graph_sections(parsed, nodes, edges), "query_id", "left")
        ranked = retrieval.fuse(ranked, within("graph_sections"), F.col("query_text"), rank="final_rank")
        rank = "fused_rank"
    laws = ranked.where(F.col(rank) <= k_statutes).withColumn("rank", F.col(rank)).drop("named", "corresponds", "all_sections", "graph_sections")
    if judgments is None or k_judgments < 1:
        return laws, None
    cases = vector.top_k(queries, judgments, k_judgments, key="chunk_id", keep=["case_id", "legal_references", "text"], bulk=bulk).join(keys.select("query_id", "named"), "query_id")
    refs = F.transform(F.coalesce("legal_references", F.expr("cast(array() as array<string>)")), section_key)
    cases = cases.withColumn("boost_applied", retrieval.matched_sections_boost(F.col("named"), refs))
    cases = cases.withColumn("rrf_score", F.round(retrieval.reciprocal_rank_score(F.col("vector_rank")) + F.col("boost_applied"), 6)).withColumn("vector_distance", vector.distance(F.col("score")))
    from pyspark.sql import Window

    return laws, cases.drop("named").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "vector_rank")))


def plain(queries: DataFrame, statutes: DataFrame, judgments: DataFrame | None, *, k_statutes: int = 3, k_judgments: int = 3, bulk: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Vector order alone, in the same shape."""
    laws = retrieval.neutral(vector.top_k(queries, statutes, k_statutes, key="chunk_id", keep=["section_id", "act", "title", "text"], bulk=bulk)).withColumn("rank", F.col("vector_rank"))
    if judgments is None or k_judgments < 1:
        return laws, None
    cases = retrieval.neutral(vector.top_k(queries, judgments, k_judgments, key="chunk_id", keep=["case_id", "legal_references", "text"], bulk=bulk)).withColumn("rank", F.col("vector_rank"))
    return laws, cases


def compare(queries: DataFrame, statutes: DataFrame, edges: DataFrame | None, nodes: DataFrame | None = None, *, k: int = 3, bulk: bool = False) -> DataFrame:
    """Sections that the hybrid search adds to the plain one."""
    hybrid, _ = research(queries, statutes, None, edges, nodes, k_statutes=k, bulk=bulk)
    base, _ = plain(queries, statutes, None, k_statutes=k, bulk=bulk)
    return retrieval.additions(hybrid, base, ["query_id", "section_id"]).select("query_id", "section_id", "rank")


def provision_cards(hits: DataFrame, chars: int = 800, related: tuple[str, ...] = ()) -> DataFrame:
    """What a reader is shown of a section; ``related`` are columns of section ids, such as successors and predecessors."""
    act, number = F.substring_index("section_id", ":", 1), F.substring_index("section_id", ":", -1)
    none = F.expr("cast(array() as array<string>)")
    ids = F.filter(F.array_distinct(F.flatten(F.array(*(F.coalesce(F.col(c).cast("array<string>"), none) for c in related)))), lambda x: x != "")
    more = [ids.alias("related_sections")] if related else []
    return hits.select("query_id", "rank", "section_id", first_nonblank(F.col("act"), act).alias("act"), number.alias("section"), first_nonblank(F.col("title"), title_from_text(F.col("text"), F.col("section_id"))).alias("title"), excerpt(F.col("text"), chars).alias("excerpt"), *more)


def judgment_cards(hits: DataFrame, chars: int = 800) -> DataFrame:
    return hits.select("query_id", "rank", F.col("chunk_id").alias("source_id"), first_nonblank(F.col("case_id"), F.lit("Unknown case")).alias("case_id"), excerpt(F.col("text"), chars).alias("excerpt"), F.col("legal_references").alias("related_sections"))


def related_cards(related_csv: DataFrame, statutes: DataFrame, ids: str = "related", chars: int = 400) -> DataFrame:
    """First chunk of every related section, missing ones left out."""
    first = statutes.groupBy("section_id").agg(F.min_by(F.struct("act", "title", "text"), "chunk_id").alias("s"))
    each = related_csv.select("query_id", F.posexplode(split_list(F.col(ids))).alias("pos", "section_id"))
    return each.join(first, "section_id").select("query_id", "pos", "section_id", "s.act", "s.title", excerpt(F.col("s.text"), chars).alias("excerpt"))


def ask(queries: DataFrame, statutes: DataFrame, judgments: DataFrame | None, edges: DataFrame | None = None, nodes: DataFrame | None = None, respond=None, *, bulk: bool = False) -> DataFrame:
    """Grounded answers: only retrieved sections may be cited, and none means out of scope."""
    laws, _ = research(queries, statutes, judgments, edges, nodes, bulk=bulk)
    context = postprocess.build_context(laws, "query_id", ["rank"], F.concat(F.lit("["), "section_id", F.lit("] "), excerpt(F.col("text"), 600)), 700)
    ids = laws.groupBy("query_id").agg(F.array_sort(F.collect_set("section_id")).alias("valid_ids"))
    given = queries.select("query_id", "query_text").join(context, "query_id", "left").join(ids, "query_id", "left").withColumn("valid_ids", F.coalesce("valid_ids", F.expr("cast(array() as array<string>)")))
    return postprocess.validate_answers(postprocess.answer(given, respond))


def triage(reports: DataFrame, statutes: DataFrame, edges: DataFrame | None = None, nodes: DataFrame | None = None, *, k: int = 12, chars: int = 800, bulk: bool = False) -> DataFrame:
    """Offence candidates of reported facts: retrieved, without procedure, current law before superseded."""
    queries = reports.withColumn("query_text", F.substring("query_text", 1, chars))
    laws, _ = research(queries, statutes, None, edges, nodes, k_statutes=k, bulk=bulk)
    cards = provision_cards(laws).withColumn("source_id", F.col("section_id"))
    return postprocess.prefer_current(postprocess.drop_procedural(cards), "query_id", F.col("act"))


def judged(reports: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Triage results of each report: proposed offences that were retrieved, no procedure, current law first.

    ``candidates(query_id, source_id, title, act, related_id)`` are proposed,
    ``known(source_id, title, act)`` retrieved. A related id that was not
    retrieved becomes null; a report that keeps no candidate is out of scope.
    """
    kept = postprocess.enrich(candidates, known, "source_id", ["title", "act"])
    kept = postprocess.nullify_dangling(kept, known.select(F.col("source_id").alias("_k_id")), "related_id", "_k_id")
    kept = postprocess.prefer_current(postprocess.drop_procedural(kept), "query_id", F.col("act"))
    some = kept.groupBy("query_id").agg(F.array_sort(F.collect_list("source_id")).alias("offences"))
    out = reports.select("query_id").join(some, "query_id", "left").withColumn("offences", F.coalesce("offences", F.expr("cast(array() as array<string>)")))
    return out.withColumn("out_of_scope", F.size("offences") == 0)


def trace(queries: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """What the graph contributes to each query: what it names, its anchors by route, and what is around them."""
    parsed = parse(queries)
    asked = parsed.select("query_id", F.col("query_text").alias("text"), query_words(F.col("query_text")).alias("words"), F.col("intent.sections").alias("sections"))
    entered = graph.anchor_routes(asked, nodes)
    around = graph.traverse(entered.select("query_id", F.col("id").alias("node")), nodes, edges, depth)
    routes = entered.groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "route", "id"))).alias("anchors"))
    return asked.select("query_id", "sections").join(routes, "query_id", "left").join(around, "query_id", "left")


def health(**tables: DataFrame) -> dict[str, bool]:
    """Whether each table can be read."""
    out = {}
    for name, df in tables.items():
        try:
            df.take(1)
            out[name] = True
        except Exception:  # whatever keeps a source from being read
            out[name] = False
    return out


def stats(**tables: DataFrame) -> dict[str, int]:
    return {name: df.count() for name, df in tables.items()}


def exists(df: DataFrame, column: str, value: str) -> bool:
    return bool(df.where(F.col(column) == value).take(1))
