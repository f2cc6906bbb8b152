"""The jobs as queries: each runs twice into a new folder and gives the whole output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobs import chunk_stream, graph_build

from ..session import shared_path
from .registry import query

# Fixed values of these queries: the settings of the jobs' own configuration files, in SQL of the second engine.
_CONCEPTS = {"License": r"\blicen[sc]ed?\b", "Email address": r"[a-z0-9._]+@[a-z0-9.]+", "Web address": r"https?://[a-z0-9./-]+", "Digits": r"\d{3,}"}
_REFERENCE = "(?i)(IPC|BNS|CrPC|BNSS|IEA|BSA|POCSO|CPC)[§:s.\\s]*(\\d+[A-Za-z]?)"
_REFS = f"list_sort(list_distinct(list_transform(regexp_extract_all(text, '{_REFERENCE}'), lambda x: upper(regexp_extract(x, '{_REFERENCE}', 1)) || ':' || regexp_extract(x, '{_REFERENCE}', 2))))"


def _concepts_sql(patterns: dict[str, str]) -> str:
    found = [f"CASE WHEN regexp_matches(text, '(?i){p}') THEN 'LEGAL_CONCEPT:{n.lower().replace(' ', '_')}' END" for n, p in patterns.items()]
    return "list_sort(list_filter([" + ", ".join(found) + "], lambda x: x IS NOT NULL))"


_WORDS = "len(list_filter(regexp_split_to_array({t}, '[ \t\n]+'), lambda x: x <> ''))"
_POINT = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id))"


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id, i, line, {_WORDS.format(t='line')} AS t FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE doc_id IS NOT NULL))),
f AS (SELECT doc_id, i, 1 AS pack, t AS held FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN held + p.t > 60 THEN pack + 1 ELSE pack END, CASE WHEN held + p.t > 60 THEN p.t ELSE held + p.t END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
c AS (SELECT doc_id, pack, string_agg(line, chr(10) ORDER BY i) AS text, 'DOC_' || doc_id || '_CHUNK_' || CASE WHEN pack < 1000 THEN lpad(CAST(pack AS VARCHAR), 3, '0') ELSE CAST(pack AS VARCHAR) END AS chunk_id FROM f JOIN p USING (doc_id, i) GROUP BY doc_id, pack)
SELECT c.doc_id, chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
  source, lang, CAST({_WORDS.format(t='text')} AS INT) AS n_words, array_to_string({_concepts_sql(_CONCEPTS)}, ',') AS concepts, array_to_string({_REFS}, ',') AS refs, md5(text) AS text_md5
FROM (SELECT *, {_POINT} AS h FROM c) c JOIN (SELECT doc_id, source, lang FROM documents) d USING (doc_id)"""
)
def job1_chunk_stream(spark, sf_dir):
    folder = shared_path(spark, "job1_chunk_stream")
    for _ in range(2):  # the second finds nothing new
        chunk_stream.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/out", f"{folder}/checkpoint", **chunk_stream.config())
    rows = chunk_stream.collection(spark, f"{folder}/out")
    return rows.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


_SLUG = "regexp_replace(source, '[^A-Za-z0-9_]+', '_', 'g')"
_ALL_CONCEPTS = _CONCEPTS | {"Shouting": "!!"}


@query(
    f"""WITH c AS (SELECT 'DOC_' || doc_id AS chunk_id, 'SOURCE_' || {_SLUG} AS case_id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'CONV_' || conv_id || '_TURN_' || CASE WHEN turn < 1000 THEN lpad(CAST(turn AS VARCHAR), 3, '0') ELSE CAST(turn AS VARCHAR) END, 'CONV_' || conv_id, text FROM conversations),
r AS (SELECT chunk_id, case_id, text, {_REFS} AS refs, {_concepts_sql(_ALL_CONCEPTS)} AS concepts FROM c),
same AS (SELECT text, min(chunk_id) AS dst FROM c WHERE regexp_matches(text, '\\S') GROUP BY text),
edges AS (SELECT DISTINCT * FROM (
  SELECT 'HAS_CHUNK' AS kind, case_id AS a, chunk_id AS b FROM c WHERE case_id IS NOT NULL
  UNION ALL SELECT 'REFERS_TO', chunk_id, unnest(refs) FROM r
  UNION ALL SELECT 'DISCUSSES', chunk_id, unnest(concepts) FROM r
  UNION ALL SELECT 'SAME_TEXT', chunk_id, dst FROM c JOIN same USING (text) WHERE chunk_id > dst)),
nodes AS (SELECT kind, a, min(b) AS b FROM (
  SELECT 'Case' AS kind, case_id AS a, CAST(NULL AS VARCHAR) AS b FROM c WHERE case_id IS NOT NULL
  UNION ALL SELECT 'Chunk', chunk_id, substr(coalesce(text, ''), 1, 80) FROM c
  UNION ALL SELECT 'StatuteSection', b, NULL FROM edges WHERE kind = 'REFERS_TO'
  UNION ALL SELECT 'LegalConcept', b, array_to_string(list_transform(string_split(substr(b, 15), '_'), lambda w: upper(w[1]) || w[2:]), ' ') FROM edges WHERE kind = 'DISCUSSES') GROUP BY kind, a),
told AS (SELECT 'nodes' AS kind, kind AS a, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind
  UNION ALL SELECT 'unnamed', kind, count(*) FROM nodes WHERE coalesce(b, '') = '' GROUP BY kind
  UNION ALL SELECT 'concept_cases', d.b, count(DISTINCT h.a) FROM edges d JOIN edges h ON d.kind = 'DISCUSSES' AND h.kind = 'HAS_CHUNK' AND h.b = d.a GROUP BY d.b)
SELECT 'node' AS part, kind, a, coalesce(b, '') AS b, 1::BIGINT AS n FROM nodes UNION ALL SELECT 'edge', kind, a, b, 1 FROM edges UNION ALL SELECT 'report', kind, a, '', n FROM told"""
)
def job2_graph_build(spark, sf_dir):
    folder = shared_path(spark, "job2_graph_build")
    for _ in range(2):
        graph_build.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", folder, **graph_build.config())
    nodes, edges = graph_build.graph_tables(spark, folder)
    part = lambda df, name, kind, a, b, n: df.select(F.lit(name).alias("part"), F.col(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"), n.cast("long").alias("n"))
    rows: DataFrame = part(nodes, "node", "label", "id", F.coalesce("name", F.lit("")), F.lit(1))
    rows = rows.unionByName(part(edges, "edge", "type", "src", F.col("dst"), F.lit(1)))
    return rows.unionByName(part(graph_build.reports(spark, folder), "report", "kind", "key", F.lit(""), F.col("n")))
