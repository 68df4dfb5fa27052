"""Queries over the core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import nested, skew
from lodespark.session import table

HEAVY_SHARE = 0.02


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = nested.triples(table(spark, sf_dir, "sample_lines"), "line_no", "line", leaves=(nested.KEY, "id", "title"))
    return nested.link(parsed, "line_no").select("line_no", "kind", "path", "child_id")


def p1_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = nested.triples(table(spark, sf_dir, "sample_lines"), "line_no", "line", leaves=(nested.KEY, "id", "title", "chunk"))
    rows = nested.pivot(parsed, "line_no", "chunk", (nested.KEY, "id", "title", "chunk"))
    return rows.select("line_no", "path", "ordinal", nested.own_id().alias("chunk_id"), "title", "chunk")


def p1_step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = nested.triples(table(spark, sf_dir, "sample_lines"), "line_no", "line", leaves=(nested.KEY, "id", "question", "answer"))
    rows = nested.pivot(parsed, "line_no", "decomposition", (nested.KEY, "id", "question", "answer"))
    return rows.select("line_no", "path", F.col("parent").alias("parent_path"), "ordinal", nested.own_id().alias("step_id"), "question", "answer")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf_dir, "traces"), ["entity_text", "source_chunk_id"], HEAVY_SHARE).select("field", "key_value")


def p3_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skew.field_rows(table(spark, sf_dir, "traces"), ["entity_text", "source_chunk_id"], "last_accessed_at", "access_count")
    states = {"mentions": ("count", F.lit(1)), "last_access": ("max", F.col("last_accessed_at")), "accesses": ("sum", F.col("access_count"))}
    return skew.tree_aggregate(rows, ["field", "key_value"], states)


def p3_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = table(spark, sf_dir, "traces").where(F.col("entity_text").isNotNull())
    return skew.tree_distinct(traces, ["entity_text"], "source_chunk_id", "chunks")


QUERIES = {"p1_found": p1_found, "p1_chunk_rows": p1_chunk_rows, "p1_step_rows": p1_step_rows, "p3_found": p3_found, "p3_key_stats": p3_key_stats, "p3_text_chunks": p3_text_chunks}

def _decoded(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({v} ->> '$', '^[ \\t\\r\\n]*[\\[{{]') AND json_valid({v} ->> '$') THEN CAST({v} ->> '$' AS JSON) ELSE {v} END"


def _is_element(v: str) -> str:
    return f"list_has_any(json_keys({v}), ['id', 'title', 'chunk', 'sent_id', 'question', 'answer', 'meta', 'supporting_facts', 'decomposition'])"


def _elements(source: str) -> str:
    """(line_no, parent, path, ordinal, key, e) of the elements of a repeated field; ``source`` gives (line_no, parent, f)."""
    at = "unnest(range(CAST(n AS BIGINT)))"
    return f"""SELECT line_no, parent, CASE WHEN parent = '' THEN '' ELSE parent || '.' END || CAST(i AS VARCHAR) AS path, CAST(i AS INTEGER) AS ordinal, key, CASE WHEN json_type(e) = 'ARRAY' THEN json_object('title', e -> 0) ELSE e END AS e FROM (
        SELECT line_no, parent, i, CASE WHEN form = 'map' THEN json_keys(f)[i + 1] END AS key, CASE form WHEN 'one' THEN f WHEN 'list' THEN {_decoded("(f -> CAST(i AS INTEGER))")} ELSE {_decoded("json_extract(f, '$.\"' || json_keys(f)[i + 1] || '\"')")} END AS e FROM (
        SELECT line_no, parent, f, form, {at} AS i FROM (
        SELECT line_no, parent, f, form, CASE form WHEN 'one' THEN 1 WHEN 'list' THEN json_array_length(f) ELSE len(json_keys(f)) END AS n FROM (
        SELECT line_no, parent, f, CASE WHEN json_type(f) = 'ARRAY' THEN CASE WHEN json_array_length(f) = 2 AND json_type(f -> 0) = 'VARCHAR' AND json_type(f -> 1) IN ('BIGINT', 'UBIGINT') THEN 'one' ELSE 'list' END WHEN {_is_element("f")} THEN 'one' ELSE 'map' END AS form FROM (
        SELECT line_no, parent, CASE WHEN json_type(f) = 'OBJECT' AND NOT {_is_element("f")} AND json_exists(f, '$.items') THEN {_decoded("(f -> 'items')")} ELSE f END AS f FROM (
        SELECT line_no, parent, {_decoded("f")} AS f FROM ({source})))
        WHERE json_type(f) IN ('ARRAY', 'OBJECT'))))) WHERE json_type(e) = 'OBJECT' OR (json_type(e) = 'ARRAY' AND json_type(e -> 0) = 'VARCHAR')"""


_RECORDS = "r AS MATERIALIZED (SELECT line_no, CAST(line AS JSON) AS j FROM sample_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT')"
_CHUNK_ROWS = f"c AS MATERIALIZED ({_elements("SELECT line_no, '' AS parent, j -> 'chunks' AS f FROM r")})"
_STEP_ROWS = f"""d AS ({_elements("SELECT line_no, '' AS parent, j -> 'decomposition' AS f FROM r")}
    UNION ALL {_elements("SELECT line_no, path AS parent, e -> 'decomposition' AS f FROM d")})"""
_FACT_ROWS = f"f AS ({_elements("SELECT line_no, '' AS parent, j -> 'supporting_facts' AS f FROM r UNION ALL SELECT line_no, path, e -> 'supporting_facts' FROM d")})"
_OWN = "coalesce(nullif(e ->> 'id', ''), key, '')"
_FIELDS = "(SELECT 'entity_text' AS field, entity_text AS key_value, last_accessed_at, access_count FROM traces UNION ALL SELECT 'source_chunk_id', source_chunk_id, last_accessed_at, access_count FROM traces)"
SQL = {
    "p1_chunk_rows": f"WITH {_RECORDS}, {_CHUNK_ROWS} SELECT line_no, path, ordinal, {_OWN} AS chunk_id, e ->> 'title' AS title, e ->> 'chunk' AS chunk FROM c",
    "p1_step_rows": f"WITH RECURSIVE {_RECORDS}, {_STEP_ROWS} SELECT line_no, path, parent AS parent_path, ordinal, {_OWN} AS step_id, e ->> 'question' AS question, e ->> 'answer' AS answer FROM d",
    "p1_found": f"""WITH RECURSIVE {_RECORDS}, {_CHUNK_ROWS}, {_STEP_ROWS}, {_FACT_ROWS},
        ids AS (SELECT DISTINCT line_no, {_OWN} AS own FROM c), titles AS (SELECT line_no, e ->> 'title' AS title, arg_max({_OWN}, ordinal) AS own FROM c GROUP BY 1, 2)
        SELECT line_no, 'chunk' AS kind, path, {_OWN} AS child_id FROM c UNION ALL SELECT line_no, 'decomposition', path, {_OWN} FROM d
        UNION ALL SELECT f.line_no, 'supporting_fact', path, coalesce(nullif(ids.own, ''), titles.own, '') FROM f
            LEFT JOIN ids ON ids.line_no = f.line_no AND ids.own = {_OWN} LEFT JOIN titles ON titles.line_no = f.line_no AND titles.title = e ->> 'title'""",
    "p3_found": f"SELECT field, key_value FROM {_FIELDS} WHERE key_value IS NOT NULL GROUP BY field, key_value HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM traces)",
    "p3_key_stats": f"SELECT field, key_value, count(*) AS mentions, max(last_accessed_at) AS last_access, CAST(sum(access_count) AS BIGINT) AS accesses FROM {_FIELDS} WHERE key_value IS NOT NULL GROUP BY field, key_value",
    "p3_text_chunks": "SELECT entity_text, count(DISTINCT source_chunk_id) AS chunks FROM traces WHERE entity_text IS NOT NULL AND source_chunk_id IS NOT NULL GROUP BY entity_text",
}
