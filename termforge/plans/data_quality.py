"""Queries of the general training-data operators: p2 rejected lines, p3 consolidation, p7 skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.operators import consolidate as C
from termforge.operators import skew
from termforge.session import scratch_path, table
from termforge.sources import strict_lines

FEW_RECORDS = 64
FILE_BYTES = 16 << 20
HEAVY_ONE_IN = 80
PERCENTILES = (0.5, 0.9, 0.99)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return strict_lines.rejected_lines(table(spark, d, "raw_lines")).select("line_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return strict_lines.loaded_rows(table(spark, d, "raw_lines"))


def _merged(spark: SparkSession, d: str, target_bytes: int):
    """The run table consolidated: its files' ranges, and the path they are at."""
    run, path = table(spark, d, "run"), scratch_path(spark, "consolidated")
    return C.consolidate(run, path, target_bytes=target_bytes), path, run.schema


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, path, schema = _merged(spark, d, FILE_BYTES)
    report = C.source_report(C.merged_rows(spark, path, schema))
    return report.where(F.col("file_id").isNotNull() & (F.col("n_distinct") < FEW_RECORDS) & (F.col("n_first") > 0)).select("file_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated table, read back from the files written."""
    _, path, schema = _merged(spark, d, FILE_BYTES)
    return C.consolidated(spark, path, schema)


def p3_file_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, FILE_BYTES)[0].drop("file_name")


def _by_docid(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_summary(skew.compress_values(table(spark, d, "run"), "term", "docid"), "term", "docid")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_by_docid(spark, d), "term", HEAVY_ONE_IN).select("term")


def p7_term_results(spark: SparkSession, d: str) -> DataFrame:
    return _by_docid(spark, d).select("term", "n_rows", F.col("n_distinct").alias("df"), F.col("mode").alias("modal_docid"))


def p7_tf_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return skew.weighted_percentiles(skew.compress_values(table(spark, d, "run"), "term", "tf"), "term", "tf", PERCENTILES)


QUERIES = {
    "p2_found": p2_found,
    "p2_loaded": p2_loaded,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p3_file_ranges": p3_file_ranges,
    "p7_found": p7_found,
    "p7_term_results": p7_term_results,
    "p7_tf_percentiles": p7_tf_percentiles,
}

_LINES = r"""
WITH raw AS (SELECT line_id, regexp_replace(line, '\r\z', '') AS s FROM raw_lines),
q AS (SELECT *,
  regexp_full_match(s, '(?s)(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)(?:\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|))*') AS well,
  regexp_full_match(s, '(?s)(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)') AS two,
  regexp_extract(s, '(?s)^("(?:[^"]|"")*"|[^"\t][^\t]*|)\t', 1) AS f1,
  regexp_extract(s, '(?s)^(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)\t(.*)$', 1) AS f2 FROM raw),
u AS (SELECT line_id, s, well, two,
  CASE WHEN starts_with(f1, '"') THEN replace(substr(f1, 2, length(f1) - 2), '""', '"') ELSE f1 END AS a,
  CASE WHEN starts_with(f2, '"') THEN replace(substr(f2, 2, length(f2) - 2), '""', '"') ELSE f2 END AS b FROM q),
v AS (SELECT *, CASE WHEN regexp_full_match(trim(a, ' '), '[0-9]+') THEN try_cast(trim(a, ' ') AS HUGEINT) END AS docid FROM u),
r AS (SELECT line_id, docid, b AS text,
  CASE WHEN regexp_full_match(s, '(?s)[\s\x0b\x1c-\x1f\x{85}\p{Z}]*') THEN 'blank' WHEN NOT well THEN 'quoting' WHEN NOT two THEN 'columns'
       WHEN docid IS NULL OR docid > 4294967295 THEN 'docid'
       WHEN NOT regexp_matches(b, '[\p{L}\p{N}]') OR regexp_matches(b, '[\x{FFFD}\x00-\x08\x0A-\x1F\x7F-\x{9F}]') THEN 'text' END AS reason FROM v)
"""
_KEPT = "SELECT DISTINCT term, docid, chunk_no, tf FROM run WHERE term IS NOT NULL"

ORACLE = {
    "p2_found": _LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_loaded": _LINES + "SELECT line_id, CAST(docid AS BIGINT) AS docid, text FROM r WHERE reason IS NULL",
    "p3_found": """
WITH rec AS (SELECT DISTINCT file_id, term, docid, chunk_no, tf FROM run WHERE term IS NOT NULL),
one AS (SELECT *, row_number() OVER (PARTITION BY term, docid, chunk_no, tf ORDER BY file_id) AS seq FROM rec)
SELECT file_id FROM one GROUP BY file_id HAVING count(*) < 64 AND count(*) FILTER (WHERE seq = 1) > 0""",
    "p3_records": _KEPT,
    "p3_file_ranges": f"""
SELECT count(*) AS n_rows, CAST(sum(octet_length(encode(term)) + 16) AS BIGINT) AS n_bytes, min(term) AS first_key, max(term) AS last_key
FROM ({_KEPT}) HAVING count(*) > 0""",
    "p7_found": """
SELECT term FROM run WHERE term IS NOT NULL GROUP BY term
HAVING count(*) * 80 >= (SELECT count(*) FROM run WHERE term IS NOT NULL)""",
    "p7_term_results": """
WITH c AS (SELECT term, docid, count(*) AS n FROM run WHERE term IS NOT NULL GROUP BY ALL),
m AS (SELECT term, docid, row_number() OVER (PARTITION BY term ORDER BY n DESC, docid) AS k FROM c WHERE docid IS NOT NULL)
SELECT term, CAST(sum(n) AS BIGINT) AS n_rows, count(docid) AS df, (SELECT docid FROM m WHERE m.term = c.term AND k = 1) AS modal_docid
FROM c GROUP BY term""",
    "p7_tf_percentiles": """
WITH o AS (SELECT term, tf, row_number() OVER (PARTITION BY term ORDER BY tf) AS k, count(*) OVER (PARTITION BY term) AS n
  FROM run WHERE term IS NOT NULL AND tf IS NOT NULL)
SELECT term, max(tf) FILTER (WHERE k = greatest(1, ceil(0.5 * n))) AS p50, max(tf) FILTER (WHERE k = greatest(1, ceil(0.9 * n))) AS p90,
  max(tf) FILTER (WHERE k = greatest(1, ceil(0.99 * n))) AS p99 FROM o GROUP BY term""",
}
