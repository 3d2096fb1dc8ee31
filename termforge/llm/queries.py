"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import contamination, distinctive, encoding_repair, format_duplicates, packing, repetition, term_counts
from termforge.operators import reference_tables as ref
from termforge.session import table

RARE_DOCS, COMMON_SHARE = 2, 0.1
CONCENTRATED = distinctive.Concentrated(tf=4, per_cent=8, least_df=3, most_df=30)


def _scored(spark: SparkSession, d: str, only: distinctive.Concentrated | None = None) -> DataFrame:
    return distinctive.distinctive_terms(
        distinctive.record_postings(table(spark, d, "run")),
        ref.newest_doc_lengths(table(spark, d, "doc_lengths")),
        ref.term_df(table(spark, d, "lexicon")),
        only=only,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The z-score selects; its threshold follows from the conditions, which are checked on what it leaves."""
    return _scored(spark, d, CONCENTRATED).where(CONCENTRATED.exact()).select("docid", "term")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("docid", "term", F.round("z", 6).alias("z"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    counts = term_counts.collection_counts(table(spark, d, "run"), table(spark, d, "run_files"))
    return term_counts.TermCounts.open(spark, counts.path).marked(RARE_DOCS, COMMON_SHARE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies(table(spark, d, "collection_rows"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, d, "collection_rows"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.damaged_rows(table(spark, d, "collection_rows")).select("row_id")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.garbled(table(spark, d, "collection_rows")).select("row_id", "kind", "restored")


def p6_validation(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.validation(table(spark, d, "collection_rows"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    cut = _packed(spark, d).where((F.col("n_parts") > 1) & (F.col("part_no") == 0))
    return cut.select(F.col("container_id").cast("int").alias("container_id"), "doc_id")


def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every document's pieces, from the packing itself."""
    return packing.packing_summary(_packed(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each container, and whether it has at most 5 % more sequences than its tokens fill, and one a shard."""
    report = packing.fill_report(_packed(spark, d))
    most = F.col("least_sequences") * 1.05 + F.col("n_shards")
    return report.select("container_id", "n_tokens", "least_sequences", (F.col("n_sequences") <= most).alias("well_filled"))


def p8_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The packing as it is."""
    return _packed(spark, d)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The certified cutoffs select; the exact share is checked on what they leave."""
    judged = repetition.reject_repetitive(table(spark, d, "documents"), asked=repetition.SHARE)
    return judged.where(F.col("rejected") & (F.col("n_repeated") * 10 >= F.col("n_words") * 3) & (F.col("n_words") > 0)).select("doc_id")


def p10_certificates(spark: SparkSession, d: str) -> DataFrame:
    return repetition.certificate_report(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents")).select("doc_id", "n_words", "n_repeated")


QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p6_validation": p6_validation,
    "p8_found": p8_found,
    "p8_assignment": p8_assignment,
    "p8_fill": p8_fill,
    "p8_sequences": p8_sequences,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
    "p10_certificates": p10_certificates,
}

_POSTINGS = """
WITH rec AS (SELECT DISTINCT term, docid, chunk_no, tf FROM run WHERE term IS NOT NULL AND docid IS NOT NULL),
p AS (SELECT term, docid, CAST(coalesce(sum(tf), 0) AS BIGINT) AS tf FROM rec GROUP BY term, docid),
d AS (SELECT docid, CAST(sum(tf) AS BIGINT) AS dl FROM p GROUP BY docid),
t AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term),
m AS (SELECT term, cf, df, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.1 * (SELECT count(*) FROM d) THEN 'common' END AS mark FROM t)
"""
_CANONICAL = r"""
WITH w AS (SELECT row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws,
  list_filter(regexp_split_to_array(text, '[|;\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]'), lambda p: regexp_matches(p, '[\p{L}\p{N}]')) AS parts
  FROM collection_rows WHERE text IS NOT NULL),
c AS (SELECT row_id, CASE WHEN len(parts) >= 3 AND len(list_filter(parts, lambda p: NOT (contains(p, ':')
      AND len(regexp_extract_all(split_part(p, ':', 1), '[\p{L}\p{N}]+')) = 1))) = 0
    THEN 'fields' || chr(10) || array_to_string(list_sort(list_transform(parts, lambda p: array_to_string(regexp_extract_all(lower(p), '[\p{L}\p{N}]+'), ' '))), chr(10))
    ELSE array_to_string(ws, ' ') END AS canonical FROM w WHERE len(ws) > 0),
g AS (SELECT row_id AS copy_row_id, min(row_id) OVER (PARTITION BY canonical) AS row_id FROM c)
"""
_SIZES = r"""
WITH s AS (SELECT doc_id, coalesce(n_tokens, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]+'))) AS n FROM documents)
"""

ORACLE = {
    "p1_found": _POSTINGS + """SELECT docid, term FROM p JOIN d USING (docid) JOIN t USING (term)
WHERE tf >= 4 AND tf * 100 >= dl * 8 AND df BETWEEN 3 AND 30""",
    "p1_scores": _POSTINGS + """, n AS (SELECT sum(dl) AS n, (SELECT count(*) FROM p) AS np FROM d),
x AS (SELECT docid, term, tf, dl, cf, n, 1000.0 * df / np AS a FROM p JOIN d USING (docid) JOIN t USING (term), n)
SELECT docid, term, round((ln((tf + a) / (dl + 1000.0 - tf - a)) - ln((cf - tf + a) / (n - dl + 1000.0 - (cf - tf) - a)))
  / sqrt(1 / (tf + a) + 1 / (cf - tf + a)), 6) AS z FROM x""",
    "p4_found": _POSTINGS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p4_counts": _POSTINGS + "SELECT term, cf, df, mark FROM m",
    "p5_found": _CANONICAL + "SELECT row_id, copy_row_id FROM g WHERE row_id <> copy_row_id",
    "p5_groups": _CANONICAL
    + """, k AS (SELECT row_id, text FROM collection_rows)
SELECT g.row_id, count(*) AS n_copies, count(DISTINCT k.text) AS n_variants FROM g JOIN k ON k.row_id = g.copy_row_id GROUP BY g.row_id""",
    "p8_found": _SIZES + "SELECT container_id, doc_id FROM s JOIN containers ON n > capacity",
    "p8_assignment": _SIZES + """SELECT CAST(container_id AS BIGINT) AS container_id, doc_id, CAST(ceil(n / capacity) AS BIGINT) AS n_parts, CAST(n AS BIGINT) AS n_tokens,
  true AS whole, true AS fits FROM s, containers WHERE n > 0""",
    "p8_fill": _SIZES + """SELECT CAST(container_id AS BIGINT) AS container_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(ceil(sum(n) / max(capacity)) AS BIGINT) AS least_sequences,
  true AS well_filled FROM s, containers WHERE n > 0 GROUP BY container_id""",
    "p9_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
j AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d))
SELECT DISTINCT item_id, doc_id FROM e JOIN j USING (g)""",
}
_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS k FROM d)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM r, (SELECT unnest(range(0, 6)) AS o) GROUP BY doc_id)
"""
ORACLE["p10_shares"] = _REPEATS + "SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_repeated FROM d LEFT JOIN c USING (doc_id)"
ORACLE["p10_found"] = _REPEATS + "SELECT doc_id FROM d JOIN c USING (doc_id) WHERE n >= 0.3 * len(w)"
