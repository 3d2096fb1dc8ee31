"""Duplicates hidden by formatting: white space, letter case, punctuation or field order.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are brought to
canonical form; they are grouped again on the full canonical text and their counts summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.text import WORD, words
from termforge.operators.skew import hot_keys, salted_lookup
from termforge.session import materialize

LEAST_FIELDS = 3
# Fixed value: what separates the fields of a list.
FIELD_BREAK = r"[|;\n\r\x0B\x0C\x85\x{2028}\x{2029}]"


def canonical_text(text: Column) -> Column:
    """The words of a text in order; of a list of `name: value` fields, its fields in sorted order.

    A list is a text all of whose parts between separators are fields (one word, a colon, a
    value), at least three; parts without a word count for nothing. Null for a null text and for
    a text without a word.
    """
    parts = F.filter(F.split(text, FIELD_BREAK), lambda p: p.rlike(WORD))
    is_list = (F.size(parts) >= LEAST_FIELDS) & F.forall(
        parts, lambda p: p.contains(":") & (F.regexp_count(F.substring_index(p, ":", 1), F.lit(WORD)) == 1)
    )
    fields = F.array_sort(F.transform(parts, lambda p: F.array_join(words(p), " ")))
    plain = F.array_join(words(text), " ")
    return F.when(is_list, F.concat(F.lit("fields\n"), F.array_join(fields, "\n"))).when(plain != "", plain)


def _distinct_texts(rows: DataFrame) -> DataFrame:
    """(text_key, first_id, n, canonical, group_key) of each distinct text with a word."""
    raw = rows.groupBy("text").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    raw = raw.withColumn("canonical", canonical_text(F.col("text"))).where(F.col("canonical").isNotNull())
    return materialize(
        raw.select(
            F.unhex(F.sha2("text", 256)).alias("text_key"), "first_id", "n", "canonical", F.unhex(F.sha2("canonical", 256)).alias("group_key")
        ),
        "distinct-texts",
    )


def _groups(distinct: DataFrame) -> DataFrame:
    """One row per group, keyed by the full canonical text."""
    return distinct.groupBy("canonical").agg(
        F.min("first_id").alias("row_id"),
        F.sum("n").alias("n_copies"),
        F.count(F.lit(1)).alias("n_variants"),
        F.any_value("group_key").alias("group_key"),
    )


def collapse(rows: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, n_copies, n_variants): one row per group of copies, with its smallest row id.

    n_copies counts all rows of the group, n_variants its byte-different texts. Rows with a
    null text or a text without a word are in no group. Other columns aren't read.
    """
    picked = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return _groups(_distinct_texts(picked)).select("row_id", "n_copies", "n_variants")


def copies(rows: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, copy_row_id): for each group its smallest row id with each further member's.

    A star, not all pairs. Rows find their group by the SHA-256 of text and canonical text; texts
    and groups holding more than a task's share of all rows or variants are split by their weight. Rows with a null row id are no members.
    """
    picked = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    distinct = _distinct_texts(picked)
    groups = materialize(_groups(distinct).drop("canonical"), "copy-groups")
    several = groups.where(F.col("n_copies") > 1)
    hot_groups, hot_texts = hot_keys(groups, "group_key", "n_variants"), hot_keys(distinct, "text_key", "n")
    of_text = salted_lookup(
        distinct.select("text_key", "group_key"), several.select("group_key", F.col("row_id").alias("group_id")), "group_key", hot_groups, ["text_key"]
    )
    member = picked.where(F.col("row_id").isNotNull()).select("row_id", F.unhex(F.sha2("text", 256)).alias("text_key"))
    found = salted_lookup(member, of_text.select("text_key", "group_id"), "text_key", hot_texts, ["row_id"])
    return found.where(F.col("row_id") != F.col("group_id")).select(F.col("group_id").alias("row_id"), F.col("row_id").alias("copy_row_id"))
