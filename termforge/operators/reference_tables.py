"""Resolving the index's own dirty side tables: superseded, repeated and missing entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_doc_lengths(doc_lengths: DataFrame) -> DataFrame:
    """(docid, dl): the newest non-null, non-zero length of each docid.

    Among rows of the same time the largest length; a row without time is older than any
    other. Docids that are null or have no usable length don't occur.
    """
    good = doc_lengths.where(F.col("docid").isNotNull() & (F.col("dl") != 0))
    return good.groupBy("docid").agg(F.max(F.struct("built_at", "dl"))["dl"].alias("dl"))


def newest_lexicon(lexicon: DataFrame) -> DataFrame:
    """(shard_id, term, df): of each entry the newest non-null df, ties to the larger."""
    good = lexicon.where(F.col("term").isNotNull() & F.col("df").isNotNull())
    return good.groupBy("shard_id", "term").agg(F.max(F.struct("built_at", "df"))["df"].alias("df"))


def term_df(lexicon: DataFrame) -> DataFrame:
    """(term, df): df summed over the shards, where the newest entry of every shard has one.

    A term whose newest entry in some shard has a null df is left out: the older entries are
    superseded and the sum would be wrong, so callers count it from the postings.
    """
    newest = lexicon.where(F.col("term").isNotNull()).groupBy("shard_id", "term").agg(F.max(F.struct("built_at", "df"))["df"].alias("df"))
    per_term = newest.groupBy("term").agg(F.sum("df").alias("df"), F.count(F.lit(1)).alias("_n"), F.count("df").alias("_known"))
    return per_term.where(F.col("_n") == F.col("_known")).select("term", "df")
