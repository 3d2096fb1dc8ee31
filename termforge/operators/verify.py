"""Consistency of an index: lengths, membership and postings compared as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.operators.ranges import numbered


def membership(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, side) of keys in one table only: left or right. Null keys don't count."""
    left, right = (x.select(key).where(F.col(key).isNotNull()).distinct() for x in (a, b))
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def length_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, dl_a, dl_b) where both tables know a document and differ in its length."""
    j = a.select("doc_id", F.col("dl").alias("dl_a")).join(b.select("doc_id", F.col("dl").alias("dl_b")), "doc_id")
    return j.where(~F.col("dl_a").eqNullSafe(F.col("dl_b")))


def posting_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(term, doc_id, tf, side): postings in one table only; empty if and only if they are equal."""
    cols = ["term", "doc_id", "tf"]
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def same_postings(a: DataFrame, b: DataFrame) -> bool:
    return posting_differences(a, b).isEmpty()


def report(index_lengths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: documents on either side only, on both, and with different lengths."""
    j = index_lengths.select("doc_id", F.col("dl").alias("a"), F.lit(1).alias("in_a")).join(
        lengths.select("doc_id", F.col("dl").alias("b"), F.lit(1).alias("in_b")), "doc_id", "full"
    )
    only_a, only_b = F.col("in_b").isNull(), F.col("in_a").isNull()
    return j.agg(
        F.count(F.when(only_a, 1)).alias("only_index"),
        F.count(F.when(only_b, 1)).alias("only_lengths"),
        F.count(F.when(~only_a & ~only_b, 1)).alias("in_both"),
        F.count(F.when(~only_a & ~only_b & ~F.col("a").eqNullSafe(F.col("b")), 1)).alias("different"),
    )


def latency_summary(samples: DataFrame, value: str) -> DataFrame:
    """(n, mean, p50, p95, max) of a sample: exact percentiles, p95 by the exclusive method, the maximum for
    fewer than 20 values. Nulls don't count; an empty sample gives n = 0 and nulls.

    Values are numbered by ranges, so no task sorts them all.
    """
    placed = numbered(samples.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull()), [], "v")
    n = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    last = n - 1

    def at(place: Column) -> Column:
        """The value at a place from 0, between two values where it isn't whole."""
        low, high = (F.max(F.when(F.col("_no") == f, F.col("v"))) for f in (F.floor(place), F.ceil(place)))
        return low + (high - low) * (place - F.floor(place))

    p95 = F.when(n < 20, F.max("v")).otherwise(at(F.least(0.95 * (n + 1) - 1, last)))
    return placed.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), at(last * 0.5).alias("p50"), p95.alias("p95"), F.max("v").alias("max"))
