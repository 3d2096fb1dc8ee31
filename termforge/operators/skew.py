"""Per-key results when a few keys hold most of the rows.

Value-frequency compression: rows are grouped by (key, value) before key. The first grouping
spreads a hot key over all tasks by its values and shrinks repeats map-side; what reaches the
per-key step is one weighted row per distinct value, and that step only uses aggregates which
combine partially, so no task ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.session import materialize

HEAVY = "_weight"


def compress_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, _weight): how many rows have this key and value.

    Rows with a null key belong to no key and are left out; a null value is a value of its own.
    Other columns of df, whatever their names, are not read.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key), F.col(value))
        .agg(F.count(F.lit(1)).alias(HEAVY))
    )


def key_summary(compressed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_rows, n_distinct, mode): exact, from weighted values.

    n_distinct counts non-null values; mode is the most frequent non-null value, the smallest
    among equals, and null for a key without values. An empty input gives an empty result.
    """
    ranked = F.when(F.col(value).isNotNull(), F.struct((-F.col(HEAVY)).alias("w"), F.col(value).alias("v")))
    return compressed.groupBy(key).agg(
        F.sum(HEAVY).alias("n_rows"),
        F.count(value).alias("n_distinct"),
        F.min(ranked)["v"].alias("mode"),
    )


def weighted_percentiles(compressed: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """(key, p<100*prob>...): nearest-rank percentiles of the values of each key, exact.

    For probability p of n rows: the smallest value whose cumulated weight reaches ceil(p * n), at
    least 1. The weighted values are range-partitioned by (key, value), so a key with many
    values spreads over neighbouring ranges; each range is summed once, the ranges before it give
    its offset (at most one row per range and key), and the running weight is taken inside a
    range only. Null values don't count; a key with null values only is left out.
    """
    spark = compressed.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(
        compressed.where(F.col(value).isNotNull())
        .select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(HEAVY).alias("w"))
        .repartitionByRange(ranges, "k", "v")
        .withColumn("range_no", F.spark_partition_id()),
        "percentile-ranges",
    )
    by_key = Window.partitionBy("k")
    offsets = (
        laid.groupBy("k", "range_no")
        .agg(F.sum("w").alias("range_w"))
        .withColumn("total", F.sum("range_w").over(by_key))
        .withColumn("before", F.sum("range_w").over(by_key.orderBy("range_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_w"))
        .drop("range_w")
    )
    inside = Window.partitionBy("k", "range_no").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.join(offsets, ["k", "range_no"]).withColumn("upto", F.col("before") + F.sum("w").over(inside))

    def at(p: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("total")))
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("w") < rank), F.col("v")))

    return placed.groupBy("k").agg(*[at(p).alias(f"p{round(100 * p)}") for p in probs]).withColumnRenamed("k", key)


def heavy_keys(summary: DataFrame, key: str, one_in: int, weight: str = "n_rows") -> DataFrame:
    """The rows of a per-key summary whose weight is at least one in `one_in` of the total.

    At most `one_in` rows by arithmetic, whatever the data.
    """
    total = summary.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t"))
    return summary.where(F.col(weight) * one_in >= total.scalar())


def least_share(spark: SparkSession) -> int:
    """One in how many rows makes a key hot: a task's even share of a shuffle, and never more than one in eighty."""
    return max(80, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(summary: DataFrame, key: str, weight: str = "n_rows", one_in: int | None = None) -> DataFrame:
    """(key, _ways): the keys of a per-key summary that hold more than one in `one_in` of the total weight, and into how
    many parts each must be split for a part to weigh no more than that. Null keys don't count.

    By default `one_in` is the number of shuffle partitions (see least_share). There are at most `one_in` such keys and
    2 * `one_in` parts by arithmetic, so the table may be broadcast whatever the data. The summary is read twice.
    """
    one_in = one_in or least_share(summary.sparkSession)
    keyed = summary.where(F.col(key).isNotNull())
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t"))
    ways = F.ceil(F.try_divide(F.col(weight) * one_in, total.scalar())).cast("int")
    return heavy_keys(keyed, key, one_in, weight).select(key, ways.alias("_ways")).where(F.col("_ways") > 1)


def salted_lookup(big: DataFrame, small: DataFrame, key: str, hot: DataFrame | None, spread: Sequence[str], how: str = "inner") -> DataFrame:
    """big joined (inner or left) with small on key, hot keys of big spread over several tasks.

    `hot` is (key, _ways) of hot_keys. Rows of big with a hot key go to one of its parts by a hash of the `spread`
    columns, and its rows of small are repeated once per part. small should have few rows per hot key. Without hot keys
    (None) it is a plain join.
    """
    if hot is None:
        return big.join(small, key, how)
    ways = F.broadcast(hot.select(F.col(key).alias("_hot"), "_ways"))  # at most one_in rows, see hot_keys
    left = big.join(ways, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(*spread), F.coalesce("_ways", F.lit(1))).cast("int"))
    right = small.join(ways, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1)))
    return left.drop("_hot", "_ways").join(right.drop("_hot", "_ways"), [key, "_part"], how).drop("_part")
