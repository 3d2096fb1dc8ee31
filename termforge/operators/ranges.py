"""Running numbers within a key, without putting a key's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.session import materialize


def numbered(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """rows with _no, the number of earlier rows of the same keys by `order`, and _prev, the order value just before.

    Rows are laid out in ranges of (keys, order), so a key that holds most rows spreads over many
    ranges; a range is numbered by itself and starts where the ranges before it end, which takes
    one row per key and range. Null keys are a key like any other. `order` should be unique
    within a key; among equals the numbers are arbitrary. keys may be empty.
    """
    laid = materialize(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "numbered-ranges")
    return numbered_ranges(laid, keys, order).drop("_range")


def numbered_ranges(laid: DataFrame, keys: Sequence[str], order: str, starts: DataFrame | None = None) -> DataFrame:
    """numbered() of rows that lie in ranges of (keys, order) already, told apart by an ascending _range, which is kept.

    `starts` is what range_starts gives for them, where it is stored.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    starts = range_starts(laid, keys, order) if starts is None else starts
    same = laid["_range"] == starts["_r"]
    for k, n in zip(keys, names, strict=True):
        same = same & laid[k].eqNullSafe(starts[n])
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    joined = laid.join(starts, same)
    out = joined.withColumn("_no", F.col("_start") + F.row_number().over(inside) - 1)
    out = out.withColumn("_prev", F.coalesce(F.lag(order).over(inside), F.col("_before")))
    return out.drop("_r", "_start", "_before", *names)


def range_starts(laid: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(_key0..., _r, _start, _before) per key and range: how many rows of the key earlier ranges hold, and the last of them."""
    names = [f"_key{i}" for i in range(len(keys))]
    per = laid.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_range").alias("_r")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(order).alias("_max")
    )
    earlier = (Window.partitionBy(*names) if names else Window).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*names, "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.max("_max").over(earlier).alias("_before"))
