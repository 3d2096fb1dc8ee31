"""Far too many small files: consolidation of sorted runs into few well-filled files.

The flushed runs are cut into key ranges; within a range the runs are merged by Spark's external
sorter, which sorts what fits in memory, spills sorted runs and merges them k ways. Every row
keeps the run it came from, so the merge itself tells which run first held a record. Outputs roll by bytes, and
their range metadata is read back from the files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.operators.skew import least_share
from termforge.session import materialize

RECORD = ("term", "docid", "chunk_no", "tf")
# A record is taken for hot if it comes up in the sample half as often as one holding a task's share of the rows would.
SAMPLED, SUSPECT = 100, 50
# Rows that a task takes anyway: where its share is less, one record can't be too much for it.
LIGHT = 100_000


def sampled(rows: DataFrame, n_rows: int) -> DataFrame:
    """A sample of about SAMPLED rows per task, all of a small table."""
    wanted = SAMPLED * least_share(rows.sparkSession)
    return rows.sample(wanted / n_rows, seed=11) if n_rows > wanted else rows


def hot_records(live: DataFrame, record: Sequence[str], n_rows: int) -> list[int]:
    """Hashes of records that seem to hold a task's share of the rows or more, from a sample.

    At most SAMPLED / SUSPECT hashes per task are collected. They only decide which of two exact ways a record takes.
    """
    if n_rows <= max(SAMPLED, LIGHT) * least_share(live.sparkSession):
        return []
    return suspects(sampled(live, n_rows).select(F.xxhash64(*record).alias("h")))


def suspects(sample: DataFrame) -> list[int]:
    """The hashes (h) that come up too often in a sample."""
    return [r[0] for r in sample.groupBy("h").count().where(F.col("count") >= SUSPECT).select("h").collect()]


def merge_runs(
    run: DataFrame, record: Sequence[str] = RECORD, source: str = "file_id", ranges: int | None = None, hot: list[int] | None = None
) -> DataFrame:
    """Rows (record..., source, n_copies, repeat, copy) in disjoint record ranges, ordered by record and source.

    The rows of the runs, merged: repeat is false for one row of each record, of its smallest source (a null source only if
    there is no other), and copy is true where the source has the record in the row before already. Rows whose
    first record column is null are damaged and left out; nulls in the others are values.

    One shuffle: rows go to their range straight from the scan and are merged there. Records that hold a task's share
    of the rows are combined map-side before, to one row per source that counts n_copies, and only the first of these
    takes part in the merge; the others follow unordered. `hot` is what hot_records finds, where that is known.
    """
    live = run.where(F.col(record[0]).isNotNull()).select(*record, source)
    hot = hot_records(live, record, run.count()) if hot is None else hot
    rows = live.withColumn("n_copies", F.lit(1).cast("bigint"))
    repeats = None
    if hot:
        is_hot = F.xxhash64(*record).isin(hot)
        per_source = live.where(is_hot).groupBy(*record, source).agg(F.count(F.lit(1)).alias("n_copies"))
        names = [f"_{c}" for c in record]
        first = per_source.groupBy(*[F.col(c).alias(n) for c, n in zip(record, names, strict=True)]).agg(F.min(source).alias("_first"))
        same = F.lit(True)
        for c, n in zip(record, names, strict=True):
            same = same & F.col(c).eqNullSafe(F.col(n))
        marked = per_source.join(F.broadcast(first), same)  # one row per hot record
        is_first = F.col(source).eqNullSafe(F.col("_first"))
        rows = rows.where(~is_hot).unionByName(marked.where(is_first).select(*record, source, "n_copies"))
        repeats = marked.where(~is_first).select(*record, source, "n_copies", F.lit(True).alias("repeat"), F.lit(False).alias("copy"))
    ranged = rows.repartitionByRange(ranges, *record) if ranges else rows.repartitionByRange(*record)
    of_record = Window.partitionBy(*record).orderBy(F.col(source).asc_nulls_last())  # the range is sorted like this
    place = F.row_number().over(of_record)
    copy = (place > 1) & F.col(source).eqNullSafe(F.lag(source).over(of_record))
    merged = ranged.select(*record, source, "n_copies", (place > 1).alias("repeat"), copy.alias("copy"))
    return merged if repeats is None else merged.unionByName(repeats)


def source_report(merged: DataFrame, source: str = "file_id") -> DataFrame:
    """(source, n_rows, n_distinct, n_first): per run its rows, its distinct records and how many of
    these no smaller source has."""
    return merged.groupBy(source).agg(
        F.sum("n_copies").alias("n_rows"),
        F.count(F.when(~F.col("copy"), 1)).alias("n_distinct"),
        F.count(F.when(~F.col("repeat"), 1)).alias("n_first"),
    )


def record_bytes(record: Sequence[str], df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    fixed = {"bigint": 8, "double": 8, "timestamp": 8, "int": 4, "float": 4, "smallint": 2, "tinyint": 1, "boolean": 1}
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) if kinds[c] in ("string", "binary") else F.lit(fixed.get(kinds[c], 16)) for c in record), F.lit(0))


def consolidate(
    run: DataFrame, path: str, record: Sequence[str] = RECORD, source: str = "file_id", target_bytes: int = 128 << 20, keep_duplicates: bool = False
) -> DataFrame:
    """Write the records of all runs into few files at `path`, ordered by record; return their ranges.

    Output files hold disjoint, ascending key ranges and about `target_bytes` (before
    encoding) each: the number of ranges follows from the number of rows and their size in a sample, and a range that
    came out too large rolls over into a further file. Each distinct record is written once;
    keep_duplicates writes it as often as the runs hold it. What the runs delivered again is kept apart (see
    consolidated and merged_rows), so a run can still be accounted for. Returned range metadata, read back
    from the files: (file_name, n_rows, n_bytes, first_key, last_key). An empty input writes
    an empty table and returns no rows.
    """
    spark = run.sparkSession
    n_rows = run.count()
    live = run.where(F.col(record[0]).isNotNull())
    sample = materialize(sampled(live, n_rows).select(F.xxhash64(*record).alias("h"), record_bytes(record, run).alias("b")), "sample")
    a_row = sample.agg(F.avg("b")).first()[0] or 1.0
    ranges = max(1, math.ceil(n_rows * a_row / target_bytes))
    hot = suspects(sample) if n_rows > max(SAMPLED, LIGHT) * least_share(spark) and not keep_duplicates else []
    out = merge_runs(run, record, source, ranges, hot).withColumn("kept", F.lit(True) if keep_duplicates else ~F.col("repeat"))
    per_file = max(1, int(1.25 * target_bytes / a_row))
    out.sortWithinPartitions("kept", *record).write.option("maxRecordsPerFile", per_file).partitionBy("kept").mode("overwrite").parquet(path)
    return file_ranges(consolidated(spark, path, run.schema, record), record)


def merged_rows(spark: SparkSession, path: str, schema: T.StructType, record: Sequence[str] = RECORD, source: str = "file_id") -> DataFrame:
    """All rows written by consolidate, as merge_runs gives them, and which are kept; `schema` is that of the runs."""
    columns = [T.StructField(c, schema[c].dataType) for c in (*record, source)]
    flag = T.BooleanType()
    columns += [T.StructField("n_copies", T.LongType()), T.StructField("repeat", flag), T.StructField("copy", flag), T.StructField("kept", flag)]
    return spark.read.schema(T.StructType(columns)).parquet(path)


def consolidated(spark: SparkSession, path: str, schema: T.StructType, record: Sequence[str] = RECORD, source: str = "file_id") -> DataFrame:
    """The records written by consolidate, ordered within files."""
    return merged_rows(spark, path, schema, record, source).where("kept").select(*record)


def file_ranges(written: DataFrame, record: Sequence[str] = RECORD) -> DataFrame:
    """Range metadata of a consolidated table, one row per non-empty file."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return (
        written.withColumn("_bytes", record_bytes(record, written))
        .groupBy(name.alias("file_name"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("_bytes").alias("n_bytes"),
            F.min(record[0]).alias("first_key"),
            F.max(record[0]).alias("last_key"),
        )
    )
