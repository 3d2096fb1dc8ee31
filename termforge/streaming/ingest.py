"""Structured Streaming ingest: lines arriving as files become postings, lengths and rejects as they come.

Each micro-batch is loaded strictly, tokenized and appended as one run of postings, like a flush
of an indexing worker; merging runs and consolidating their files stay batch jobs. A batch that is
replayed after a failure overwrites its own folder, so every line is indexed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from termforge.operators import index as ix
from termforge.sources import strict_lines

LINES = T.StructType([T.StructField("line_id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("received_at", T.TimestampType())])


def read_line_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def index_stream(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write postings, doc_lengths and rejects of a stream of lines under `out`, in one folder per batch."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        tokens = ix.tokenized(strict_lines.loaded_rows(rows), "docid", "text").persist()
        ix.postings(tokens).write.mode("overwrite").parquet(f"{out}/postings/batch={batch_id}")
        ix.doc_lengths(tokens).write.mode("overwrite").parquet(f"{out}/doc_lengths/batch={batch_id}")
        strict_lines.rejected_lines(rows).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        tokens.unpersist()
        rows.unpersist()

    return lines.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_fetches(log: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """(window_start, superdomain, fetches, errors, bytes) of a stream of crawl log rows, with a watermark on ts_iso."""
    timed = log.withColumn("ts", F.to_timestamp("ts_iso")).where(F.col("ts").isNotNull()).withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", width), "superdomain")
        .agg(F.count(F.lit(1)).alias("fetches"), F.count(F.when(F.col("status") >= 400, 1)).alias("errors"), F.sum("bytes").alias("bytes"))
        .select(F.col("window.start").alias("window_start"), "superdomain", "fetches", "errors", "bytes")
    )
