"""Crawl log analytics: running counts, priorities, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.scoring import page_score, super_score, total_priority
from termforge.functions.urls import url_domain, url_superdomain
from termforge.operators.ranges import numbered

# The columns of the log, in order.
LOG_COLUMNS = ("ts_iso", "url", "status", "depth", "bytes", "domain", "superdomain", "domain_count_before", "super_count_before",
               "page_score", "super_score", "total_priority", "priority_at_pop")


def running_counts(fetches: DataFrame, order: str = "log_id", crawl: str = "crawl_id") -> DataFrame:
    """Fetches (order, crawl, url, depth, ...) with domain and counts of earlier fetches of the same domain and superdomain.

    Counts restart in each crawl. Domains come from the URLs. A domain can hold most of a crawl, so
    rows are numbered by ranges.
    """
    rows = fetches.withColumn("domain", url_domain(F.col("url"))).withColumn("superdomain", url_superdomain(F.col("url")))
    for key, name in (("domain", "domain_count_before"), ("superdomain", "super_count_before")):
        rows = numbered(rows, [crawl, key], order).withColumn(name, F.col("_no").cast("bigint")).drop("_no", "_prev")
    return rows


def with_priority(rows: DataFrame) -> DataFrame:
    """page_score, super_score and total_priority of rows with counts and depth, to 3 decimals."""
    d, s = F.col("domain_count_before"), F.col("super_count_before")
    return (
        rows.withColumn("page_score", F.round(page_score(d), 3))
        .withColumn("super_score", F.round(super_score(s), 3))
        .withColumn("total_priority", F.round(total_priority(d, s, F.col("depth")), 3))
    )


def summary(log: DataFrame) -> DataFrame:
    """One row: pages, total_bytes, domains, superdomains."""
    return log.agg(
        F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.countDistinct(F.lower("domain")).alias("domains"),
        F.countDistinct(F.lower("superdomain")).alias("superdomains"),
    )


def status_errors(log: DataFrame) -> DataFrame:
    """(status, n) of error statuses from 400 on, ordered; failed fetches (0) aren't errors of a server."""
    return log.where(F.col("status") >= 400).groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def status_code(status) -> F.Column:
    """Numeric status of a fetch; 0 for anything that isn't a number."""
    return F.coalesce(F.expr(f"try_cast({status} as int)"), F.lit(0))


def write_log(log: DataFrame, path: str) -> None:
    """CSV of the log columns, scores with 3 decimals; nulls are empty, and quotes in fields are doubled."""
    scores = {"page_score", "super_score", "total_priority", "priority_at_pop"}
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.3f", c)).alias(c) if c in scores else F.col(c) for c in LOG_COLUMNS]
    log.select(*shown).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log columns of such a CSV, as text."""
    return spark.read.option("header", True).option("escape", '"').csv(path).select(*LOG_COLUMNS)
