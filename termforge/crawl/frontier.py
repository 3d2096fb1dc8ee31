"""Deterministic crawl over a stored web: rounds of the best frontier URLs.

A crawl is sequential: what a URL is worth depends on what was fetched before. It is taken in
synchronous rounds, like a fixed number of workers: the best URLs of the frontier are popped, robots
rules are checked at the pop, the stored pages are looked up, log rows are numbered, links that
were never seen are ranked by the counts at that time and enter the frontier. Every popped
URL counts as seen, sampling is by a seeded hash, and the crawl ends when the frontier is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.crawl.links import extract_links
from termforge.crawl.report import running_counts, status_code, with_priority
from termforge.crawl.robots import robots_filter
from termforge.functions.scoring import total_priority
from termforge.functions.urls import defragment, is_cgi, looks_binary, url_domain, url_superdomain
from termforge.operators.ranges import numbered
from termforge.session import materialize, scratch_path

# Links kept and sampled per page, size of the frontier before and after trimming.
MOST_LINKS, OVERSAMPLE = 100, 200
FRONTIER_CAP, FRONTIER_KEEP = 10_000, 2_000


@dataclass
class Limits:
    max_pages: int = 50
    max_depth: int = 1
    round_size: int = 32
    seed: int = 7


def top_of(frontier: DataFrame, n: int) -> DataFrame:
    """The n best URLs: priority descending, then depth, sequence, URL."""
    return frontier.orderBy(F.desc("priority"), "depth", "seq", "url").limit(n)


def trimmed(frontier: DataFrame, cap: int = FRONTIER_CAP, keep: int = FRONTIER_KEEP) -> DataFrame:
    """The frontier, or its `keep` best URLs if it has more than `cap`."""
    return top_of(frontier, keep) if frontier.count() > cap else frontier


def unseen(links: DataFrame, *seen: DataFrame) -> DataFrame:
    for s in seen:
        links = links.join(s.select("url"), "url", "left_anti")
    return links


def kept_links(links: DataFrame, seed: int = 7, most: int = MOST_LINKS, oversample: int = OVERSAMPLE) -> DataFrame:
    """Links (page, url, pos) of each page: all of up to `most`, else a seeded sample of `oversample`."""
    by_page = Window.partitionBy("page")
    ranked = links.withColumn("_n", F.count(F.lit(1)).over(by_page)).withColumn("_k", F.row_number().over(by_page.orderBy(F.xxhash64("url", "pos", F.lit(seed)))))
    return ranked.where((F.col("_n") <= most) | (F.col("_k") <= oversample)).drop("_n", "_k")


def descended(pages: DataFrame, max_depth: int) -> DataFrame:
    """The pages whose links are followed: with a body, above the greatest depth, and not refused by the server."""
    return pages.where((F.col("bytes") > 0) & (F.col("depth") < max_depth) & (F.col("status") < 400))


def child_candidates(pages: DataFrame, seed: int = 7) -> DataFrame:
    """(page, url, pos, depth) of links of pages (url, html, depth) that may be fetched: no binaries, no CGI."""
    links = pages.select(F.col("url").alias("page"), (F.col("depth") + 1).alias("depth"), F.posexplode(extract_links("html", "url")).alias("pos", "url"))
    kept = kept_links(links, seed).where(~looks_binary(F.col("url")) & ~is_cgi(F.col("url")))
    return kept.select("page", "url", "pos", "depth")


def prioritized(urls: DataFrame, log: DataFrame) -> DataFrame:
    """URLs (url, depth, seq) with the priority that follows from the pages logged so far."""
    rows = urls.withColumn("_d", url_domain(F.col("url"))).withColumn("_s", url_superdomain(F.col("url")))
    d = log.groupBy(F.col("domain").alias("_d")).agg(F.count(F.lit(1)).alias("_dn"))
    s = log.groupBy(F.col("superdomain").alias("_s")).agg(F.count(F.lit(1)).alias("_sn"))
    p = total_priority(F.coalesce("_dn", F.lit(0)), F.coalesce("_sn", F.lit(0)), F.col("depth"))
    return rows.join(d, "_d", "left").join(s, "_s", "left").select("url", "depth", "seq", p.alias("priority"))


Web = DataFrame | Callable[[DataFrame], DataFrame]


class _Grown:
    """A table that grows by a round's rows at a time: each round is written once, and a read sees all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, scratch_path(spark, name), None

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)
        self.schema = self.schema or rows.schema

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def crawl(spark: SparkSession, seeds: DataFrame, web: Web, robots: DataFrame, agent: str = "*", limits: Limits | None = None) -> DataFrame:
    """Log of a crawl: (log_id, crawl_id, url, status, depth, bytes, domain, superdomain, counts, scores, priority_at_pop).

    seeds (url); web is the table (url, status, html) of stored responses, or a function that gets them for URLs (url), such
    as fetch.live_pages; a URL without a response fails with status 0; robots (host, robots). Rounds stop at max_pages
    log rows or an empty frontier.
    """
    limits = limits or Limits()
    start = seeds.where(F.col("url").isNotNull()).select(F.trim(defragment(F.col("url"))).alias("url")).where(F.col("url") != "").distinct()
    start = start.join(robots_filter(start, robots, agent).where("allowed").select("url").distinct(), "url", "left_semi")
    empty_log = spark.createDataFrame([], "domain string, superdomain string")
    first = numbered(start, [], "url").select("url", F.lit(0).alias("depth"), (F.col("_no") + 1).alias("seq"))
    frontier = materialize(prioritized(first, empty_log), "frontier")
    seen, log, n_log, n_seq = _Grown(spark, "seen"), _Grown(spark, "log"), 0, frontier.count()
    seen.add(frontier.select("url"))
    while n_log < limits.max_pages:
        best = Window.orderBy(F.desc("priority"), "depth", "seq", "url")  # a round's rows
        popped = materialize(top_of(frontier, min(limits.round_size, limits.max_pages - n_log)).withColumn("rank", F.row_number().over(best)), "popped")
        if popped.isEmpty():
            break
        frontier = frontier.join(popped.select("url"), "url", "left_anti")
        allowed = popped.join(robots_filter(popped.select("url"), robots, agent).where("allowed").select("url").distinct(), "url", "left_semi")
        pages = allowed.join(web(allowed.select("url")) if callable(web) else web, "url", "left")
        got = materialize(
            pages.select(
                (F.row_number().over(Window.orderBy("rank")) + n_log).cast("bigint").alias("log_id"), F.lit(1).alias("crawl_id"), "url",
                status_code("status").alias("status"), "depth",
                F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint").alias("bytes"), "html", F.round("priority", 3).alias("priority_at_pop"),
            ),
            "fetched",
        )
        n_log += got.count()
        log.add(got.drop("html"))
        parents = descended(got, limits.max_depth)
        fresh = unseen(child_candidates(parents.select("url", "html", "depth"), limits.seed), seen.table())
        least = fresh.groupBy("url").agg(F.min("depth").alias("depth"), F.min_by("page", F.struct("depth", "page", "pos")).alias("page"))
        ranked = least.withColumn("_k", F.row_number().over(Window.partitionBy("page").orderBy("url"))).where(F.col("_k") <= MOST_LINKS)
        new = ranked.select("url", "depth", (F.row_number().over(Window.orderBy("depth", "url")) + n_seq).alias("seq"))  # a round's links
        located = log.table().withColumn("domain", url_domain(F.col("url"))).withColumn("superdomain", url_superdomain(F.col("url")))
        new = materialize(prioritized(new, located), "children")
        n_seq += new.count()
        seen.add(new.select("url"))
        frontier = materialize(trimmed(frontier.unionByName(new)), "frontier")
    if log.schema is None:
        schema = "log_id bigint, crawl_id int, url string, status int, depth int, bytes bigint, priority_at_pop double"
        return with_priority(running_counts(spark.createDataFrame([], schema)))
    return with_priority(running_counts(log.table()))
