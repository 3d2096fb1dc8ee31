"""Command line: build and query an index, serve it, cut a subset, look into a table, run a crawl over stored pages."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Sequence
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge import service
from termforge.crawl import fetch, frontier, links, report
from termforge.functions.text import utc_text
from termforge.operators import index as ix
from termforge.operators import retrieval as rt
from termforge.operators import verify
from termforge.session import local_session
from termforge.sources import corpus

# Fixed value: the search page that gives the seeds of a query.
SEARCH_URL = "https://html.duckduckgo.com/html/?q="


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termforge")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index", help="build an index from TSV files or a Parquet table (doc_id, text)")
    c.add_argument("source"), c.add_argument("out"), c.add_argument("--docids", choices=corpus.POLICIES, default="explicit")
    c = sub.add_parser("search")
    c.add_argument("index"), c.add_argument("query"), c.add_argument("--mode", default="AND"), c.add_argument("--topk", type=int, default=10)
    c = sub.add_parser("bench", help="latency of ranked searches, of listed queries or of ones sampled from the lexicon")
    c.add_argument("index"), c.add_argument("--queries-file"), c.add_argument("--n", type=int, default=200), c.add_argument("--topk", type=int, default=10)
    c = sub.add_parser("serve")
    c.add_argument("index"), c.add_argument("--port", type=int, default=8000)
    c = sub.add_parser("subset")
    c.add_argument("source"), c.add_argument("out"), c.add_argument("limit", type=int)
    c = sub.add_parser("inspect")
    c.add_argument("table"), c.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("crawl", help="deterministic crawl over a stored web (url, status, html), or live, and robots (host, robots)")
    seeds = c.add_mutually_exclusive_group(required=True)
    seeds.add_argument("--seeds-file"), seeds.add_argument("--result-page"), seeds.add_argument("--query", help="start from the results of a search page")
    c.add_argument("--search-url", default=SEARCH_URL), c.add_argument("--timeout", type=float, default=3.0)
    c.add_argument("--web"), c.add_argument("--robots"), c.add_argument("--out", default="crawl.csv"), c.add_argument("--user-agent", default="*")
    c.add_argument("--max-pages", type=int, default=50), c.add_argument("--max-depth", type=int, default=1), c.add_argument("--num-seeds", type=int, default=10)
    return p


def _documents(spark: SparkSession, source: str, docids: str) -> DataFrame:
    return spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else corpus.read_collection(spark, source, docids)


def _seeds(spark: SparkSession, a: argparse.Namespace, opener: Callable) -> DataFrame:
    """Seed URLs (url) of a list, a stored result page or the result page of a query."""
    if a.seeds_file:
        return corpus.list_file(spark, a.seeds_file).select(F.col("value").alias("url"))
    if a.query:
        asked = spark.createDataFrame([(a.search_url + quote_plus(a.query),)], "url string")
        page = fetch.as_pages(fetch.fetched(asked, a.timeout, a.user_agent, opener)).first()["html"] or ""
    else:
        with open(a.result_page, encoding="utf-8", errors="replace") as f:
            page = f.read()
    return spark.createDataFrame([(u,) for u in links.result_seeds(page, a.num_seeds)], "url string")


def _latencies(spark: SparkSession, a: argparse.Namespace) -> str:
    """A line per mode: number of queries and mean, median, 95th percentile and maximum of their milliseconds."""
    index = ix.open_index(spark, a.index)
    asked = corpus.list_file(spark, a.queries_file).select(F.col("value").alias("query")) if a.queries_file else rt.sample_queries(index.lexicon, a.n).select("query")
    queries, lines = [r["query"] for r in asked.limit(a.n).collect()], []
    for mode in ("AND", "OR"):
        took = []
        for q in queries:
            began = time.perf_counter()
            rt.search_topk(index, q, a.topk, mode=mode).collect()
            took.append(((time.perf_counter() - began) * 1000,))
        r = verify.latency_summary(spark.createDataFrame(took, "ms double"), "ms").first()
        lines.append(f"{mode}\t{r['n']} queries" + "".join(f"\t{k} {r[k]:.2f} ms" for k in ("mean", "p50", "p95", "max") if r[k] is not None))
    return "\n".join(lines)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None, opener: Callable = fetch.web_opener) -> str:
    """Run a command and return what it prints. `opener` fetches URLs where a crawl is live."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if a.command == "index":
        i = ix.build_documents(_documents(spark, a.source, a.docids), a.out)
        said = f"{i.n_docs} documents, average length {i.avgdl:.3f}, build {i.build_id}"
    elif a.command == "search":
        rows = rt.search_topk(ix.open_index(spark, a.index), a.query, a.topk, mode=a.mode).collect()
        said = "\n".join(f"{r['doc_id']}\t{r['score']:.6f}" for r in rows)
    elif a.command == "bench":
        said = _latencies(spark, a)
    elif a.command == "serve":
        service.server(ix.open_index(spark, a.index), a.port).serve_forever()
        said = ""
    elif a.command == "subset":
        corpus.write_subset(corpus.numbered_lines(spark, a.source), a.out, a.limit)
        said = a.out
    elif a.command == "inspect":
        said = corpus.inspect(spark.read.parquet(a.table), a.limit)
    else:
        seeds = _seeds(spark, a, opener)
        web = spark.read.parquet(a.web) if a.web else fetch.live_pages(a.timeout, a.user_agent, opener)
        rules = spark.read.parquet(a.robots) if a.robots else spark.createDataFrame([], "host string, robots string")
        log = frontier.crawl(spark, seeds, web, rules, a.user_agent, frontier.Limits(a.max_pages, a.max_depth))
        report.write_log(log.withColumn("ts_iso", utc_text(F.current_timestamp())), a.out)
        errors = {r["status"]: r["n"] for r in report.status_errors(log).collect()}
        said = json.dumps({**report.summary(log).first().asDict(), "errors": errors})
    print(said)
    return said


if __name__ == "__main__":
    main()
