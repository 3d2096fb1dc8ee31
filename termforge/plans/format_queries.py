"""Queries of formats and small functions: run files, logs, lists, responses, frontier limits, service requests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge import service
from termforge.crawl import fetch, frontier, links, report
from termforge.functions import scoring, text, urls
from termforge.plans.retrieval_queries import _RUN, _bm25, _index
from termforge.session import scratch_path, table
from termforge.sources import corpus, runs

SUBSET, CAP, KEEP = 50, 1000, 200
# Requests to the search service.
REQUESTS = [
    {"query": "the of"}, {"query": "bright quiet", "mode": "or"}, {"query": " "}, {"query": "the", "mode": "XOR"}, {"query": "zzzunknown"}, {},
]


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_log").where("url IS NOT NULL")


def tsv_runs(spark, d):
    """All postings, written as text runs and read back."""
    path = scratch_path(spark, "tsv-runs")
    runs.write_tsv_runs(_index(spark, d).postings, path)
    return runs.read_tsv_runs(spark, path)


def binary_runs(spark, d):
    """All postings, written as binary runs and read back."""
    path = scratch_path(spark, "binary-runs")
    runs.write_binary_runs(_index(spark, d).postings, path)
    return runs.read_binary_runs(spark, path)


def mixed_runs(spark, d):
    """Postings of even documents in text runs and of odd ones in binary runs, read by one glob."""
    path, p = scratch_path(spark, "mixed-runs"), _index(spark, d).postings
    runs.write_tsv_runs(p.where("doc_id % 2 = 0"), f"{path}/text")
    runs.write_binary_runs(p.where("doc_id % 2 <> 0"), f"{path}/binary")
    return runs.read_runs(spark, f"{path}/*")


def crawl_csv(spark, d):
    """The crawl log, written as CSV and read back as text."""
    path = scratch_path(spark, "crawl-csv")
    report.write_log(table(spark, d, "crawl_log"), path)
    return report.read_log(spark, path)


def _written_lines(spark, d):
    """The raw lines as one text file in their order."""
    path = scratch_path(spark, "lines")
    table(spark, d, "raw_lines").orderBy("line_id").select("line").coalesce(1).write.text(path)
    return path


def numbered_lines(spark, d):
    return corpus.numbered_lines(spark, _written_lines(spark, d), line_sep="\n")


def strict_lines(spark, d):
    """The same lines, read by a reader that fails at malformed UTF-8."""
    return corpus.text_lines(spark, _written_lines(spark, d), "fail", "\n")


def subset_lines(spark, d):
    path = scratch_path(spark, "subset")
    corpus.write_subset(table(spark, d, "raw_lines"), path, SUBSET, "line_id", "line")
    return corpus.text_lines(spark, path, line_sep="\n")


def _listed(spark, rows, column):
    path = scratch_path(spark, "list")
    spaced = F.concat(F.lit("  "), F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\r\n]", " "), F.lit("\t "))
    rows.select(spaced.alias("value")).write.text(path)
    return corpus.list_file(spark, path)


def query_list(spark, d):
    """A list of queries with spaces around and blank lines."""
    return _listed(spark, table(spark, d, "search_queries"), "query").select(F.col("value").alias("query"))


def seed_list(spark, d):
    return _listed(spark, table(spark, d, "crawl_log"), "url").select(F.col("value").alias("url"))


def result_page_seeds(spark, d):
    """Seeds of a result page per logged URL: the URL behind a redirect, and a plain link."""
    found = F.concat(
        F.lit('<a class="x result__a" href="//r.test/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1">a</a><a href="http://no.test/">b</a><a class="result__a" href="http://plain.test/x">c</a>')
    )
    return _log(spark, d).select("log_id", F.posexplode(links.seeds_of_results(found)).alias("pos", "seed"))


def joined_urls(spark, d):
    hrefs = F.explode(F.array(F.lit("/x/y?z=1"), F.lit("//other.test/a"), F.lit("https://third.test/b")))
    return _log(spark, d).select("log_id", "url", hrefs.alias("href")).select("log_id", "href", urls.join_url("url", "href").alias("joined"))


def fetch_status(spark, d):
    """Numeric status of fetches whose failures are texts."""
    told = F.when(F.col("status") == 0, "error:TimeoutError").otherwise(F.col("status").cast("string"))
    return table(spark, d, "crawl_log").withColumn("told", told).select("log_id", report.status_code("told").alias("status"))


def response_pages(spark, d):
    """Responses as pages: html only for successful ones of a HTML type, malformed bytes replaced."""
    kind = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit("image/png"), F.lit("TEXT/HTML"), F.lit(None)), (F.col("log_id") % 4 + 1).cast("int"))
    rows = _log(spark, d).select(
        F.col("log_id").cast("string").alias("url"), F.lit(None).cast("string").alias("final_url"), F.when(F.col("status") != 0, F.col("status")).alias("code"),
        F.when(F.col("status") == 0, "TimeoutError").alias("failure"), kind.alias("content_type"), F.lit(None).cast("string").alias("content_encoding"),
        F.concat(F.encode("url", "UTF-8"), F.unhex(F.lit("FF"))).alias("payload"),
    )
    return fetch.as_pages(rows).select("url", "status", "html", F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint").alias("bytes"))


def utc_times(spark, d):
    return table(spark, d, "search_queries").select("qid", text.utc_text("asked_at").alias("asked_at"))


def shown_scores(spark, d):
    return table(spark, d, "crawl_log").select("log_id", scoring.shown_score(F.col("priority_at_pop")).alias("shown"))


def followed_pages(spark, d):
    return frontier.descended(table(spark, d, "crawl_log"), 2).select("log_id")


def frontier_trim(spark, d):
    rows = _log(spark, d).select("url", "depth", F.col("log_id").alias("seq"), F.col("total_priority").alias("priority")).where("priority IS NOT NULL AND depth IS NOT NULL")
    return frontier.trimmed(rows, CAP, KEEP)


def link_cap(spark, d):
    """How many links are kept of each crawl's URLs, taken as the links of one page."""
    rows = _log(spark, d).select(F.coalesce("crawl_id", F.lit(-1)).alias("page"), "url", F.col("log_id").cast("int").alias("pos"))
    return frontier.kept_links(rows).groupBy("page").agg(F.count(F.lit(1)).alias("n_kept"))


def service_requests(spark, d):
    """Status and number of results of requests to the service."""
    index = _index(spark, d)
    answers = [(json.dumps(r), *service.handle_search(index, json.dumps(r))) for r in REQUESTS]
    answers.append(("not json", *service.handle_search(index, "{")))
    answers.append(("no index", *service.handle_search(None, '{"query": "the"}')))
    rows = [(request, status, answer.get("totalResults")) for request, status, answer in answers]
    rows.append(("health", 200, service.health(index)["documents"]))
    return spark.createDataFrame(rows, "request string, status int, n bigint")


def inspected(spark, d):
    """Schema line, number of rows and shown rows of a table."""
    said = corpus.inspect(table(spark, d, "lexicon"), 7).split("\n")
    return spark.createDataFrame([(said[1], len(said) - 2, "term:string" in said[0])], "n_rows string, n_shown bigint, has_term boolean")


QUERIES = {
    f.__name__: f
    for f in (
        tsv_runs, binary_runs, mixed_runs, crawl_csv, numbered_lines, strict_lines, subset_lines, query_list, seed_list, result_page_seeds, joined_urls, fetch_status,
        response_pages, utc_times, shown_scores, followed_pages, frontier_trim, link_cap, service_requests, inspected,
    )
}

_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_P = _RUN + "SELECT term, doc_id, tf FROM p"
_TOTAL = "(SELECT least(10, count(*)) FROM ({}))"


def _stripped(column: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({column}, ''), '[\r\n]', ' ', 'g'), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _scores(column: str) -> str:
    return f"printf('%.3f', {column}) AS {column}"


ORACLE = {
    "tsv_runs": _P,
    "binary_runs": _P,
    "mixed_runs": _P,
    "crawl_csv": "SELECT ts_iso, url, CAST(status AS VARCHAR) AS status, CAST(depth AS VARCHAR) AS depth, CAST(bytes AS VARCHAR) AS bytes, domain, superdomain, "
    "CAST(domain_count_before AS VARCHAR) AS domain_count_before, CAST(super_count_before AS VARCHAR) AS super_count_before, "
    + ", ".join(_scores(c) for c in ("page_score", "super_score", "total_priority", "priority_at_pop")) + " FROM crawl_log",
    "numbered_lines": "SELECT row_number() OVER (ORDER BY line_id) - 1 AS line_no, line AS value FROM raw_lines",
    "strict_lines": "SELECT line AS value FROM raw_lines",
    "subset_lines": rf"SELECT line AS value FROM raw_lines WHERE regexp_matches(line, '[^{_SPACE}]') ORDER BY line_id LIMIT {SUBSET}",
    "query_list": f"SELECT query FROM (SELECT {_stripped('query')} AS query FROM search_queries) WHERE query <> ''",
    "seed_list": f"SELECT url FROM (SELECT {_stripped('url')} AS url FROM crawl_log) WHERE url <> ''",
    "result_page_seeds": "SELECT log_id, 0 AS pos, url_decode(url) AS seed FROM crawl_log WHERE url IS NOT NULL "
    "UNION ALL SELECT log_id, 1, 'http://plain.test/x' FROM crawl_log WHERE url IS NOT NULL",
    "joined_urls": r"""WITH u AS (SELECT log_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS authority
  FROM crawl_log WHERE url IS NOT NULL)
SELECT log_id, '/x/y?z=1' AS href, scheme || '://' || authority || '/x/y?z=1' AS joined FROM u
UNION ALL SELECT log_id, '//other.test/a', scheme || '://other.test/a' FROM u UNION ALL SELECT log_id, 'https://third.test/b', 'https://third.test/b' FROM u""",
    "fetch_status": "SELECT log_id, coalesce(status, 0) AS status FROM crawl_log",
    "response_pages": """WITH r AS (SELECT CAST(log_id AS VARCHAR) AS url, CASE WHEN status = 0 THEN 'error:TimeoutError' ELSE CAST(status AS VARCHAR) END AS status,
  CASE WHEN status <> 0 AND status < 400 AND log_id % 4 IN (0, 2) THEN url || chr(65533) END AS html FROM crawl_log WHERE url IS NOT NULL)
SELECT url, status, html, coalesce(octet_length(encode(html)), 0) AS bytes FROM r""",
    "utc_times": "SELECT qid, strftime(asked_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS asked_at FROM search_queries",
    "shown_scores": "SELECT log_id, CASE WHEN priority_at_pop <> 0 THEN printf('%.3f', priority_at_pop) ELSE 'N/A' END AS shown FROM crawl_log",
    "followed_pages": "SELECT log_id FROM crawl_log WHERE bytes > 0 AND depth < 2 AND status < 400",
    "frontier_trim": f"""WITH f AS (SELECT url, depth, log_id AS seq, total_priority AS priority FROM crawl_log WHERE url IS NOT NULL AND total_priority IS NOT NULL AND depth IS NOT NULL)
SELECT * FROM f QUALIFY count(*) OVER () <= {CAP} OR row_number() OVER (ORDER BY priority DESC, depth, seq, url) <= {KEEP}""",
    "link_cap": """SELECT coalesce(crawl_id, -1) AS page, CASE WHEN count(*) <= 100 THEN count(*) ELSE least(count(*), 200) END AS n_kept
FROM crawl_log WHERE url IS NOT NULL GROUP BY ALL""",
    "service_requests": " UNION ALL ".join(
        [
            f"SELECT '{json.dumps(REQUESTS[0])}' AS request, 200 AS status, {_TOTAL.format(_bm25({'the': 1, 'of': 1}, 'AND'))} AS n",
            f"SELECT '{json.dumps(REQUESTS[1])}', 200, {_TOTAL.format(_bm25({'bright': 1, 'quiet': 1}, 'OR'))}",
            f"SELECT '{json.dumps(REQUESTS[2])}', 400, NULL", f"SELECT '{json.dumps(REQUESTS[3])}', 400, NULL", f"SELECT '{json.dumps(REQUESTS[4])}', 200, 0",
            f"SELECT '{json.dumps(REQUESTS[5])}', 400, NULL", "SELECT 'not json', 500, NULL", "SELECT 'no index', 500, NULL",
            "SELECT 'health', 200, (SELECT count(DISTINCT docid) FROM run WHERE term IS NOT NULL AND docid IS NOT NULL)",
        ]
    ),
    "inspected": "SELECT count(*) || ' rows' AS n_rows, CAST(least(7, count(*)) AS BIGINT) AS n_shown, true AS has_term FROM lexicon",
}
