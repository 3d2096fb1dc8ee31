"""Queries of crawl analytics: URLs, links, running counts, frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.crawl import frontier, links, report, robots
from termforge.functions import urls
from termforge.session import materialize, table

# Fixed values of the simulated crawl: URLs of a block, one page in HUBS that links to all of its block, and limits by
# which the frontier of a log of some thousand URLs outgrows a round, is trimmed and then drained down to linked pages.
BLOCK, HUBS = 250, 50
MAX_PAGES, ROUND = 6_000, 1_000


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The crawl log's rows with a URL; log_id tells repeated rows apart."""
    return table(spark, d, "crawl_log").where("url IS NOT NULL")


def url_domain(spark, d):
    u = F.col("url")
    return _log(spark, d).select("log_id", urls.url_host(u).alias("host"), urls.url_domain(u).alias("domain"), urls.url_superdomain(u).alias("superdomain"))


def url_canonical(spark, d):
    return _log(spark, d).select("log_id", urls.canonical_simple(F.col("url")).alias("canonical"))


def url_canonical_exact(spark, d):
    return _log(spark, d).select("log_id", urls.canonicalize("url").alias("canonical"))


def url_defragmented(spark, d):
    return _log(spark, d).select(urls.defragment(F.col("url")).alias("url")).distinct()


def url_binary_or_cgi(spark, d):
    return _log(spark, d).select("log_id", urls.looks_binary(F.col("url")).alias("is_binary"), urls.is_cgi(F.col("url")).alias("is_cgi"))


def _escaped(url: Column) -> Column:
    """A URL as the value of an attribute."""
    for ch, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        url = F.replace(url, F.lit(ch), F.lit(entity))
    return url


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each logged URL, linking to itself, to its host's root and out of the web."""
    html = F.concat(F.lit('<html><a href="'), _escaped(F.col("url")), F.lit('">a</a> <a href="/">root</a> <a href="mailto:x@y.test">m</a> <a href="#top">t</a></html>'))
    return _log(spark, d).select("log_id", "url", "depth", html.alias("html"))


def extract_links(spark, d):
    found = _pages(spark, d).select("log_id", F.posexplode(links.extract_links("html", "url")).alias("pos", "link"))
    return found.select("log_id", "pos", "link")


def links_dedup(spark, d):
    return extract_links(spark, d).select("link").distinct()


def link_scheme_filter(spark, d):
    hrefs = F.explode(F.array(F.col("url"), F.lit("#top"), F.lit("mailto:a@b.test"), F.lit("MAILTO:a@b.test"), F.lit("  "), F.lit("javascript:void(0)")))
    return _log(spark, d).select("log_id", hrefs.alias("href")).where(urls.is_page_href(F.col("href")))


def crawl_running_counts(spark, d):
    """Counts before each logged fetch; a row without a depth counts, too, and has a null total priority."""
    rows = _log(spark, d).select("log_id", "crawl_id", "url", "depth")
    out = report.with_priority(report.running_counts(rows))
    return out.select("log_id", "domain_count_before", "super_count_before", "page_score", "super_score", "total_priority")


def crawl_summary(spark, d):
    return report.summary(table(spark, d, "crawl_log"))


def status_errors(spark, d):
    return report.status_errors(table(spark, d, "crawl_log"))


def frontier_topk(spark, d):
    rows = _log(spark, d).select("url", "depth", F.col("log_id").alias("seq"), F.col("total_priority").alias("priority")).where("priority IS NOT NULL AND depth IS NOT NULL")
    return frontier.top_of(rows, 100)


def frontier_antijoin(spark, d):
    seen = _log(spark, d).where("crawl_id = 1").select(urls.canonical_simple(F.col("url")).alias("url"))
    fresh = _log(spark, d).where("crawl_id > 1").select(urls.canonical_simple(F.col("url")).alias("url")).distinct()
    return frontier.unseen(fresh, seen.distinct())


def _rules(rows: DataFrame) -> DataFrame:
    """Robots files (host, robots) that forbid one path prefix on hosts of one superdomain."""
    hosts = rows.select(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1).alias("host")).distinct()
    return hosts.where(F.lower("host").endswith(".test")).withColumn("robots", F.lit("User-agent: *\nDisallow: /d"))


def robots_allowed(spark, d):
    """Every logged URL under these rules."""
    rows = _log(spark, d).select("url").distinct()
    return robots.robots_filter(rows, _rules(rows), "*")


def _linked_web(pages: DataFrame) -> DataFrame:
    """Stored pages (url, status, html) that link across the log, of pages (url, html).

    URLs lie by hash in blocks of about BLOCK. A page links on to the next three of its block, one in HUBS to all of
    it. A page is stored under its URL without a fragment, as a seed is, and under the canonical one, as a link is.
    """
    blocks = max(1, pages.count() // BLOCK)
    rows = materialize(pages.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks))).withColumn("hub", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(HUBS)) == 0), "blocks")
    anchor = F.concat(F.lit('<a href="'), _escaped(F.col("url")), F.lit('">n</a>'))
    w = Window.partitionBy("block").orderBy("url")  # a block has about BLOCK rows
    near = rows.withColumn("near", F.concat(*[F.coalesce(F.lead(anchor, k).over(w), F.lit("")) for k in (1, 2, 3)]))
    every = rows.groupBy("block").agg(F.array_join(F.sort_array(F.collect_list(anchor)), "").alias("every"))
    linked = near.where("NOT hub").select("url", "html", "near").unionByName(near.where("hub").join(every, "block").select("url", "html", F.col("every").alias("near")))
    stored = linked.select("url", F.concat("html", "near").alias("html"))
    as_link = stored.withColumn("url", urls.canonicalize("url"))
    both = stored.withColumn("url", F.trim(urls.defragment(F.col("url")))).unionByName(as_link).where("url IS NOT NULL AND url <> ''")
    return both.groupBy("url").agg(F.min("html").alias("html")).withColumn("status", F.lit("200"))


def simulated_crawl(spark, d):
    """A crawl from all of the log's depth 0 URLs over pages linking to themselves, their roots and other logged URLs,
    under rules that forbid one path prefix on hosts of one superdomain."""
    web = materialize(_linked_web(_pages(spark, d).groupBy("url").agg(F.min("html").alias("html"))), "web")
    seeds = _log(spark, d).where("depth = 0").select("url").distinct()
    out = frontier.crawl(spark, seeds, web, _rules(_log(spark, d).select("url")), limits=frontier.Limits(max_pages=MAX_PAGES, max_depth=2, round_size=ROUND))
    return out.select("log_id", "url", "status", "depth", "domain_count_before", "super_count_before", "total_priority", "priority_at_pop")


QUERIES = {
    f.__name__: f
    for f in (
        url_domain, url_canonical, url_canonical_exact, url_defragmented, url_binary_or_cgi, extract_links, links_dedup, link_scheme_filter, crawl_running_counts,
        crawl_summary, status_errors, frontier_topk, frontier_antijoin, robots_allowed, simulated_crawl,
    )
}

_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':.*$', ''))"
_L = f"""WITH l AS (SELECT log_id, crawl_id, url, depth, {_HOST} AS host, string_split({_HOST}, '.') AS lb FROM crawl_log WHERE url IS NOT NULL),
u AS (SELECT *, CASE WHEN len(lb) < 2 THEN host WHEN len(lb) >= 3 AND array_to_string(lb[-2:], '.') IN ('co.uk', 'ac.uk') THEN array_to_string(lb[-3:], '.')
  ELSE array_to_string(lb[-2:], '.') END AS domain, lb[-1] AS superdomain FROM l)
"""
_CANON = r"""
SELECT log_id, lower(regexp_extract(b, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) || '://' ||
  regexp_replace(lower(regexp_extract(b, '^[^:]*://([^/?]*)', 1)), CASE WHEN lower(b) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') ||
  CASE WHEN path = '/' THEN '' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM (
SELECT log_id, b, regexp_extract(b, '^[^:]*://[^/?]*([^?]*)', 1) AS path,
  array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid)(=|$)')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS q
FROM (SELECT log_id, crawl_id, regexp_replace(url, '#.*$', '') AS b FROM crawl_log WHERE url IS NOT NULL {where}))"""
_LINKS = "WITH c AS (" + _CANON.replace("{where}", "") + r"""), k AS (SELECT log_id, 0 AS pos, canonical AS link FROM c
UNION ALL SELECT log_id, 1, regexp_extract(canonical, '^[^:]+://[^/?]*') FROM c)
"""
_PATH = r"lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)', 1))"
ORACLE = {
    "url_domain": _L + "SELECT log_id, host, domain, superdomain FROM u",
    "url_canonical": _CANON.replace("{where}", ""),
    "url_canonical_exact": _CANON.replace("{where}", ""),
    "extract_links": _LINKS + "SELECT log_id, pos, link FROM k",
    "links_dedup": _LINKS + "SELECT DISTINCT link FROM k",
    "robots_allowed": r"""SELECT url, allowed FROM (SELECT DISTINCT url, authority <> '' AND NOT (lower(authority) LIKE '%.test' AND starts_with(path, '/d')) AS allowed
FROM (SELECT url, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1) AS authority,
  regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path FROM crawl_log WHERE url IS NOT NULL))""",
    "url_defragmented": "SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM crawl_log WHERE url IS NOT NULL",
    "url_binary_or_cgi": f"SELECT log_id, regexp_matches({_PATH}, '\\.({'|'.join(urls.BINARY_SUFFIXES)})$') AS is_binary, contains(lower(url), 'cgi') AS is_cgi FROM crawl_log WHERE url IS NOT NULL",
    "link_scheme_filter": "SELECT log_id, unnest([url, 'MAILTO:a@b.test']) AS href FROM crawl_log WHERE url IS NOT NULL AND trim(url) <> ''",
    "crawl_running_counts": _L + """, r AS (SELECT log_id, depth, row_number() OVER (PARTITION BY crawl_id, domain ORDER BY log_id) - 1 AS d,
  row_number() OVER (PARTITION BY crawl_id, superdomain ORDER BY log_id) - 1 AS s FROM u)
SELECT log_id, d AS domain_count_before, s AS super_count_before, round(1 / log2(2 + d), 3) AS page_score, round(0.1 / log2(2 + s), 3) AS super_score,
  round(1 / log2(2 + d) + 0.1 / log2(2 + s) + 1 / (1.0 + depth), 3) AS total_priority FROM r""",
    "crawl_summary": """SELECT count(*) AS pages, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, count(DISTINCT lower(domain)) AS domains,
  count(DISTINCT lower(superdomain)) AS superdomains FROM crawl_log""",
    "status_errors": "SELECT status, count(*) AS n FROM crawl_log WHERE status >= 400 GROUP BY status",
    "frontier_topk": """SELECT url, depth, log_id AS seq, total_priority AS priority FROM crawl_log WHERE url IS NOT NULL AND total_priority IS NOT NULL AND depth IS NOT NULL
ORDER BY priority DESC, depth, seq, url LIMIT 100""",
    "frontier_antijoin": "SELECT DISTINCT canonical AS url FROM (" + _CANON.replace("{where}", "AND crawl_id > 1") + ") WHERE canonical NOT IN (SELECT canonical FROM ("
    + _CANON.replace("{where}", "AND crawl_id = 1") + "))",
}
