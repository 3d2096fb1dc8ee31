import gzip
import json
import threading
import urllib.request
import zlib

import pytest
from pyspark.sql import functions as F

from termforge import service
from termforge.crawl import fetch, frontier, links, report, robots
from termforge.functions import urls
from termforge.operators import index as ix
from termforge.plans import crawl_queries

DOMAINS = [
    ("http://maps.harbor.test/a/b.html", "harbor.test", "test"), ("https://shop.lamp.co.uk/x", "lamp.co.uk", "uk"), ("http://lamp.co.uk", "lamp.co.uk", "uk"),
    ("http://deep.dept.ac.uk/?q", "dept.ac.uk", "uk"), ("https://intranet:9000/", "intranet", "intranet"), ("HTTP://Me:pw@WWW.Ri_ver.Example:81/x", "ri_ver.example", "example"),
    ("http://10.20.30.40/", "30.40", "40"), ("http://anchor.museum/path", "anchor.museum", "museum"), ("no url", "", ""),
]
CANONICAL = [
    ("https://Tide.Test/", "https://tide.test"), ("https://tide.test?gclid=9&z=2&utm_campaign=q&m=1", "https://tide.test?m=1&z=2"),
    ("https://tide.test:443/x/", "https://tide.test/x/"), ("http://tide.test:80", "http://tide.test"), ("http://tide.test:443/x", "http://tide.test:443/x"),
    ("https://tide.test/chart#depth", "https://tide.test/chart"), ("https://tide.test/?b&a=", "https://tide.test?a=&b="),
]


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "url string").select(f(F.col("url"))).collect()]


def test_domains(spark):
    assert column(spark, [u for u, *_ in DOMAINS], urls.url_domain) == [d for _, d, _ in DOMAINS]
    assert column(spark, [u for u, *_ in DOMAINS], urls.url_superdomain) == [s for _, _, s in DOMAINS]


def test_canonical(spark):
    given, want = [u for u, _ in CANONICAL], [c for _, c in CANONICAL]
    assert column(spark, given, urls.canonical_simple) == want
    assert column(spark, [*given, None, "http://a:bad/"], urls.canonicalize) == [*want, None, None]
    assert urls.canonical("http://me:pw@Tide.Test/log/main.html;p=2?FBCLID=7&k=&w=x%20y/z") == "http://tide.test/log/main.html?k=&w=x+y%2Fz"
    assert urls.canonical("http://h.com/foo/index.html", rewrite_index=True) == "http://h.com/foo/"


def test_filters(spark):
    u = ["http://a/x.JPG", "http://a/x.jpg?y", "http://a/x.html", "http://a/cgi-bin/x", "/img/a.css#f"]
    assert column(spark, u, urls.looks_binary) == [True, True, False, False, True]
    assert column(spark, u, urls.is_cgi) == [False, False, False, True, False]
    h = ["", " ", "#a", "mailto:x", "MAILTO:x", "javascript:1", "/p", "http://a"]
    assert column(spark, h, urls.is_page_href) == [False, False, False, False, True, False, True, True]
    assert column(spark, ["http://a/b#c#d", "x"], urls.defragment) == ["http://a/b", "x"]


PAGE = """<a href="first">f</a><base target="_top"><base href="https://Tide.Test/Charts/"><p><a href="/">r</a><a href="?w=3&utm_y=1&b=2">q</a><a href="North">c</a>
<a href="tel:123">t</a><a name="x">none</a><a href="http://Anchor.test:80/p/" href="http://again.test/">d</a><base href="http://not.test/"><a href=" https://lamp.test/#w ">e</a>"""


def test_links(spark):
    want = ["http://start.test/d/first", "https://tide.test", "https://tide.test/Charts/?b=2&w=3", "https://tide.test/Charts/North", "http://again.test", "https://lamp.test"]
    assert links.page_links('<a href="/a">a</a><a href="http://x:bad/">b</a><a href="/c">c</a>', "http://s.test") == ["http://s.test/a"]
    assert links.page_links(PAGE, "http://start.test/d/p") == want
    df = spark.createDataFrame([(PAGE, "http://start.test/d/p"), (None, "http://a"), ("no links", None)], "html string, base string")
    assert [r[0] for r in df.select(links.extract_links("html", "base")).collect()] == [want, None, []]
    joined = spark.createDataFrame([("http://a/b/c", "../d"), (None, "x"), ("http://a", None)], "b string, h string").select(urls.join_url("b", "h"))
    assert [r[0] for r in joined.collect()] == ["http://a/d", None, None]


def test_result_page_seeds():
    html = '<a class="result__a x" href="//d/l/?uddg=https%3A%2F%2Fa.test%2F&r=1">a</a><a class="result__a" href="/l/?x=uddg=1">b</a><a class="result__a" href="http://c">c</a><a href="http://d">d</a>'
    assert links.result_seeds(html) == ["https://a.test/", "https:/l/?x=uddg=1", "http://c"] and links.result_seeds(html, 1) == ["https://a.test/"]


def test_robots(spark):
    u = spark.createDataFrame([("http://a.test/ok",), ("http://a.test/private/x",), ("http://b.test/private",), ("nohost",), (None,)], "url string")
    rules = spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /private"), ("a.test", ""), (None, "x")], "host string, robots string")
    got = {r["url"]: r["allowed"] for r in robots.robots_filter(u, rules, "me").collect()}
    assert got == {"http://a.test/ok": True, "http://a.test/private/x": False, "http://b.test/private": True, "nohost": False, None: False}
    assert robots.may_fetch("http://a/x", None, "me") and not robots.may_fetch("x", None, "me") and not robots.may_fetch("http://a/x", "User-agent: *\nDisallow: /", "me")


def test_content_encodings(spark):
    raw = b"<html>" * 9
    deflated = zlib.compress(raw)
    cases = [
        (gzip.compress(raw), "GZIP", raw), (gzip.compress(raw[:6]) + gzip.compress(raw[6:]), "gzip", raw), (deflated, "deflate", raw), (deflated[2:-4], "deflate", raw),
        (b"junk", "gzip", b"junk"), (gzip.compress(raw)[:-9], "gzip", gzip.compress(raw)[:-9]), (raw, "br", raw), (raw, None, raw), (b"", "gzip", b""), (None, "gzip", None),
    ]
    df = spark.createDataFrame([(i, p, e) for i, (p, e, _) in enumerate(cases)], "i int, p binary, e string").orderBy("i")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(fetch.content("p", "e")).collect()] == [w for *_, w in cases]


def test_responses_and_openers(spark):
    rows = [
        ("http://a", "http://b", 200, None, "Text/HTML; x", "gzip", gzip.compress("é".encode())), ("http://pic", None, 200, None, "image/png", None, b"x"),
        ("http://gone", None, 404, None, "text/html", None, b"x"), ("http://slow", None, None, "TimeoutError", None, None, None), (None, None, None, None, None, None, None),
    ]
    got = [tuple(r) for r in fetch.as_pages(spark.createDataFrame(rows, fetch.RESPONSE)).collect()]
    assert got == [("http://a", "http://b", "200", "é"), ("http://pic", "http://pic", "200", None), ("http://gone", "http://gone", "404", None),
                   ("http://slow", "http://slow", "error:TimeoutError", None), (None, None, None, None)]

    def opener(url, timeout, agent):
        if "slow" in url:
            raise ConnectionResetError
        return {"code": 503} if "busy" in url else {"code": 200, "content_type": "text/html", "payload": agent.encode()}

    urls_ = spark.createDataFrame([("http://ok",), ("http://slow",), ("http://busy",), (None,)], "url string")
    got = {tuple(r) for r in fetch.live_pages(1, "me", opener)(urls_).collect()}
    assert got == {("http://ok", "200", "me"), ("http://slow", "error:ConnectionResetError", None), ("http://busy", "503", None)}


def test_running_counts_and_priority(spark):
    rows = [(1, 1, "http://a.x.com/1", 0), (2, 1, "http://b.x.com/2", 1), (3, 1, "http://y.com/", 2), (4, 2, "http://x.com/", 0), (5, 1, "http://y.com/2", 1), (6, None, "bad", 0)]
    log = report.with_priority(report.running_counts(spark.createDataFrame(rows, "log_id bigint, crawl_id int, url string, depth int")))
    got = {r["log_id"]: (r["domain_count_before"], r["super_count_before"]) for r in log.collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 2), 4: (0, 0), 5: (1, 3), 6: (0, 0)}
    cases = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 6, 1), (6, 14, 2)], "domain_count_before bigint, super_count_before bigint, depth int")
    got = [(r["page_score"], r["super_score"], r["total_priority"]) for r in report.with_priority(cases).collect()]
    assert got == [(1.0, 0.1, 2.1), (0.631, 0.063, 1.194), (0.5, 0.033, 1.033), (0.333, 0.025, 0.692)]


def test_crawl_over_a_stored_web(spark):
    def page(*to):
        return "".join(f'<a href="{t}">x</a>' for t in to)

    web = [
        ("http://a.test/", "200", page("/1", "http://b.test/x", "/pic.png", "/cgi/x", "/1")), ("http://a.test/1", "200", page("/", "/2")),
        ("http://b.test/x", "404", page("/never")), ("http://a.test/2", "200", page("/3")), ("http://a.test", "200", page("/1")),
    ]
    seeds = spark.createDataFrame([("http://a.test/#top",), (" ",), (None,), ("http://closed.test/",)], "url string")
    rules = spark.createDataFrame([("closed.test", "User-agent: *\nDisallow: /")], "host string, robots string")
    w = spark.createDataFrame(web, "url string, status string, html string")
    log = frontier.crawl(spark, seeds, w, rules, limits=frontier.Limits(max_pages=20, max_depth=2)).orderBy("log_id").collect()
    assert [r["url"] for r in log] == ["http://a.test/", "http://b.test/x", "http://a.test/1", "http://a.test/2", "http://a.test"] or {r["url"] for r in log} == {
        "http://a.test/", "http://b.test/x", "http://a.test/1", "http://a.test", "http://a.test/2"}
    assert [r["log_id"] for r in log] == list(range(1, len(log) + 1))
    assert all(r["depth"] <= 2 for r in log) and frontier.crawl(spark, seeds.limit(0), w, rules).count() == 0


def test_frontier_trim_and_link_cap(spark):
    f = spark.range(30).selectExpr("concat('u', id) as url", "0 as depth", "id as seq", "cast(id % 3 as double) as priority")
    best = frontier.trimmed(f, cap=20, keep=5).collect()
    assert [r["seq"] for r in best] == [2, 5, 8, 11, 14] and frontier.trimmed(f, cap=30).count() == 30
    many = spark.range(450).selectExpr("'p' as page", "concat('u', id) as url", "cast(id as int) as pos")
    kept = frontier.kept_links(many).count()
    assert kept == 200 and frontier.kept_links(many.limit(100)).count() == 100


def test_log_csv(spark, tmp_path):
    row = ("2025-01-01T00:00:00Z", "http://a", 200, 0, 5, "a", "a", 0, 0, 1.0, 0.1, 2.1, 2.1)
    df = spark.createDataFrame([row], "ts_iso string, url string, status int, depth int, bytes bigint, domain string, superdomain string, domain_count_before bigint, super_count_before bigint, page_score double, super_score double, total_priority double, priority_at_pop double")
    report.write_log(df, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).first()["total_priority"] == "2.100"
    assert [r["s"] for r in spark.createDataFrame([("200",), ("error:X",), (None,)], "x string").select(report.status_code("x").alias("s")).collect()] == [200, 0, 0]


def test_service(toy):
    index = ix.of_documents(toy)
    status, answer = service.handle_search(index, json.dumps({"query": "the river"}))
    assert status == 200 and answer["totalResults"] == 2 and answer["results"][0]["docid"] == 5 and answer["mode"] == "AND"
    assert service.handle_search(index, '{"query": " "}')[0] == 400 and service.handle_search(index, '{"query": "a", "mode": "XOR"}')[0] == 400
    assert service.handle_search(None, '{"query": "a"}')[0] == 500 and service.handle_search(index, "{")[0] == 500
    assert service.health(index)["documents"] == 8
    s = service.server(index, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"
    with urllib.request.urlopen(f"{base}/health") as r:
        assert json.load(r)["status"] == "ok"
    with urllib.request.urlopen(urllib.request.Request(f"{base}/search", data=b'{"query": "nobody", "mode": "OR"}')) as r:
        assert json.load(r)["results"][0]["docid"] == 4
    with urllib.request.urlopen(base) as r:
        assert b"search" in r.read()
    s.shutdown()


@pytest.mark.parametrize("status", [400, 503])
def test_summary(spark, status):
    log = spark.createDataFrame([(status, 10, "A.com", "com"), (0, None, "a.com", "COM"), (200, 5, None, None)], "status int, bytes bigint, domain string, superdomain string")
    assert tuple(report.summary(log).first()) == (3, 15, 1, 1)
    assert [tuple(r) for r in report.status_errors(log).collect()] == [(status, 1)]


def crawl_log(spark, folder, rows):
    spark.createDataFrame(rows, "log_id bigint, url string, depth int").write.parquet(f"{folder}/crawl_log.parquet")
    return str(folder)


def test_links_of_every_logged_url(spark, tmp_path):
    logged = ["http://a.test/p?b=2&a=1&utm_source=x", "http://a.test/?amp=1&lt=2", 'http://a.test/"q"', "http://a.test/<x>", "http://a.test/plain"]
    d = crawl_log(spark, tmp_path, [(i, u, 0) for i, u in enumerate(logged)])
    first = {r["log_id"]: r["link"] for r in crawl_queries.extract_links(spark, d).where("pos = 0").collect()}
    assert first == {i: urls.canonical(u) for i, u in enumerate(logged)} and first[0] == "http://a.test/p?a=1&b=2"
    assert {r["link"] for r in crawl_queries.links_dedup(spark, d).collect()} == {*first.values(), "http://a.test"}


def test_simulated_crawl_is_whole(spark, tmp_path, monkeypatch):
    """All depth 0 URLs are seeds, linked pages follow, the frontier is trimmed and forbidden links fall at the pop."""
    monkeypatch.setattr(crawl_queries, "ROUND", 60)
    sizes, popped = [], []
    trimmed, filtered = frontier.trimmed, frontier.robots_filter
    monkeypatch.setattr(frontier, "trimmed", lambda f: sizes.append(f.count()) or trimmed(f, 150, 100))
    monkeypatch.setattr(frontier, "robots_filter", lambda u, *a: popped.append(filtered(u, *a).where("NOT allowed").count()) or filtered(u, *a))
    rows = [(i, f"http://h{i % 90}.{'test' if i % 3 else 'example'}/{'d' if i % 7 == 0 else 'p'}{i}?b=1&a={i}", int(i >= 230)) for i in range(330)]
    log = crawl_queries.simulated_crawl(spark, crawl_log(spark, tmp_path, rows)).collect()
    assert len({r["url"] for r in log if r["depth"] == 0}) > 60 and max(sizes) > 150 and len(popped) > 3
    assert popped[0] > 0 and sum(popped[1:]) > 0
    assert any(r["depth"] > 0 and r["status"] == 200 for r in log) and all(r["status"] == 200 for r in log if "/p" in r["url"])
    assert not [r["url"] for r in log if ".test/d" in r["url"]]
