import json

import pytest

from termforge import cli
from termforge.functions.text import body_text, utc_text


def test_index_search_inspect(spark, toy, tmp_path):
    toy.write.parquet(str(tmp_path / "docs.parquet"))
    assert cli.main(["index", str(tmp_path / "docs.parquet"), str(tmp_path / "ix")], spark).startswith("8 documents, average length 6.875")
    assert cli.main(["search", str(tmp_path / "ix"), "clock tower"], spark) == "5\t3.050007"
    assert cli.main(["search", str(tmp_path / "ix"), "the river", "--mode", "or", "--topk", "1"], spark) == "5\t1.716656"
    said = cli.main(["bench", str(tmp_path / "ix"), "--n", "2"], spark).split("\n")
    assert [x.split("\t")[:2] for x in said] == [["AND", "2 queries"], ["OR", "2 queries"]] and "p95" in said[0]
    (tmp_path / "q.txt").write_text("clock tower\n\nriver\nsilt\n")
    assert "3 queries" in cli.main(["bench", str(tmp_path / "ix"), "--queries-file", str(tmp_path / "q.txt")], spark)
    assert "8 rows" in cli.main(["inspect", str(tmp_path / "docs.parquet"), "--limit", "2"], spark)


def test_tsv_subset(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\ta b\n\n2\tb c\n3\tc d\n")
    cli.main(["subset", str(tmp_path / "c.tsv"), str(tmp_path / "s"), "2"], spark)
    assert cli.main(["index", str(tmp_path / "s"), str(tmp_path / "ix2")], spark).startswith("2 documents")


def test_crawl(spark, tmp_path):
    spark.createDataFrame([("http://a.test/", "200", '<a href="/b">b</a>'), ("http://a.test/b", "500", "x")], "url string, status string, html string").write.parquet(str(tmp_path / "web"))
    (tmp_path / "seeds.txt").write_text("http://a.test/\n")
    said = json.loads(cli.main(["crawl", "--seeds-file", str(tmp_path / "seeds.txt"), "--web", str(tmp_path / "web"), "--out", str(tmp_path / "log")], spark))
    assert said == {"pages": 2, "total_bytes": 19, "domains": 1, "superdomains": 1, "errors": {"500": 1}}
    (tmp_path / "page.html").write_text('<a class="result__a" href="http://a.test/b">x</a>')
    said = json.loads(cli.main(["crawl", "--result-page", str(tmp_path / "page.html"), "--web", str(tmp_path / "web"), "--out", str(tmp_path / "log2")], spark))
    assert said["pages"] == 1
    with pytest.raises(SystemExit):
        cli.main(["crawl", "--web", "x"], spark)


def test_live_crawl_from_a_query(spark, tmp_path):
    """The search page and all pages come through the opener, which runs on the executors."""

    def opener(url, timeout, agent):
        pages = {
            "http://find.test/?q=old+ships": '<a class="result__a" href="//r/?uddg=http%3A%2F%2Fa.test%2F">x</a>', "http://a.test/": '<a href="/next">n</a><a href="/gone">g</a>',
            "http://a.test/next": "end",
        }
        if timeout != 1.5 or agent != "me" or url not in pages:
            raise TimeoutError(url)
        return {"final_url": url, "code": 200, "content_type": "text/html", "payload": pages[url].encode()}

    asked = ["crawl", "--query", "old ships", "--search-url", "http://find.test/?q=", "--timeout", "1.5", "--user-agent", "me", "--out", str(tmp_path / "log")]
    said = json.loads(cli.main(asked, spark, opener))
    assert said == {"pages": 3, "total_bytes": 45, "domains": 1, "superdomains": 1, "errors": {}}
    log = spark.read.csv(str(tmp_path / "log"), header=True)
    assert {(r["url"], r["status"]) for r in log.collect()} == {("http://a.test/", "200"), ("http://a.test/next", "200"), ("http://a.test/gone", "0")}


def test_small_functions(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"), "2025-01-02 03:04:05")], "b binary, t string")
    assert tuple(df.select(body_text("b"), utc_text(df.t.cast("timestamp"))).first()) == ("a�b", "2025-01-02T03:04:05Z")
