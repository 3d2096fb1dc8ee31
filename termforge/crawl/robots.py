"""Robots rules from stored robots.txt files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def may_fetch(url: str | None, robots: str | None, agent: str) -> bool:
    """False for a URL without a host; without a stored file everything is allowed."""
    if not url or not urlparse(url).netloc:
        return False
    if robots is None:
        return True
    parser = RobotFileParser()
    parser.parse(robots.splitlines())
    return parser.can_fetch(agent, url)


def _decide(agent: str):
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsers: dict[str, RobotFileParser] = {}
            allowed = []
            for url, text in zip(pdf["url"], pdf["robots"], strict=True):
                if not url or not urlparse(url).netloc:
                    allowed.append(False)
                elif text is None:
                    allowed.append(True)
                else:
                    if text not in parsers:
                        parsers[text] = RobotFileParser()
                        parsers[text].parse(text.splitlines())
                    allowed.append(parsers[text].can_fetch(agent, url))
            yield pd.DataFrame({"url": pdf["url"], "allowed": allowed})

    return decide


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """(url, allowed) of a table (url), by robots files (host, robots); the host is the URL's network location.

    Null URLs are not allowed. A host with several files counts with the greatest text, so rows
    are never multiplied. The join may be split where a host has most URLs, as files are one row a host (adaptive skew joins do).
    """
    from termforge.functions.urls import _AUTHORITY

    one = robots.where(F.col("host").isNotNull()).groupBy("host").agg(F.max("robots").alias("robots"))
    located = urls.select("url", F.regexp_extract("url", _AUTHORITY, 1).alias("host"))
    return located.join(one, "host", "left").select("url", "robots").mapInPandas(_decide(agent), "url string, allowed boolean")
