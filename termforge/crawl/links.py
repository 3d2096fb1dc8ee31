"""Links of stored pages, and seeds of stored result pages.

The parser only reports start tags as (tag, attributes); what they mean is decided afterwards, in `page_links` and
`result_seeds`.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import islice
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.functions.urls import SKIPPED_SCHEMES, canonical

# Class of a result's anchor, and the parameter in which a redirect carries its target.
RESULT_CLASS, TARGET = "result__a", "uddg"


def start_tags(html: str, *wanted: str) -> list[tuple[str, dict[str, str]]]:
    """(tag, attributes) of the wanted start tags in order; of a repeated attribute the last value, '' for none."""
    seen: list[tuple[str, dict[str, str]]] = []
    parser = HTMLParser(convert_charrefs=True)
    parser.handle_starttag = lambda tag, attrs: seen.append((tag, {k: v or "" for k, v in attrs})) if tag in wanted else None
    parser.feed(html)
    return seen


def page_links(html: str, base: str) -> list[str]:
    """Canonical links of a page, in order, repeats kept.

    Anchors before the first base element with an address resolve against the page's URL, those after it against that
    element's. Reading ends at the first address that is no valid URL.
    """
    addressed = [(tag, a["href"].strip()) for tag, a in start_tags(html, "a", "base") if a.get("href")]
    moved = next((k for k, (tag, _) in enumerate(addressed) if tag == "base"), len(addressed))
    out: list[str] = []
    try:
        for k, (tag, href) in enumerate(addressed):
            if k == moved:
                base = canonical(urljoin(base, href))
            elif tag == "a" and not href.startswith(("#", *SKIPPED_SCHEMES)):
                out.append(canonical(urljoin(base, href)))
    except ValueError:
        return out
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """array of links; null for null html, and empty for a page without links."""
    return pd.Series([None if h is None else page_links(h, b or "") for h, b in zip(html, base, strict=True)], dtype=object)


def redirect_target(href: str) -> str:
    """Where a result's address leads: the target a redirect carries, else the address itself, completed by a scheme
    if it only looks like a redirect."""
    target = parse_qs(urlsplit(href).query).get(TARGET)
    if target:
        return unquote(target[0])
    return f"https:{href}" if f"{TARGET}=" in href else href


def result_seeds(html: str, most: int = 10) -> list[str]:
    """Target URLs of the first `most` results of a stored search result page."""
    results = (a["href"] for _, a in start_tags(html, "a") if "href" in a and RESULT_CLASS in a.get("class", "").split())
    return [redirect_target(href) for href in islice(results, most)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def seeds_of_results(html: pd.Series) -> pd.Series:
    """array of the targets of a result page's first ten results; null for null."""
    return html.map(result_seeds, na_action="ignore")
