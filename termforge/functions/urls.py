"""URL expressions: host, domain, canonical form, link filters."""

from __future__ import annotations

from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Binary suffixes, tracking parameters, default ports, schemes that aren't pages, two-label suffixes, index files.
BINARY_SUFFIXES = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "pdf", "zip", "tar", "gz", "tgz", "bz2", "xz", "rar", "7z",
    "mp3", "wav", "flac", "mp4", "avi", "mov", "mkv", "webm", "css", "js", "woff", "woff2", "ttf", "eot",
)
TRACKING_PREFIX, TRACKING_NAMES = "utm_", ("fbclid", "gclid")
DEFAULT_PORTS = {"http": 80, "https": 443}
SKIPPED_SCHEMES = ("mailto:", "javascript:", "tel:", "ftp:", "file:", "data:", "blob:")
TWO_LABEL_SUFFIXES = ("co.uk", "ac.uk")
INDEX_FILES = ("index.html", "index.htm", "index.jsp", "main.html")

_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def url_host(url: Column) -> Column:
    """Lower-cased host without user info and port; empty where there is none."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*).*$", "$1")
    return F.lower(F.regexp_replace(host, r"[\[\]]", ""))


def url_domain(url: Column) -> Column:
    """The last two labels of the host, three under co.uk and ac.uk; the host itself if shorter."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) < 2, host).when((F.size(labels) >= 3) & last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def url_superdomain(url: Column) -> Column:
    return F.element_at(F.split(url_host(url), r"\."), -1)


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def canonical(url: str, rewrite_index: bool = False) -> str:
    """Canonical form of one URL; raises ValueError for an invalid port, like urllib."""
    parts = urlparse(urldefrag(url)[0])
    scheme = parts.scheme.lower()
    netloc = (parts.hostname or "").lower()
    if parts.port and DEFAULT_PORTS.get(scheme) != parts.port:
        netloc += f":{parts.port}"
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith(TRACKING_PREFIX) and k.lower() not in TRACKING_NAMES)
    path = "" if parts.path == "/" else parts.path
    if rewrite_index:
        head, _, tail = path.rpartition("/")
        if tail.lower() in INDEX_FILES:
            path = head + "/" if head else ""
    return urlunparse((scheme, netloc, path, "", urlencode(kept), ""))


def canonical_or_none(url: str) -> str | None:
    try:
        return canonical(url)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonicalize(url: pd.Series) -> pd.Series:
    """Canonical URL: see canonical(); null for a null or invalid URL."""
    return url.map(canonical_or_none, na_action="ignore")


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href resolved against base; null if either is null or invalid."""

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def canonical_simple(url: Column) -> Column:
    """Canonical form in JVM expressions, for URLs without user info, parameters (;) and characters
    that need re-encoding; equal to canonicalize() on those."""
    bare = defragment(url)
    scheme = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.lower(F.regexp_extract(bare, _AUTHORITY, 1))
    default = ((scheme == "http") & authority.endswith(":80")) | ((scheme == "https") & authority.endswith(":443"))
    authority = F.when(default, F.regexp_replace(authority, r":\d+$", "")).otherwise(authority)
    path = F.regexp_extract(bare, r"^[^:]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|fbclid|gclid)(=|$)"))
    whole = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    return F.concat(scheme, F.lit("://"), authority, F.when(path == "/", "").otherwise(path), F.when(whole != "", F.concat(F.lit("?"), whole)).otherwise(""))


def looks_binary(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1))
    return path.rlike(rf"\.({'|'.join(BINARY_SUFFIXES)})$")


def is_cgi(url: Column) -> Column:
    return F.lower(url).contains("cgi")


def is_page_href(href: Column) -> Column:
    """Whether an href leads to a page: not empty, no fragment, none of the skipped schemes (case-sensitive)."""
    h = F.trim(href)
    return (h != "") & ~h.rlike(r"^(#|" + "|".join(SKIPPED_SCHEMES) + ")")
