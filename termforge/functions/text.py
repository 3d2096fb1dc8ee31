"""Column expressions on text: words, tokens, entity decoding."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token pattern of the indexing tokenizer, the public word-and-punctuation
# tokenizer, and the word definition (maximal runs of letters or digits).
INDEX_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
WORD = r"[\p{L}\p{N}]+"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
PUBLIC_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(text: Column | str) -> Column:
    """HTML entities decoded; only texts with an ampersand leave the JVM's fast path untouched."""
    return _unescape(col(text))


try:  # optional text repair of the tokenizer's pipeline; without it texts are only entity-decoded
    import ftfy

    HAVE_REPAIR = True
except ImportError:
    HAVE_REPAIR = False


@F.pandas_udf(T.StringType())
def repair_text(s: pd.Series) -> pd.Series:
    """Text repaired by the optional library where it is installed, else unchanged (HAVE_REPAIR tells)."""
    return s.map(ftfy.fix_text, na_action="ignore") if HAVE_REPAIR else s


@F.pandas_udf(T.StringType())
def body_text(s: pd.Series) -> pd.Series:
    """Bytes of a page as UTF-8 text, malformed bytes as U+FFFD."""
    return s.map(lambda b: bytes(b).decode("utf-8", errors="replace"), na_action="ignore")


def utc_text(ts: Column | str) -> Column:
    """Timestamp as YYYY-MM-DDThh:mm:ssZ; the session's time zone must be UTC."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def index_tokens(text: Column | str) -> Column:
    """Tokens of the index: lower-cased ASCII words, inner dots and hyphens kept. Null for null."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(INDEX_TOKEN), F.lit(0))


def query_terms(query: Column | str) -> Column:
    """Lower-cased, split at white space, nothing else cleaned; repeats stay."""
    return F.filter(F.split(F.lower(col(query)), r"(?U)\s+"), lambda x: x != "")


def words(text: Column | str) -> Column:
    """Lower-cased maximal runs of letters or digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def public_token_count(text: Column | str) -> Column:
    """Number of tokens of the public word-and-punctuation tokenizer; 0 for null text."""
    return F.coalesce(F.regexp_count(col(text), F.lit(PUBLIC_TOKEN)), F.lit(0))
