"""Words of text batches as integer arrays, for the operators that run in Arrow batches."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd

_WORD = re.compile(r"[^\W_]+")
CHARS_AT_ONCE = 2_000_000


def words(text: str | None) -> list[str]:
    """Lower-cased maximal runs of letters or digits; none for a missing text."""
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def slices(pdf: pd.DataFrame, text: str = "text", chars: int = CHARS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The batch in pieces of at most `chars` characters of text, or of one row."""
    upto = pdf[text].str.len().fillna(0).astype("int64").cumsum().to_numpy()
    start, base = 0, 0
    while start < len(pdf):
        end = max(start + 1, int(np.searchsorted(upto, base + chars, side="right")))
        yield pdf.iloc[start:end]
        start, base = end, int(upto[end - 1])


def coded(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts in one array, equal words having equal codes, and where each text starts
    (one more entry than texts)."""
    code: dict[str, int] = defaultdict(count().__next__)
    parts = [words(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    flat = np.fromiter((code[w] for p in parts for w in p), np.int64, int(starts[-1]))
    return flat, starts
