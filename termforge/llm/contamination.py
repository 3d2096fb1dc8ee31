"""Evaluation texts leaking into training text: prefix-filtered join on word shingles.

A passage of `window` words of an item is contained in a document only if each of its shingles
is. Shingles are ordered by rarity (number of documents holding them, over all documents), and
of each window only the necessary prefix, its rarest shingle, is joined with the documents;
a window one of whose shingles occurs nowhere is dropped. A hit fixes the alignment of item
and document: length and position say which words must agree, and these are compared exactly.

Items are taken in blocks of bounded size. A block's index is broadcast, the documents are
scanned where they are, and nothing of them is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.batches import slices, words

WINDOW = 10
SHINGLE = 5
BLOCK_WORDS = 1_000_000
# Alignments of items and documents compared at once.
ALIGNMENTS = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_codes(ids: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit code for each run of k word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _BASE + x[j : j + n]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _numbered(vocabulary: dict[str, int], texts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, 0 for words of no item; texts lie k zeros apart. Also their starts,
    and the positions of shingles made of item words only."""
    flat: list[int] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    gap, get = [0] * k, vocabulary.get
    for i, t in enumerate(texts):
        starts[i] = len(flat)
        flat.extend([get(w, 0) for w in words(t)])
        flat.extend(gap)
    starts[-1] = len(flat)
    ids = np.array(flat, np.int64)
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    at = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.zeros(0, np.int64)
    return ids, starts, at


class ItemBlock:
    """Items (item_id, words) of one block with their shingles."""

    def __init__(self, items: list[tuple], window: int = WINDOW, k: int = SHINGLE):
        self.window, self.k = window, k
        texts = [(i, words(t)) for i, t in items]
        self.items = [(i, w) for i, w in texts if len(w) >= window]
        self.vocabulary: dict[str, int] = {}
        for _, ws in self.items:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        self.codes = [shingle_codes(x, k) for x in ids]
        self.all_codes = np.unique(np.concatenate(self.codes)) if self.codes else np.zeros(0, np.uint64)
        # all items one after another, a window of no word around each
        gap = np.full(window, -1, np.int64)
        self.flat = np.concatenate([gap, *[part for x in ids for part in (x, gap)]])
        self.starts = window + np.concatenate([[0], np.cumsum([len(x) + window for x in ids])[:-1]]).astype(np.int64) if ids else np.zeros(0, np.int64)
        self.prefix_codes, self.upto = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.prefix_item, self.prefix_at = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def choose_prefixes(self, codes: np.ndarray, documents: np.ndarray) -> None:
        """Of each window its rarest shingle, from codes and the number of documents with them; a code that isn't there occurs
        in none, and neither does a window with it. Sets the entries (item, position) of each prefix code."""
        n_docs = np.zeros(len(self.all_codes), np.int64)
        n_docs[np.searchsorted(self.all_codes, codes)] = documents
        rank = np.empty(len(n_docs), np.int64)
        rank[np.lexsort((self.all_codes, n_docs))] = np.arange(len(n_docs))
        nowhere = int((n_docs == 0).sum())  # ranks below are of codes that occur nowhere
        per_window, found = self.window - self.k + 1, []
        for n, own in enumerate(self.codes):
            ranks = np.lib.stride_tricks.sliding_window_view(rank[np.searchsorted(self.all_codes, own)], per_window)
            rarest = ranks.argmin(axis=1)
            there = ranks.min(axis=1) >= nowhere
            at = np.unique((np.arange(len(ranks)) + rarest)[there])
            found.append(np.stack([own[at].view(np.int64), np.full(len(at), n), at]))
        code, item, at = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.argsort(code.view(np.uint64), kind="stable")
        self.prefix_codes, first = np.unique(code.view(np.uint64)[order], return_index=True)
        self.upto = np.append(first, len(order))
        self.prefix_item, self.prefix_at = item[order], at[order]

    def matches(self, doc: np.ndarray, q: np.ndarray, codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item), distinct, for hits: positions q of document words with a prefix code, and the text each lies in.

        A hit aligns the document with every entry of its code; an alignment matches if a run of at least `window` equal
        words passes through it. Alignments are compared in slices of bounded size.
        """
        which = np.searchsorted(self.prefix_codes, codes)
        n_entries = self.upto[which + 1] - self.upto[which]
        done = np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(n_entries)])
        reach = np.arange(-(self.window - 1), self.window)
        for low in range(0, int(bounds[-1]), ALIGNMENTS):
            pair = np.arange(low, min(low + ALIGNMENTS, int(bounds[-1])))
            hit = np.searchsorted(bounds, pair, side="right") - 1
            entry = self.upto[which[hit]] + pair - bounds[hit]
            key = text[hit] * len(self.items) + self.prefix_item[entry]
            new = ~np.isin(key, done)
            hit, entry, key = hit[new], entry[new], key[new]
            at = self.starts[self.prefix_item[entry]] + self.prefix_at[entry]
            place = q[hit][:, None] + reach
            inside = (place >= 0) & (place < len(doc))
            equal = inside & (doc[np.where(inside, place, 0)] == self.flat[at[:, None] + reach])
            left = np.logical_and.accumulate(equal[:, self.window - 1 :: -1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(equal[:, self.window - 1 :], axis=1).sum(axis=1)
            done = np.union1d(done, key[left + right - 1 >= self.window])
        return done // max(1, len(self.items)), done % max(1, len(self.items))


def _member(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(codes):
        return np.zeros(len(codes), bool)
    where = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return table[where] == codes


def _frequencies(shared):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: ItemBlock = shared.value
        n = np.zeros(len(block.all_codes), np.int64)
        for batch in batches:
            for pdf in slices(batch):
                ids, starts, at = _numbered(block.vocabulary, pdf["text"].tolist(), block.k)
                codes = shingle_codes(ids, block.k)[at] if len(at) else np.zeros(0, np.uint64)
                hit = _member(codes, block.all_codes)
                text_of = np.searchsorted(starts, at[hit], side="right") - 1
                which = np.searchsorted(block.all_codes, codes[hit])
                pairs = np.unique(text_of * len(block.all_codes) + which) if len(which) else np.zeros(0, np.int64)
                n += np.bincount(pairs % max(1, len(n)), minlength=len(n)) if len(n) else 0
        some = np.flatnonzero(n)
        yield pd.DataFrame({"code": block.all_codes[some].view(np.int64), "n": n[some]})

    return count


def _matches(shared):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: ItemBlock = shared.value
        for batch in batches:
            for pdf in slices(batch):
                ids, starts, at = _numbered(block.vocabulary, pdf["text"].tolist(), block.k)
                codes = shingle_codes(ids, block.k)[at] if len(at) else np.zeros(0, np.uint64)
                hit = _member(codes, block.prefix_codes)
                q = at[hit]
                texts, items = block.matches(ids, q, codes[hit], np.searchsorted(starts, q, side="right") - 1)
                if len(texts):
                    yield pd.DataFrame({"item_id": [block.items[n][0] for n in items.tolist()], "doc_id": pdf["doc_id"].iloc[texts].tolist()})

    return match


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(item_id, doc_id), distinct: `window` consecutive words of the item are consecutive in the document.

    Items and documents that are null, empty or shorter than the window match nothing. Items are
    handled in as many blocks as keep each near `block_words` words, by a hash of text and id,
    so what is broadcast stays bounded however many items there are; each block costs two scans
    of the documents. All texts are read whole.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    wanted = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(chars) // (2 * block_words)
    out = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block = ItemBlock([(r[0], r[1]) for r in rows], window, shingle)
        counted = corpus.mapInPandas(_frequencies(spark.sparkContext.broadcast(block)), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
        frequency = counted.toPandas()  # at most one row per item shingle
        block.choose_prefixes(frequency["code"].to_numpy(np.int64).view(np.uint64), frequency["n"].to_numpy(np.int64))
        found = corpus.mapInPandas(_matches(spark.sparkContext.broadcast(block)), "item_id string, doc_id string")
        out = found if out is None else out.unionByName(found)
    kinds = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    return out.distinct().select(F.col("item_id").cast(kinds[0]).alias("item_id"), F.col("doc_id").cast(kinds[1]).alias("doc_id"))
