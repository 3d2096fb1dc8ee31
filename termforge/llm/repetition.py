"""Repetition inside a single document, with risk-controlled cutoffs.

The share of repeated words is measured exactly for every document. Which share makes a document
be rejected is chosen per stratum (length class) from labelled documents: cutoffs are
tried from strict to lenient, and a cutoff is certified while the exact binomial upper bound
of its false rejections stays below the allowed risk, the error being shared among strata
and cutoffs (Bonferroni), so all certified cutoffs hold together.

Labels tell which documents are repetitive by another measure than the share. Where none are given every document is labelled
by how well its own word order compresses (see order_saving), which knows nothing of runs of words.
"""

from __future__ import annotations

import lzma
import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm.batches import coded, slices
from termforge.session import materialize

RUN = 6
SHARE = 0.3
CUTOFFS = (0.60, 0.50, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10)
# A text is labelled repetitive if its word order saves this part of what its words in random order take, compressed:
# half of what repeating SHARE of the words should save, as naming a repeat costs something, too.
SAVING = SHARE / 2
RISK = 0.05
ERROR = 0.05
STRATA = (100, 1000)
_LZMA = [{"id": lzma.FILTER_LZMA2, "preset": 1, "dict_size": 1 << 20, "lc": 0, "lp": 2, "pb": 2}]


def repeated_words(codes: np.ndarray, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Per text, how many words lie in a run of `run` words that also starts at an earlier word.

    Exact: a run is named by its text and, doubling up, by the names of the shorter runs it is
    made of, so different runs never share a name.
    """
    n, n_texts = len(codes), len(starts) - 1
    text_of = np.repeat(np.arange(n_texts), np.diff(starts))
    at = np.arange(n - run + 1) if n >= run else np.arange(0)
    at = at[text_of[at] == text_of[at + run - 1]] if len(at) else at
    if not len(at):
        return np.zeros(n_texts, np.int64)

    def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    name, length, by_length = codes, 1, {1: codes}
    while length * 2 <= run:
        name = named(name[: len(name) - length], name[length:])
        length *= 2
        by_length[length] = name
    whole, done = by_length[length][at], length
    for k in sorted(by_length, reverse=True):
        while done + k <= run:
            whole = named(whole, by_length[k][at + done])
            done += k
    whole = named(text_of[at], whole)
    first = np.zeros(len(at), bool)
    first[np.unique(whole, return_index=True)[1]] = True
    edge = np.zeros(n + 1, np.int64)
    again = at[~first]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def order_saving(text: str | None) -> float:
    """How much smaller a text's words compress in their own order than in a random one (seeded), as a share; 0 for fewer
    than two words. Words are written as numbers of fixed width, so neither spelling nor length of words counts."""
    codes, _ = coded([text])
    if len(codes) < 2:
        return 0.0
    shuffled = np.random.default_rng(len(codes)).permutation(codes)
    own, other = (len(lzma.compress(x.astype("<u4").tobytes(), format=lzma.FORMAT_RAW, filters=_LZMA)) for x in (codes, shuffled))
    return 1 - own / other


def _measure(run: int, label: bool):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch):
                texts = pdf["text"].tolist()
                codes, starts = coded(texts)
                saving = [order_saving(t) if label else None for t in texts]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": np.diff(starts), "n_repeated": repeated_words(codes, starts, run), "saving": saving}).astype({"saving": "float64"})

    return measure


def _measured(docs: DataFrame, doc_id: str, text: str, run: int, label: bool) -> DataFrame:
    """repetition() with saving, the order_saving of every row with `label`, else null."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))  # pandas has no integers with nulls
    out = rows.mapInPandas(_measure(run, label), "doc_id string, n_words bigint, n_repeated bigint, saving double")
    out = out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[doc_id])).withColumn("saving", F.when(~F.isnan("saving"), F.col("saving")))
    return out.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0)))


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_repeated, share) of every row.

    A word is repeated if it lies in a run of `run` words that also occurs starting at an
    earlier word of the text. A null, empty or short text has share 0. Whole texts are measured;
    rows are independent, so nothing is shuffled.
    """
    return _measured(docs, doc_id, text, run, False).drop("saving")


def upper_bound(errors: int, trials: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a proportion at confidence 1 - error.

    Above errors / trials the terms of the binomial tail fall from `errors` down, after d of them by exp(-d (d - 1) / 2 errors)
    at least; those that can't change the sum aren't added, so millions of errors take thousands of terms.
    """
    if errors >= trials:
        return 1.0
    k = np.arange(errors, max(0, errors - 50 - 10 * math.isqrt(errors)), -1, dtype=float)
    fall = np.concatenate([[0.0], np.cumsum(np.log(k / (trials - k + 1)))])
    steps, ways = np.arange(len(fall)), math.lgamma(trials + 1) - math.lgamma(errors + 1) - math.lgamma(trials - errors + 1)

    def at_most(p: float) -> float:
        first = ways + errors * math.log(p) + (trials - errors) * math.log1p(-p)
        return math.exp(first) * float(np.exp(fall + steps * (math.log1p(-p) - math.log(p))).sum())

    low, high = errors / trials, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or mid >= 1 or at_most(mid) > error:
            low = mid
        else:
            high = mid
    return high


def stratum(n_words: Column, edges: Sequence[int] = STRATA) -> Column:
    """Length class of a document: how many of the edges its number of words reaches."""
    return sum((F.when(n_words >= e, 1).otherwise(0) for e in edges), F.lit(0))


@dataclass(frozen=True)
class Certificate:
    """What the labelled documents say of a stratum: the lowest certified cutoff (null if none is), among how many good documents it
    rejects how many, and the upper bound of the rate that follows; the strictest cutoff's where none is certified."""

    stratum: int
    n_good: int
    cutoff: float | None
    n_rejected: int
    bound: float


def certificates(
    labelled: DataFrame, cutoffs: Sequence[float] = CUTOFFS, risk: float = RISK, error: float = ERROR, strata: int = len(STRATA) + 1
) -> list[Certificate]:
    """One certificate per stratum, from labelled rows (stratum, share, is_repetitive).

    A false rejection is a document at or above the cutoff that isn't repetitive; its rate is
    taken among the documents that aren't. Cutoffs are tried in the given, falling order and
    the first that fails ends a stratum; each test has the error divided by the number of
    strata and cutoffs. Rows with a null label or share don't count. Only one count per stratum and cutoff reaches
    the driver.
    """
    good = labelled.where(~F.col("is_repetitive") & F.col("share").isNotNull())
    counts = good.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("share") >= c, 1)).alias(f"c{i}") for i, c in enumerate(cutoffs)]
    )
    by_stratum = {row["stratum"]: row for row in counts.collect()}
    out = []
    for stratum_no in range(strata):
        row = by_stratum.get(stratum_no)
        n = row["n"] if row else 0
        found = Certificate(stratum_no, n, None, row["c0"] if row else 0, upper_bound(row["c0"] if row else 0, n, error / (strata * len(cutoffs))))
        for i, c in enumerate(cutoffs if row else ()):
            bound = upper_bound(row[f"c{i}"], n, error / (strata * len(cutoffs)))
            if bound > risk:
                break
            found = Certificate(stratum_no, n, c, row[f"c{i}"], bound)
        out.append(found)
    return out


def self_labelled(scored: DataFrame) -> DataFrame:
    """(stratum, share, is_repetitive) of all documents, labelled by their saving."""
    return scored.select("stratum", "share", (F.col("saving") >= SAVING).alias("is_repetitive"))


def measured_strata(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: bool = True) -> DataFrame:
    """(doc_id, n_words, n_repeated, share, stratum, saving) of every document, written once; saving is null without `label`."""
    return materialize(_measured(docs, doc_id, text, RUN, label).withColumn("stratum", stratum(F.col("n_words"))), "repetition")


def reject_repetitive(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labels: DataFrame | None = None,
    cutoffs: Sequence[float] = CUTOFFS, risk: float = RISK, error: float = ERROR, asked: float | None = None
) -> DataFrame:
    """(doc_id, n_words, n_repeated, share, stratum, cutoff, certified, rejected) of every document.

    labels (doc_id, is_repetitive) tell of the documents that cutoffs are chosen from; without them every document
    is labelled by its order_saving. A document is rejected if its share reaches the
    certified cutoff of its stratum. A stratum without one rejects nothing: its cutoff is null.

    With `asked`, a share from which documents must be rejected whatever the risk, cutoffs above it (or null) fall to it
    and are marked as not certified. Documents with a null id are measured, too.
    """
    scored = measured_strata(docs, doc_id, text, labels is None)
    labelled = self_labelled(scored) if labels is None else scored.join(labels.select("doc_id", "is_repetitive"), "doc_id")
    chosen = certificates(labelled, cutoffs, risk, error)
    used = [c.cutoff if asked is None or (c.cutoff is not None and c.cutoff <= asked) else asked for c in chosen]
    cut = F.element_at(F.array(*[F.lit(u).cast("double") for u in used]), F.col("stratum") + 1)
    sure = F.element_at(F.array(*[F.lit(u is not None and u == c.cutoff) for u, c in zip(used, chosen, strict=True)]), F.col("stratum") + 1)
    out = scored.drop("saving").withColumn("cutoff", cut).withColumn("certified", sure)
    return out.withColumn("rejected", F.coalesce(F.col("share") >= F.col("cutoff"), F.lit(False)))


def certificate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(stratum, n_good, cutoff, n_rejected, bound): the certificates reject_repetitive works with, one row a stratum."""
    found = certificates(self_labelled(measured_strata(docs, doc_id, text)))
    schema = "stratum int, n_good bigint, cutoff double, n_rejected bigint, bound double"
    return docs.sparkSession.createDataFrame([astuple(c) for c in found], schema)
