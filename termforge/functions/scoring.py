"""Scoring expressions: BM25 and crawl priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default BM25 parameters and priority weights.
K1, B = 1.2, 0.75
SUPER_WEIGHT, DEPTH_WEIGHT = 0.1, 1.0


def bm25_idf(df: Column, n: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(tf: Column, dl: Column, idf: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """BM25 contribution of one query term; a missing or zero length contributes 0."""
    norm = tf + k1 * (1.0 - b + b * dl / avgdl)
    return F.when(dl > 0, idf * tf * (k1 + 1.0) / norm).otherwise(F.lit(0.0))


def page_score(domain_before: Column) -> Column:
    return 1.0 / F.log2(domain_before + 2.0)


def super_score(super_before: Column, weight: float = SUPER_WEIGHT) -> Column:
    return F.lit(weight) / F.log2(super_before + 2.0)


def total_priority(domain_before: Column, super_before: Column, depth: Column, super_w: float = SUPER_WEIGHT, depth_w: float = DEPTH_WEIGHT) -> Column:
    return page_score(domain_before) + super_score(super_before, super_w) + F.lit(depth_w) / (depth + 1.0)


def shown_score(score: Column) -> Column:
    """A score as a page shows it: 3 decimals, N/A for none or zero."""
    return F.when(score != 0, F.format_string("%.3f", score)).otherwise("N/A")
