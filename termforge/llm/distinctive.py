"""How distinctive a term is per record: log-odds with an informative Dirichlet prior.

For term w of document d with tf occurrences among dl, the rest of the collection being the other
documents, and a prior that spreads `strength` pseudo-occurrences over the terms in
proportion to their document frequency (alpha_w = strength * df_w / sum of df):

    delta    = ln((tf + alpha_w) / (dl + strength - tf - alpha_w))
             - ln((cf - tf + alpha_w) / (N - dl + strength - (cf - tf) - alpha_w))
    variance = 1 / (tf + alpha_w) + 1 / (cf - tf + alpha_w)
    z        = delta / sqrt(variance)

cf is the term's occurrences in the collection and N all occurrences. Common terms get a z near
or below 0, terms concentrated in the document a high one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.operators.index import run_postings
from termforge.operators.skew import hot_keys, salted_lookup
from termforge.session import materialize

STRENGTH = 1000.0


def record_postings(run: DataFrame) -> DataFrame:
    """(term, docid, tf): tf summed over the distinct records (term, docid, chunk_no, tf).

    Rows with a null term or docid are damaged and left out; a null tf adds nothing. See run_postings.
    """
    return run_postings(run).select("term", F.col("doc_id").alias("docid"), "tf")


def z_score(tf: Column, dl: Column, df: Column, cf: Column, n: Column, n_postings: Column, strength: float) -> Column:
    """Null where it is undefined: a logarithm of nothing, or a division by it."""
    a = strength * df / n_postings
    rest = cf - tf
    inside = F.ln(F.try_divide(tf + a, dl + strength - tf - a))
    outside = F.ln(F.try_divide(rest + a, n - dl + strength - rest - a))
    return F.try_divide(inside - outside, F.sqrt(F.try_divide(F.lit(1.0), tf + a) + F.try_divide(F.lit(1.0), rest + a)))


@dataclass(frozen=True)
class Concentrated:
    """Postings whose tf is at least `tf` and at least `per_cent` % of the length, of terms with df from `least_df` to `most_df`."""

    tf: int
    per_cent: int
    least_df: int
    most_df: int

    def exact(self) -> Column:
        return (F.col("tf") >= self.tf) & (F.col("tf") * 100 >= F.col("dl") * self.per_cent) & F.col("df").between(self.least_df, self.most_df)


def z_floor(c: Concentrated, n: int, n_postings: int, longest: int, least_rest: int, most_rest: int, strength: float = STRENGTH) -> float:
    """A z that no posting fulfilling `c` can fall below.

    longest is the greatest length, least_rest and most_rest bound cf - tf over such postings. Write u = cf - tf + a with
    alpha a between a0 and a1, so u is between least_rest + a0 and most_rest + a1. Then

    - (tf + a) / (dl + strength - tf - a) >= (tf + a0) / (tf * (1 / s - 1) + strength - a0) with s the least share, as
      dl <= tf / s. In tf this is monotone, from its value at c.tf to s / (1 - s); the smaller of the two bounds it;
    - (rest + a) / (n - dl + strength - rest - a) <= u / (n - longest + strength - most_rest - a1);
    - the variance is at most 1 / (c.tf + a0) + 1 / u.

    So z >= g(u) = (C - ln u) / sqrt(1 / t + 1 / u). Where C > ln u, u * (ln g)' = -1 / (C - ln u) + t / (2 * (u + t)) falls
    strictly, so g rises at most first and falls then, and is least at an end of the interval. Elsewhere
    nothing is claimed, and the floor is minus infinity.
    """
    a0, a1 = strength * c.least_df / n_postings, strength * c.most_df / n_postings
    s, t = c.per_cent / 100, c.tf + a0
    outside = n - longest + strength - most_rest - a1
    inside = c.tf * (1 / s - 1) + strength - a0
    low, high = least_rest + a0, most_rest + a1
    if outside <= 0 or inside <= 0 or low <= 0 or high < low or not 0 < s < 1:
        return -math.inf
    top = math.log(min(t / inside, s / (1 - s))) + math.log(outside)
    if top <= math.log(high):
        return -math.inf
    return min((top - math.log(u)) / math.sqrt(1 / t + 1 / u) for u in (low, high)) - 1e-9


def distinctive_terms(
    postings: DataFrame, doc_lengths: DataFrame | None = None, term_df: DataFrame | None = None, strength: float = STRENGTH,
    only: Concentrated | None = None
) -> DataFrame:
    """(term, docid, tf, dl, df, cf, z) for every posting (term, docid, tf), or for those that may be `only`.

    doc_lengths (docid, dl) and term_df (term, df) give the lengths and document frequencies
    kept with the index; where they have no value, or aren't given, it is counted from the
    postings. Every posting comes out, ordered by nothing; z is null only where it is undefined
    (a document of one term being the whole collection of one term). With `only`, postings whose z is below
    the least one such postings can have (see z_floor) are left out; all that fulfil it are among the rest,
    as are those without a z. Postings with null fields must have been removed (record_postings does). Terms and documents
    holding more than a task's share of the postings are split by their weight.
    """
    kept = materialize(postings.select("term", "docid", "tf"), "postings")
    docs = kept.groupBy("docid").agg(F.sum("tf").alias("dl"), F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("n_terms"))
    terms = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("cf"), F.max("tf").alias("most"))
    if doc_lengths is not None:
        given = doc_lengths.select("docid", F.col("dl").cast("bigint").alias("_dl"))
        docs = docs.join(given, "docid", "left").withColumn("dl", F.coalesce("_dl", "dl")).drop("_dl")
    if term_df is not None:
        given = term_df.select("term", F.col("df").cast("bigint").alias("_df"))
        terms = terms.join(given, "term", "left").withColumn("df", F.coalesce("_df", "df")).drop("_df")
    docs, terms = materialize(docs, "documents"), materialize(terms, "terms")
    n, n_postings, longest = docs.agg(F.coalesce(F.sum("occurrences"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.coalesce(F.max("dl"), F.lit(0))).first()
    rows = salted_lookup(kept, docs.select("docid", "dl"), "docid", hot_keys(docs, "docid", "n_terms"), ["term"])
    rows = salted_lookup(rows, terms.select("term", "df", "cf"), "term", hot_keys(terms, "term", "n_docs"), ["docid"])
    z = z_score(F.col("tf"), F.col("dl"), F.col("df"), F.col("cf"), F.lit(n), F.lit(max(1, n_postings)), strength)
    scored = rows.select("term", "docid", "tf", "dl", "df", "cf", z.alias("z"))
    if only is None:
        return scored
    meant = terms.where(F.col("df").between(only.least_df, only.most_df) & (F.col("most") >= only.tf))
    rest = meant.agg(F.min(F.col("cf") - F.col("most")), F.max(F.col("cf") - only.tf)).first()
    floor = z_floor(only, n, max(1, n_postings), longest, rest[0] or 0, rest[1] or 0, strength)
    return scored.where(F.col("z").isNull() | (F.col("z") >= floor)) if floor > -math.inf else scored
