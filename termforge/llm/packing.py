"""Filling fixed-capacity sequences with documents: cost-balanced packing.

The cost of a piece of l tokens is linear * l + quadratic * l * l, an estimate of what training on
it takes (feed-forward and attention). Within a shard, pieces are taken in descending length
and each goes to the sequence of lowest cost that still has room for it; one is opened only where
none has. Shards are bounded in size and packed independently, so the work is spread and
no task sees more than a shard of one container.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.functions.text import public_token_count
from termforge.session import materialize

LINEAR = 1.0
QUADRATIC = 1.0 / 2048
SHARD_PIECES = 4096
CONTAINERS_AT_ONCE = 1000
ASSIGNMENT = T.StructType(
    [
        T.StructField("container_id", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("seq_no", T.IntegerType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("part_no", T.IntegerType()),
        T.StructField("n_parts", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("capacity", T.IntegerType()),
    ]
)


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """(doc_id, tokens): the id as a string, and the given token count, counted from the text where it is null."""
    given = F.col(n_tokens).cast("int")
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(given, public_token_count(F.col(text)).cast("int")).alias("tokens"))


def pieces(sizes: DataFrame, containers: Sequence[tuple[int, int]]) -> DataFrame:
    """(container_id, capacity, doc_id, part_no, n_parts, tokens): every document once per container.

    A document of at most `capacity` tokens is one piece; a longer one is cut into full pieces and
    a remainder. Documents without tokens take no room and have no piece.
    """
    kinds = F.array(*[F.struct(F.lit(int(i)).cast("bigint").alias("container_id"), F.lit(int(c)).alias("capacity")) for i, c in containers])
    rows = sizes.where(F.col("tokens") > 0).withColumn("kind", F.explode(kinds)).select("doc_id", "tokens", "kind.*")
    rows = rows.withColumn("n_parts", F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    rows = rows.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    left = F.col("tokens") - F.col("part_no") * F.col("capacity")
    return rows.select("container_id", "capacity", "doc_id", "part_no", "n_parts", F.least(left, F.col("capacity")).alias("tokens"))


def assign(tokens: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence number of each piece; tokens must be in descending order and at most capacity.

    Starts with as many sequences as the tokens fill at least. Some more starting numbers are
    tried, and of all packings the one with the fewest sequences, then of the least spread of
    cost, is kept.
    """
    costs = linear * tokens + quadratic * tokens.astype(np.float64) ** 2
    least = max(1, math.ceil(int(tokens.sum()) / capacity))
    best: tuple[tuple[int, float], np.ndarray] | None = None
    for start in dict.fromkeys([least, math.ceil(least * 1.01), math.ceil(least * 1.03)]):
        room = np.full(start + len(tokens), capacity, np.int64)
        cost = np.zeros(start + len(tokens))
        used, where = start, np.empty(len(tokens), np.int32)
        for i, (t, c) in enumerate(zip(tokens.tolist(), costs.tolist(), strict=True)):
            k = int(np.argmin(np.where(room[:used] >= t, cost[:used], np.inf)))
            if room[k] < t:
                k, used = used, used + 1
            where[i] = k
            room[k] -= t
            cost[k] += c
        score = (len(np.unique(where)), float(cost[:used].std()))
        if best is None or score < best[0]:
            best = (score, where)
    return np.unique(best[1], return_inverse=True)[1].astype(np.int32)


def _pack(linear: float, quadratic: float):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "part_no"], ascending=[False, True, True], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        return pd.DataFrame(
            {
                "container_id": pdf["container_id"], "shard": pdf["shard"], "seq_no": assign(pdf["tokens"].to_numpy(np.int64), capacity, linear, quadratic),
                "doc_id": pdf["doc_id"], "part_no": pdf["part_no"], "n_parts": pdf["n_parts"], "n_tokens": pdf["tokens"], "capacity": pdf["capacity"],
            }
        )

    return pack


def pack_documents(
    docs: DataFrame, containers: DataFrame, doc_id: str = "doc_id", text: str = "text", n_tokens: str = "n_tokens",
    linear: float = LINEAR, quadratic: float = QUADRATIC, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """(container_id, shard, seq_no, doc_id, part_no, n_parts, n_tokens, capacity): one row per piece.

    A sequence is (container_id, shard, seq_no) and holds at most `capacity` tokens; only
    documents longer than the capacity are cut (n_parts > 1). Documents with a null or empty text
    and no given size don't occur. A container with a null id, or a null or non-positive capacity is left out. Containers are
    taken in blocks of CONTAINERS_AT_ONCE, as literals of the scan, however many there are. Pieces go to shards of about `shard_pieces` by a hash of
    all their fields, which spreads pieces of one document and of equal ids.
    """
    usable = containers.select("container_id", "capacity").where(F.col("container_id").isNotNull() & (F.col("capacity") > 0)).distinct()
    id_kind = dict(docs.dtypes)[doc_id]
    sizes = materialize(document_sizes(docs, doc_id, text, n_tokens), "document-sizes")
    packed = None
    for kinds in _blocks(usable, CONTAINERS_AT_ONCE):
        rows = pieces(sizes, [(r[0], r[1]) for r in kinds])
        shards = max(1, math.ceil(rows.count() / len(kinds) / shard_pieces))
        sharded = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no", "tokens"), F.lit(shards)))
        block = sharded.groupBy("container_id", "shard").applyInPandas(_pack(linear, quadratic), ASSIGNMENT)
        packed = block if packed is None else packed.unionByName(block)
    if packed is None:
        packed = docs.sparkSession.createDataFrame([], ASSIGNMENT)
    return packed.withColumn("doc_id", F.col("doc_id").cast(id_kind))


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of at most `size`, one partition at a time on the driver."""
    it = rows.toLocalIterator()
    while block := list(islice(it, size)):
        yield block


def fill_report(assignment: DataFrame) -> DataFrame:
    """(container_id, n_sequences, least_sequences, n_shards, n_tokens, fill): how full the sequences of each container are, and
    how many of them its tokens would fill at least."""
    per_seq = assignment.groupBy("container_id", "shard", "seq_no", "capacity").agg(F.sum("n_tokens").alias("t"))
    return per_seq.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.ceil(F.sum("t") / F.max("capacity")).alias("least_sequences"), F.countDistinct("shard").alias("n_shards"),
        F.sum("t").alias("n_tokens"), (F.sum("t") / F.sum("capacity")).alias("fill"),
    )


def packing_summary(assignment: DataFrame) -> DataFrame:
    """(container_id, doc_id, n_parts, n_tokens, whole, fits): per document and container its pieces put together.

    whole: all parts 0 to n_parts - 1 are there once; fits: none of their sequences holds more than the capacity, and a
    document is cut only if it must be.
    """
    sequence = ["container_id", "shard", "seq_no"]
    loads = assignment.groupBy(*sequence).agg(F.sum("n_tokens").alias("_load"))
    rows = assignment.join(loads, sequence)
    return rows.groupBy("container_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.sum("n_tokens").alias("n_tokens"),
        ((F.count(F.lit(1)) == F.max("n_parts")) & (F.countDistinct("part_no") == F.max("n_parts")) & (F.max("part_no") == F.max("n_parts") - 1)).alias("whole"),
        (F.bool_and(F.col("_load") <= F.col("capacity")) & ((F.max("n_parts") == 1) | (F.sum("n_tokens") > F.max("capacity")))).alias("fits"),
    )
