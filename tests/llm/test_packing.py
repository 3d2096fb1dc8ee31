import math
import random
import re
from collections import defaultdict

import numpy as np

from termforge.llm import packing as P

SCHEMA = "doc_id bigint, text string, n_tokens int, capacity string, shard string"


def documents(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = max(1, int(rng.lognormvariate(3.5, 1)))
        rows.append((i, "w, " * (words // 2) + "x" * (words % 2), None if rng.random() < 0.3 else words, "c", "s"))
    return rows + [(n, None, None, "c", "s"), (n + 1, "", None, "c", "s"), (n + 2, None, 7, "c", "s")]


def sizes(rows):
    return {i: (n if n is not None else len(re.findall(r"\w+|[^\w\s]+", t or ""))) for i, t, n, *_ in rows}


def test_assignment_is_complete_and_fits(spark):
    rows = documents()
    kinds = spark.createDataFrame([(1, 64, "a"), (2, 512, "b"), (None, 5, "c"), (3, None, "d"), (4, 0, "e")], "container_id int, capacity int, size_class string")
    out = P.pack_documents(spark.createDataFrame(rows, SCHEMA), kinds, shard_pieces=500).collect()
    size = sizes(rows)
    for kind, capacity in ((1, 64), (2, 512)):
        own = [r for r in out if r["container_id"] == kind]
        fill, parts = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r["shard"], r["seq_no"]] += r["n_tokens"]
            parts[r["doc_id"]].append((r["part_no"], r["n_tokens"], r["n_parts"]))
        assert max(fill.values()) <= capacity
        assert {i: sum(t for _, t, _ in ps) for i, ps in parts.items()} == {i: s for i, s in size.items() if s}
        assert all(len(ps) == math.ceil(size[i] / capacity) == ps[0][2] for i, ps in parts.items())
        assert sum(fill.values()) / (capacity * len(fill)) > 0.9
    assert {r["container_id"] for r in out} == {1, 2}


def test_cost_is_balanced():
    rng = np.random.default_rng(3)
    tokens = np.sort(rng.integers(1, 400, 2000))[::-1].astype(np.int64)
    where = P.assign(tokens, 1024, 1.0, 1.0 / 256)
    cost = np.bincount(where, P.LINEAR * tokens + tokens.astype(float) ** 2 / 256)
    first_fit, room, naive = [], [], []
    for t in tokens.tolist():
        k = next((k for k, r in enumerate(room) if r >= t), len(room))
        if k == len(room):
            room.append(1024)
        room[k] -= t
        naive.append(k)
    first_fit = np.bincount(naive, tokens + tokens.astype(float) ** 2 / 256)
    assert len(cost) <= 1.05 * len(room) and cost.std() / cost.mean() < 0.5 * first_fit.std() / first_fit.mean()


def test_equal_sizes_single_piece_and_full_pieces():
    assert P.assign(np.array([10]), 10).tolist() == [0]
    assert sorted(np.bincount(P.assign(np.full(9, 5), 10)).tolist()) == [1, 2, 2, 2, 2]
    assert sorted(P.assign(np.full(4, 10), 10).tolist()) == [0, 1, 2, 3]


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c", None, "c", "s"), (None, "a b c", None, "c", "s"), (5, "x y", None, "c", "s"), (5, "x y", None, "c", "s")]
    out = P.pack_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, 4)], "container_id int, capacity int")).collect()
    assert len(out) == 4 and sum(r["n_tokens"] for r in out) == 10


def test_token_count_is_pythons(spark):
    texts = ["a_b c-d  e", "x² ½ ǆ", "日本語、テスト", "é combining", "\x1cx\x85y z", "...!? a", "½½", "ａ＿ｂ", "" , "  "]
    rows = [(i, t, None, "", "") for i, t in enumerate(texts)]
    got = {int(r["doc_id"]): r["tokens"] for r in P.document_sizes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: len(re.findall(r"\w+|[^\w\s]+", t)) for i, t in enumerate(texts)}


def test_empty_and_limits(spark):
    e = spark.createDataFrame([], SCHEMA)
    kinds = spark.createDataFrame([(1, 8)], "container_id int, capacity int")
    assert P.pack_documents(e, kinds).count() == 0
    assert P.pack_documents(spark.createDataFrame(documents(5), SCHEMA), kinds.where("false")).count() == 0


def test_more_containers_than_a_block(spark):
    kinds = spark.range(1100).selectExpr("id as container_id", "cast(8 + id % 3 as int) as capacity")
    docs = spark.createDataFrame(documents(8), SCHEMA)
    out = P.packing_summary(P.pack_documents(docs, kinds))
    size = {i: s for i, s in sizes(documents(8)).items() if s}
    got = {(r["container_id"], r["doc_id"]): (r["n_parts"], r["n_tokens"], r["whole"], r["fits"]) for r in out.collect()}
    assert got == {(k, i): (math.ceil(s / (8 + k % 3)), s, True, True) for k in range(1100) for i, s in size.items()}


def test_summary_tells_bad_packings(spark):
    fine = [(1, 0, 0, "a", 0, 1, 5, 10), (1, 0, 1, "b", 0, 2, 10, 10), (1, 0, 2, "b", 1, 2, 2, 10)]
    bad = [(2, 0, 0, "a", 0, 1, 6, 10), (2, 0, 0, "c", 0, 1, 6, 10), (2, 0, 1, "b", 0, 2, 10, 10), (2, 0, 2, "d", 0, 2, 3, 10), (2, 0, 3, "d", 1, 2, 3, 10)]
    got = {(r["container_id"], r["doc_id"]): (r["whole"], r["fits"]) for r in P.packing_summary(spark.createDataFrame(fine + bad, P.ASSIGNMENT)).collect()}
    assert got == {(1, "a"): (True, True), (1, "b"): (True, True), (2, "a"): (True, False), (2, "c"): (True, False), (2, "b"): (False, False), (2, "d"): (True, False)}
