import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from termforge.operators import skew


def data(seed=0, n=4000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        k = "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c", "d"])
        rows.append((k, rng.choice([None, *range(12)]) if k != "d" else None, "n", 1.0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, n_rows string, _weightless double")


def test_summary(spark):
    rows = data()
    got = {r["k"]: (r["n_rows"], r["n_distinct"], r["mode"]) for r in skew.key_summary(skew.compress_values(frame(spark, rows), "k", "v"), "k", "v").collect()}
    by = defaultdict(list)
    for k, v, *_ in rows:
        if k is not None:
            by[k].append(v)
    want = {}
    for k, vs in by.items():
        c = Counter(v for v in vs if v is not None)
        want[k] = (len(vs), len(c), min((v for v in c if c[v] == max(c.values())), default=None))
    assert got == want and got["d"][2] is None


def test_percentiles(spark):
    rows = data(1)
    out = skew.weighted_percentiles(skew.compress_values(frame(spark, rows), "k", "v"), "k", "v", (0.0, 0.5, 0.9, 1.0))
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    by = defaultdict(list)
    for k, v, *_ in rows:
        if k is not None and v is not None:
            by[k].append(v)
    want = {k: tuple(sorted(vs)[max(1, math.ceil(p * len(vs))) - 1] for p in (0.0, 0.5, 0.9, 1.0)) for k, vs in by.items()}
    assert got == want and "d" not in got


def test_heavy_keys_and_lookup(spark):
    rows = data(2)
    big = frame(spark, rows)
    s = skew.key_summary(skew.compress_values(big, "k", "v"), "k", "v")
    hot = skew.hot_keys(s, "k", one_in=5)
    assert [tuple(r) for r in hot.collect()] == [("hot", 2 + (10 * s.where("k = 'hot'").first()["n_rows"] > 4 * s.agg(F.sum("n_rows")).first()[0]))]
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("zzz", 3)], "k string, w int")
    got = Counter((r["k"], r["v"], r["w"]) for r in skew.salted_lookup(big, small, "k", hot, ["v"]).select("k", "v", "w").collect())
    assert got == Counter((k, v, {"hot": 1, "a": 2}[k]) for k, v, *_ in rows if k in ("hot", "a"))


def test_every_hot_key_is_split_by_its_weight(spark):
    """Keys of a half, of just under one in eighty and of a task's share: no part exceeds the share, none is lost."""
    one_in = 200
    weights = {"half": 10_000, "under": 240, "share": 100, "rest": 90}
    rest = 20_000 - sum(weights.values())
    summary = spark.createDataFrame([*weights.items(), *((f"r{i}", 1) for i in range(rest)), (None, 5000)], "k string, n_rows bigint")
    total = 20_000
    ways = {r["k"]: r["_ways"] for r in skew.hot_keys(summary, "k", one_in=one_in).collect()}
    assert ways == {"half": 100, "under": 3} and all(weights[k] / w <= total / one_in for k, w in ways.items())
    big = summary.where("k IN ('half', 'under')").select("k", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("v"))
    small = spark.createDataFrame([("half", "x"), ("under", "y")], "k string, w string")
    out = skew.salted_lookup(big, small, "k", skew.hot_keys(summary, "k", one_in=one_in), ["v"])
    assert {r["w"]: r["n"] for r in out.groupBy("w").agg(F.countDistinct("v").alias("n")).collect()} == {"x": 10_000, "y": 240}
    assert skew.least_share(spark) == 80


def test_empty(spark):
    c = skew.compress_values(frame(spark, []), "k", "v")
    s = skew.key_summary(c, "k", "v")
    assert s.count() == 0 and skew.heavy_keys(s, "k", 80).count() == 0 and skew.weighted_percentiles(c, "k", "v", (0.5,)).count() == 0


def test_clashing_value_column_name(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, n_rows int").withColumn("total", F.lit(1))
    assert skew.key_summary(skew.compress_values(df, "k", "n_rows"), "k", "n_rows").first()["n_distinct"] == 1
