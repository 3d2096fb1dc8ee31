import random
from collections import defaultdict

from termforge.operators.ranges import numbered


def test_numbers_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([1, None]), "x") for i in rng.sample(range(10_000), 1500)]
    df = spark.createDataFrame(rows, "o bigint, k string, c int, _key0x string")
    got = {r["o"]: (r["k"], r["c"], r["_no"], r["_prev"]) for r in numbered(df, ["k", "c"], "o").collect()}
    seen, want = defaultdict(list), {}
    for o, k, c, _ in sorted(rows):
        want[o] = (k, c, len(seen[k, c]), seen[k, c][-1] if seen[k, c] else None)
        seen[k, c].append(o)
    assert got == want
    whole = {r["o"]: r["_no"] for r in numbered(df, [], "o").collect()}
    assert whole == {o: n for n, o in enumerate(sorted(r[0] for r in rows))}


def test_empty(spark):
    assert numbered(spark.createDataFrame([], "o bigint, k string"), ["k"], "o").count() == 0
