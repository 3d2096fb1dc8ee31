import random
from collections import defaultdict

from termforge.operators import consolidate as C
from termforge.session import scratch_path

SCHEMA = "file_id bigint, term string, docid bigint, chunk_no int, tf int, seq string, n_copies string"


def run_rows(seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        term = "the" if rng.random() < 0.4 else rng.choice([None, "a", "b", "zebra", "été", ""])
        rows.append((rng.randrange(40), term, rng.randrange(30), rng.choice([0, 1, None]), rng.choice([1, 2, None]), "x", "y"))
    return rows


def test_report_matches_brute_force(spark):
    rows = run_rows()
    run = spark.createDataFrame(rows, SCHEMA)
    by_file, first, n_rows = defaultdict(set), {}, defaultdict(int)
    for f, *rec in [r[:5] for r in rows]:
        if rec[0] is not None:
            by_file[f].add(tuple(rec))
            first[tuple(rec)] = min(first.get(tuple(rec), f), f)
            n_rows[f] += 1
    want = {f: (n_rows[f], len(s), sum(first[r] == f for r in s)) for f, s in by_file.items()}
    got = {r["file_id"]: (r["n_rows"], r["n_distinct"], r["n_first"]) for r in C.source_report(C.merge_runs(run)).collect()}
    assert got == want


def test_null_source_is_never_first_if_another_has_the_record(spark):
    run = spark.createDataFrame([(None, "a", 1, 0, 1), (5, "a", 1, 0, 1), (None, "b", 1, 0, 1)], "file_id bigint, term string, docid bigint, chunk_no int, tf int")
    got = {(r["term"], r["repeat"]): r["file_id"] for r in C.merge_runs(run).collect()}
    assert got == {("a", False): 5, ("a", True): None, ("b", False): None}


def test_hot_record_is_combined_before_the_merge(spark, monkeypatch):
    """A record with a third of all rows, in every file: exact, and only its first row is merged."""
    monkeypatch.setattr(C, "LIGHT", 1)
    monkeypatch.setattr(C, "SAMPLED", 2)
    monkeypatch.setattr(C, "SUSPECT", 12)
    monkeypatch.setattr(C, "least_share", lambda spark: 40)
    rows = [(f, "hot", 1, 0, None) for f in [*range(300), *range(200), None]] + [(f % 300, f"t{f % 97}", f, 0, 1) for f in range(1000)]
    run = spark.createDataFrame(rows, "file_id bigint, term string, docid bigint, chunk_no int, tf int")
    assert len(C.hot_records(run.drop("file_id"), C.RECORD, run.count())) == 1
    merged = C.merge_runs(run)
    got = merged.where("term = 'hot'").collect()
    assert len(got) == 301 and [(r["file_id"], r["n_copies"]) for r in got if not r["repeat"]] == [(0, 2)]
    want = {f: (1 + (f < 200), 1, int(f == 0)) for f in range(300)}
    for f in range(1000):
        n, k, first = want[f % 300]
        want[f % 300] = (n + 1, k + 1, first + 1)
    want[None] = (1, 1, 0)
    assert {r["file_id"]: (r["n_rows"], r["n_distinct"], r["n_first"]) for r in C.source_report(merged).collect()} == want
    path = scratch_path(spark, "t")
    C.consolidate(run, path, target_bytes=4000, keep_duplicates=True)
    assert C.consolidated(spark, path, run.schema).count() == len(rows)


def test_one_shuffle(spark):
    run = spark.createDataFrame(run_rows(), SCHEMA)
    plan = C.merge_runs(run)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan


def test_consolidated_files(spark):
    rows = run_rows(2)
    run = spark.createDataFrame(rows, SCHEMA)
    path = scratch_path(spark, "t")
    ranges = C.consolidate(run, path, target_bytes=4000).orderBy("first_key").collect()
    want = {r[1:5] for r in rows if r[1] is not None}
    back = [tuple(r) for r in C.consolidated(spark, path, run.schema).collect()]
    assert {(r["file_id"], *r[:4]) for r in C.merged_rows(spark, path, run.schema).collect()} == {r[:5] for r in rows if r[1] is not None}
    assert len(back) == len(want) and set(back) == want
    assert sum(r["n_rows"] for r in ranges) == len(want)
    assert all(a["last_key"] <= b["first_key"] for a, b in zip(ranges, ranges[1:], strict=False))


def test_files_are_sorted_and_duplicates_kept_on_request(spark):
    rows = run_rows(3, 500)
    run = spark.createDataFrame(rows, SCHEMA)
    path = scratch_path(spark, "t")
    C.consolidate(run, path, target_bytes=1 << 20, keep_duplicates=True)
    back = [r["term"] for r in C.consolidated(spark, path, run.schema).collect()]
    assert len(back) == sum(r[1] is not None for r in rows) and back == sorted(back)


def test_empty(spark):
    run = spark.createDataFrame([], SCHEMA)
    assert C.consolidate(run, scratch_path(spark, "t")).count() == 0
    assert C.source_report(C.merge_runs(run)).count() == 0
