import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termforge.llm import distinctive as D
from termforge.llm import term_counts as C

RUN = "file_id bigint, term string, docid bigint, chunk_no int, tf int, z string, df string"


def rows(seed=0, n=2000):
    rng = random.Random(seed)
    out = []
    for f in range(n // 20):
        for _ in range(20):
            term = "the" if rng.random() < 0.35 else rng.choice([None, "a", "b", "c", "rare%d" % rng.randrange(60)])
            out.append((f, term, rng.choice([None, *range(25)]) if rng.random() < 0.1 else rng.randrange(25), rng.randrange(3), rng.choice([None, 1, 2, 5]), "x", "y"))
    return out + out[:100]


def postings(data):
    recs = {(t, d, c, tf) for _, t, d, c, tf, *_ in data if t is not None and d is not None}
    p = defaultdict(int)
    for t, d, _, tf in recs:
        p[t, d] += tf or 0
    return p


def test_scores_match_the_formula(spark):
    data = rows()
    p = postings(data)
    dl, df, cf = defaultdict(int), defaultdict(int), defaultdict(int)
    for (t, d), tf in p.items():
        dl[d] += tf
        df[t] += 1
        cf[t] += tf
    n = sum(dl.values())
    got = {(r["term"], r["docid"]): r for r in D.distinctive_terms(D.record_postings(spark.createDataFrame(data, RUN)), strength=50.0).collect()}
    assert set(got) == set(p)
    for (t, d), tf in p.items():
        a, rest = 50.0 * df[t] / len(p), cf[t] - tf
        z = math.log((tf + a) / (dl[d] + 50 - tf - a)) - math.log((rest + a) / (n - dl[d] + 50 - rest - a))
        assert math.isclose(got[t, d]["z"], z / math.sqrt(1 / (tf + a) + 1 / (rest + a)), rel_tol=1e-9, abs_tol=1e-9)
        assert (got[t, d]["tf"], got[t, d]["dl"], got[t, d]["df"], got[t, d]["cf"]) == (tf, dl[d], df[t], cf[t])


def test_given_lengths_and_frequencies_fill_in(spark):
    p = spark.createDataFrame([("a", 1, 4), ("b", 1, 1), ("a", 2, 1)], "term string, docid bigint, tf bigint")
    lengths = spark.createDataFrame([(1, 50), (9, 9)], "docid bigint, dl int")
    dfs = spark.createDataFrame([("a", 7)], "term string, df bigint")
    got = {(r["term"], r["docid"]): (r["dl"], r["df"]) for r in D.distinctive_terms(p, lengths, dfs).collect()}
    assert got == {("a", 1): (50, 7), ("b", 1): (50, 1), ("a", 2): (1, 7)}


def test_common_terms_score_low(spark):
    p = [("the", d, 5) for d in range(40)] + [("odd", 3, 5), ("odd", 4, 4)] + [("w%d" % d, d, 3) for d in range(40)]
    got = {(r["term"], r["docid"]): r["z"] for r in D.distinctive_terms(spark.createDataFrame(p, "term string, docid bigint, tf bigint"), strength=50.0).collect()}
    assert got["odd", 3] > 2 > got["the", 3]


def test_undefined_scores_are_null(spark):
    one = spark.createDataFrame([("a", 1, 3)], "term string, docid bigint, tf bigint")
    assert [(r["tf"], r["z"]) for r in D.distinctive_terms(one).collect()] == [(3, None)]
    only = D.Concentrated(1, 1, 1, 9)
    assert D.distinctive_terms(one, only=only).where(only.exact()).count() == 1


def score(tf, dl, df, cf, n, np_, s):
    a = s * df / np_
    rest = cf - tf
    return (math.log((tf + a) / (dl + s - tf - a)) - math.log((rest + a) / (n - dl + s - rest - a))) / math.sqrt(1 / (tf + a) + 1 / (rest + a))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 60), st.integers(0, 1150), st.integers(3, 30), st.integers(0, 400), st.integers(5000, 10**7), st.floats(0.2, 1.0), st.floats(1, 2000))
def test_no_posting_falls_below_the_floor(more, extra, df, rest, n, density, strength):
    """Random postings that fulfil the conditions, against the floor of the widest bounds that admit them."""
    c = D.Concentrated(4, 8, 3, 30)
    tf = 4 + more
    dl = min(tf + extra, tf * 100 // 8)
    np_ = int(n * density)
    floor = D.z_floor(c, n, np_, 800, 0, 400, strength)
    if n - dl >= rest:
        assert score(tf, dl, df, tf + rest, n, np_, strength) >= floor
    assert D.z_floor(c, n, np_, 800, 2, 90, strength) >= floor


def test_the_floor_keeps_every_concentrated_term(spark):
    rng = random.Random(8)
    p = {("w%d" % rng.randrange(4000), d): 1 for d in range(300) for _ in range(40)}
    for k in range(120):
        for d in rng.sample(range(300), rng.choice([2, 3, 5, 30, 31])):
            p["c%d" % k, d] = rng.choice([2, 3, 4, 5, 9])
    df = spark.createDataFrame([(t, d, n) for (t, d), n in p.items()], "term string, docid bigint, tf bigint")
    only = D.Concentrated(4, 8, 3, 30)
    every, kept = D.distinctive_terms(df, strength=20.0), D.distinctive_terms(df, strength=20.0, only=only)
    key = lambda x: {(r["term"], r["docid"]) for r in x.where(only.exact()).collect()}
    assert key(every) == key(kept) and len(key(every)) > 50 and kept.count() < every.count() / 2


def test_empty_tables(spark):
    e = spark.createDataFrame([], RUN)
    assert D.distinctive_terms(D.record_postings(e)).count() == 0
    c = C.collection_counts(e)
    assert c.marked(2, 0.1).count() == 0 and c.n_docs == 0


def brute(data):
    cf, docs, every = defaultdict(int), defaultdict(set), set()
    for (t, d), tf in postings(data).items():
        cf[t] += tf
        docs[t].add(d)
        every.add(d)
    return {t: (cf[t], len(docs[t])) for t in docs}, len(every)


def current(counts):
    return {r["term"]: (r["cf"], r["df"]) for r in counts.table().collect()}


def files_of(spark, data):
    return spark.createDataFrame(sorted({(r[0], 20) for r in data}) + [(None, None)], "file_id bigint, n_rows bigint")


def test_deliveries_give_what_one_gives(spark):
    data = rows(3)
    run = spark.createDataFrame([*data, (None, "late", 3, 0, 2, "x", "y")], RUN)
    want, n = brute([*data, (None, "late", 3, 0, 2)])
    for files, share in ((None, 0.9), (files_of(spark, data), 0.5), (files_of(spark, data), 1.0), (files_of(spark, []), 0.9)):
        c = C.collection_counts(run, files, share)
        assert current(c) == want and c.n_docs == n


def test_reopened_counts_take_redeliveries_changes_and_deletions(spark):
    data = rows(4, 600)
    run = spark.createDataFrame(data, RUN)
    c = C.collection_counts(run)
    path, (want, n) = c.path, brute(data)
    with pytest.raises(FileExistsError):
        C.TermCounts.create(spark, path)
    c = C.TermCounts.open(spark, path)
    c.deliver(run.where("file_id < 5"))
    assert current(c) == want and c.n_docs == n and c.version.number == 2
    # a further chunk of known postings, and a new document
    more = [(99, "a", 1, 7, 3, "x", "y"), (99, "a", 1, 8, None, "x", "y"), (99, "a", 1000, 0, 2, "x", "y")]
    C.TermCounts.open(spark, path).deliver(spark.createDataFrame(more, RUN))
    c = C.TermCounts.open(spark, path)
    data = data + more
    assert (current(c), c.n_docs) == brute(data)
    # documents out; one of them changed, one never there, one null
    changed = [(100, "new", 2, 0, 5, "x", "y")]
    out = {d for d in range(25) if d % 2 == 0}
    c.deliver(spark.createDataFrame(changed, RUN), spark.createDataFrame([(d,) for d in [*out, 777, None]], "docid bigint"))
    data = [r for r in data if r[2] not in out] + changed
    c = C.TermCounts.open(spark, path)
    assert (current(c), c.n_docs) == brute(data)
    assert {r["docid"] for r in c.records().collect()} == {r[2] for r in data if r[1] is not None and r[2] is not None}
    # what was taken out may come again
    c.deliver(spark.createDataFrame([(101, "a", 4, 0, 1, "x", "y")], RUN))
    data = data + [(101, "a", 4, 0, 1)]
    assert (current(c), c.n_docs) == brute(data)
    c.deliver(deleted=run.selectExpr("docid").union(spark.range(2000)))
    c = C.TermCounts.open(spark, path)
    assert current(c) == {} and c.n_docs == 0 and C.TermCounts.open(spark, path, 1).n_docs == n
    c.deliver(deleted=spark.range(5).selectExpr("id as docid"))
    assert current(c) == {} and c.n_docs == 0
    with pytest.raises(FileNotFoundError):
        C.TermCounts.open(spark, path + "-none")


def test_compaction_keeps_what_is_there(spark):
    data = rows(6, 400)
    c = C.collection_counts(spark.createDataFrame(data, RUN), files_of(spark, data), 0.5)
    c.deliver(deleted=spark.createDataFrame([(1,), (2,)], "docid bigint"))
    c.deliver(spark.createDataFrame([(99, "a", 1, 0, 7, "x", "y")], RUN))
    data = [r for r in data if r[2] not in (1, 2)] + [(99, "a", 1, 0, 7)]
    before = sorted(map(repr, c.records().collect()))
    c.compact()
    c = C.TermCounts.open(spark, c.path)
    assert sorted(map(repr, c.records().collect())) == before and len(c.version.records) == 1 and c.version.gone == []
    assert (current(c), c.n_docs) == brute(data)
    c.deliver(spark.createDataFrame([(*r[:5], "x", "y") for r in data[:50]], RUN))
    assert (current(c), c.n_docs) == brute(data)
    empty = C.collection_counts(spark.createDataFrame([], RUN))
    empty.compact()
    assert empty.n_docs == 0


def test_a_slower_delivery_is_refused(spark):
    run = spark.createDataFrame(rows(5, 100), RUN)
    path = C.collection_counts(run).path
    one, other = C.TermCounts.open(spark, path), C.TermCounts.open(spark, path)
    one.deliver(run.where("file_id = 0"))
    with pytest.raises(FileExistsError):
        other.deliver(run.where("file_id = 1"))


def test_only_touched_partitions_are_rewritten_and_parts_grow(spark, monkeypatch):
    monkeypatch.setattr(C, "TERMS_A_PART", 10)
    first = spark.createDataFrame([(0, "t%d" % i, i, 0, 1, "", "") for i in range(100)], RUN)
    c = C.collection_counts(first)
    assert c.version.parts == 8 and c.version.n_terms == 100
    before = dict(c.version.counts)
    c.deliver(spark.createDataFrame([(0, "t1", 1, 1, 8, "", "")], RUN))
    assert sum(before[k] != c.version.counts[k] for k in before) == 1 and current(c)["t1"] == (9, 1)
    c.deliver(spark.createDataFrame([(0, "u%d" % i, i, 0, 1, "", "") for i in range(200)], RUN))
    assert c.version.parts == 16 and len(current(c)) == 300


def test_known_records_are_looked_up_by_id_ranges(spark):
    data = [(0, "t", i, 0, 1, "", "") for i in range(5000)]
    c = C.collection_counts(spark.createDataFrame(data, RUN))
    found = c.records(spark.createDataFrame([(7,), (8,), (4990,)], "docid bigint"))
    assert {r["docid"] for r in found.collect()} == {7, 8, 4990}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(docid,7), LessThanOrEqual(docid,8)" in plan.replace("PushedFilters: ", "") or "docid,4990" in plan


def test_hot_record_is_combined_first(spark, monkeypatch):
    from termforge.operators import consolidate

    monkeypatch.setattr(consolidate, "LIGHT", 1)
    monkeypatch.setattr(consolidate, "SAMPLED", 2)
    monkeypatch.setattr(consolidate, "SUSPECT", 12)
    monkeypatch.setattr(consolidate, "least_share", lambda spark: 40)
    data = [(f, "hot", 1, 0, 2, "", "") for f in range(500)] + [(f, "t%d" % (f % 50), f, 0, 1, "", "") for f in range(1000)]
    c = C.collection_counts(spark.createDataFrame(data, RUN))
    assert (current(c), c.n_docs) == brute(data)


def test_marks(spark):
    p = [("rare", 1, 0, 1), ("rare", 2, 0, 1)] + [("common", d, 0, 1) for d in range(40)] + [("fine", d, 0, 1) for d in range(4)]
    df = spark.createDataFrame(p, "term string, docid bigint, chunk_no int, tf int")
    c = C.collection_counts(df)
    assert {r["term"]: r["mark"] for r in c.marked(2, 0.1).collect()} == {"rare": "rare", "common": "common", "fine": None}
    assert {r["mark"] for r in C.collection_counts(df.where("docid < 2")).marked(2, 0.1).collect()} == {"rare"}
