import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termforge.llm import batches as B
from termforge.llm import contamination as C
from termforge.llm import repetition as R


def leaks(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = B.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = B.words(t)
        for k in range(len(w) - n + 1):
            out |= {(i, d) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 14, 40])))) for i in range(40)] + [(90, None), (91, ""), (92, "a " * 30), (0, "w1 " * 12)]
    docs = []
    for d in range(600):
        w = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            x = B.words(rng.choice(items)[1])
            a = rng.randrange(len(x) + 1)
            piece = x[a : a + rng.choice([9, 10, 11, 30])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [p.upper() for p in piece]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(900, None), (901, ""), (902, "A, a-a " * 20)], items


def test_leaks_match_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id bigint, text string, item_id string, code int")
    i = spark.createDataFrame([(*x, "t") for x in items], "item_id bigint, text string, doc_id string")
    want = leaks(docs, items)
    assert len(want) > 30
    for size in (C.BLOCK_WORDS, 200):
        rows = C.leaked_items(d, i, block_words=size).collect()
        assert {(r["item_id"], r["doc_id"]) for r in rows} == want and len(rows) == len(want)


def test_slices_of_alignments(spark, monkeypatch):
    """Repeated words make many alignments of a document and an item; passages may touch the ends of texts and items."""
    monkeypatch.setattr(C, "ALIGNMENTS", 7)
    items = [(1, "x " * 40), (2, "y " + "x " * 12), (3, "a b c d e f g h i j"), (4, "j i h g f e d c b a j i h"), (5, "x " * 9), (6, "x " * 10 + "z")]
    docs = [(1, "x " * 200), (2, "x " * 9), (3, "a b c d e f g h i"), (4, "j a b c d e f g h i j"), (5, "a b c d e f g h i j"), (6, "c d e f g h i j a b"), (7, "y " + "x " * 9), (8, "e d c b a j i h g f e")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in C.leaked_items(d.coalesce(1), i).collect()} == leaks(docs, items)


def test_other_windows(spark):
    docs, items = corpus(7)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in C.leaked_items(d, i, window=6, shingle=3).collect()} == leaks(docs, items, 6)


def test_long_document_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(10))
    d = spark.createDataFrame([(1, "x " * 500_000 + item + " y" * 500_000)], "doc_id bigint, text string")
    i = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert [tuple(r) for r in C.leaked_items(d, i).collect()] == [(5, 1)]
    assert C.leaked_items(d.where("false"), i).count() == 0 and C.leaked_items(d, i.where("false")).count() == 0


def repeated(words, n=6):
    seen, mark = set(), [False] * len(words)
    for k in range(len(words) - n + 1):
        g = tuple(words[k : k + n])
        if g in seen:
            mark[k : k + n] = [True] * n
        seen.add(g)
    return sum(mark)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6), st.integers(1, 9))
def test_repeated_words_match_brute_force(texts, run):
    codes, starts = B.coded([" ".join(t) for t in texts])
    assert R.repeated_words(codes, starts, run).tolist() == [repeated(t, run) for t in texts]


TEXTS = [None, "", "one two", "a b c d e f " * 2, "A, b. C d e f a b c d e f g", "x " * 50, "буква " * 7, " ".join(map(str, range(200)))]


def test_measure(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "a b c d e f " * 3, "s")]
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in R.repetition(spark.createDataFrame(rows, "doc_id bigint, text string, share string")).collect()}
    assert got == {i: (len(B.words(t)), repeated(B.words(t))) for i, t, _ in rows}
    assert R.repetition(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_large_ids_beside_nulls(spark):
    big = 2**62 + 1
    text = "a b c d e f g h i j k "
    df = spark.createDataFrame([(big, text * 2), (None, text)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in R.repetition(df).collect()} == {big, None}
    items = spark.createDataFrame([("x7", text)], "item_id string, text string")
    assert {tuple(r) for r in C.leaked_items(df, items).collect()} == {("x7", big), ("x7", None)}


def test_slices_cover_every_row():
    import pandas as pd

    pdf = pd.DataFrame({"text": ["a" * n if n else None for n in (0, 5, 100, 3, 0, 50, 1)]})
    parts = list(B.slices(pdf, chars=20))
    assert sum(map(len, parts)) == 7 and pd.concat(parts).equals(pdf)


@pytest.mark.parametrize("errors,trials,error,want", [(0, 100, 0.05, 0.0295130), (5, 100, 0.05, 0.1022534), (10, 10, 0.05, 1.0), (0, 1, 0.1, 0.9)])
def test_exact_bound(errors, trials, error, want):
    assert math.isclose(R.upper_bound(errors, trials, error), want, abs_tol=1e-6)


def test_bound_covers():
    rng = np.random.default_rng(1)
    missed = sum(R.upper_bound(int(rng.binomial(80, 0.1)), 80, 0.1) < 0.1 for _ in range(500))
    assert missed <= 70


def test_certified_cutoffs(spark):
    rng = random.Random(2)
    rows = [(s, rng.random() * (0.28 if s else 0.12), False) for s in (0, 1) for _ in range(1500)] + [(0, 0.9, True)] * 50 + [(2, 0.2, False)] * 5 + [(0, None, False), (0, 0.4, None)]
    schema = "stratum int, share double, is_repetitive boolean"
    got = R.certificates(spark.createDataFrame(rows, schema))
    assert [(c.stratum, c.n_good, c.cutoff) for c in got] == [(0, 1500, 0.15), (1, 1500, 0.30), (2, 5, None)]
    assert all(c.bound <= R.RISK for c in got[:2]) and got[2].bound > R.RISK
    assert [(c.n_good, c.cutoff) for c in R.certificates(spark.createDataFrame([], schema))] == [(0, None)] * 3


def test_certified_risk_holds(spark):
    """Good documents whose shares straddle every cutoff: in at most `error` of the holdouts may a certified cutoff reject more than the risk."""
    rng = np.random.default_rng(4)
    rows = [(trial, float(rng.beta(1, 9)), False) for trial in range(60) for _ in range(300)]
    got = R.certificates(spark.createDataFrame(rows, "stratum int, share double, is_repetitive boolean"), strata=60, error=60 * 0.05)
    tail = lambda c: (1 - c) ** 9
    assert sum(c.cutoff is not None and tail(c.cutoff) > R.RISK for c in got) <= 3


def test_labels_know_repeats_without_counting_them():
    rng = random.Random(9)
    fresh = " ".join(str(rng.randrange(3000)) for _ in range(400))
    assert R.order_saving(fresh) < R.SAVING < R.order_saving(fresh + " " + fresh) and R.order_saving("spam! " * 300 + fresh) < 1
    assert [R.order_saving(t) for t in (None, "", "one")] == [0.0] * 3
    assert R.order_saving(fresh) == R.order_saving(fresh.upper())


def test_bound_of_many_errors():
    want = 0.05 + 3.0902323 * math.sqrt(0.05 * 0.95 / 1e8)
    assert math.isclose(R.upper_bound(5_000_000, 10**8, 0.001), want, abs_tol=1e-7)


def test_every_document_is_labelled(spark):
    """Also in a large collection all documents stand behind the cutoffs, not some 20,000."""
    n = 21_000
    report = R.certificate_report(spark.range(n).selectExpr("id AS doc_id", "concat('one two ', id) AS text")).collect()
    assert [(r["stratum"], r["n_good"]) for r in report] == [(0, n), (1, 0), (2, 0)] and report[0]["cutoff"] == R.CUTOFFS[-1]


def texts_with_repeats(n=600, most=0.5):
    rng = random.Random(3)
    for i in range(n):
        w = [str(rng.randrange(10_000)) for _ in range(rng.choice([20, 150, 1200]))]
        k = rng.randrange(int(len(w) * most))
        yield i, " ".join(w + w[:k])


def test_rejection_never_misses_the_asked_share(spark):
    texts = list(texts_with_repeats())
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    judged = R.reject_repetitive(df, asked=R.SHARE)
    want = {i for i, t in texts if repeated(B.words(t)) * 10 >= 3 * len(B.words(t))}
    assert {r["doc_id"] for r in judged.where("share >= 0.3").collect()} == want
    assert want <= {r["doc_id"] for r in judged.where("rejected").collect()}
    labels = df.selectExpr("doc_id", "true as is_repetitive")
    none = R.reject_repetitive(df, labels=labels)
    assert none.where("rejected").count() == 0 and none.where("cutoff IS NOT NULL OR certified").count() == 0
    asked = R.reject_repetitive(df, labels=labels, asked=0.3)
    assert {(r["cutoff"], r["certified"]) for r in asked.select("cutoff", "certified").distinct().collect()} == {(0.3, False)}


def test_cutoffs_select_on_both_sides_of_the_asked_share(spark):
    """Labels that call much repetition good push the cutoff up, labels that call little of it bad pull it down."""
    df = spark.createDataFrame(list(texts_with_repeats(2400, 1.0)), "doc_id bigint, text string")
    shares = R.repetition(df)
    for limit, low, high in ((0.4, 0.4, 0.4), (0.14, 0.10, 0.15)):
        labels = shares.selectExpr("doc_id", f"share >= {limit} as is_repetitive")
        got = [r["cutoff"] for r in R.reject_repetitive(df, labels=labels).select("cutoff").distinct().collect()]
        assert all(c is None or low <= c <= high for c in got) and any(c is not None for c in got)
    report = R.certificate_report(df).collect()
    assert [r["stratum"] for r in report] == [0, 1, 2] and all(r["cutoff"] is None or r["bound"] <= R.RISK for r in report)
