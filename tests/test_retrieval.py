import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from model import bags, bm25
from termforge.functions import codec
from termforge.functions.snippet import snippet
from termforge.operators import index as ix
from termforge.operators import retrieval as rt
from termforge.operators import verify
from termforge.operators.matching import document_rows
from termforge.session import scratch_path
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def index(spark, toy):
    return ix.of_documents(toy)


def top(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in df.collect()]


ASKED = [
    ("clock tower", "AND"), ("the river", "AND"), ("the river", "OR"), ("the the clock", "AND"), ("tar zzz", "AND"), ("nobody", "OR"), ("Nobody's", "OR"), ("", "AND"), ("zzz", "AND"),
]
GOLDEN = [(q, m, bm25(q, m)) for q, m in ASKED]


def test_model_by_hand():
    """One known term in one document of 7 of the 55 tokens: idf ln(1 + 7.5 / 1.5), length norm 0.25 + 0.75 * 7 / 6.875."""
    assert bm25("tower", "AND") == [(5, round(math.log(6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 7 / 6.875)), 6))]


@pytest.mark.parametrize("query,mode,want", GOLDEN)
def test_golden_scores(index, query, mode, want):
    assert top(rt.ranked(index, query, mode)) == want
    assert {r["doc_id"] for r in rt.boolean(index, query, mode).collect()} == {i for i, _ in want}


def test_batch_equals_single(spark, index):
    qs = [(i, q, m if i % 2 else m.lower() + " ", 3, "x") for i, (q, m, _) in enumerate(GOLDEN)] + [(98, "the", "XOR", 3, "x"), (99, None, "AND", 3, "x"), (None, "the", "AND", 1, "x")]
    got = defaultdict(list)
    for r in rt.batch(index, spark.createDataFrame(qs, "qid bigint, query string, mode string, topk int, score string"), topk=F.col("topk")).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["doc_id"], round(r["score"], 6)))
    assert got == {i: w[:3] for i, (_, _, w) in enumerate(GOLDEN) if w}


@pytest.mark.parametrize("broadcast", [0, rt.BROADCAST_ROWS])
def test_batch_with_hot_terms_and_long_lists(spark, monkeypatch, broadcast):
    """AND from the rarest term, frequent terms split by document, one query asking for more than the others."""
    monkeypatch.setattr(rt, "MANY", 4)
    monkeypatch.setattr(rt, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    texts = [" ".join(["hot"] + rng.choices(["warm", "mild", "cool", "cold"], weights=(20, 8, 3, 1), k=6)) for _ in range(300)]
    asked = ["hot", "hot cold", "cold hot warm hot", "mild cool cold", "cold zzz", "warm mild", "cool cold hot"]
    qs = [(i, q, m, 300 if q == "hot cold" else 4) for i, (q, m) in enumerate((q, m) for q in asked for m in ("AND", "OR"))]
    i = ix.of_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = defaultdict(list)
    for r in rt.batch(i, spark.createDataFrame(qs, "qid int, query string, mode string, topk int"), topk=F.col("topk")).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["doc_id"], round(r["score"], 6)))
    assert got == {k: bm25(q, m, texts=texts)[:n] for k, q, m, n in qs}


def shuffled_rows(spark, run):
    """Rows that the stages of an action write for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    jvm = spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    result = run()
    return result, sum(n for k, n in stages().items() if k not in before)


def test_batch_shuffles_no_pairs_of_queries_and_documents(spark):
    """300 queries of terms that most of 400 documents hold: 120,000 pairs, of which a list's best go to the shuffle."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["hot", "warm", "mild", "cool"], weights=(20, 10, 6, 2), k=rng.randint(2, 9))) for _ in range(400)]
    i = ix.write_index(ix.of_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")), scratch_path(spark, "index"))
    asked = ["hot warm", "WARM hot", "mild hot", "hot", "cool  warm mild"]
    qs = [(n, asked[n % 5], "or", 1 + n % 7) for n in range(300)]
    found, n_rows = shuffled_rows(spark, lambda: rt.batch(i, spark.createDataFrame(qs, "qid int, query string, mode string, topk int"), topk=F.col("topk")).orderBy("qid", "rank").collect())
    got = defaultdict(list)
    for r in found:
        got[r["qid"]].append((r["doc_id"], round(r["score"], 6)))
    assert got == {n: bm25(q.lower(), "OR", texts=texts)[:k] for n, q, _, k in qs}
    assert n_rows < 20_000


def test_bounds_leave_the_best(spark):
    """Few lists in a block, few pairs at once, and topk from one to more than there are matches."""
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(25)]
    texts = [" ".join(rng.choices(vocabulary, weights=[2**-(n / 3) for n in range(25)], k=rng.randint(1, 40))) for _ in range(500)]
    qs = [(n, " ".join(rng.choices(vocabulary + ["zzz"], k=rng.randint(1, 4))), rng.choice(("AND", "OR")), rng.choice((1, 2, 5, 50, 600))) for n in range(60)]
    i = ix.of_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = defaultdict(list)
    for r in rt.batch(i, spark.createDataFrame(qs, "qid int, query string, mode string, topk int"), topk=F.col("topk")).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["doc_id"], round(r["score"], 6)))
    assert got == {n: w for n, q, m, k in qs if (w := bm25(q, m, texts=texts)[:k])}
    assert rt.batch(i, spark.createDataFrame([(1, "zzz", "OR", 3)], "qid int, query string, mode string, topk int")).count() == 0


@pytest.mark.parametrize("rows", [0, ix.SLICE_ROWS])
def test_ranking_index_is_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(ix, "SLICE_ROWS", rows)
    rng = random.Random(3)
    records = [(f"t{rng.randint(0, 30)}", rng.randint(0, 60), rng.randint(0, 2), rng.choice((1, 2, None))) for _ in range(2000)]
    run = spark.createDataFrame(records + records[:300] + [(None, 1, 0, 1), ("a", None, 0, 1)], "term string, docid bigint, chunk_no int, tf int")
    a, b = ix.ranking_index(run), ix.of_run(run)
    assert verify.same_postings(a.postings, b.postings) and (a.n_docs, a.avgdl) == (b.n_docs, b.avgdl)
    assert sorted(map(tuple, a.doc_lengths.collect())) == sorted(map(tuple, b.doc_lengths.collect()))
    assert a.documents.count() == b.n_docs == a.documents.select("doc_id").distinct().count()
    assert ix.ranking_index(run.limit(0)).n_docs == 0


def test_documents_over_several_batches():
    rng = random.Random(9)
    for size in (1, 2, 7, 1000):
        rows = sorted(((rng.choice("abcde"), rng.choice((-5, 1, 2, 3, 9)), rng.choice((0, 1, None)), rng.choice((1, 2, None))) for _ in range(rng.randint(1, 200))), key=lambda r: r[1])
        whole = pa.table(dict(zip(("term", "docid", "chunk_no", "tf"), map(list, zip(*rows)), strict=True)), pa.schema([("term", pa.string()), ("docid", pa.int64()), ("chunk_no", pa.int32()), ("tf", pa.int32())]))
        want = defaultdict(lambda: defaultdict(int))
        for term, docid, _, tf in set(rows):
            want[docid][term] += tf or 0
        found = [r for b in document_rows(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [r["doc_id"] for r in found] == sorted(want)
        assert all(dict(zip(r["terms"], r["tfs"], strict=True)) == want[r["doc_id"]] and r["dl"] == sum(r["tfs"]) for r in found)


def test_parameters(index):
    with pytest.raises(ValueError):
        rt.search_topk(index, "the", 0)
    with pytest.raises(ValueError):
        rt.boolean(index, "the", "XOR")
    with pytest.raises(ValueError):
        rt.search(index, "the", "XOR")
    assert top(rt.ranked(index, "the river", "XOR")) == top(rt.ranked(index, "the river", None)) == bm25("the river", "OR")
    assert len(top(rt.search_topk(index, "the river", 1))) == 1
    assert rt.search(index, "the river", ranked_by_score=False).columns == ["doc_id"]


def test_statistics(index):
    assert (index.n_docs, index.avgdl, index.lexicon.count(), index.postings.count()) == (8, 6.875, 39, 53)
    assert {r["doc_id"]: r["dl"] for r in index.doc_lengths.collect()}[0] == 9


def test_written_index_is_the_same(spark, index):
    back = ix.write_index(index, scratch_path(spark, "index"))
    assert verify.same_postings(back.postings, index.postings) and back.n_docs == 8 and back.build_id
    assert top(rt.ranked(back, "the river", "OR", topk=2)) == bm25("the river", "OR")[:2]


def test_long_document_is_split_by_its_terms(spark):
    rows = [(f"t{i}", 1, 0, 1) for i in range(900)] + [(f"t{i % 50}", 2 + i % 40, 0, 2) for i in range(400)]
    run = spark.createDataFrame(rows, "term string, docid bigint, chunk_no int, tf int")
    i = ix.build_run(run, scratch_path(spark, "index"))
    assert verify.same_postings(i.postings, ix.of_run(run).postings)
    assert {r["doc_id"]: r["dl"] for r in i.with_lengths().select("doc_id", "dl").distinct().collect()} == {r["doc_id"]: r["dl"] for r in i.doc_lengths.collect()}
    assert sorted(map(tuple, i.blocks().collect())) == sorted(map(tuple, ix.block_directory(i.postings).collect()))
    assert "PushedFilters: [IsNotNull(term)" in i.blocks().where("term = 't1'")._jdf.queryExecution().executedPlan().toString()


def test_merge_equals_direct(toy, index):
    parts = [ix.postings(ix.tokenized(toy.where(toy.doc_id % 3 == k))) for k in range(3)]
    assert verify.same_postings(ix.merge_postings(*parts), index.postings)
    doubled = ix.merge_postings(index.postings, index.postings)
    assert doubled.agg(F.sum("tf")).first()[0] == 110


def test_tokens(spark):
    rows = [(1, "U.S. policy 3.14 3-14"), (2, "café a--b ..."), (3, "Tom &amp; Jerry&#39;s"), (4, ""), (5, None), (None, "x")]
    got = {r["doc_id"]: r["tokens"] for r in ix.tokenized(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ["u.s", "policy", "3.14", "3-14"], 2: ["caf", "a", "b"], 3: ["tom", "jerry", "s"], 4: []}


def test_blocks_and_seek(spark):
    p = spark.createDataFrame([("t", i * 3, 1 + i % 200) for i in range(300)] + [("u", 0, 1)], "term string, doc_id bigint, tf bigint")
    d = ix.block_directory(p)
    rows = {(r["term"], r["block_no"]): r for r in d.collect()}
    assert [rows["t", b]["n"] for b in range(3)] == [128, 128, 44] and rows["u", 0]["first_docid"] == 0
    for b in range(3):
        docs = [i * 3 for i in range(300)][b * 128 : b * 128 + 128]
        base = docs[0] - 3 if b else 0
        assert rows["t", b]["doc_bytes"] == len(codec.varbyte_encode(codec.docid_gaps(docs, base)))
    assert rt.seek_block_ge(d, "t", 384).first()["block_no"] == 1
    assert rt.seek_block_ge(d, "t", 10_000).count() == 0
    assert rt.next_ge(p, "t", 4).first()["doc_id"] == 6 and rt.next_ge(p, "t", 10_000).first()["doc_id"] is None


def test_varbyte_cases():
    for n, hexed in ((0, "80"), (1, "81"), (127, "ff"), (128, "0081"), (300, "2c82"), (16384, "000081"), (2097152, "00000081")):
        assert codec.varbyte_encode([n]).hex() == hexed
    assert codec.varbyte_decode(bytes.fromhex("2c8205")).tolist() == [300]
    with pytest.raises(ValueError):
        codec.varbyte_encode([-1])
    with pytest.raises(ValueError):
        codec.docid_gaps([3, 2])
    with pytest.raises(ValueError):
        codec.raw_encode([1 << 32])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40)))
def test_varbyte_round_trip(xs):
    assert codec.varbyte_decode(codec.varbyte_encode(xs)).tolist() == xs
    docs = sorted(set(xs))
    assert codec.docids_of(codec.varbyte_decode(codec.varbyte_encode(codec.docid_gaps(docs)))).tolist() == docs


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_raw_round_trip(xs):
    assert codec.raw_decode(codec.raw_encode(xs)).tolist() == xs


def test_verify_reports(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "doc_id bigint, dl bigint")
    b = spark.createDataFrame([(2, 6), (3, 8), (4, 9), (None, 1)], "doc_id bigint, dl bigint")
    assert {tuple(r) for r in verify.membership(a, b).collect()} == {(1, "left"), (4, "right")}
    assert [tuple(r) for r in verify.length_mismatches(a, b).collect()] == [(3, 7, 8)]


def test_latency_summary_small_and_large(spark):
    import statistics

    for n in (0, 5, 19, 20, 57):
        xs = [float((i * 37) % 101) for i in range(n)]
        r = verify.latency_summary(spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double"), "v").first()
        assert r["n"] == n
        if n:
            want = statistics.quantiles(xs, n=20)[18] if n >= 20 else max(xs)
            assert math.isclose(r["p95"], want) and math.isclose(r["p50"], statistics.median(xs)) and r["max"] == max(xs)


def test_snippet(spark):
    long = "x" * 100 + " needle here and a haystack " + "y" * 300
    rows = [(long, "needle haystack"), ("short", "zzz"), ("", "a"), (long, ""), (None, "a"), ("z" * 250, "none")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, q string").select(snippet(F.col("c"), F.col("q"))).collect()]
    assert got[0] == "..." + long[51:251] + "..." and got[1] == "short" and got[2] == "" and got[4] is None
    assert got[3] == long[:200] + "..." and got[5] == "z" * 200 + "..."


def test_index_of_run_and_empty(spark):
    rows = [("a", 1, 0, 2), ("a", 1, 0, 2), ("a", 1, 1, 3), (None, 1, 0, 1), ("b", None, 0, 1), ("b", 2, 0, None)]
    i = ix.of_run(spark.createDataFrame(rows, "term string, docid bigint, chunk_no int, tf int"))
    assert {tuple(r) for r in i.postings.collect()} == {("a", 1, 5), ("b", 2, 0)}
    e = ix.of_documents(spark.createDataFrame([], "doc_id bigint, text string"))
    assert e.n_docs == 0 and rt.ranked(e, "the").count() == 0


def test_model_of_bm25(index):
    assert dict(top(rt.ranked(index, "silt and and salt", "OR", k1=0.9, b=0.4))) == dict(bm25("silt and and salt", "OR", 0.9, 0.4))
    assert index.postings.count() == sum(map(len, bags()))
