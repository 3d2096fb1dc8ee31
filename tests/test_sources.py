import os

import pandas as pd
import pytest

from pyspark.sql import functions as F

from termforge.operators import reference_tables as ref
from termforge.operators import index as ix
from termforge.operators import verify
from termforge.sources import corpus, runs


@pytest.fixture
def collection(tmp_path):
    path = tmp_path / "c.tsv"
    path.write_bytes("7\tfirst text\n\nnot a number\tskipped\nno tab at all\n 8 \ttext\twith tab\n9\tlast \xe9\n".encode("latin-1"))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_policies(spark, collection):
    assert rows(corpus.read_collection(spark, collection)) == [(7, "first text"), (8, "text\twith tab"), (9, "last ")]
    assert rows(corpus.read_collection(spark, collection, "ordinal", 10)) == [(10, "first text"), (12, "skipped"), (13, "no tab at all"), (14, "with tab"), (15, "last ")]
    assert [i for i, _ in rows(corpus.read_collection(spark, collection, "ordinal_skip_blank"))] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        corpus.read_collection(spark, collection, "other")


def test_lists_and_subset(spark, tmp_path):
    (tmp_path / "q.txt").write_text("  one two \n\n\t\nthree\n")
    assert [r[0] for r in corpus.list_file(spark, str(tmp_path / "q.txt")).collect()] == ["one two", "three"]
    df = spark.createDataFrame([(3, "c"), (1, None), (2, " "), (4, "d"), (5, "e")], "n int, t string")
    assert rows(corpus.first_non_blank(df, 2, "n", "t")) == [(3, "c"), (4, "d")]
    dup = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id bigint, line int, text string")
    assert rows(corpus.latest_by_id(dup, "line").select("doc_id", "text")) == [(1, "b"), (2, "c")]


POSTINGS = [("alpha", 1, 2), ("alpha", 5, 1), ('quo"te', 3, 4), ("é", 0, 4294967295)]


def test_run_files(spark, tmp_path):
    p = spark.createDataFrame(POSTINGS, runs.RUN_SCHEMA)
    runs.write_tsv_runs(p, str(tmp_path / "tsv"))
    assert rows(runs.read_tsv_runs(spark, str(tmp_path / "tsv"))) == sorted(POSTINGS)
    for n in (3, 2):
        runs.write_binary_runs(p, str(tmp_path / "bin"), n)
        assert rows(runs.read_binary_runs(spark, str(tmp_path / "bin" / "*.run"))) == sorted(POSTINGS)
    assert 1 <= len(os.listdir(tmp_path / "bin")) <= 2
    (tmp_path / "bin" / "run_t.run").write_text("beta\t2\t9\n")
    (tmp_path / "bin" / "empty.run").write_text("")
    both = runs.read_runs(spark, str(tmp_path / "bin"))
    assert rows(runs.read_runs(spark, str(tmp_path / "none*"))) == []
    assert rows(both) == sorted([*POSTINGS, ("beta", 2, 9)])
    assert verify.same_postings(ix.merge_postings(p, both.where("term <> 'beta'")), p.selectExpr("term", "doc_id", "2 * tf as tf"))


def test_groups_of_a_run_cross_batches(monkeypatch):
    monkeypatch.setattr(runs, "GROUP", 3)
    batches = [pd.DataFrame({"term": list("aab"), "doc_id": [1, 2, 1], "tf": 1}), pd.DataFrame({"term": list("bbbb"), "doc_id": [2, 3, 4, 5], "tf": 2}), pd.DataFrame({"term": ["b"], "doc_id": [6], "tf": 1})]
    data = runs.MAGIC + b"".join(runs.encoded_groups(iter(batches)))
    assert [(t, d.tolist()) for t, d, _ in runs.decode_run(data)] == [("a", [1, 2]), ("b", [1, 2, 3, 4, 5]), ("b", [6])]
    assert list(runs.encoded_groups(iter([]))) == []


def test_failed_write_leaves_no_run(spark, tmp_path):
    bad = spark.createDataFrame([("a", -1, 1)], runs.RUN_SCHEMA).selectExpr("term", "doc_id", "raise_error('stop') as tf")
    with pytest.raises(Exception, match="stop"):
        runs.write_binary_runs(bad.selectExpr("term", "doc_id", "cast(tf as bigint) as tf"), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists() or os.listdir(tmp_path / "x") == []


def test_malformed_text(spark, tmp_path):
    (tmp_path / "m.txt").write_bytes(b"a\xffb\nc\xef\xbf\xbdd\n\xef\xbf\xbd\xc3\nfine \xc3\xa9\n")
    got = lambda how: [r[0] for r in corpus.text_lines(spark, str(tmp_path / "m.txt"), how).collect()]
    assert got("drop") == ["ab", "c\ufffdd", "\ufffd", "fine \xe9"]
    assert got("replace") == ["a\ufffdb", "c\ufffdd", "\ufffd\ufffd", "fine \xe9"]
    with pytest.raises(Exception, match="UTF"):
        got("fail")
    with pytest.raises(ValueError):
        corpus.sound_text(F.col("x"), "other")


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    want = []
    for f in range(5):
        lines = [f"{f}-{i}" + "x" * (i % 7) for i in range(0 if f == 2 else 400 * (f + 1))]
        (tmp_path / f"part-{f}.txt").write_text("".join(x + "\n" for x in lines))
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = corpus.numbered_lines(spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
        assert got == list(enumerate(want)) and df.rdd.getNumPartitions() > 5
        assert df.where("line_no = 777").first()["value"] == want[777]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_binary_run_errors():
    data = runs.encode_run(iter([("a", [1, 2], [3, 4])]))
    assert [(t, d.tolist(), f.tolist()) for t, d, f in runs.decode_run(data)] == [("a", [1, 2], [3, 4])]
    with pytest.raises(ValueError):
        list(runs.decode_run(b"XXXX"))
    with pytest.raises(EOFError):
        list(runs.decode_run(data[:-1]))
    assert runs.run_format(data) == "binary" and runs.run_format(b"a\t1\t2") == "tsv"


def test_superseded_entries(spark):
    lengths = [(1, 5, "2025-01-01"), (1, 7, "2025-01-02"), (1, None, "2025-01-03"), (2, 0, "2025-01-01"), (None, 3, "2025-01-01"), (3, 4, None)]
    df = spark.createDataFrame(lengths, "docid bigint, dl int, built_at string")
    assert rows(ref.newest_doc_lengths(df)) == [(1, 7), (3, 4)]
    lex = [(0, "a", 2, "2025-01-01"), (0, "a", 3, "2025-01-02"), (1, "a", 4, "2025-01-01"), (0, "b", 1, "2025-01-01"), (1, "b", 9, "2025-01-01"), (1, "b", None, "2025-01-02"), (0, None, 1, "2025-01-01")]
    df = spark.createDataFrame(lex, "shard_id int, term string, df bigint, built_at string")
    assert rows(ref.newest_lexicon(df)) == [(0, "a", 3), (0, "b", 1), (1, "a", 4), (1, "b", 9)] and rows(ref.term_df(df)) == [("a", 7)]
