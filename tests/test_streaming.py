from termforge.operators import index as ix
from termforge.operators import verify
from termforge.sources import strict_lines
from termforge.streaming import ingest


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "f", i, f"{i % 7}\tsome text number {i} &amp; more" if i % 5 else "broken", None) for i in range(60)]
    df = spark.createDataFrame(rows, ingest.LINES)
    src = str(tmp_path / "in")
    df.where("line_id < 30").repartition(2).write.parquet(src)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = ingest.index_stream(ingest.read_line_files(spark, src, 1), out, check)
        q.awaitTermination()

    run()
    df.where("line_id >= 30").repartition(2).write.mode("append").parquet(src)
    run()
    got = ix.merge_postings(spark.read.parquet(f"{out}/postings").select("term", "doc_id", "tf"))
    want = ix.postings(ix.tokenized(strict_lines.loaded_rows(df), "docid", "text"))
    assert verify.same_postings(got, want)
    assert spark.read.parquet(f"{out}/rejects").count() == 12


def test_windowed_fetches(spark, tmp_path):
    rows = [("2025-01-01T00:00:10Z", "test", 200, 5), ("2025-01-01T00:00:50Z", "test", 404, 1), ("2025-01-01T00:01:10Z", "test", 0, None), (None, "x", 1, 1)]
    df = spark.createDataFrame(rows, "ts_iso string, superdomain string, status int, bytes bigint")
    df.write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    q = ingest.windowed_fetches(s).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[2:] for r in spark.table("w").collect()) == [(1, 0, None), (2, 1, 6)]
