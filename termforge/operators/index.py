"""Building an inverted index: postings, document lengths, lexicon, block directory, statistics."""

from __future__ import annotations

import functools
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions.codec import block_docids, raw, unraw, unvarbyte, varbyte, varbyte_size
from termforge.functions.text import HAVE_REPAIR, index_tokens, repair_text, unescape
from termforge.operators.consolidate import RECORD, hot_records
from termforge.operators.matching import DOCUMENT, document_rows
from termforge.operators.ranges import numbered, numbered_ranges, range_starts
from termforge.operators.skew import hot_keys, least_share, salted_lookup
from termforge.session import materialize, shuffles_removed

BLOCK = 128
# Rows of a run beyond which it is shuffled in parts, and into how many.
SLICE_ROWS, SLICES = 10_000_000, 2
ENCODERS = {"varbyte": varbyte, "raw": raw}


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repair: bool = False) -> DataFrame:
    """(doc_id, text) with HTML entities decoded; texts without an ampersand stay in the JVM.

    repair also applies the optional repair library to texts with other than ASCII characters, if
    it is installed.

    Rows with a null id or text are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    coded = F.col("text").contains("&")
    decoded = rows.where(~coded).unionByName(rows.where(coded).withColumn("text", unescape("text")))
    if not (repair and HAVE_REPAIR):
        return decoded
    other = F.col("text").rlike(r"[^\x00-\x7F]")
    return decoded.where(~other).unionByName(decoded.where(other).withColumn("text", repair_text("text")))


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return clean(docs, doc_id, text).select("doc_id", index_tokens("text").alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf) from (doc_id, tokens): term frequencies, combined map-side."""
    terms = tokens.select("doc_id", F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(tokens: DataFrame, keep_empty: bool = True) -> DataFrame:
    """(doc_id, dl): token counts with repeats; documents without tokens are kept with 0 unless told otherwise."""
    rows = tokens.select("doc_id", F.size("tokens").cast("bigint").alias("dl"))
    return rows if keep_empty else rows.where(F.col("dl") > 0)


def merge_postings(*runs: DataFrame) -> DataFrame:
    """One posting per (term, doc_id) of all runs, frequencies summed."""
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def lengths_from_postings(p: DataFrame) -> DataFrame:
    """(doc_id, dl) as summed frequencies; documents without a posting don't occur."""
    return p.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def lexicon(p: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, total_tokens, avgdl)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_tokens"), F.avg("dl").alias("avgdl"))


def blocked(p: DataFrame, block_size: int = BLOCK, starts: DataFrame | None = None) -> DataFrame:
    """Postings with block_no and gap (distance to the term's previous docid, to 0 for the first).

    Gaps run on across blocks. Postings are numbered by ranges, so a frequent term isn't one task's. Postings of a written
    index lie in ranges already (_range); `starts` are what it stores of them.
    """
    rows = numbered_ranges(p, ["term"], "doc_id", starts).drop("_range") if "_range" in p.columns else numbered(p, ["term"], "doc_id")
    block = F.floor(F.col("_no") / block_size).cast("int")
    return rows.withColumn("block_no", block).withColumn("gap", F.col("doc_id") - F.coalesce("_prev", F.lit(0))).drop("_no", "_prev")


def block_directory(p: DataFrame, block_size: int = BLOCK, starts: DataFrame | None = None) -> DataFrame:
    """(term, block_no, n, first_docid, last_docid, doc_bytes, freq_bytes, raw_bytes) of each block."""
    return (
        blocked(p, block_size, starts)
        .groupBy("term", "block_no")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("doc_id").alias("first_docid"),
            F.max("doc_id").alias("last_docid"),
            F.sum(varbyte_size(F.col("gap"))).cast("bigint").alias("doc_bytes"),
            F.sum(varbyte_size(F.col("tf"))).cast("bigint").alias("freq_bytes"),
            (F.count(F.lit(1)) * 8).alias("raw_bytes"),
        )
    )


def block_lexicon(directory: DataFrame, codec: str = "varbyte") -> DataFrame:
    """(term, df, nblocks, codec, last_docid, bytes): a term's entry, from the directory of its blocks.

    The entries of single blocks stay in the directory, a row each, as a frequent term has too many for one cell.
    """
    size = F.col("doc_bytes") + F.col("freq_bytes") if codec == "varbyte" else F.col("raw_bytes")
    return directory.groupBy("term").agg(
        F.sum("n").alias("df"), F.count(F.lit(1)).alias("nblocks"), F.lit(codec).alias("codec"), F.max("last_docid").alias("last_docid"), F.sum(size).alias("bytes")
    )


def encoded_blocks(blocks: DataFrame, codec: str = "varbyte") -> DataFrame:
    """(term, block_no, n, first_docid, last_docid, codec, doc_data, freq_data) of blocked postings.

    varbyte holds gaps, the first to the docid before the block; raw holds docids. A block is a bounded list.
    """
    if codec not in ENCODERS:
        raise ValueError(f"unknown codec {codec!r}")
    encode = ENCODERS[codec]
    entry = F.sort_array(F.collect_list(F.struct("doc_id", "gap", "tf")))
    b = blocks.groupBy("term", "block_no").agg(entry.alias("_e"))
    docs = F.transform("_e", lambda x: x["gap"] if codec == "varbyte" else x["doc_id"])
    return b.select(
        "term", "block_no", F.size("_e").alias("n"), F.element_at("_e", 1)["doc_id"].alias("first_docid"), F.element_at("_e", -1)["doc_id"].alias("last_docid"),
        F.lit(codec).alias("codec"), encode(docs).alias("doc_data"), encode(F.transform("_e", lambda x: x["tf"])).alias("freq_data"),
    )


def decoded_blocks(encoded: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of encoded blocks of either codec. A block stands for itself: gaps are laid out from its first docid."""
    small = encoded.where(F.col("codec") == "varbyte").select("term", block_docids("doc_data", "first_docid").alias("_d"), unvarbyte("freq_data").alias("_f"))
    plain = encoded.where(F.col("codec") == "raw").select("term", unraw("doc_data").alias("_d"), unraw("freq_data").alias("_f"))
    pairs = small.unionByName(plain).select("term", F.explode(F.arrays_zip("_d", "_f")).alias("_x"))
    return pairs.select("term", F.col("_x")["_d"].alias("doc_id"), F.col("_x")["_f"].alias("tf"))


def term_offsets(lex: DataFrame) -> DataFrame:
    """(term, byte_offset) of a lexicon (term, df): where a term's list would start in one file in term order, raw codec.

    Two-level running sum: range-partitioned terms are summed inside their range, ranges by the
    few rows of their totals, so no task sees all terms.
    """
    laid = materialize(
        lex.select("term", (F.col("df") * 8).alias("bytes")).repartitionByRange("term").withColumn("range_no", F.spark_partition_id()), "term-ranges"
    )
    totals = laid.groupBy("range_no").agg(F.sum("bytes").alias("range_bytes"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select("range_no", F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range_no").orderBy("term").rowsBetween(Window.unboundedPreceding, 0)
    return laid.join(starts, "range_no").select("term", (F.col("start") + F.sum("bytes").over(inside) - F.col("bytes")).alias("byte_offset"))


@dataclass
class Index:
    """Postings, lengths and lexicon of one build, with N and avgdl computed once.

    rows are the postings with what a written index keeps beside them: the document's length (dl), and the range they lie
    in (_range). starts and directory are what it stores of ranges and blocks. documents are its postings, a row per document.
    """

    rows: DataFrame
    doc_lengths: DataFrame
    lexicon: DataFrame
    n_docs: int
    avgdl: float
    build_id: str = ""
    starts: DataFrame | None = None
    directory: DataFrame | None = None
    documents: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.rows.select("term", "doc_id", "tf")

    def with_lengths(self) -> DataFrame:
        """(term, doc_id, tf, dl); dl is null for a document without a length."""
        if "dl" in self.rows.columns:
            return self.rows.select("term", "doc_id", "tf", "dl")
        return self.postings.join(self.doc_lengths, "doc_id", "left")

    def by_document(self) -> DataFrame:
        """(doc_id, dl, terms, tfs) of each document with a posting: those it has, or the postings gathered once and written."""
        if self.documents is None:
            entry = F.collect_list(F.struct("term", "tf")).alias("_e")
            gathered = self.with_lengths().groupBy("doc_id").agg(F.first("dl").alias("dl"), entry)
            self.documents = materialize(gathered.select("doc_id", "dl", F.col("_e")["term"].alias("terms"), F.col("_e")["tf"].alias("tfs")), "by-document")
        return self.documents

    def blocks(self) -> DataFrame:
        """The block directory: the stored one, or that of the postings."""
        return block_directory(self.postings) if self.directory is None else self.directory

    def blocked(self, term: str | None = None) -> DataFrame:
        """Postings with block_no and gap, of all terms or of one; a literal term reaches the scan."""
        if self.starts is None:
            return blocked(self.postings if term is None else self.postings.where(F.col("term") == term))
        rows, starts = self.rows.select("term", "doc_id", "tf", "_range"), self.starts
        if term is not None:
            rows, starts = rows.where(F.col("term") == term), starts.where(F.col("_key0") == term)
        return blocked(rows, BLOCK, starts)


def of_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_empty: bool = True) -> Index:
    tokens = tokenized(docs, doc_id, text)
    p, lengths = postings(tokens), doc_lengths(tokens, keep_empty)
    s = corpus_stats(lengths).first()
    return Index(p, lengths, lexicon(p), s["n_docs"], s["avgdl"] or 0.0)


def sound_records(run: DataFrame, n_rows: int | None = None, hot: list[int] | None = None) -> DataFrame:
    """Records (term, docid, chunk_no, tf) with term and docid; those that hold a task's share of the rows are combined map-side."""
    rows = run.select(*RECORD).where(F.col("term").isNotNull() & F.col("docid").isNotNull())
    hot = hot_records(rows, RECORD, run.count() if n_rows is None else n_rows) if hot is None else hot
    if not hot:
        return rows
    again = F.xxhash64(*RECORD).isin(hot)
    return rows.where(~again).unionByName(rows.where(again).distinct())


def distinct_records(run: DataFrame) -> DataFrame:
    """The distinct records (term, docid, chunk_no, tf) of a run table, rows of a term and document in one partition.

    Rows with a null term or docid are damaged and left out; nulls in the others are values. One shuffle, by term and
    document together, which no frequent term and no long document fills, and repeats are dropped where they meet. Records
    that hold a task's share of the rows are combined map-side before.
    """
    order = Window.partitionBy("docid", "term").orderBy("chunk_no", "tf")
    same = (F.row_number().over(order) > 1) & F.col("chunk_no").eqNullSafe(F.lag("chunk_no").over(order)) & F.col("tf").eqNullSafe(F.lag("tf").over(order))
    return sound_records(run).repartition("term", "docid").withColumn("_same", same).where(~F.col("_same")).drop("_same")


def run_postings(run: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of a run table: frequencies summed over distinct records; a null tf adds nothing."""
    return distinct_records(run).groupBy("term", F.col("docid").alias("doc_id")).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"))


def of_run(run: DataFrame) -> Index:
    """Index of a run table, lengths from its postings."""
    p = run_postings(run)
    lengths = lengths_from_postings(p)
    s = corpus_stats(lengths).first()
    return Index(p, lengths, lexicon(p), s["n_docs"], s["avgdl"] or 0.0)


def ranking_index(run: DataFrame) -> Index:
    """What ranking needs of a run table's index: postings with their document's length, a row per document, written.

    The run is shuffled once, by document, and no order or directory of postings is made. A run of more than SLICE_ROWS rows is
    shuffled in SLICES parts of its documents, one after the other, and each part's shuffle files go before the next.
    """
    spark = run.sparkSession
    n_rows = run.count()
    slices = SLICES if n_rows > SLICE_ROWS else 1
    hot = hot_records(run.select(*RECORD).where(F.col("term").isNotNull() & F.col("docid").isNotNull()), RECORD, n_rows)
    parts = []
    for k in range(slices):
        rows = sound_records(run if slices == 1 else run.where(F.pmod(F.xxhash64("docid"), F.lit(slices)) == k), hot=hot)
        gathered = rows.repartition("docid").sortWithinPartitions("docid").mapInArrow(document_rows, DOCUMENT)
        with shuffles_removed(spark):
            parts.append(materialize(gathered, "by-document"))
    documents = functools.reduce(DataFrame.unionByName, parts)
    s = corpus_stats(documents).first()
    rows = documents.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_x"))
    rows = rows.select(F.col("_x")["terms"].alias("term"), "doc_id", F.col("_x")["tfs"].alias("tf"), "dl")
    return Index(rows, documents.select("doc_id", "dl"), lexicon(rows), s["n_docs"], s["avgdl"] or 0.0, documents=documents)


def build_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_empty: bool = True) -> Index:
    """Build and open the index of documents: texts are tokenized once."""
    tokens = materialize(tokenized(docs, doc_id, text), "tokens")
    return write_postings(postings(tokens), path, doc_lengths(tokens, keep_empty))


def build_run(run: DataFrame, path: str) -> Index:
    """Build and open the index of a run table."""
    return write_postings(run_postings(run), path)


def write_index(index: Index, path: str) -> Index:
    """Write an index and open it; all its tables are derived from its postings and lengths."""
    return write_postings(index.postings, path, index.doc_lengths)


def write_postings(p: DataFrame, path: str, lengths: DataFrame | None = None) -> Index:
    """Write the index of postings (term, doc_id, tf) as Parquet and open it.

    `lengths` (doc_id, dl) default to the sums of the postings. The postings are computed once; lengths, lexicon and
    statistics are derived from their files. They come to lie in term ranges, sorted by (term, doc_id), so a
    literal term filter prunes row groups, each with its document's length, and the directory of their
    blocks is kept beside them. All tables carry one build id and can't be mixed.
    """
    spark = p.sparkSession
    build = uuid.uuid4().hex
    base = materialize(p, "base-postings")
    with ThreadPoolExecutor(1) as beside:
        lex = beside.submit(_write, lexicon(base), f"{path}/lexicon")
        documents = materialize(base.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("n_terms")), "documents")
        dl = documents.select("doc_id", "dl")
        most, total = documents.agg(F.max("n_terms"), F.sum("n_terms")).first()
        long = hot_keys(documents, "doc_id", "n_terms") if total and most * least_share(spark) > total else None
        if lengths is not None:
            _write(lengths, f"{path}/doc_lengths")
            dl = spark.read.parquet(f"{path}/doc_lengths")
        measured = salted_lookup(base, dl, "doc_id", long, ["term"], "left")
        measured = materialize(measured.select("term", "doc_id", "tf", "dl"), "measured-postings")  # range bounds are sampled from it
        ranged = measured.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        _write(ranged.withColumn("_range", F.spark_partition_id()), f"{path}/postings")
        laid = spark.read.parquet(f"{path}/postings")
        _write(range_starts(laid, ["term"], "doc_id"), f"{path}/starts")
        directory = block_directory(laid.drop("dl"), BLOCK, spark.read.parquet(f"{path}/starts"))
        _write(directory.sortWithinPartitions("term", "block_no"), f"{path}/blocks")
        s = corpus_stats(dl).first()
        if lengths is None:
            _write(dl, f"{path}/doc_lengths")
        lex.result()
    _write(spark.range(1).select(F.lit(build).alias("build_id"), F.lit(s["n_docs"]).cast("bigint").alias("n_docs"), F.lit(float(s["avgdl"] or 0.0)).alias("avgdl")), f"{path}/stats")
    return open_index(spark, path)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> Index:
    s = spark.read.parquet(f"{path}/stats").first()
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    return Index(read("postings"), read("doc_lengths"), read("lexicon"), s["n_docs"], s["avgdl"], s["build_id"], read("starts"), read("blocks"))


def write_blocks(index: Index, path: str, codec: str = "varbyte") -> DataFrame:
    """Write the postings as encoded blocks, ordered by term and block, and return them; see encoded_blocks."""
    blocks = materialize(encoded_blocks(index.blocked(), codec), "encoded-blocks")
    _write(blocks.repartitionByRange("term", "block_no").sortWithinPartitions("term", "block_no"), path)
    return blocks.sparkSession.read.parquet(path)
