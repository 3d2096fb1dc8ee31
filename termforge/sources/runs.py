"""Run files: tab-separated and the binary interchange format, read by partition."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

RUN_SCHEMA = "term string, doc_id bigint, tf bigint"
# Fixed value: the mark at the start of a binary run.
MAGIC = b"RUN1"
# Rows after which a term goes on in a further group.
GROUP = 1_000_000


def read_tsv_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).option("quote", "").option("escape", "").csv(path, sep="\t")


def write_tsv_runs(postings: DataFrame, path: str) -> None:
    """Sorted by (term, doc_id) over disjoint term ranges, one file per range."""
    rows = postings.select("term", "doc_id", "tf").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    rows.write.mode("overwrite").option("quote", "").option("escape", "").option("emptyValue", "").csv(path, sep="\t")


def encode_run(groups: Iterator[tuple[str, np.ndarray, np.ndarray]]) -> bytes:
    """Binary run of (term, docids, frequencies): little-endian, a length-prefixed term, a count, two u32 arrays."""
    out = [MAGIC]
    for term, docids, freqs in groups:
        name = term.encode("utf-8")
        out += [struct.pack("<I", len(name)), name, struct.pack("<I", len(docids)), np.asarray(docids).astype("<u4").tobytes(), np.asarray(freqs).astype("<u4").tobytes()]
    return b"".join(out)


def decode_run(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Groups of a binary run; ValueError for another format, EOFError for a truncated file."""
    if data[:4] != MAGIC:
        raise ValueError("not a binary run")
    at = 4

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise EOFError("truncated run")
        at += n
        return data[at - n : at]

    while at < len(data):
        term = take(struct.unpack("<I", take(4))[0]).decode("utf-8")
        n = struct.unpack("<I", take(4))[0]
        docids = np.frombuffer(take(4 * n), "<u4").astype(np.int64)
        yield term, docids, np.frombuffer(take(4 * n), "<u4").astype(np.int64)


def _decode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for content in pdf["content"]:
            for term, docids, freqs in decode_run(bytes(content)):
                yield pd.DataFrame({"term": term, "doc_id": docids, "tf": freqs})


def read_binary_runs(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, tf) of binary runs, a file per task at a time (a run is as large as one batch of documents)."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_decode_files, RUN_SCHEMA)


def encoded_groups(batches: Iterable[pd.DataFrame]) -> Iterator[bytes]:
    """The groups of a run, without its mark, from rows in order of (term, doc_id).

    A group's length stands before its rows, so a term's rows are gathered until the next term comes; a term goes
    on in a further group after GROUP rows, which a reader sums or concatenates all the same.
    """
    term, docids, freqs, held = None, [], [], 0

    def group() -> bytes:
        return encode_run(iter([(term, np.concatenate(docids), np.concatenate(freqs))]))[len(MAGIC) :]

    for pdf in batches:
        for name, part in pdf.groupby("term", sort=False):
            if held and (name != term or held >= GROUP):
                yield group()
                docids, freqs, held = [], [], 0
            term = name
            docids.append(part["doc_id"].to_numpy())
            freqs.append(part["tf"].to_numpy())
            held += len(part)
    if held:
        yield group()


@dataclass
class _Written(WriterCommitMessage):
    draft: str | None
    name: str | None


class _RunWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        number, draft = TaskContext.get().partitionId(), None
        groups = encoded_groups(b.to_pandas() for b in iterator if b.num_rows)
        first = next(groups, None)
        if first is None:
            return _Written(None, None)
        fs, root = _file_system(self.path)
        draft = f"{root}/_draft-{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/_draft-{self.job}")
        with fs.open_output_stream(draft) as out:
            out.write(MAGIC + first)
            for g in groups:
                out.write(g)
        return _Written(draft, f"{root}/part-{number:05d}-{self.job}.run")

    def commit(self, messages) -> None:
        fs, root = _file_system(self.path)
        fs.create_dir(root)
        kept = {m.name for m in messages if m and m.name}
        for m in messages:
            if m and m.draft:
                fs.move(m.draft, m.name)
        if self.overwrite:
            from pyarrow.fs import FileSelector, FileType

            for f in fs.get_file_info(FileSelector(root)):
                if f.type == FileType.File and f.path.endswith(".run") and f.path not in kept:
                    fs.delete_file(f.path)
        self._tidy(fs, root)

    def abort(self, messages) -> None:
        self._tidy(*_file_system(self.path))

    def _tidy(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        draft = f"{root}/_draft-{self.job}"
        if fs.get_file_info(draft).type == FileType.Directory:
            fs.delete_dir(draft)


def _file_system(path: str):
    """File system and path by URI, as Arrow knows them (local, HDFS, S3, GCS); a bare path is local or shared."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


class RunSink(DataSource):
    """Data source "run1": writes rows (term, doc_id, tf) in order of (term, doc_id) as one binary run per partition.

    Each task streams to a draft; drafts become runs when all tasks are done. Overwriting removes the folder's older runs.
    """

    @classmethod
    def name(cls) -> str:
        return "run1"

    def schema(self) -> str:
        return RUN_SCHEMA

    def writer(self, schema, overwrite: bool) -> _RunWriter:
        return _RunWriter(self.options["path"].removeprefix("file:") if self.options["path"].startswith("file:/") else self.options["path"], overwrite)


def write_binary_runs(postings: DataFrame, path: str, runs: int | None = None) -> None:
    """Write postings as binary runs, one per term range, each sorted by (term, doc_id)."""
    spark = postings.sparkSession
    spark.dataSource.register(RunSink)
    rows = postings.select("term", "doc_id", "tf")
    ranged = rows.repartitionByRange(runs, "term", "doc_id") if runs else rows.repartitionByRange("term", "doc_id")
    ranged.sortWithinPartitions("term", "doc_id").write.format("run1").mode("overwrite").save(path)


def run_format(head: bytes) -> str:
    """Format of a run by its first bytes: binary or tsv."""
    return "binary" if head[:4] == MAGIC else "tsv"


def formats_of(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """format -> files at a path or glob, by the first bytes of each. A run holds a batch of documents, so there are few."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(conf)
    out: dict[str, list[str]] = {}
    for found in fs.globStatus(pattern) or ():
        for f in fs.listStatus(found.getPath()):
            name = f.getPath().getName()
            if f.isFile() and not name.startswith(("_", ".")):
                stream = fs.open(f.getPath())
                try:
                    head = bytes(b & 0xFF for b in (stream.read() for _ in range(min(len(MAGIC), f.getLen()))))
                finally:
                    stream.close()
                out.setdefault(run_format(head), []).append(f.getPath().toString())
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, tf) of runs of either format at a path or glob, each file read by its own format."""
    files = formats_of(spark, path)
    parts = []
    if "tsv" in files:
        parts.append(spark.read.schema(RUN_SCHEMA).option("quote", "").option("escape", "").csv(files["tsv"], sep="\t"))
    if "binary" in files:
        parts.append(spark.read.format("binaryFile").load(files["binary"]).select("content").mapInPandas(_decode_files, RUN_SCHEMA))
    out = spark.createDataFrame([], RUN_SCHEMA)
    for p in parts:
        out = out.unionByName(p)
    return out
