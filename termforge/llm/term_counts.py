"""Frequency of every distinct term, kept up to date by signed deltas.

The counts of a collection live in a persistent table partitioned by a hash of the term, beside the records they count.
A delivery adds records, takes documents out, or both (a changed document). Only what it adds or takes
out is aggregated, into signed per-term changes of occurrences and of documents, and only the partitions of
changed terms are merged and rewritten into the next version.

Folder: `versions/N.json` says what version N consists of; `counts/v=N/part=P` are partitions of the counts, `records/v=N` the
records delivery N added and `gone/v=N` the documents it took out. A delivery writes its files first and its
version file last, by a rename that fails if the version is there, so readers see whole versions
only and a delivery that breaks off leaves nothing but files no version names.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.operators.consolidate import hot_records
from termforge.session import materialize, scratch_path

RECORD = ("term", "docid", "chunk_no", "tf")
COUNTS = "term string, cf bigint, df bigint"
TERMS_A_PART = 250_000
# Into how many id ranges the documents of a delivery are gathered, to read no more of the records than these.
SPANS = 24
PAGE_ROWS = 2000


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def sound(rows: DataFrame) -> DataFrame:
    """The record columns of rows whose term and docid aren't null; other columns aren't read."""
    return rows.select(*RECORD).where(F.col("term").isNotNull() & F.col("docid").isNotNull())


def added_records(delivered: DataFrame, known: DataFrame | None, about: int) -> DataFrame:
    """(record..., lead): the distinct records delivered that aren't known, lead marking one for each (term, docid)
    that has no known record.

    One shuffle, by (term, docid), which no single term or document fills. Records that hold a task's share of the
    rows are combined map-side before; `about` is roughly the number of rows.
    """
    hot = hot_records(delivered, RECORD, about)
    rows = delivered.withColumn("known", F.lit(0))
    if hot:
        again = F.xxhash64(*RECORD).isin(hot)
        rows = rows.where(~again).unionByName(rows.where(again).distinct())
    if known is not None:
        rows = rows.unionByName(known.select(*RECORD).withColumn("known", F.lit(1)))
    pair = Window.partitionBy("docid", "term")  # in this order rows come out sorted by document, as they are stored
    order = pair.orderBy("chunk_no", "tf", F.desc("known"))
    same = F.col("chunk_no").eqNullSafe(F.lag("chunk_no").over(order)) & F.col("tf").eqNullSafe(F.lag("tf").over(order)) & (F.row_number().over(order) > 1)
    lead = F.row_number().over(order) == 1
    if known is not None:
        lead = lead & (F.max("known").over(pair) == 0)
    marked = rows.repartition("term", "docid").select(*RECORD, "known", same.alias("_same"), lead.alias("lead"))
    return marked.where(~F.col("_same") & (F.col("known") == 0)).select(*RECORD, "lead")


def changes(records: DataFrame, sign: int) -> DataFrame:
    """(term, docid, cf, df, n): signed changes of occurrences and documents per term, with a null docid, and per
    document its number of records, with a null term. One scan; a null tf adds nothing."""
    return records.groupingSets([["term"], ["docid"]], "term", "docid").agg(
        F.coalesce(F.sum("tf") * sign, F.lit(0)).cast("bigint").alias("cf"), (F.count(F.when(F.col("lead"), 1)) * sign).alias("df"), F.count(F.lit(1)).alias("n")
    )


@dataclass
class Version:
    """What a version consists of: the folder of each partition of the counts, its record and deletion folders, totals."""

    number: int = 0
    parts: int = 1
    counts: dict[str, str] = field(default_factory=dict)
    records: list[int] = field(default_factory=list)
    gone: list[int] = field(default_factory=list)
    n_docs: int = 0
    n_terms: int = 0
    kinds: str | None = None


class TermCounts:
    """Versioned counts (term, cf, df) of a folder. Terms whose df falls to 0 leave."""

    def __init__(self, spark: SparkSession, path: str, version: Version):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> TermCounts:
        """Empty counts in a new folder; FileExistsError if it holds a version."""
        new = cls(spark, path, Version())
        if new._numbers():
            raise FileExistsError(path)
        return new

    @classmethod
    def open(cls, spark: SparkSession, path: str, number: int | None = None) -> TermCounts:
        """The newest version of a folder, or the given one; FileNotFoundError if there is none."""
        old = cls(spark, path, Version())
        numbers = old._numbers()
        if not numbers or (number is not None and number not in numbers):
            raise FileNotFoundError(path)
        stored = spark.read.option("wholetext", True).text(old._file(max(numbers) if number is None else number)).first()[0]
        old.version = Version(**json.loads(stored))
        return old

    # ---- reading

    @property
    def n_docs(self) -> int:
        return self.version.n_docs

    def table(self, only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{p}" for k, p in sorted(self.version.counts.items()) if only is None or int(k) in only]
        if not folders:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(*folders)

    def records(self, of: DataFrame | None = None) -> DataFrame | None:
        """(record..., lead) of the documents that are there, or of those among `of` (docid); None if there are none.

        Documents are looked up by at most SPANS ranges of ids, so of the sorted record files only pages that may hold them
        are read.
        """
        v = self.version
        if not v.records:
            return None
        schema = T.StructType.fromJson(json.loads(v.kinds))
        read = lambda kind, numbers, s: self.spark.read.schema(s).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/v={k}" for k in numbers])
        rows = read("records", v.records, schema)
        if of is not None:
            low, high = of.agg(F.min("docid"), F.max("docid")).first()
            if low is None:
                return None
            rows = rows.where(_within(of, low, high)).join(of, "docid", "left_semi")
        if v.gone:
            gone = read("gone", v.gone, T.StructType([schema["docid"], schema["v"]])).groupBy("docid").agg(F.max("v").alias("_until"))
            rows = rows.join(gone, "docid", "left").where(F.col("_until").isNull() | (F.col("v") >= F.col("_until")))
        return rows.select(*RECORD, "lead")

    def marked(self, rare_docs: int, common_share: float) -> DataFrame:
        """(term, cf, df, mark): rare (df <= rare_docs), common (df > common_share of all documents) or null.

        A term that is both, in a tiny collection, is rare.
        """
        mark = F.when(F.col("df") <= rare_docs, "rare").when(F.col("df") > common_share * self.n_docs, "common")
        return self.table().withColumn("mark", mark)

    # ---- writing

    def deliver(self, rows: DataFrame | None = None, deleted: DataFrame | None = None, about: int | None = None) -> None:
        """Merge a delivery: run rows (term, docid, chunk_no, tf) added and documents (docid) taken out before.

        Records known already, and rows or files delivered again, change nothing. A document in both is a changed one: its
        rows replace what it had. Rows with a null term or docid, null docids and documents that aren't there are ignored.
        `about`, roughly the number of rows, saves counting them.
        """
        number, v = self.version.number + 1, self.version
        delta: list[tuple[int, DataFrame]] = []
        records, gone = list(v.records), list(v.gone)
        taken = None
        if deleted is not None and v.records:
            taken = materialize(deleted.select("docid").where(F.col("docid").isNotNull()).distinct(), "taken-out")
            out = self.records(taken)
            if out is not None:
                delta.append((-1, changes(out, -1)))
                taken.write.mode("overwrite").parquet(f"{self.path}/gone/v={number}")
                gone.append(number)
        kinds = v.kinds
        if rows is not None:
            rows = sound(rows)
            known = None
            if v.records:
                touched = materialize(rows.select("docid").distinct(), "touched")
                known = self.records(touched if taken is None else touched.join(taken, "docid", "left_anti"))
                known = None if known is None else materialize(known, "known-records")
            new = added_records(rows, known, rows.count() if about is None else about).sortWithinPartitions("docid")
            new.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/records/v={number}")
            kinds = kinds or T.StructType([*new.schema.fields, T.StructField("v", T.IntegerType())]).json()
            added = changes(self.spark.read.schema(new.schema).parquet(f"{self.path}/records/v={number}"), 1)
            if known is not None:  # documents that were there are no new ones
                added = added.join(known.select(F.col("docid").alias("_d")).distinct(), F.col("docid") == F.col("_d"), "left")
                added = added.withColumn("n", F.when(F.col("_d").isNotNull(), 0).otherwise(F.col("n"))).drop("_d")
            delta.append((1, added))
            records.append(number)
        self._merge(delta, number, records, gone, kinds)

    def compact(self) -> None:
        """Publish a version of the same counts whose records lie in one folder, in ranges of document and term, without those
        of documents taken out. Older versions stay readable as long as their folders do."""
        v, live = self.version, self.records()
        if live is None:
            return
        number = v.number + 1
        laid = materialize(live, "live-records").repartitionByRange("docid", "term").sortWithinPartitions("docid")
        laid.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/records/v={number}")
        self.version = self._published(replace(v, number=number, records=[number], gone=[]))

    def _merge(self, delta: list[tuple[int, DataFrame]], number: int, records: list[int], gone: list[int], kinds: str | None) -> None:
        """Merge signed changes into the partitions they fall in and publish the version."""
        v = self.version
        n_docs, per_term, touched, n = v.n_docs, None, set(), 0
        changed = F.col("term").isNotNull() & ((F.col("cf") != 0) | (F.col("df") != 0))
        for sign, rows in delta:
            rows = materialize(rows, "delta")
            # the set holds at most `parts` numbers
            told = rows.agg(
                F.count_if(F.col("docid").isNotNull() & (F.col("n") > 0)).alias("docs"), F.count_if(changed).alias("terms"),
                F.collect_set(F.when(changed, part_of(F.col("term"), v.parts))).alias("parts"),
            ).first()
            n_docs, n, touched = n_docs + sign * told["docs"], n + told["terms"], touched | set(told["parts"])
            terms = rows.where(changed).select("term", "cf", "df")
            per_term = terms if per_term is None else per_term.unionByName(terms)
        parts, counts, n_terms = v.parts, dict(v.counts), v.n_terms
        if touched:
            while v.n_terms + n > 2 * TERMS_A_PART * parts:
                parts *= 2
            touched = touched if parts == v.parts else set(range(parts))
            before = self.table(sorted(touched) if parts == v.parts else None)
            both = before.unionByName(per_term).withColumn("part", part_of(F.col("term"), parts)).repartition(len(touched), "part")
            merged = both.groupBy("part", "term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).where("df > 0")
            folder = f"counts/v={number}"
            merged.select("term", "cf", "df", "part").write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/{folder}")
            counts = {k: p for k, p in counts.items() if parts == v.parts and int(k) not in touched}
            counts.update({name.split("=")[1]: f"{folder}/{name}" for name in self._folders(folder)})
            n_terms = TermCounts(self.spark, self.path, Version(parts=parts, counts=counts)).table().count()  # from the files' footers
        self.version = self._published(Version(number, parts, counts, records, gone, n_docs, n_terms, kinds))

    # ---- files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, below: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{below}")
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:08d}.json"

    def _numbers(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _published(self, version: Version) -> Version:
        """Write the version's file; FileExistsError if another delivery was faster."""
        draft, fs = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        final, _ = self._fs(self._file(version.number))
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise FileExistsError(f"version {version.number} of {self.path}")
        return version


def _within(ids: DataFrame, low, high) -> Column:
    """Whether docid lies in one of at most SPANS ranges that hold all ids (docid): ids are gathered in 8 * SPANS equal
    ranges, and neighbours joined where least lies between them."""
    spans = [(low, high)]
    if isinstance(low, int) and high > low:
        step = max(1, math.ceil((high - low + 1) / (8 * SPANS)))
        found = ids.groupBy(F.expr(f"(docid - {low}L) div {step}L")).agg(F.min("docid").alias("a"), F.max("docid").alias("b")).select("a", "b").collect()
        spans = sorted((r["a"], r["b"]) for r in found)
        gaps = sorted(range(1, len(spans)), key=lambda k: spans[k][0] - spans[k - 1][1], reverse=True)[: SPANS - 1]
        starts = [0, *sorted(gaps)]
        spans = [(spans[i][0], spans[j - 1][1]) for i, j in zip(starts, [*starts[1:], len(spans)], strict=True)]
    any_of = F.lit(False)
    for a, b in spans:
        any_of = any_of | F.col("docid").between(a, b)
    return any_of


def collection_counts(run: DataFrame, files: DataFrame | None = None, first_share: float = 0.9, path: str | None = None) -> TermCounts:
    """Counts of a run table, taken in two deliveries: the files up to the `first_share` quantile of the file ids in the
    manifest `files` (file_id, n_rows), then the later ones. Without a usable manifest all come at once.

    Rows with a null file_id come with the first. Which delivery a row comes with changes nothing in the counts.
    """
    spark = run.sparkSession
    counts = TermCounts.create(spark, path or scratch_path(spark, "term-counts"))
    cut, about = files.agg(F.percentile_approx("file_id", first_share), F.sum("n_rows")).first() if files is not None else (None, None)
    if cut is None:
        counts.deliver(run)
        return counts
    counts.deliver(run.where(F.col("file_id").isNull() | (F.col("file_id") <= cut)), about=about)
    counts.deliver(run.where(F.col("file_id") > cut), about=None if about is None else int(about * (1 - first_share)) + 1)
    return counts
