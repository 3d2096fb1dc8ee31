"""Reading collections: TSV files under several docid policies, query and seed lists, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions.text import SPACE
from termforge.operators.ranges import numbered

POLICIES = ("explicit", "ordinal", "ordinal_skip_blank")
MALFORMED = ("drop", "replace", "fail")
REPLACEMENT, NONCHARACTER = chr(0xFFFD), chr(0xFDD0)


def sound_text(value: Column, malformed: str = "drop") -> Column:
    """Text without malformed UTF-8: its bytes dropped, replaced by U+FFFD, or an error (fail) when they are met."""
    if malformed == "fail":
        return F.validate_utf8(value)
    if malformed == "replace":
        return F.make_valid_utf8(value)
    if malformed != "drop":
        raise ValueError(f"malformed must be one of {MALFORMED}")
    # replacement characters that are meant wait as a noncharacter while malformed bytes become replacement characters
    kept = F.replace(F.make_valid_utf8(F.replace(value, F.lit(REPLACEMENT), F.lit(NONCHARACTER))), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(kept, F.lit(NONCHARACTER), F.lit(REPLACEMENT)))


def text_lines(spark: SparkSession, path: str, malformed: str = "drop", line_sep: str | None = None) -> DataFrame:
    """(value): the lines of text files, globs allowed; see sound_text for malformed UTF-8. Lines end with a line feed, a
    carriage return or both, or with line_sep alone."""
    return spark.read.text(path, lineSep=line_sep).select(sound_text(F.col("value"), malformed).alias("value"))


def numbered_lines(spark: SparkSession, path: str, malformed: str = "drop", line_sep: str | None = None) -> DataFrame:
    """(line_no, value): lines with their dense ordinal from 0, files in the order of their paths.

    Lines are counted per block of a file, blocks are offset by the counts before them, and a line's place in its block is
    the distance of its running id to the block's first. So numbering takes a scan more and one row per block, and no line
    is shuffled.
    """
    # the running id is that of the scan, so it comes before anything that could drop rows
    lines = spark.read.text(path, lineSep=line_sep).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    blocks = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = lines.join(starts, ["_file", "_block"])
    return placed.select((F.col("_start") + F.col("_id") - F.col("_first")).alias("line_no"), sound_text(F.col("value"), malformed).alias("value"))


def parse_explicit(lines: DataFrame, value: str = "value") -> DataFrame:
    """(doc_id, text) of lines `docid<TAB>text`; all after the first tab is text.

    Lines without a tab or with an id that isn't an integer are skipped, as are null lines.
    """
    parts = F.split(F.col(value), "\t", 2)
    rows = lines.select(F.expr("try_cast(trim(split(" + value + ", '\t', 2)[0]) as bigint)").alias("doc_id"), F.get(parts, 1).alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def parse_ordinal(lines: DataFrame, start: int = 0, skip_blank: bool = False, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """(doc_id, text) with ordinals as ids: start + line number, or start + number of non-blank lines before.

    Text is the last tab-separated field; a line without a tab is all text. Blank lines are skipped
    but use up an id unless skip_blank is set.
    """
    blank = F.trim(F.regexp_replace(F.col(value), r"(?U)\s+", " ")) == ""
    rows = lines.where(F.col(value).isNotNull() & ~blank).select(F.col(line_no).alias("_n"), F.element_at(F.split(F.col(value), "\t"), -1).alias("text"))
    if not skip_blank:
        return rows.select((F.col("_n") + start).alias("doc_id"), "text")
    return numbered(rows, [], "_n").select((F.col("_no") + start).alias("doc_id"), "text")


def read_collection(spark: SparkSession, path: str, policy: str = "explicit", start: int = 0) -> DataFrame:
    """(doc_id, text) of TSV files under a docid policy: explicit, ordinal or ordinal_skip_blank."""
    if policy not in POLICIES:
        raise ValueError(f"unknown docid policy {policy!r}")
    if policy == "explicit":
        return parse_explicit(text_lines(spark, path))
    return parse_ordinal(numbered_lines(spark, path), start, policy == "ordinal_skip_blank")


def latest_by_id(rows: DataFrame, order: str, doc_id: str = "doc_id") -> DataFrame:
    """One row per id, the last by `order`: repeated explicit ids, last line wins."""
    cols = [c for c in rows.columns if c != doc_id]
    return rows.groupBy(doc_id).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(doc_id, "_r.*")


def first_non_blank(rows: DataFrame, n: int, order: str, text: str) -> DataFrame:
    """The first n rows by `order` whose text isn't blank: null, empty or white space only."""
    return rows.where(F.col(text).rlike(f"[^{SPACE}]")).orderBy(order).limit(n)


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed non-blank lines, for query and seed lists."""
    v = F.regexp_replace("value", f"^[{SPACE}]+|[{SPACE}]+$", "")
    return text_lines(spark, path).select(v.alias("value")).where(F.col("value") != "")


def write_subset(lines: DataFrame, path: str, n: int, order: str = "line_no", value: str = "value") -> None:
    """Write the first n non-blank lines as text, in order, into one file."""
    first_non_blank(lines, n, order, value).select(value).coalesce(1).write.mode("overwrite").text(path)


def inspect(df: DataFrame, n: int = 10) -> str:
    """Schema, number of rows and first rows of a table, as text."""
    rows = "\n".join(str(tuple(r)) for r in df.limit(n).collect())
    return f"{df.schema.simpleString()}\n{df.count()} rows\n{rows}"
