"""Lines of TSV files: load the conforming ones, report the others with a reason.

Strict load plus anti-join. Offsets of the raw lines are kept; one anchored pattern admits only
lines of exactly two well-formed fields; the loaded offsets are subtracted from the raw ones, and
only what remains is diagnosed. Everything runs in JVM expressions; quantifiers are possessive,
so matching is linear and needs no stack however long a line is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line format.
QUOTED = r'"(?:[^"]++|"")*+"'
FIELD = rf'(?:{QUOTED}(?=\t|\z)|(?!")[^\t]*+)'
DOCID = r'("?) *0*([0-9]{1,10}) *\1'
STRICT = rf"(?s)\A{DOCID}\t(?=[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])({FIELD})\z"
WELL_QUOTED = rf"(?s)\A{FIELD}(?:\t{FIELD})*+\z"
QUOTED_AT_START = rf"(?s)(\A|\t){QUOTED}"
ID_FIRST = rf"\A{DOCID}\t"
BLANK = r"(?s)\A[\s\x1c-\x1f\x85\p{Z}]*+\z"
BAD_TEXT = r"[\x{FFFD}\x00-\x08\x0A-\x1F\x7F-\x9F]"
MAX_DOCID = 4294967295


def _content(line: str) -> Column:
    c = F.coalesce(F.col(line), F.lit(""))
    return F.when(c.endswith("\r"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def _unquote(field: Column) -> Column:
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def _docid(line: Column, pattern: str) -> Column:
    """The id of a line that matches the pattern; the digits in it fit a bigint."""
    return F.regexp_extract(line, pattern, 2).cast("bigint")


def load_lines(raw: DataFrame, line: str = "line") -> DataFrame:
    """The columns of raw for every line that loads, with _line, its content, added.

    One pattern admits exactly two well-formed fields, the first an id in ASCII digits and the
    second with a letter or digit; the id's range and bad characters are checked apart.
    """
    rows = raw.withColumn("_line", _content(line))
    ok = F.col("_line").rlike(STRICT) & ~F.col("_line").rlike(BAD_TEXT)
    return rows.where(F.when(ok, _docid(F.col("_line"), STRICT) <= MAX_DOCID).otherwise(F.lit(False)))


def loaded_rows(raw: DataFrame, offset: str = "line_id", line: str = "line") -> DataFrame:
    """(offset, docid, text) of every line that loads."""
    text = _unquote(F.regexp_extract("_line", STRICT, 3))
    return load_lines(raw.select(offset, line), line).select(offset, _docid(F.col("_line"), STRICT).alias("docid"), text.alias("text"))


def rejected_lines(raw: DataFrame, offset: str = "line_id", line: str = "line") -> DataFrame:
    """(offset, line, reason) of every line that does not load, with the first reason that applies.

    Reasons, in order: blank, quoting, columns, docid, text. A null line is blank. The raw offsets
    minus the loaded ones remain; as an offset may be null or repeated in dirty input, the
    line's hash goes with it (equal lines have equal outcomes). Other columns are not read.
    """
    rows = raw.select(F.col(offset).alias("_offset"), F.col(line).alias("_raw")).withColumn("_hash", F.xxhash64("_raw"))
    good = load_lines(rows, "_raw").select(F.col("_offset").alias("_o"), F.col("_hash").alias("_h"))
    left = rows.join(good, F.col("_offset").eqNullSafe(F.col("_o")) & (F.col("_hash") == F.col("_h")), "left_anti")
    s = F.col("_line")
    bare = F.regexp_replace(s, QUOTED_AT_START, "$1")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit("\t"), F.lit(""))) + 1
    reason = (
        F.when(s.rlike(BLANK), "blank")
        .when(~s.rlike(WELL_QUOTED), "quoting")
        .when(fields != 2, "columns")
        .when(~F.coalesce(F.when(s.rlike(ID_FIRST), _docid(s, ID_FIRST) <= MAX_DOCID), F.lit(False)), "docid")
        .otherwise("text")
    )
    return left.withColumn("_line", _content("_raw")).select(F.col("_offset").alias(offset), F.col("_raw").alias(line), reason.alias("reason"))
