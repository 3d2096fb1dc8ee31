import pytest

from termforge.sources import strict_lines as S

CASES = [
    (1, "5\tgood text", None), (2, " 7 \tpadded id", None), (3, '8\t"a ""quoted"" tab\tinside"', None), (4, '"9"\tid quoted', None),
    (5, "10\ttrailing return\r", None), (6, '11\tquote " inside is content"', None), (7, "4294967295\tlargest", None), (8, "000000000000012\tzeros", None),
    (9, "", "blank"), (10, "   ", "blank"), (11, "\r", "blank"), (12, "\t", "blank"), (13, " ", "blank"),
    (14, '1\t"never closed', "quoting"), (15, '1\t"closed" then more', "quoting"), (16, '1\t2\t"open', "quoting"), (17, '1\t"""', "quoting"),
    (18, "only one field", "columns"), (19, "1\tb\tc", "columns"), (20, "1\tb\t", "columns"), (21, '"a\tb"', "columns"),
    (22, "\ttext", "docid"), (23, "4294967296\ttext", "docid"), (24, "１２\ttext", "docid"), (25, "-1\ttext", "docid"), (26, "1.0\ttext", "docid"),
    (27, "99999999999999999999999\ttext", "docid"), (28, "﻿12\ttext", "docid"),
    (29, "1\t?!", "text"), (30, '1\t""', "text"), (31, "1\tbad � mark", "text"), (32, "1\tesc \x1b here", "text"), (33, "1\t", "text"),
    (34, "1\tbell\x07", "text"), (35, "﻿\t", "docid"), (36, None, "blank"),
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, s, "x", "clash") for i, s, _ in CASES]
    return spark.createDataFrame(rows, "line_id bigint, line string, _line string, reason string")


def test_reasons(lines):
    got = {r["line_id"]: r["reason"] for r in S.rejected_lines(lines).collect()}
    assert got == {i: r for i, _, r in CASES if r}


def test_loaded(lines):
    got = {r["line_id"]: (r["docid"], r["text"]) for r in S.loaded_rows(lines).collect()}
    assert set(got) == {i for i, _, r in CASES if r is None}
    assert got[3] == (8, 'a "quoted" tab\tinside') and got[4] == (9, "id quoted") and got[2] == (7, "padded id")
    assert got[5] == (10, "trailing return") and got[8][0] == 12


def test_split_is_complete_with_null_and_repeated_offsets(spark):
    rows = [(None, "1\tok"), (None, "bad"), (3, "2\tok"), (3, "2\tok"), (3, "worse")]
    raw = spark.createDataFrame(rows, "line_id bigint, line string")
    assert S.loaded_rows(raw).count() == 3
    assert sorted(r["line"] for r in S.rejected_lines(raw).collect()) == ["bad", "worse"]


def test_very_long_lines(spark):
    long = "word " * 400_000
    rows = [(1, "1\t" + long), (2, '2\t"' + '""' * 500_000 + 'a"'), (3, '3\t"' + '""' * 500_000), (4, "\t" * 300_000)]
    raw = spark.createDataFrame(rows, "line_id bigint, line string")
    assert {r["line_id"] for r in S.loaded_rows(raw).collect()} == {1, 2}
    assert {r["line_id"]: r["reason"] for r in S.rejected_lines(raw).collect()} == {3: "quoting", 4: "blank"}


def test_empty(spark):
    raw = spark.createDataFrame([], "line_id bigint, line string")
    assert S.rejected_lines(raw).count() == 0 and S.loaded_rows(raw).count() == 0
