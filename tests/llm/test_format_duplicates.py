import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from termforge.llm import format_duplicates as D

WORD = re.compile(r"[^\W_]+")


def canonical(text):
    """Plain model of the definition."""
    ws = WORD.findall((text or "").lower())
    if not ws:
        return None
    parts = [p for p in re.split("[|;\n\r]", text) if WORD.search(p)]
    if len(parts) >= 3 and all(":" in p and len(WORD.findall(p.split(":")[0])) == 1 for p in parts):
        return ("f", *sorted(" ".join(WORD.findall(p.lower())) for p in parts))
    return ("t", " ".join(ws))


TEXTS = [
    "The cat, sat.", "the CAT sat", "(The cat sat)", "The cat\tsat.", "the cat  sat", "cat the sat", "The cats sat", "", None, " ?! ", "Καλός ΔΡΌΜΟΣ", "καλός δρόμος",
    "Name: A b | Age: 5 | Town: X", "age: 5;\nTOWN: x;name:  a B", "Name: A b | Age: 5", "Age: 5 | Name: A b", "Name: A b | Age: 5 | Town X", "Town X | Name: A b | Age: 5",
    "Full name: A | Age: 5 | Town: X", "Age: 5 | Full name: A | Town: X", "Name: A | Age: 5 | Town: X |", "Town: X | Name: A\rAge: 5", "a:b;c:d;e:f", "e:f;a:b;c:d", "e: f|a :b|c: d",
]


def frame(spark, texts):
    rows = [(100 + i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_id bigint, text string, group_key string, n int")


def want(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        if canonical(t) is not None:
            groups[canonical(t)].append(100 + i)
    return groups


def test_groups_match_the_definition(spark):
    g = want(TEXTS)
    got = {r["row_id"]: (r["n_copies"], r["n_variants"]) for r in D.collapse(frame(spark, TEXTS)).collect()}
    assert got == {v[0]: (len(v), len({TEXTS[i - 100] for i in v})) for v in g.values()}
    assert len(g["f", "a b", "c d", "e f"]) == 3


def test_copies(spark):
    rng = random.Random(5)
    hot = "one text held by very many rows"
    texts = TEXTS + [hot if rng.random() < 0.5 else hot.upper() if rng.random() < 0.5 else f"text {rng.randrange(60)}" for _ in range(800)] + TEXTS
    pairs = {(v[0], m) for v in want(texts).values() for m in v[1:]}
    rows = D.copies(frame(spark, texts)).collect()
    assert len(rows) == len(pairs) and {(r["row_id"], r["copy_row_id"]) for r in rows} == pairs


def test_long_texts_and_null_ids(spark):
    long = "word " * 300_000
    rows = [(1, long), (2, long.upper()), (None, long), (3, None)]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    assert [tuple(r) for r in D.copies(df).collect()] == [(1, 2)]
    assert [(r["row_id"], r["n_copies"]) for r in D.collapse(df).collect()] == [(1, 3)]


def test_empty(spark):
    e = frame(spark, TEXTS).where(F.lit(False))
    assert D.copies(e).count() == 0 and D.collapse(e).count() == 0
