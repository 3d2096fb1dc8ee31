"""Queries beside their SQL on the smallest test tables."""

import glob
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def comparable(value):
    return None if value is None or value != value else round(value, 6) + 0.0 if isinstance(value, float) else str(value)


def database():
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        name, files = os.path.basename(path)[: -len(".parquet")], f"{path}/*" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM read_parquet('{files}')")
    return db


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(comparable(r[i]) for i in order) for r in found), key=repr)


def both(spark, db, query, sql):
    df, want = query(spark, DATA), db.sql(sql)
    return rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
