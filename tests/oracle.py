"""Compare a Spark result with the SQL counterpart run by DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=repr)


def check(spark_df, db, sql):
    got, want = spark_df.toPandas(), db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want), f"{len(got)} rows, expected {len(want)}"
    for mine, theirs in zip(canonical(got), canonical(want)):
        assert mine == theirs, f"{mine} is not {theirs}"
    return len(got)
