"""Runs a query and its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def _plain(x):
    return int(x) if isinstance(x, float) and x.is_integer() else x  # whole numbers of a column with nulls


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return list(frame.columns), sorted(str(tuple(map(_plain, row))) for row in rows)


def by_sql(sql: str, data: str = DATA):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return rows_of(c.execute(sql).fetchdf())


def by_spark(spark, query, data: str = DATA):
    return rows_of(query(spark, data).toPandas())
