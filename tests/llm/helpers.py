"""Small documents tables and DuckDB beside Spark."""

from __future__ import annotations

import duckdb
import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: texts, or (doc_id, text), or (doc_id, text, lang, source)."""
    full = []
    for i, r in enumerate(rows):
        r = r if isinstance(r, tuple) else (i, r)
        doc_id, text, lang, source = (*r, *(None, None))[:4]
        full.append((doc_id, text, lang, source, len(text) if text is not None else None))
    return spark.createDataFrame(full, SCHEMA)


def written(docs, folder):
    """The table as a file, as the queries read it; returns the data folder."""
    docs.coalesce(2).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def duck(sql: str, folder: str, **frames: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return con.sql(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).astype(str).itertuples(index=False, name=None)))
    assert key(a) == key(b)
