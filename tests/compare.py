"""Compare the Spark result of a query with its SQL twin on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def oracle_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    relation = connection.sql(sql)
    return pd.DataFrame(relation.fetchall(), columns=relation.columns, dtype=object)


def _value(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    columns = [[_value(v) for v in frame[name].astype(object).tolist()] for name in names]
    return sorted(zip(*columns)) if columns else []


def spark_rows(df) -> pd.DataFrame:
    return pd.DataFrame([tuple(row) for row in df.collect()], columns=df.columns, dtype=object)


def difference(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else a short account of the difference."""
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(oracle_frame.columns)}"
    ours, theirs = rows_of(spark_frame), rows_of(oracle_frame)
    if ours == theirs:
        return None
    only_ours, only_theirs = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
    return (
        f"{len(ours)} rows != {len(theirs)} rows, {len(only_ours)} only in Spark, {len(only_theirs)} only in SQL;"
        f"\n  Spark {only_ours[:3]}\n  SQL   {only_theirs[:3]}"
    )
