"""Compare a Spark result with its SQL twin: names, kinds and all values, in any row order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        if str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype("float64")
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v)
    key = df.astype(str).agg("\x1f".join, axis=1) if len(df.columns) else pd.Series([], dtype=str)
    return df.assign(_k=key).sort_values("_k").reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    kinds = {c: (str(spark_df[c].dtype), str(sql_df[c].dtype)) for c in spark_df.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and not all("datetime" in x for x in k)
           and not (k[0] == "float64" and k[1].startswith("Int") and spark_df[c].isna().any())}  # whole numbers with nulls
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)} kinds {odd}"
    a, b = canonical(spark_df), canonical(sql_df)
    if not a["_k"].equals(b["_k"]):
        bad = (a["_k"] != b["_k"]).to_numpy().nonzero()[0]
        i = bad[0]
        return f"{len(bad)} rows differ, kinds {odd}\n  spark {a['_k'][i][:600]!r}\n  sql   {b['_k'][i][:600]!r}"
    if odd:
        return f"kinds {odd}"
    return None
