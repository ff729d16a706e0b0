"""Compare Spark results with the DuckDB oracle texts (used by tests).

Values are normalised per column (dates to ISO text, floats to 9 significant
digits, decimals to their plain text) and compared as sorted row multisets.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{v:f}"
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time() else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def normalise(cols: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, x or "") for x in r))
    return [cols[i] for i in order], out


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    sc, sr = normalise(*spark_rows(spark_df))
    dc, dr = normalise(*duck_rows(con, sql))
    if sc != dc:
        return f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"row count differs: spark={len(sr)} duck={len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return f"first differing row: spark={a} duck={b}"
    return None


def main(argv: list[str]) -> int:
    from storelens.oracle import oracle_texts
    from storelens.plans.registry import ENTRIES, run
    from storelens.session import local_session
    from storelens.sources.tables import load_tables

    sf = "0.01"
    keys = []
    for a in argv:
        if a.startswith("--sf="):
            sf = a.split("=", 1)[1]
        else:
            keys.append(a)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck_connection(sf_dir)
    texts = oracle_texts()
    t = load_tables(spark, sf_dir)
    bad = 0
    for k in keys or list(ENTRIES):
        df = run(k, spark, sf_dir, t)
        if k not in texts:
            print(f"{k}: rows={df.count()} (no oracle)")
            continue
        try:
            msg = compare(df, con, texts[k])
        except Exception as e:  # report and continue with the next key
            msg = f"error: {type(e).__name__}: {str(e)[:300]}"
        n = con.execute(f"SELECT count(*) FROM ({texts[k]})").fetchone()[0] if msg is None else "-"
        print(f"{k}: {'OK rows=' + str(n) if msg is None else 'FAIL ' + msg}")
        bad += msg is not None
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))


def compare_strict(spark_df, con, sql: str) -> str | None:
    """pandas path: Spark ``toPandas`` against DuckDB ``df``; equal dtypes
    (datetime units aside) and exactly equal values, rows in sorted order."""
    import pandas as pd

    sp = spark_df.toPandas()
    dp = con.execute(sql).df()
    cols = sorted(sp.columns)
    if cols != sorted(dp.columns):
        return f"columns differ: {sorted(sp.columns)} vs {sorted(dp.columns)}"
    sp, dp = sp[cols], dp[cols]
    for c in cols:
        a, b = sp[c].dtype, dp[c].dtype
        if str(a).startswith("datetime64") and str(b).startswith("datetime64"):
            sp[c], dp[c] = sp[c].astype("datetime64[ns]"), dp[c].astype("datetime64[ns]")
        elif a != b:
            return f"dtype of {c}: spark={a} duck={b}"
    if len(sp) != len(dp):
        return f"row count differs: {len(sp)} vs {len(dp)}"
    sp = sp.sort_values(cols, na_position="first").reset_index(drop=True)
    dp = dp.sort_values(cols, na_position="first").reset_index(drop=True)
    ha = pd.util.hash_pandas_object(sp, index=False)
    hb = pd.util.hash_pandas_object(dp, index=False)
    if (ha != hb).any():
        i = int((ha != hb).to_numpy().nonzero()[0][0])
        return f"row {i}: spark={sp.iloc[i].tolist()} duck={dp.iloc[i].tolist()}"
    return None
