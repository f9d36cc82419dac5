"""Comparison of a query with its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for f in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def rows(df):
    """Rows as sorted tuples of text, columns by name, numbers to 5 places."""

    def cell(x):
        if x is None or x != x:
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x) + 0.0:.5f}".replace("-0.00000", "0.00000")
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False, name=None))


def close(a, b, digits=2e-5):
    """Whether two lists of rows agree, numbers within digits."""
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if u != v:
                try:
                    if abs(float(u) - float(v)) > digits:
                        return False
                except ValueError:
                    return False
    return True
