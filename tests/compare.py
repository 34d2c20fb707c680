"""Compare a query with its DuckDB SQL over one folder of tables: python tests/compare.py SF_DIR NAME..."""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return tuple(plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    cols = sorted(frame.columns)
    rows = [tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)]
    return [tuple(cols), *sorted(rows, key=repr)]


def differences(spark, sf_dir: str, name: str, limit: int = 5) -> list:
    import __spark_entry__ as entry

    mine = canonical(entry.queries()[name](spark, sf_dir).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return [] if len(mine) > 1 else ["no rows"]
    theirs = canonical(duck(sf_dir).execute(sql).fetchdf())
    if mine == theirs:
        return []
    return [f"{len(mine) - 1} rows against {len(theirs) - 1}", mine[0], theirs[0], [x for x in zip(mine[1:], theirs[1:]) if x[0] != x[1]][:limit]]


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quire.session import local_session

    session = local_session(8, 8)
    for query in sys.argv[2:] or sorted(entry.queries()):
        began = time.time()
        try:
            found = differences(session, sys.argv[1], query)
        except Exception as e:  # report and go on with the next query
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        print("OK  " if not found else "DIFF", query, round(time.time() - began, 1), *found, flush=True)
