"""Run the registered queries next to their check SQL: python -m tests.compare SF_DIR [names]."""

from __future__ import annotations

import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    """Rows as sorted tuples with columns sorted by name."""
    import pandas as pd

    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return round(float(x), 6)
        return str(x)

    columns = sorted(df.columns)
    rows = [tuple(one(x) for x in r) for r in df[columns].itertuples(index=False)]
    return columns, sorted(rows, key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, sf_dir: str, name: str):
    import __spark_entry__ as entry

    sql = entry.oracle_sql().get(name)
    got = canonical(entry.queries()[name](spark, sf_dir).toPandas())
    if sql is None:
        return None, got, None
    want = canonical(con.execute(sql).df())
    return got == want, got, want


def main() -> None:
    from tests.session import make_session

    import __spark_entry__ as entry

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    for name in only or entry.queries():
        begin = time.time()
        try:
            same, got, want = check(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {str(e)[:600]}", flush=True)
            continue
        word = {True: "ok", False: "DIFFERS", None: "rows only"}[same]
        print(f"{name}: {word} {len(got[1])} rows {time.time() - begin:.1f}s", flush=True)
        if same is False:
            print("  columns", got[0], want[0], len(want[1]))
            print("  only here", [r for r in got[1] if r not in want[1]][:2])
            print("  only sql ", [r for r in want[1] if r not in got[1]][:2])
        spark.catalog.clearCache()


if __name__ == "__main__":
    main()
