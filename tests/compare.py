"""Run registered queries in Spark and DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    """None if equal, else what differs."""
    rel = con.sql(sql)
    want_names, want = rows(rel.columns, rel.fetchall())
    got_names, got = rows(df.columns, df.collect())
    if want_names != got_names:
        return f"columns {got_names} != {want_names}"
    if want == got:
        return None
    return (f"{sum(got.values())} rows, expected {sum(want.values())}; only here "
            f"{list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}")


def main():
    from pyspark.sql import SparkSession

    from queries.oracles import ORACLES
    from queries.registry import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLES:
                diff = compare(df, con, ORACLES[name])
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                state = f"rows only: {df.count()}"
        except Exception as e:  # report and go on to the next query
            state = f"ERROR {str(e)[:600]}"
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name}: {state} ({time.time() - t:.1f}s)", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
