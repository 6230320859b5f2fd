"""Runs registered queries and their SQL on one scale and compares rows. python tests/oracle.py [NAME or module ...]"""

import glob
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(df):
    import pandas as pd

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else repr(list(v)) if hasattr(v, "__iter__") and not isinstance(v, str) else float(v) if isinstance(v, bool) else str(v)
            df[c] = pd.Series([plain(v) for v in df[c]], dtype=object, index=df.index)
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = pd.Series([None if v is None or v is pd.NA or v != v else float(v) for v in df[c].astype(object)], dtype=object, index=df.index)
    return sorted(map(repr, df.itertuples(index=False, name=None)))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    """None if rows agree, else what differs."""
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a != b:
        odd = sorted(set(a) ^ set(b))[:6]
        return f"{len(a)} and {len(b)} rows; {odd}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sf), E.oracle_sql(), 0
    wanted = sys.argv[1:]
    for name, q in E.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted) or not wanted and name.startswith(("op", "pipeline")):
            continue
        t = time.time()
        try:
            said = compare(spark, con, name, q, sql[name], sf) if name in sql else f"rows {q(spark, sf).count()}"
        except Exception as e:
            said = "ERROR " + str(e)[:600]
        if said and not said.startswith("rows"):
            bad += 1
        print(("ok  " if not said else "    ") + name, said or "", round(time.time() - t, 1), flush=True)
    print(bad, "bad")
