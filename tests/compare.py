"""Run queries and their SQL side by side: python -m tests.compare SF_DIR [NAME...]"""

import sys
import traceback

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if not sql:
        return f"rows {len(got)}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns), (cols, df.columns)
    a, b = rows(df.columns, got), rows(cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert a == b, f"{len(a)} and {len(b)} rows; {len(bad)} differ: {bad[:3]}"
    return f"ok {len(a)}"


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    for q in sys.argv[2:] or [x for x in entry.queries() if not x.startswith("op") and x != "pipeline"]:
        try:
            said = compare(session, sys.argv[1], q)
            if sys.argv[2:] or not said.startswith("ok"):
                print(q, said, flush=True)
        except Exception as e:
            print(q, "FAIL", type(e).__name__, str(e).split("JVM stacktrace")[0][:420].replace("\n", " "), flush=True)
    print("done")
