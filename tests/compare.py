"""Run catalog queries on Spark and their SQL on DuckDB and compare the rows."""

import decimal
import glob
import math
import os
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(df, sql: str, con) -> str | None:
    """None when both sides give the same columns and rows."""
    spark_columns, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    sql_columns, want = _sorted([d[0] for d in cursor.description], cursor.fetchall())
    if spark_columns != sql_columns:
        return f"columns {spark_columns} != {sql_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a!r:.400} != sql {b!r:.400}"
    return None


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = difference(run(spark, folder), sql[name], con)
                state = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                state = f"rows only: {run(spark, folder).count()}"
        except Exception as error:
            state = f"FAILED {type(error).__name__} {str(error)[:600]}"
        bad += not state.startswith(("ok", "rows"))
        print(f"{time.time() - start:6.2f}s {name}: {state}", flush=True)
    print("problems:", bad)
