"""Run registered queries on Spark and their check SQL on DuckDB and compare rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "toArray"):
        return tuple(float(x) for x in value.toArray())
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) or isinstance(v, bool) else "", v if v is not None else 0) for v in row)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


UNWANTED = (
    "EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "PythonUDF",
    "CartesianProduct", "BroadcastNestedLoopJoin",
)


def unwanted_nodes(df):
    """Python operators and joins without keys in the plan."""
    plan = df._jdf.queryExecution().toString()
    return [f"plan has {node}" for node in UNWANTED if node in plan]


def compare(spark, con, sf_dir, name, fn, sql):
    """List of problems, empty when both sides agree in columns, types and rows."""
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    spark_rows = sorted((tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return [f"columns {columns} != {sorted(names)}"]
    order = [names.index(c) for c in columns]
    duck_rows = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=key)
    # Training-data operators are free in style.
    problems = [] if name.startswith("op") and name[2:3].isdigit() else unwanted_nodes(df)
    for column, kind in df.dtypes:
        want = KINDS.get(kind)
        if want and not kinds[column].upper().startswith({"VARCHAR": "STRING"}.get(want, want)) and kinds[column].upper() != want:
            problems.append(f"type of {column}: {kind} != {kinds[column]}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    if not duck_rows:
        problems.append("no rows")
    different = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if different:
        problems.append(f"{len(different)} different, first {columns}: {str(different[0][0])[:600]} != {str(different[0][1])[:600]}")
    return problems


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tripflow.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    if os.environ.get("PLAIN"):  # a session without this library's settings
        from pyspark.sql import SparkSession

        builder = SparkSession.builder.master("local[8]")
        for name, value in conf.items():
            builder = builder.config(name, value)
        spark = builder.getOrCreate()
    else:
        spark = build_session("compare", master="local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                problems = compare(spark, con, sf_dir, name, fn, checks[name])
                note = "ok"
            else:
                note = f"rows only: {len(fn(spark, sf_dir).collect())}"
                problems = []
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else note} {name} {time.time() - start:.1f}s", *problems, flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
