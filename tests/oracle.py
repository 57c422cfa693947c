"""Run registered queries beside their SQL in DuckDB and compare the results.

    python -m tests.oracle [--sf DIR] [name ...]
"""

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        if isinstance(v, dict):
            return tuple((k, cell(x)) for k, x in v.items())
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        return str(v)

    df = df[sorted(df.columns)]
    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if not len(got) and not len(want):
        return None
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got.columns)}: {str(bad[0])[:700]}" if bad else None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    if argv[:1] == ["--from"]:
        names = list(queries)
        argv = names[names.index(argv[1]) :]
    for name in argv or queries:
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).toPandas())
                problem = None if n else "no rows"
        except Exception as e:  # report and go on with the others
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:6.2f}s {name}{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
