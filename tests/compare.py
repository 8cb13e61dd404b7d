"""Run registered queries in Spark and DuckDB and compare their rows.

    python tests/compare.py [folder] [query ...]
"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float):
        return float(f"{value:.10g}")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(frame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    ours, theirs = rows_of(frame.columns, frame.collect()), rows_of(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}: {ours[:2]} / {theirs[:2]}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name in wanted:
        start = time.time()
        try:
            frame = entry.queries()[name](spark, folder)
            if name in oracles:
                problem = differences(frame, db, oracles[name])
                verdict = "equal" if problem is None else f"DIFFERENT {problem}"
                bad += problem is not None
            else:
                verdict = f"{frame.count()} rows, no SQL"
        except Exception as error:
            verdict, bad = f"FAILED {type(error).__name__}: {str(error)[:600]}", bad + 1
        print(f"{name:30s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{len(wanted)} queries, {bad} wrong")


if __name__ == "__main__":
    main()
