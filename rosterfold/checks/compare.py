"""Run registered queries against their SQL twins: ``python -m rosterfold.checks.compare DIR [NAME...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from rosterfold.checks.oracle import oracle_sql
from rosterfold.checks.registry import QUERIES


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = Counter(tuple(_plain(row[i]) for i in places) for row in result.fetchall())
    return [columns[i] for i in places], rows


def differences(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """None when both sides hold the same rows, else a short description."""
    ours, theirs = spark_rows(QUERIES[name](spark, sf_dir)), duck_rows(sf_dir, oracle_sql()[name])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if ours[1] != theirs[1]:
        extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
        return (f"{sum(ours[1].values())} rows against {sum(theirs[1].values())}; "
                f"extra {list(extra)[:2]}, missing {list(missing)[:2]}")
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from rosterfold.checks.session import local_session
    from rosterfold.operators.workspace import clear

    spark, failures = local_session(), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = differences(spark, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - reported and counted, the other queries still run
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    clear(spark)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
