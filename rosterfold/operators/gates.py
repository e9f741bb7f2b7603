"""Ordered validation gates.

A gate names a failure condition and the status it gives. A list of gates compiles into one CASE
column: the first gate that fails decides, later gates are not reached, and a row that passes all of
them gets the closing status. Passed rows, failed rows and statuses are then views of one frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rosterfold.functions.status import OK


@dataclass(frozen=True)
class Gate:
    name: str
    fails: Column
    status: Column


def judged(df: DataFrame, gates: list[Gate], success: Column) -> DataFrame:
    """Add ``gate``, the name of the first failed gate or null, and ``status``."""
    first, outcome = None, None
    for gate in gates:
        # An undecided condition is a failure: a row passes only when it provably passes.
        fails = F.coalesce(gate.fails, F.lit(True))
        first = F.when(fails, gate.name) if first is None else first.when(fails, gate.name)
    rows = df.withColumn("gate", F.lit(None).cast("string") if first is None else first)
    for gate in gates:
        hit = F.col("gate") == gate.name
        outcome = F.when(hit, gate.status) if outcome is None else outcome.when(hit, gate.status)
    return rows.withColumn("status", success if outcome is None else outcome.otherwise(success))


def passed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status.code") == OK)


def is_passed() -> Column:
    return F.col("status.code") == OK


def when_passed(value: Column) -> Column:
    return F.when(F.col("gate").isNull(), value)
