"""Helpers of the operators: running totals over a distributed order, and small checked collects."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rosterfold.operators.workspace import new_folder, pinned

__all__ = ["in_order", "new_folder", "partitions", "pinned", "table", "text_or_empty"]


#: Bytes of rows that Spark hands a Python worker at a time, where the session says nothing else: two pieces of ``words.PIECE``.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, also when the session began elsewhere.

    Rows come to the workers in batches of ``BATCH_BYTES``. Spark counts 10,000 rows to a batch, whatever their size, and holds each batch
    outside its heap and in the worker too; rows of texts or of packed sets may have any size.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(rows: DataFrame, by: list[Column], size: str, label: str) -> DataFrame:
    """``rows`` with two more columns, ``_rank`` and ``_before``: how many rows, and how much of ``size``, come
    earlier in the order ``by``.

    Rows are range partitioned and sorted; each task counts its own rows, the table is written, and the totals of
    earlier partitions, one row for each partition, are added. ``by`` must end in a column that tells the rows of a
    large group apart, so that such a group is spread over many partitions. ``size`` is a non-negative bigint.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            ends = np.cumsum(batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False)) + total
            before = np.concatenate([[total], ends[:-1]]) if n else ends
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(count, count + n, dtype=np.int64)), pa.array(before.astype(np.int64))],
                names=[*batch.schema.names, "_part", "_rank", "_before"])
            if n:
                count, total = count + n, int(ends[-1])

    out = T.StructType([*rows.schema, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType()), T.StructField("_before", T.LongType())])
    written = pinned(placed.mapInArrow(numbered, out), label)
    earlier, rank, before = [], 0, 0
    for row in written.groupBy("_part").agg(F.count("*").alias("n"), F.sum(size).alias("s")).orderBy("_part").collect():
        earlier.append((row["_part"], rank, before))
        rank, before = rank + row["n"], before + row["s"]
    totals = spark.createDataFrame(earlier, "_part int, _r bigint, _b bigint")
    return (written.join(F.broadcast(totals), "_part")
            .withColumns({"_rank": F.col("_rank") + F.col("_r"), "_before": F.col("_before") + F.col("_b")})
            .drop("_part", "_r", "_b"))
