"""Tables laid out by a key: bucketed and sorted, so that folds and joins by that key read them without an exchange.

Rows are sent to their bucket once, when the table is written; each bucket is one file. Windows, aggregates and joins by the key
then begin where the rows already lie together, and two tables with the same key and number of buckets are joined bucket
by bucket. All rows of a key are in one bucket, so a layout is for tables in which no key holds a large share, such as state
and history of ordinary users; ordered operators still cut keys that are too large for a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from rosterfold.operators.workspace import new_folder

BUCKETS = 64


def laid_out(df: DataFrame, label: str, key: str, order: list[str], buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write the rows in buckets of ``key``, sorted by it and ``order``, and read them back.

    The table is external: its files are below ``path``, or in the shared folder, and its entry in the session's catalog tells
    readers of the buckets. Writing again to the same path needs a new table.
    """
    spark = df.sparkSession
    name = f"rosterfold_{label}_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    (placed.write.bucketBy(buckets, key).sortBy(key, *order).option("path", path or new_folder(spark, label))
     .format("parquet").saveAsTable(name))
    return spark.table(name)
