"""Reading and writing request, event, status and state tables, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from rosterfold.operators.folds import latest
from rosterfold.schemas import conform

KEEP_NULL = ("groups",)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Requests or events stored as Parquet, in the domain's schema."""
    return conform(spark.read.parquet(path), schema, KEEP_NULL)


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                source: str = "parquet", **options: str) -> DataFrame:
    """The same as a stream.

    ``source="kafka"`` reads the well-formed JSON values of a topic instead of files; it needs the Kafka connector
    on the class path and the usual ``kafka.bootstrap.servers`` and ``subscribe`` options. See ``malformed`` for the
    other records.
    """
    if source == "kafka":
        return well_formed(spark.readStream.format("kafka").options(**options).load(), schema)
    reader = spark.readStream.schema(schema).options(**options)
    return conform(reader.format(source).load(path), schema, KEEP_NULL)


_BROKEN = "_broken"


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records (key, value, timestamp) with their value parsed; ``_broken`` has the text of one that is no such object."""
    value = F.col("value").cast("string")
    wide = T.StructType([*schema, T.StructField(_BROKEN, T.StringType())])
    record = F.from_json(value, wide, {"columnNameOfCorruptRecord": _BROKEN})
    rows = records.withColumn("record", record)
    broken = F.when(F.col("record").isNull(), F.coalesce(value, F.lit(""))).otherwise(F.col(f"record.{_BROKEN}"))
    return rows.withColumn(_BROKEN, broken)


def well_formed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of all records that parse; a record without a time of its own takes the one it was logged at."""
    rows = _parsed(records, schema).filter(F.col(_BROKEN).isNull()).select("record.*", F.col("timestamp").alias("_logged")).drop(_BROKEN)
    if "ts" in schema.fieldNames():
        rows = rows.withColumn("ts", F.coalesce("ts", F.col("_logged").cast("timestamp_ntz")))
    return conform(rows, schema, KEEP_NULL)


def malformed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Key, time and text of the records that do not parse, to be kept apart."""
    return _parsed(records, schema).filter(F.col(_BROKEN).isNotNull()).select(
        F.col("key").cast("string").alias("key"), "timestamp", F.col(_BROKEN).alias("value"))


def read_events(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """One log out of per-type tables: event type to path."""
    log = None
    for event_type, path in paths.items():
        part = conform(spark.read.parquet(path).withColumn("event_type", F.lit(event_type)), schema, KEEP_NULL)
        log = part if log is None else log.unionByName(part)
    return log


def current_state(history: DataFrame, key: str = "name") -> DataFrame:
    """Current rows of a history table, one per key: the highest version of the latest epoch."""
    order = ["epoch", "aggregate_version"] if "epoch" in history.columns else ["aggregate_version"]
    known = history.filter(F.col("aggregate_version").isNotNull())
    return latest(known, [key], order)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


RUN = "run"


def write_events(events: DataFrame, path: str, run: str) -> None:
    """Events in one folder per event type, so that a reader of one type opens only that folder.

    A run owns a folder of its own in each and overwrites it, so that a run which is repeated leaves the same rows.
    """
    rows = events.withColumn(RUN, F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type", RUN).parquet(path)


def write_statuses(outcomes: DataFrame, path: str, run: str) -> None:
    """The status of every request, keyed by the request id; repeatable as above."""
    outcomes.select(F.col("request_id").cast("string").alias("request_id"), "gate", "status").write.mode("overwrite").parquet(f"{path}/{RUN}={run}")
