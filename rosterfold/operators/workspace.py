"""Intermediate tables in the cluster's shared folder.

Iterative operators and chunked scans read the same rows several times and must read the same rows
each time, also after an executor is lost. They write them once, as Parquet, below the folder named
by ``spark.checkpoint.dir``, or below the warehouse where that is unset.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/rosterfold-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def move_files(spark: SparkSession, folder: str, to: str, prefix: str) -> None:
    """Move the files of a folder, if it is there, under names that begin with ``prefix``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path(to))
    for status in files.listStatus(path(folder)) if files.exists(path(folder)) else []:
        if not files.rename(status.getPath(), path(to, prefix + status.getPath().getName())):
            raise OSError(f"{status.getPath()} was not moved")


def clear(spark: SparkSession) -> None:
    """Delete the tables this application wrote; frames that read them are of no use afterwards."""
    delete(spark, _own_folder(spark))


def pinned(df: DataFrame, label: str) -> DataFrame:
    """Write the rows once and go on from the written table; lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
