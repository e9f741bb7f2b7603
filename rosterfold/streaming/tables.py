"""Tables written by micro-batches.

Every micro-batch owns the folder ``batch_id=N`` of each table and overwrites it, so that a batch
that runs again after a failure leaves the same rows. A state table holds one row per key and batch
that touched the key; the current row of a key is the one of its latest batch. Now and then the
current rows are written as one table, and later reads start there.

A table that is ``split`` by a key has a folder for each of a number of parts, by a hash of the key, in every batch folder. A reader
that asks for some keys opens the folders of their parts and no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from rosterfold.operators.folds import latest
from rosterfold.operators.workspace import delete

BATCH = "batch_id"
PART = "part"


@dataclass(frozen=True)
class BatchTable:
    spark: SparkSession
    path: str
    columns: str
    split: str | None = None
    parts: int = 16

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.split), F.lit(self.parts)).cast("int")

    def _save(self, df: DataFrame, folder: str) -> None:
        if self.split is None:
            df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        else:
            # One row for each key and batch, so the parts are of one size.
            df.withColumn(PART, self._part()).repartition(PART).write.mode("overwrite").option("compression", "zstd").partitionBy(PART).parquet(folder)

    def write(self, df: DataFrame, batch_id: int) -> None:
        names = T.StructType.fromDDL(self.columns).fieldNames()
        self._save(df.select(*names), f"{self.path}/{BATCH}={batch_id}")

    def _complete(self, folder: str, prefix: str, since: int = -1) -> list[int]:
        """Numbers above ``since`` of the finished sub-folders of a folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(path):
            return []
        found = [status.getPath() for status in files.listStatus(path) if status.isDirectory() and status.getPath().getName().startswith(prefix)]
        numbered = [(int(p.getName().removeprefix(prefix)), p) for p in found]
        return sorted(n for n, p in numbered if n > since and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _folders(self, folder: str, parts: set[int] | None) -> list[str]:
        """The folder itself, or those of its parts that are asked for and there."""
        if parts is None:
            return [folder]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = {status.getPath().getName() for status in files.listStatus(path) if status.isDirectory()}
        return [f"{folder}/{PART}={n}" for n in sorted(parts) if f"{PART}={n}" in names]

    def _asked(self, wanted: DataFrame | None) -> set[int] | None:
        """The parts of wanted keys, at most all of them; None without a split or without wanted keys."""
        if self.split is None or wanted is None:
            return None
        return {row[PART] for row in wanted.select(self._part().alias(PART)).distinct().collect()}

    def _read(self, base: str, folders: list[str], parts: set[int] | None = None) -> DataFrame:
        schema = f"{self.columns}, {BATCH} bigint"
        folders = [part for folder in folders for part in self._folders(folder, parts)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        stored = schema if self.split is None else f"{schema}, {PART} int"
        rows = self.spark.read.schema(stored).option("basePath", base).parquet(*folders)
        return rows.select(*T.StructType.fromDDL(schema).fieldNames())

    def _batches(self, since: int = -1, before: int | None = None, parts: set[int] | None = None) -> DataFrame:
        """Rows of the finished batches in a range, from exactly their folders."""
        numbers = [n for n in self._complete(self.path, f"{BATCH}=", since) if before is None or n < before]
        return self._read(self.path, [f"{self.path}/{BATCH}={n}" for n in numbers], parts)

    def before(self, batch_id: int | None = None) -> DataFrame:
        """Rows of all batches before the given one, so that a repeated batch does not see itself."""
        return self._batches(before=batch_id)

    def rows(self) -> DataFrame:
        return self.before().drop(BATCH)

    def written(self, batch_id: int) -> DataFrame:
        return self._batches(batch_id - 1, batch_id + 1).drop(BATCH)

    def _compacted(self) -> str:
        return f"{self.path}-compacted"

    def _covered(self, batch_id: int | None) -> int:
        """The last batch of the latest compacted table that a reader before ``batch_id`` may use; -1 without one."""
        done = [n for n in self._complete(self._compacted(), "upto=") if batch_id is None or n < batch_id]
        return max(done, default=-1)

    def stored(self, keys: list[str], batch_id: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """All rows before the given batch that were not compacted away, of the keys in ``wanted`` only when that is given.

        Reads the latest compacted table and the batches after it; of a split table, the parts of the wanted keys. The wanted keys
        are a batch's, so they are few beside the state, and rows of other keys are dropped before anything is shuffled by key.
        """
        start, parts = self._covered(batch_id), self._asked(wanted)
        rows = self._batches(start, batch_id, parts)
        if start >= 0:
            rows = rows.unionByName(self._read(self._compacted(), [f"{self._compacted()}/upto={start}"], parts))
        if wanted is not None:
            rows = rows.join(wanted.select(*keys).distinct(), keys, "left_semi").select(*rows.columns)
        return rows

    def current(self, keys: list[str], batch_id: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """State before the given batch: the latest row of each key."""
        return latest(self.stored(keys, batch_id, wanted), keys, [BATCH]).drop(BATCH)

    def compact(self, keys: list[str], batch_id: int, merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write the state after a batch as one table and delete what only older readers needed.

        ``merge`` makes the state of all stored rows; without it that is the latest row of each key. The table before it and the
        batches after that one stay: they are the state that a repeated batch reads.
        """
        earlier = self._covered(batch_id)
        state = self.current(keys, batch_id + 1) if merge is None else merge(self.stored(keys, batch_id + 1).drop(BATCH))
        self._save(state.withColumn(BATCH, F.lit(batch_id).cast("long")), f"{self._compacted()}/upto={batch_id}")
        for n in self._complete(self._compacted(), "upto="):
            if n < earlier:
                delete(self.spark, f"{self._compacted()}/upto={n}")
        for n in self._complete(self.path, f"{BATCH}="):
            if n <= earlier:
                delete(self.spark, f"{self.path}/{BATCH}={n}")
