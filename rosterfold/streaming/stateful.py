"""Running state kept by Spark itself: counts as a streaming aggregation, users as a keyed state processor.

Both keep their state in RocksDB below the query's checkpoint, so a query that is started again goes on where it was.

Which form to prefer: ``jobs.user_fold`` orders a batch's rows with the batch operators, so a user may have any share of a batch and
its state is a table that other jobs read. ``user_state`` touches only the parts of the state that hold the batch's users,
and is the cheaper one for many small batches; but all rows of one part in one batch meet in one call, so
batches have to be bounded (``maxFilesPerTrigger``) where one user may fill them. The counts are combined before they are sent,
so no key is too large for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rosterfold.functions.etags import USER_SECRET, etag
from rosterfold.operators.folds import USER_CREATED, USER_UPDATED
from rosterfold.schemas import USER_EVENT_ORDER
from rosterfold.streaming.tables import PART, BatchTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_to_end(rows: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """Process everything available of a stream that changes state, and hand each batch's changes to ``work``."""
    with rocksdb(rows.sparkSession):
        query = (rows.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()


def counts(spark: SparkSession, root: str, key: str) -> tuple[Callable[[DataFrame], DataFrame], Callable, BatchTable]:
    """How often each key was asked for: (the counting of a stream, batch function, table of counts)."""
    table = BatchTable(spark, f"{root}/{key}_counts", f"{key} string, value bigint")

    def counted(stream: DataFrame) -> DataFrame:
        return stream.groupBy(key).agg(F.count(F.lit(1)).alias("value"))

    return counted, table.write, table


# Users.

_PROFILE = ["uid", "display_name", "email"]
_STATE = "uid string, display_name string, email string, aggregate_version int"
_CHANGED = f"name string, {_STATE}"
_FIELDS = ["name", *_PROFILE, "aggregate_version"]
#: Aligned lists, one element for each user of a part.
_PART_STATE = ", ".join([*(f"{c} array<string>" for c in _FIELDS[:-1]), f"{_FIELDS[-1]} array<int>"])


class UserFold(StatefulProcessor):
    """Profiles and versions of the users of one part. A created event starts at version 1, every other one adds 1; created and
    updated events replace the profile; events before the first created event are left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getValueState("users", _PART_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["name", *USER_EVENT_ORDER], kind="stable", ignore_index=True)
        names, at = events["name"].to_numpy(), np.arange(len(events))
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        ends = np.append(starts[1:], len(events))

        def last(found: pd.Series) -> np.ndarray:
            return np.maximum.reduceat(np.where(found, at, -1), starts)

        created = last(events["event_type"] == USER_CREATED)
        replaced = last(events["event_type"].isin([USER_CREATED, USER_UPDATED]))
        added = ends - np.where(created >= 0, created, starts)
        profiles = list(events[_PROFILE].astype(object).where(events[_PROFILE].notna(), None).itertuples(index=False, name=None))
        before = self.users.get()
        users = {} if before is None else {name: state for name, *state in zip(*before)}
        changed = []
        for name, made, profile_at, count in zip(names[starts], created.tolist(), replaced.tolist(), added.tolist()):
            known = users.get(name)
            if known is None and made < 0:
                continue
            profile = profiles[profile_at] if profile_at >= 0 else known[:-1]
            users[name] = [*profile, count + (0 if made >= 0 else known[-1])]
            changed.append((name, *users[name]))
        if changed:
            self.users.update(tuple(map(list, zip(*((name, *state) for name, state in users.items())))))
            yield pd.DataFrame(changed, columns=_FIELDS)

    def close(self) -> None:
        pass


def user_state(spark: SparkSession, root: str, secret: str = USER_SECRET, parts: int = 4096) -> tuple[Callable[[DataFrame], DataFrame], Callable, BatchTable]:
    """Current users: (the fold of a stream of user events, batch function, table of users).

    Calls of the processor and its reads and writes of state cost the same for one user and for many, so users are kept in
    ``parts`` by a hash of their names: a batch makes at most that many calls, however many users it has.
    """
    table = BatchTable(spark, f"{root}/user_state", f"{_CHANGED}, etag string")

    def folded(stream: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("name"), F.lit(parts)).alias(PART)
        needed = stream.select(part, "name", *USER_EVENT_ORDER, "event_type", *_PROFILE)
        return needed.groupBy(PART).transformWithStateInPandas(UserFold(), _CHANGED, "Update", "None")

    def work(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.withColumn("etag", etag(secret, F.col("name"), F.col("aggregate_version"))), batch_id)

    return folded, work, table
