"""Keys that hold too many rows for one task, and joins that spread them.

A key is *heavy* when it has more rows than ``spark.rosterfold.rowsPerTask``. At most ``HEAVY_KEYS``
keys are treated as heavy, the largest ones: any other key then holds less than one part in
``HEAVY_KEYS`` of the input. The list of heavy keys is therefore bounded whatever the input size,
which is what makes it safe to bring to the driver and to broadcast. Finding heavy keys looks at a
sample; that only decides where rows are placed, never which rows or values come out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

HEAVY_KEYS = 20_000
PIECES = "_pieces"
SALT = "_salt"

_ROWS_PER_TASK = ("spark.rosterfold.rowsPerTask", 4_000_000)
#: How many rows a frame may have for each row of its sources before it is searched for heavy keys.
_GROWTH = 4
_BYTES_PER_ROW, _UNKNOWN = 16, 1 << 60
_SAMPLED_PER_KEY = 2_000


def _setting(spark: SparkSession, setting: tuple[str, int]) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst, by its own threshold, would send this frame to every executor."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= threshold


def _source_rows(df: DataFrame) -> int | None:
    """How many rows the sources of a frame have at most, by the size that Catalyst knows of them; None when it knows none.

    A row of a stored table takes ``_BYTES_PER_ROW`` or more. No file is opened and no name is listed for it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return None if total >= _UNKNOWN else total // _BYTES_PER_ROW


@dataclass(frozen=True)
class HeavyKeys:
    """The heavy keys of a frame, one row each, with the number of pieces to spread it over."""

    keys: list[str]
    table: DataFrame
    pieces: int

    def mark(self, df: DataFrame) -> DataFrame:
        """Add the number of pieces; null on rows of ordinary keys. No shuffle: the list is bounded."""
        return df.join(F.broadcast(self.table), self.keys, "left").select(*df.columns, PIECES)

    def part(self, df: DataFrame, heavy: bool) -> DataFrame:
        kept = df.join(F.broadcast(self.table.select(*self.keys)), self.keys, "left_semi" if heavy else "left_anti")
        return kept.select(*df.columns)


def heavy_keys(df: DataFrame, keys: list[str]) -> HeavyKeys | None:
    """Heavy keys of ``df``, or None when no task could get too many rows.

    Looking costs a pass over the key columns, so callers name a frame that is cheap to read, at
    best the stored table that the joined rows came from.
    """
    spark = df.sparkSession
    limit = _setting(spark, _ROWS_PER_TASK)
    known = _source_rows(df)
    if (df.count() if known is None else _GROWTH * known) <= limit:
        return None
    fraction = min(1.0, _SAMPLED_PER_KEY / limit)
    seen = df.select(*keys)
    if fraction < 1.0:
        seen = seen.sample(fraction=fraction, seed=17)
    # A key of `limit` rows is expected `limit * fraction` times in the sample; half of that leaves
    # room for chance.
    floor = limit * fraction / 2 if fraction < 1.0 else limit
    largest = (seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"))
               .filter(F.col("_seen") > floor)
               .orderBy(F.desc("_seen")).limit(HEAVY_KEYS).collect())
    if not largest:
        return None
    rows = [row["_seen"] / fraction for row in largest]
    share = max(limit, sum(rows) / HEAVY_KEYS)
    table = [tuple(row[key] for key in keys) + (1 + int(size / share),) for row, size in zip(largest, rows)]
    schema = T.StructType([df.schema[key] for key in keys] + [T.StructField(PIECES, T.IntegerType())])
    return HeavyKeys(keys, spark.createDataFrame(table, schema), sum(row[-1] for row in table))


class Probe:
    """A frame to look for heavy keys in, each list of key columns at most once."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._found: dict[tuple[str, ...], HeavyKeys | None] = {}

    def heavy(self, keys: list[str]) -> HeavyKeys | None:
        if tuple(keys) not in self._found:
            self._found[tuple(keys)] = heavy_keys(self.df, keys)
        return self._found[tuple(keys)]


def lookup(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "left",
           probe: Probe | None = None) -> DataFrame:
    """Equi-join that keeps every left row's key intact but not in one place.

    ``right`` has a bounded number of rows per key. Rows of a heavy left key are dealt out over
    salts by a hash of ``spread``, columns that tell the key's rows apart, and the right rows of
    those keys are repeated once per salt. When ``right`` is small enough to be broadcast nothing
    is shuffled, so nothing needs salting. ``probe`` has the keys of ``left`` and is cheaper to look
    at.
    """
    if fits_broadcast(right):
        return left.join(right, on, how)
    heavy = (probe or Probe(left)).heavy(on)
    if heavy is None:
        return left.join(right, on, how)
    salted = (heavy.mark(left)
              .withColumn(SALT, F.when(F.col(PIECES).isNull(), F.lit(0))
                          .otherwise(F.pmod(F.xxhash64(*spread), F.col(PIECES)).cast("int")))
              .drop(PIECES))
    copies = (heavy.mark(right)
              .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(PIECES, F.lit(1)) - 1)))
              .drop(PIECES))
    return salted.join(copies, [*on, SALT], how).drop(SALT)


def exists_in(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], flag: str,
              probe: Probe | None = None) -> DataFrame:
    """``left`` with a boolean column: is there a row of ``right`` (unique on the key)?"""
    known = right.select(*on, F.lit(True).alias(flag))
    return lookup(left, known, on, spread, probe=probe).withColumn(flag, F.coalesce(flag, F.lit(False)))
