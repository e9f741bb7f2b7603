import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import CLASHING, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def frames(spark):
    class Frames:
        @staticmethod
        def docs(rows, extra=False):
            from pyspark.sql import functions as F

            df = spark.createDataFrame([tuple(r) + (len(r[1] or ""),) for r in rows], SCHEMA + ", n_chars int").withColumn("n_chars", F.col("n_chars").cast("bigint")).repartition(3)
            return df.withColumns({c: F.lit(v) for c, v in CLASHING.items()}) if extra else df

        @staticmethod
        def given(name, sf="sf0.001"):
            return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")

    return Frames
