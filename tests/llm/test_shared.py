import pyarrow as pa
from pyspark.sql import functions as F

from rosterfold.llm import ngram_join, phrases
from rosterfold.llm.shared import BATCH_BYTES, _BATCH_BYTES, importable


def test_workers_get_batches_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    spark.conf.unset(_BATCH_BYTES)
    importable(spark)
    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    got = rows.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in got) == 300
    assert max(r["bytes"] for r in got) <= BATCH_BYTES + 200_000


def test_a_setting_of_the_session_stands_and_the_size_of_batches_changes_no_result(spark, frames):
    docs = frames.given("documents")
    found = []
    for size in (None, "2000"):
        spark.conf.unset(_BATCH_BYTES) if size is None else spark.conf.set(_BATCH_BYTES, size)
        importable(spark)
        assert spark.conf.get(_BATCH_BYTES) == (size or str(BATCH_BYTES))
        found.append((sorted(map(tuple, phrases.best_phrases(docs).collect())),
                      sorted(map(tuple, ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()))))
    spark.conf.unset(_BATCH_BYTES)
    assert found[0] == found[1] and all(found[0])
