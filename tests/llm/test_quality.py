import numpy as np
from odd_rows import ODD
from pyspark.sql import functions as F

from rosterfold.llm.quality import SIZE, good, scored, statistics, trained


def test_held_out_rows_are_told_apart(frames):
    docs, labels = frames.given("documents", "sf0.01"), frames.given("labels", "sf0.01")
    model, found = trained(docs, labels)
    rows = scored(found, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    good_, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    order = np.mean([g > b for g in good_ for b in bad])
    assert order > 0.99 and np.mean([(r["score"] >= 0.5) == r["quality"] for r in rows]) > 0.97


def test_labels_of_held_out_rows_are_not_learned(spark, frames):
    docs, labels = frames.given("documents"), frames.given("labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = trained(docs, labels)[0], trained(docs, flipped)[0]
    assert np.allclose(one.means, two.means) and np.allclose(one.factors, two.factors)


def test_scores_equal_the_densities(frames):
    """Against the density written out with full covariances."""
    import pyarrow as pa

    docs, labels = frames.given("documents"), frames.given("labels")
    model, _ = trained(docs, labels)
    x = statistics(pa.array([r["text"] for r in docs.limit(20).collect()]))
    logs = []
    for mean, factor, offset in zip(model.means, model.factors, model.offsets):
        cov = np.linalg.inv(factor.T @ factor)
        d = x - mean
        logs.append(offset - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 4, -500, 500))), atol=1e-6)


def test_odd_rows(spark, frames):
    labels = spark.createDataFrame([(1, 1), (6, 0), (4, 0), (7, 1), (99, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    frame = frames.docs(ODD, extra=True)
    model, found = trained(frame, labels)
    rows = scored(found, model).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(d[0] or 0 for d in ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert good(frame, labels).columns == frame.columns
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in scored(found, trained(frame, none)[0]).collect()} == {0.5}
    ones = spark.createDataFrame([(7, 1)], "doc_id bigint, quality int")
    assert {r["score"] for r in scored(found, trained(frame, ones)[0]).collect()} == {1.0}
    model, found = trained(frames.docs([]), labels)
    assert scored(found, model).collect() == [] and SIZE == 18
