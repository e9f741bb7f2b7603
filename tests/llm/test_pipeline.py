import corpus_pipeline
import pytest
from odd_rows import ODD

from rosterfold.llm import decontamination, mixing, ngram_join, quality, registry
from rosterfold.llm.shared import pinned

SF = "/root/testdata/sf0.001"


def test_stages_have_their_effects(spark, frames):
    docs = frames.given("documents")
    labels, bench = frames.given("labels"), frames.given("benchmark")
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        after.append(pinned(stage(spark, after[-1], SF), f"test-{name}"))
        if name != "sharding":
            assert after[-1].schema == docs.schema
    ids = [sorted(r["doc_id"] for r in a.select("doc_id").collect()) for a in after]

    model, found = quality.trained(docs, labels)
    assert ids[1] == sorted(r["doc_id"] for r in quality.scored(found, model).filter("score >= 0.5").collect())
    groups = {}
    for r in ngram_join.near_duplicates(after[1]).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert ids[2] == sorted(groups) and all(c in ids[1] for c in groups)
    leaks = {r["doc_id"] for r in decontamination.overlaps(after[2], bench).collect()}
    assert ids[3] == [i for i in ids[2] if i not in leaks]
    assert ids[4] == sorted(r["doc_id"] for r in mixing.taken(mixing.mix(after[3])).collect() for _ in range((r["taken"] > 0) + (r["taken"] > r["size"])))
    assert ids[5] == ids[4]


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect())) and rows.count() > 100


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, frames, rows):
    docs = frames.docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = pinned(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_a_query_for_each_operator():
    assert [q.split("_")[0] for q in registry.QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]


def test_mix_equals_its_sql(spark):
    from rosterfold.checks.compare import duck_rows, spark_rows

    name = "op7_hypergeometric_mix"
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(SF, registry.ORACLE[name])
