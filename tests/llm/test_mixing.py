from odd_rows import ODD, words_of

from rosterfold.llm.mixing import mix, mixed_documents, shuffled, split, taken, targets


def test_targets_share_the_excess_until_none_is_above():
    goals = targets([10, 1000, 1000], [3, 1, 2])
    assert goals[0] == 20 and all(g <= 2 * s for g, s in zip(goals, [10, 1000, 1000]))
    assert abs(sum(goals) - 1.5 * 2010) < 1e-6 and abs(goals[2] / goals[1] - 2) < 1e-9


def test_quotas_add_up():
    import numpy as np

    quotas = np.array([5, 0, 1234, 77])
    parts = split(quotas, 8, np.random.Generator(np.random.PCG64(1)))
    assert (sum(parts) == quotas).all() and max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 1


def test_odd_rows(frames):
    rows = taken(mix(frames.docs(ODD, extra=True))).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows) == sorted((d[0] or 0, len(words_of(d[1]))) for d in ODD)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {d[3] for d in ODD}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])


def test_draws_are_disjoint_and_shuffled(frames):
    docs = [(k, "one two three four five " * (1 + k % 7), "en", f"s{k % 3}") for k in range(200)]
    mixture = mix(frames.docs(docs), shards=4, block_words=16)
    rows = shuffled(mixture.draws).collect()
    words = [(r["row"], r["epoch"], w) for r in rows for w in range(r["word"], r["word"] + r["words"])]
    assert len(words) == len(set(words)) == sum(int(s["target"]) for s in mixture.sources.collect())
    for k in range(4):
        assert sorted(r["place"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(shuffled(mix(frames.docs(docs), shards=4, block_words=16).draws).collect())]


def test_documents_of_the_mix(frames):
    docs = [(k, "one two three four five " * (1 + k % 7), "en", f"s{k % 3}") for k in range(60)]
    counts = {}
    for r in mixed_documents(frames.docs(docs, extra=True)).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    for r in taken(mix(frames.docs(docs))).collect():
        assert counts.get(r["doc_id"], 0) == (r["taken"] > 0) + (r["taken"] > r["size"])
    frame = frames.docs(ODD, extra=True)
    assert mixed_documents(frame).columns == frame.columns


def test_empty_table(frames):
    assert taken(mix(frames.docs([]))).collect() == [] and mixed_documents(frames.docs([])).collect() == []
