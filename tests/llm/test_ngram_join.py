import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from odd_rows import ODD, words_of

from rosterfold.llm import ngram_join
from rosterfold.llm.components import components
from rosterfold.llm.ngram_join import first_of_each, near_duplicates


def expected(docs):
    """n_shingles and component of each row, by comparing all pairs."""
    sets = []
    for _, text, *_ in docs:
        w = words_of(text)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    names = {}
    for k, d in enumerate(docs):
        if d[0] is not None:
            names[find(k)] = min(names.get(find(k), d[0]), d[0])
    return [(d[0], len(sets[k]), names.get(find(k))) for k, d in enumerate(docs)]


def compare(frame, docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(expected(docs), key=key)


def texts(seed, n=220):
    """Families of near copies at similarities around 0.8, chains, shared passages, and others."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    passage = " ".join(word() for _ in range(60))
    out = []
    while len(out) < n:
        base = [word() for _ in range(draw.choice([1, 3, 5, 8, 40, 80, 160]))]
        out.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 3, 12])):
            copy = out[-1].split() if draw.random() < 0.5 else list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        if draw.random() < 0.5:
            out.append(" ".join(word() for _ in range(draw.choice([5, 20, 200]))) + " " + passage)
    return out


@pytest.mark.parametrize("seed, run, heavy", [(1, 4096, 16), (2, 4, 2), (3, 2, 10_000)])
def test_against_all_pairs(frames, monkeypatch, seed, run, heavy):
    monkeypatch.setattr(ngram_join, "RUN", run)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    docs = [(k * 7 % 1009, t, "en", "s") for k, t in enumerate(texts(seed))]
    compare(frames.docs(docs), docs)


def test_odd_rows_and_one_document_of_each(frames):
    compare(frames.docs(ODD, extra=True), ODD)
    frame = frames.docs(ODD, extra=True)
    kept = first_of_each(frame)
    assert kept.columns == frame.columns
    # 2 repeats 1, 8 repeats 7, the text without doc_id is near 1; without shingles all stay.
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 10]


def test_empty_table(frames):
    assert near_duplicates(frames.docs([])).collect() == [] and first_of_each(frames.docs([])).collect() == []


def test_coded_offsets():
    import numpy as np

    for offsets in ([0], [0, 0, 254, 255, 255, 511], [255], [254, 4_000_000]):
        assert ngram_join._decoded(ngram_join._coded(np.array(offsets))).tolist() == offsets


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(128, 90), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 90 for k in [90, *range(100, 130)]}


def test_one_of_rows_that_repeat_stays(frames):
    text = "a quiet morning by the river with nothing much to tell"
    docs = [(1, text, "en", "s")] * 3 + [(2, text, "en", "s")] * 2 + [(None, "other words of a text that has no number at all", "en", "s")] * 4 + [(3, "", "en", "s")] * 2
    assert sorted(r["doc_id"] or 0 for r in first_of_each(frames.docs(docs, extra=True)).collect()) == [0, 1, 3, 3]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), max_size=400), st.sets(st.integers(0, 2 ** 64 - 1), max_size=80), st.integers(0, 60))
def test_sketches_differ_in_no_more_places_than_sets(one, more, left_out):
    other = set(sorted(one)[left_out:]) | more
    x, y = (np.frombuffer(ngram_join._sketch(np.array(sorted(s), np.uint64)), np.uint8) for s in (one, other))
    assert len(x) * 8 == ngram_join.SKETCH_BITS and int(np.bitwise_count(x ^ y).sum()) <= len(one ^ other)


def test_a_family_of_near_copies_is_not_verified_pair_by_pair(frames, monkeypatch):
    # 5 of 200 words changed in each copy: two copies differ too much from each other, and each from the original just so.
    draw = random.Random(8)
    base = [f"w{draw.randrange(900)}" for _ in range(200)]
    docs = []
    for k in range(240):
        copy = list(base)
        for at in draw.sample(range(200), 5):
            copy[at] = f"x{draw.randrange(10 ** 6)}"
        docs.append((k, " ".join(copy), "en", "s"))
    tested, kept = [], []
    plain = ngram_join._within_reach

    def counted(pairs, held):
        near = plain(pairs, held)
        tested.append(pairs.count())
        kept.append(near.count())
        return near

    monkeypatch.setattr(ngram_join, "_within_reach", counted)
    compare(frames.docs(docs), docs)
    assert sum(kept) <= 240 < sum(tested)
