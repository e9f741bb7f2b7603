import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from odd_rows import ODD, words_of

from rosterfold.llm import language_model as L
from rosterfold.llm.words import Words


def check(frame, docs, extra=0):
    rows = L.scores(frame).collect()
    tokens = [words_of(d[1]) + [None] for d in docs]
    out = [d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 2 for d in docs]
    counts = Counter(w for t, h in zip(tokens, out) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((d[0] or 0, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t, h in zip(docs, tokens, out))
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    return rows


def test_base_scores_and_model(frames, monkeypatch):
    docs = [tuple(r) for r in frames.given("documents").collect()]
    rows = check(frames.given("documents"), docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    monkeypatch.setattr(L, "COMMON", 50)  # most words are looked up by the join
    monkeypatch.setattr(L, "WORDS", 20)
    check(frames.given("documents"), docs)


def test_probabilities_add_up_to_one(frames):
    docs = frames.given("documents")
    counts = L.word_counts(docs).cache()
    words = L.vocabulary(counts)
    model = L.trained(docs, words)
    k = len(words.frequencies)
    every = np.arange(k)
    for one, two in ((0, 0), (1, 5), (k - 1, 3)):
        assert abs((10 ** model.log10(every, np.full(k, one), np.full(k, two))).sum() - 1) < 1e-4
    known = {r["h"] for r in counts.collect()}
    chosen = set(words.hashes[words.outcomes >= 0].view(np.int64).tolist())
    for shape in range(L.SHAPES):
        own = [r["c"] for r in counts.collect() if r["shape"] == shape and r["h"] not in chosen] if shape % 9 == 0 else None
        if own:
            assert sum(own) == words.class_n[shape]
            assert abs(sum((1 - words.unseen[shape]) * c / words.class_n[shape] for c in own) + words.unseen[shape] - 1) < 1e-9
    assert len(known) == words.types


def test_contexts_do_not_cross_texts():
    words = Words(pa.array(["a b", "", "c"]))
    full, one, two = L._contexts(np.array([5, 6, 7]), words)
    assert full.tolist() == [5, 6, 0, 0, 7, 0] and one.tolist() == [0, 5, 6, 0, 0, 7] and two.tolist() == [0, 0, 5, 0, 0, 0]


def test_odd_rows(frames):
    check(frames.docs(ODD, extra=True), ODD)
    assert L.scores(frames.docs([])).collect() == []
    only = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    check(frames.docs([(only, "no training rows here", "", "")]), [(only, "no training rows here", "", "")])
