import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from odd_rows import ODD
from pyspark.sql import functions as F

from rosterfold.checks.compare import duck_rows, spark_rows
from rosterfold.llm import phrases as ph
from rosterfold.llm.phrases import END, OP13_SQL, RARE, best_phrases, op13_de_bruijn_phrases, paths


def pieces_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, least=10, top=2000):
    """rows: (lang, text)."""
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            sizes[lang] += len(words)
            for n in (1, 2, 3):
                counts.update((lang, *words[k:k + n]) for k in range(len(words) - n + 1))
    covered = {}
    for (lang, *words), f in counts.items():
        if len(words) == 3 and f >= least:
            for pair in (words[:2], words[1:]):
                covered[lang, *pair] = max(f, covered.get((lang, *pair), 0))
    out = []
    for (lang, *words), a in counts.items():
        if len(words) < 2 or a < least or len(words) == 2 and 100 * covered.get((lang, *words), 0) >= 50 * a:
            continue
        cuts = [(counts[lang, *words[:k]], counts[lang, *words[k:]]) for k in range(1, len(words))]
        score, k = min((1_000_000 * a * a // (left * right), k) for k, (left, right) in enumerate(cuts))
        out.append((lang, " ".join(words), a, *cuts[k], sizes[lang], score))
    ranked = []
    for lang in sizes:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own, 1)]
    return sorted(ranked)


def check(frame, docs, least=10, top=2000):
    got = sorted(tuple(r) for r in best_phrases(frame, least, top).collect())
    want = brute([(d[2], d[1]) for d in docs], least, top)
    assert got == want
    return got


def random_docs(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(14)] + ["Ünd", "x-y", "😀", "THE", "the", "rare%d"]
    long_one = " ".join(f"z{k}" for k in range(60))  # a passage that repeats whole: one path
    docs = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(8)):
            parts.append(" ".join(rng.choice(words).replace("%d", str(rng.randrange(400))) for _ in range(rng.randrange(9))) + rng.choice(".,;:!?\n\x0b\t "))
        if k % 4 == 0:
            parts.insert(rng.randrange(len(parts) + 1), long_one + rng.choice([". ", " ", " end "]))
        docs.append((k, "".join(parts), rng.choice(["en", "en", "de", None, "und"]), "s"))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(frames, seed):
    docs = random_docs(seed)
    assert len(check(frames.docs(docs), docs, 3)) > 50


def test_small_chunks_and_buckets_change_nothing(frames, monkeypatch):
    docs = random_docs(5, 40)
    few = frames.docs(docs)
    want = brute([(d[2], d[1]) for d in docs], 4)
    monkeypatch.setattr(ph, "CHUNK", 64)
    assert sorted(tuple(r) for r in best_phrases(few, 4).collect()) == want


def test_rings_repeats_and_top(frames):
    docs = [(k, "ha ha ha ha ha ha. a b c a b c a b c a", "en", "s") for k in range(12)] + [(50, "one two " * 9000, "fr", "s"), (51, "one two", "fr", "s")]
    check(frames.docs(docs), docs)
    check(frames.docs(docs), docs, 10, 2)


def test_odd_rows(frames):
    docs = [*ODD, *((100 + k, "To be or, not to BE; to be", None, None) for k in range(9)), *[ODD[1]] * 12]
    check(frames.docs(docs, extra=True), docs)
    assert best_phrases(frames.docs([])).collect() == []
    assert best_phrases(frames.docs([(1, None, None, None), (2, " .,", "en", "s")])).collect() == []


def test_paths_are_compacted(spark):
    # 1 2 3 4 5 ten times, 9 2 3 four times: the node (2, 3) has a choice, all later ones have none.
    nodes = spark.createDataFrame([(1, 2, 10), (9, 2, 4), (2, 3, 14), (3, 4, 10), (4, 5, 10), (5, 6, 10)], "a bigint, b bigint, flow bigint")
    edges = spark.createDataFrame([(1, 2, 3, 10), (9, 2, 3, 4), (2, 3, 4, 10), (3, 4, 5, 10), (4, 5, 6, 10)], "a bigint, b bigint, c bigint, n bigint")
    got = sorted((tuple(r["words"]), r["n"], r["before"], r["after"]) for r in paths(nodes, edges).collect())
    assert got == [((1, 2, 3), 10, 10, 14), ((2, 3, 4, 5, 6), 10, 14, 10), ((9, 2, 3), 4, 4, 14)]
    ring = spark.createDataFrame([(1, 2, 1, 5), (2, 1, 2, 5)], "a bigint, b bigint, c bigint, n bigint")
    nodes = spark.createDataFrame([(1, 2, 5), (2, 1, 5)], "a bigint, b bigint, flow bigint")
    assert sorted(tuple(r["words"]) for r in paths(nodes, ring).collect()) == [(1, 2, 1), (2, 1, 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(2, 6), min_size=1, max_size=6), min_size=1, max_size=6), st.sets(st.integers(2, 6)))
def test_flows_give_the_shorter_counts(lists, rare):
    ids = np.array([0 if w in rare else w for words in lists for w in words], np.uint64)
    piece = np.array([k for k, words in enumerate(lists) for _ in words])
    edges = list(zip(*(x.tolist() for x in ph.edges_of(ids, piece))))
    known = [[0 if w in rare else w for w in words] for words in lists]
    for w in range(2, 7):
        assert sum(e[0] == w for e in edges) == sum(words.count(w) for words in known)
        for v in range(2, 7):
            assert sum(e[:2] == (w, v) for e in edges) == sum(words[k:k + 2] == [w, v] for words in known for k in range(len(words)))
    assert all(e[2] == END for e in edges if e[1] == END) and all(e[2] == RARE for e in edges if e[1] == RARE)
    a, b, c, g, n = ph.summed(*(np.array(x, np.uint64) for x in (zip(*edges) if edges else ([], [], []))), None, whole=True)
    assert Counter(edges) == {(x, y, z): k for x, y, z, k in zip(a.tolist(), b.tolist(), c.tolist(), n.tolist())}
    half = ph._pack(a, b, c, n)
    assert all((x == y).all() for x, y in zip(ph._unpack(half), (a, b, c, n)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_twin(spark, sf):
    assert spark_rows(op13_de_bruijn_phrases(spark, f"/root/testdata/{sf}")) == duck_rows(f"/root/testdata/{sf}", OP13_SQL)


def test_scores_past_64_bits(spark):
    big = 10 ** 15 + 7
    row = spark.createDataFrame([(big, big + 5, big + 11)], "a bigint, f1 bigint, f2 bigint")
    assert row.select(ph._score("f1", "f2").alias("s")).first()["s"] == 1_000_000 * big * big // ((big + 5) * (big + 11))
    exact = spark.createDataFrame([(3, 3, 3)], "a bigint, f1 bigint, f2 bigint").withColumn("f1", F.col("f1"))
    assert exact.select(ph._score("f1", "f2").alias("s")).first()["s"] == 1_000_000


def test_texts_are_read_in_small_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["some words " * 9000] * 30), pa.array(["en"] * 30)], names=["text", "lang"])
    read = list(ph._read(iter([batch])))
    assert max(len(found.raw) for found in read) <= 1 << 19 and ph.CHUNK <= 1 << 18
    assert sum(len(found.ids) for found in read) == 30 * 18000
