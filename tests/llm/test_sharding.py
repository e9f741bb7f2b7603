import zlib

import pytest
from odd_rows import ODD

from rosterfold.llm.sharding import shard


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > middle:
                used, held = used + 1, 0
            held += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def checked(rows, docs, shards):
    text = {}
    for d in docs:
        text.setdefault(d[0], []).append(d[1] or "")
    assert len(rows) == len(docs)
    places = {}
    for r in rows:
        assert any((len(t.encode()) + 1, zlib.crc32(t.encode())) == (r["size"], r["text_crc32"]) for t in text[r["doc_id"]])
        places.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(p) == 1 for p in places.values())
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    return [sum(r["size"] for r in rows if r["shard"] == k) for k in range(shards)]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_odd_rows(frames, shards):
    checked(shard(frames.docs(ODD, extra=True), shards).collect(), ODD, shards)


def test_the_largest_shard_has_the_smallest_capacity(frames):
    docs = [(k, f"text {k * k % 37} " * (1 + k * k % 41), "en", "s") for k in range(300)]
    loads = checked(shard(frames.docs(docs), 8).collect(), docs, 8)
    groups = {}
    for d in docs:
        groups[d[1]] = groups.get(d[1], 0) + len(d[1]) + 1
    assert max(loads) == smallest_capacity(sorted(groups.values(), reverse=True), 8)


def test_a_group_of_a_third_leaves_the_other_shards_even(frames):
    docs = [(k, "same text in very many rows", "en", "s") for k in range(400)] + [(1000 + k, f"other text number {k} " * 3, "en", "s") for k in range(400)]
    loads = checked(shard(frames.docs(docs), 8).collect(), docs, 8)
    assert max(loads[1:]) - min(loads[1:]) < 200


def test_empty_table(frames):
    assert shard(frames.docs([])).collect() == []
