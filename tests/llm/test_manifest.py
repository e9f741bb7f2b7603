import zlib
from hashlib import sha256

import pytest
from odd_rows import ODD

from rosterfold.llm import manifest
from rosterfold.llm.manifest import FAN, Node, OpenTree, folded, grown, leaves, lowered, op11_incremental_witnesses, witnessed


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each node the levels of (place in the run, the run's others)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, where):
            run = nodes[at // 16 * 16:at // 16 * 16 + 16]
            path.append((at % 16, run[:at % 16] + run[at % 16 + 1:]))
        nodes, where = [H(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)], [at // 16 for at in where]
    return nodes[0], paths


def fold(h, path):
    for at, others in path:
        h = H(*others[:at], h, *others[at:])
    return h


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text). The expected rows of the query."""
    if not rows:
        return []
    sources, out = {}, []
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    for s, top in zip(order, tops):
        for (_, _, h, row), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            path, other = path + top, h
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                other = leaf((*row[:4], row[4].translate({c: c + 32 for c in range(65, 91)})))
            back = fold(other, path)
            out.append((row[0], h, trees[s][0], root, H(*(x for _, o in path for x in o)), back, back == root))
    return out


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def check(spark, df, rows, depth=3):
    from pyspark.sql import functions as F

    got = witnessed(leaves(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0), depth)
    got = got.select("doc_id", "leaf", "subroot", "root", "proof", "back", (F.col("back") == F.col("root")).alias("v")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 600, 4095, 4096])
def test_a_block_equals_the_plain_tree(n):
    hashes = [H(str(k)) for k in range(n)]
    root, paths = tree(hashes)
    nodes, top = grown(hashes, True)
    assert top.hash == root
    for k in {0, 1, n // 2, n - 1} & set(range(n)):
        assert nodes[k].witness() == paths[k] and folded(hashes[k], paths[k]) == root


def test_witnesses_grow_with_every_append():
    tree_, nodes = OpenTree(), []
    for k in range(3 * FAN + 5):
        nodes.append(Node(H(str(k))))
        tree_.append(nodes[-1])
        first = nodes[0].witness()
        assert first[0] == (0, [n.hash for n in nodes[1:min(k + 1, FAN)]])
        assert len(first) == (1 if k < FAN - 1 else 2) and (len(first) == 1 or len(first[1][1]) == (k + 1) // FAN - 1)
    assert tree_.seal(nodes).hash == tree([n.hash for n in nodes])[0]


def test_odd_rows_and_ties(spark, frames):
    rows = [*ODD, (15, "Once MORE", "en", "s1"), (15, "another text", "en", "s1")]
    check(spark, frames.docs(rows, extra=True), [(r[0], r[3], r[2], len(r[1] or ""), r[1]) for r in rows])
    check(spark, frames.docs(rows[:1]), [(1, "s1", "en", len(rows[0][1]), rows[0][1])])


def test_empty_table(spark, frames):
    assert witnessed(leaves(frames.docs([]), lowered("text").isNull())).collect() == []


def test_sources_over_several_blocks_and_many_sources(spark, frames):
    # Blocks of 16 rows, so that small tables have trees of blocks of blocks, below and above the sources.
    rows = [(k, f"Text {k} A", "en", "hot" if k % 3 else f"s{k}" if k % 2 else "two") for k in range(1300)]
    check(spark, frames.docs(rows), [(r[0], r[3], r[2], len(r[1]), r[1]) for r in rows], 1)


def test_given_documents(spark, frames):
    docs = [tuple(r) for r in frames.given("documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = op11_incremental_witnesses(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs), key=key)
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 2


def test_sql_twin(spark):
    from rosterfold.checks.compare import duck_rows, spark_rows

    for sf in ("sf0.001", "sf0.01"):
        assert spark_rows(op11_incremental_witnesses(spark, f"/root/testdata/{sf}")) == duck_rows(f"/root/testdata/{sf}", manifest.OP11_SQL)
