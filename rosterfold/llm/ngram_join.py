"""Near-duplicate documents by a grouped prefix join on word shingles.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Sets whose similarity
is so high share a shingle among their first ``n - ceil(0.8 n) + 1`` in any common order; rare shingles come first here.

1. ``_heavy``: shingle frequencies over all documents, counted in hashed buckets; only the largest buckets (a bounded
   list) are kept. They decide the order, never the result.
2. ``_sets``: for each document the size, a 128-bit fingerprint of its set, and its prefix. Equal sets form a class,
   classes of equal prefix and size a group.
3. ``_shared``: the prefix shingles that two or more groups have, each with pivots, its first groups by hash.
4. Groups are tested against pivots first, which joins large sets of near copies in linear work.
5. Group pairs that are not yet known to be connected, share a prefix shingle, and pass the filters by size and by place
   in the prefix (``_remaining``) are all expanded to pairs of classes and tested. Long runs are cut in blocks.

Whether two classes link is decided on their whole sets, for all pairs that a bound leaves: a set's sketch is a row of bits, each
the parity of the shingles that fall on it, so two sketches differ in no more places than the sets do in shingles. Pairs
whose sketches differ in more places than sets that link may are dropped, and only the others get their sets
(``_within_reach``). Members of a class are never expanded into pairs.

Defined cases: null and empty texts have no shingles, link with nothing, and are a component of their own; a text of one
to four words is one shingle; equal texts link, whatever their doc_id; a null doc_id is never a component's
name unless all its documents have none; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rosterfold.llm.components import components
from rosterfold.llm.shared import partitions, pinned, table
from rosterfold.llm.words import Words, mix, pieces, signed

HEAVY = 16  # documents from which a bucket counts as frequent
HEAVY_BUCKETS = 500_000
RANGE_BITS = 22
FLUSH = 3_000_000  # shingles a task holds before it codes them
PIVOTS, TESTED = 16, 8  # pivots of a shingle, and how many of them a group is tested against
RUN = 4096
SEEN = 200_000  # groups a task remembers, to drop copies early
FILTER_BITS = 28
SKETCH_BITS = 1024
SALT = np.uint64(0x5851F42D4C957F2D)


def _coded(offsets: np.ndarray) -> bytes:
    """Sorted offsets as bytes: each byte is a step; 255 goes on without an entry."""
    steps = np.diff(offsets, prepend=0)
    out = np.full(int((steps // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(steps // 255 + 1) - 1] = steps % 255
    return out.tobytes()


def _decoded(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _heavy(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many leading bits of a hash name a bucket, the frequent buckets in order, and the logarithm of their counts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(48, max(RANGE_BITS, int(size // 3).bit_length()))
    inner = np.uint64(RANGE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            buckets = np.sort(np.concatenate(held) >> np.uint64(64 - bits))
            ranges = buckets >> inner
            first = np.flatnonzero(np.diff(ranges, prepend=np.uint64(1 << 63)))
            packs = [_coded((b & np.uint64((1 << RANGE_BITS) - 1)).astype(np.int64)) for b in np.split(buckets, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(signed(ranges[first])), pa.array(packs, pa.binary())], names=["range", "packed"])

        n = 0
        for batch in pieces(batches):
            for shingles in Words(batch.column(0)).shingle_sets():
                held.append(shingles)
                n += len(shingles)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, now = np.zeros(1 << RANGE_BITS, np.uint32), None

        def frequent() -> pa.RecordBatch:
            at = np.flatnonzero(counts >= HEAVY)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + (now << RANGE_BITS)), pa.array(counts[at].astype(np.int64))], names=["bucket", "n"])

        for batch in batches:
            for range_, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now is not None and range_ != now:
                    yield frequent()
                    counts[:] = 0
                now = range_
                at, n = np.unique(_decoded(packed.as_buffer()), return_counts=True)
                counts[at] += n.astype(np.uint32)
        if now is not None:
            yield frequent()

    coded = docs.select("text").mapInArrow(count, "range bigint, packed binary")
    found = (coded.repartition(partitions(spark), "range").sortWithinPartitions("range")
             .mapInArrow(add, "bucket bigint, n bigint").orderBy(F.desc("n"), "bucket").limit(HEAVY_BUCKETS).toPandas().sort_values("bucket"))
    return bits, found["bucket"].to_numpy(np.uint64), np.log2(found["n"].to_numpy(float)).astype(np.uint64)


class _Order:
    """The common order of shingles: those of rare buckets by hash, then the frequent ones by the logarithm of their count."""

    def __init__(self, docs: DataFrame):
        self.bits, self.buckets, self.logs = _heavy(docs)

    def prefixes(self, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
        """The prefix of each set, and the rank at which it ends."""
        every = np.concatenate(sets)
        rank = every >> np.uint64(6)
        if len(self.buckets):
            bucket = every >> np.uint64(64 - self.bits)
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            rank = np.where(self.buckets[at] == bucket, rank | self.logs[at] << np.uint64(58), rank)
        rank >>= np.uint64(1)  # ends are compared as signed numbers
        end = 0
        for shingles in sets:
            n = len(shingles)
            own, end = rank[end:end + n], end + n
            order = np.argsort(own, kind="stable")[:n - (4 * n + 4) // 5 + 1]
            yield shingles[order], int(own[order[-1]]) if n else 0


def _group(n: int, prefix: np.ndarray) -> int:
    """The name of all sets of this size and prefix."""
    h = (mix(prefix) * mix(np.arange(1, len(prefix) + 1, dtype=np.uint64))).sum(keepdims=True, dtype=np.uint64)
    return int(signed(mix(h + np.uint64(n)))[0])


def _print(shingles: np.ndarray, salt: np.uint64) -> int:
    return int(signed(mix(shingles ^ salt).sum(keepdims=True, dtype=np.uint64))[0])


def _prints(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    return _print(shingles, np.uint64(0)), _print(shingles, SALT)


def _sets(docs: DataFrame, order: _Order) -> DataFrame:
    """row, doc_id, text_hash, n, the fingerprint of the set, the group g and the end of its prefix, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = list(Words(batch.column(1)).shingle_sets())
            rows = [(len(s), *_prints(s), _group(len(s), p), end) for s, (p, end) in zip(sets, order.prefixes(sets))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", "text_hash", "n", "fp1", "fp2", "g", "end"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    found = rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, fp1 bigint, fp2 bigint, g bigint, end bigint")
    return pinned(found.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")


def _shared(docs: DataFrame, order: _Order) -> DataFrame:
    """token, g and pos (the place in the prefix) of all prefix entries whose shingle other groups have as well.

    Entries are made from the texts once more, which costs less than to keep or to join them; equal ones of copies are
    dropped in each task before the shuffle.
    """
    spark = docs.sparkSession

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            sets = [s for s in Words(batch.column(0)).shingle_sets() if len(s)]
            tokens, groups, places = [], [], []
            for shingles, (prefix, _) in zip(sets, order.prefixes(sets) if sets else ()):
                g = _group(len(shingles), prefix)
                if g not in seen:
                    tokens.append(prefix)
                    groups.append(np.full(len(prefix), g))
                    places.append(np.arange(len(prefix), dtype=np.int32))
                    if len(seen) < SEEN:
                        seen.add(g)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(groups)), pa.array(np.concatenate(places))], names=["token", "g", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether another group has its token
        for batch in batches:
            token, g, pos = (c.to_numpy() for c in batch.columns)
            if not len(token):
                continue
            if held is not None:
                token, g, pos = (np.concatenate([h, c]) for h, c in zip(held, (token, g, pos)))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1])
            token, g, pos = token[new], g[new], pos[new]
            start = np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            if held is not None:
                start[0] = not held[3]
            alone = start.copy()
            alone[:-1] &= start[1:]
            alone[-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[~alone]) for c in (token, g, pos)], names=["token", "g", "pos"])
            held = (token[-1:], g[-1:], pos[-1:], not start[-1])
        if held is not None and held[3]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:3]], names=["token", "g", "pos"])

    made = docs.select("text").mapInArrow(entries, "token bigint, g bigint, pos int")
    placed = made.repartition(partitions(spark), "token").sortWithinPartitions("token", "g")
    return pinned(placed.mapInArrow(run, "token bigint, g bigint, pos int"), "shared-shingles")


def _stars(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (ga, gb, c) of groups with pivots, the groups of each prefix shingle that have the most of their own prefix in
    common with others. An unchanged original has it all, its near copies only what they left unchanged."""
    least = Window.partitionBy("token").orderBy(F.desc("degree"), "g")
    degrees = groups.join(shared.groupBy("g").agg(F.count("*").alias("shared")), "g")
    prefix = F.expr("n - (4 * n + 4) div 5 + 1")
    # Shares in steps, so that hashes decide between groups that are about alike.
    ranked = degrees.select("g", (F.floor(8 * F.col("shared") / prefix) * 1024 + F.pmod(F.xxhash64("g"), F.lit(1024))).alias("degree"))
    pivots = (shared.join(ranked, "g").withColumn("k", F.row_number().over(least)).filter(F.col("k") <= PIVOTS).select("token", F.col("g").alias("gb")))
    return shared.select("token", F.col("g").alias("ga")).join(pivots, "token").filter("ga <> gb").groupBy("ga", "gb").agg(F.count("*").alias("c"))


def _may_link(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (ga, gb, c) worth a test: c prefix shingles known to be in common, sizes and ends from ``groups``.

    Of the set whose prefix ends first, all prefix shingles that the other has are in the other's prefix. So the
    rest of that prefix is missing there, and what is missing is bounded by the similarity.
    """
    one = groups.select(F.col("g").alias("ga"), F.col("n").alias("na"), F.col("end").alias("ea"))
    two = groups.select(F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("end").alias("eb"))
    sized = pairs.join(one, "ga").join(two, "gb").filter("5 * least(na, nb) >= 4 * greatest(na, nb)")
    both = F.expr("(4 * (na + nb) + 8) div 9")  # shingles that sets of these sizes must share
    fits = lambda n: F.expr(f"{n} - (4 * {n} + 4) div 5 + 1") - F.col("c") <= F.col(n) - both
    return sized.filter(F.when(F.col("ea") < F.col("eb"), fits("na")).when(F.col("ea") > F.col("eb"), fits("nb")).otherwise(fits("na") | fits("nb")))


def _place(doc_ids: pa.Array, fp1: np.ndarray, bits: int) -> np.ndarray:
    ids = pc.fill_null(doc_ids, -1).to_numpy(zero_copy_only=False).view(np.uint64)
    return (mix(fp1.view(np.uint64) ^ mix(ids + SALT)) >> np.uint64(64 - bits)).astype(np.int64)


def _filter(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """A bit for each place that a wanted set (doc_id, fp1) hashes to: at most ``FILTER_BITS`` places, for any input.

    It only spares the work for other texts; a larger corpus lets more of them through.
    """
    bits = min(FILTER_BITS, max(16, int(wanted.count() * 16).bit_length()))
    part = min(bits, 20)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(0), batch.column(1).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> part), pa.array(at)], names=["part", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(1 << part, bool)
        for batch in batches:
            for k, at in zip(*(c.to_numpy() for c in batch.columns)):
                if now is not None and k != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(own).tobytes()])], names=["part", "packed"])
                    own[:] = False
                now = k
                own[at & ((1 << part) - 1)] = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(own).tobytes()])], names=["part", "packed"])

    rows = wanted.select("doc_id", "fp1").mapInArrow(places, "part bigint, place bigint").distinct()
    packed = rows.repartition(partitions(wanted.sparkSession), "part").sortWithinPartitions("part").mapInArrow(pack, "part bigint, packed binary")
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for row in packed.collect():
        size = max(1, (1 << part) >> 3)
        out[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["packed"], np.uint8)
    return bits, out


def _sketch(shingles: np.ndarray) -> bytes:
    """The parity of the shingles on each of ``SKETCH_BITS`` places."""
    places = (mix(shingles ^ (SALT << np.uint64(1))) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def _within_reach(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b, fa, fb) whose sketches do not rule a link out. Sets of n and m shingles that link differ in at most
    n + m - 2 ceil(4 (n + m) / 9) of them."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            size = batch.column(6).to_numpy()
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b", "fa", "fb"]).filter(pa.array(apart <= size - 2 * ((4 * size + 8) // 9)))

    first = held.select(F.col("f").alias("fa"), F.col("sketch").alias("x"), F.col("size").alias("na"))
    second = held.select(F.col("f").alias("fb"), F.col("sketch").alias("y"), F.col("size").alias("nb"))
    rows = pairs.join(first, "fa").join(second, "fb").select("a", "b", "fa", "fb", "x", "y", (F.col("na") + F.col("nb")).alias("sizes"))
    print_ = "struct<fp1: bigint, fp2: bigint>"
    return pinned(rows.mapInArrow(test, f"a bigint, b bigint, fa {print_}, fb {print_}").distinct(), "near-pairs")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b: classes) that link, decided on whole sets."""
    named = classes.select("rep", "doc_id", "fp1", "fp2")
    both = pairs
    for side in ("a", "b"):
        both = both.join(named.select(F.col("rep").alias(side), F.struct("fp1", "fp2").alias(f"f{side}")), side)
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(named, "rep")
    bits, known = _filter(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = list(Words(batch.column(1)).shingle_sets())
            prints = np.array([_print(s, np.uint64(0)) for s in sets], np.int64)
            at = _place(batch.column(0), prints, bits)
            kept = np.flatnonzero((known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(prints[kept]), pa.array([_print(sets[k], SALT) for k in kept], pa.int64()), pa.array([sets[k].tobytes() for k in kept], pa.binary()),
                                                  pa.array([_sketch(sets[k]) for k in kept], pa.binary()), pa.array([len(sets[k]) for k in kept], pa.int64())],
                                                 names=["fp1", "fp2", "s", "sketch", "size"])

    held = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "fp1 bigint, fp2 bigint, s binary, sketch binary, size bigint").select(F.struct("fp1", "fp2").alias("f"), "s", "sketch", "size")
    held = pinned(held, "whole-sets")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                every = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((every[1:] == every[:-1]).sum())
                kept.append(100 * same >= 80 * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    first = held.select(F.col("f").alias("fa"), F.col("s").alias("x"))
    second = held.select(F.col("f").alias("fb"), F.col("s").alias("y"))
    near = _within_reach(both.select("a", "b", "fa", "fb"), held)
    return pinned(near.join(first, "fa").join(second, "fb").select("a", "b", "x", "y").mapInArrow(test, "a bigint, b bigint").distinct(), "links")


def _remaining(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Group pairs (ga < gb) with different labels that may link. ``groups``: g, n, label.

    Sets of sizes n and m link only if they share at least o = ceil(4 (n + m) / 9) shingles. Then they share one among the
    first n - o + 1 of the one and the first m - o + 1 of the other, so pairs are made only from entries at such places.
    """
    labelled = shared.join(groups.select("g", "n", "label"), "g")
    runs = labelled.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    open_ = labelled.join(runs.select("token", F.ceil(F.col("m") / RUN).cast("int").alias("blocks")), "token")
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    # A long run meets block by block, so that no task holds all of it.
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")})
    placed = open_.select("token", "b1", "b2", "own", "g", "n", "pos", "label").repartition(partitions(shared.sparkSession), "token", "b1", "b2").sortWithinPartitions("token", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            own, g, n, pos, label = rows[:, 3:].T
            across = rows[0, 1] != rows[0, 2]
            for at in range(0, len(rows), 512):
                i = slice(at, at + 512)
                ok = (label[i, None] != label) & (g[i, None] < g) & (5 * np.minimum(n[i, None], n) >= 4 * np.maximum(n[i, None], n))
                if across:
                    ok &= own[i, None] != own
                both = (4 * (n[i, None] + n) + 8) // 9
                ok &= (pos[i, None] <= n[i, None] - both) & (pos <= n - both)
                x, y = np.nonzero(ok)
                if len(x):
                    # The lower group comes first on either side of the blocks.
                    yield pa.RecordBatch.from_arrays([pa.array(g[i][x]), pa.array(g[y])], names=["ga", "gb"])

        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            *done, rest = np.split(rows, cut)
            for some in done:
                yield from pairs(some)
            held = [rest] if len(rest) else []
        for some in held:
            yield from pairs(some)

    return placed.mapInArrow(run, "ga bigint, gb bigint").distinct()


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with ``label``, the component of the class."""
    found = components(links)
    return pinned(classes.join(found, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node"), "labelled")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, component_id, class (``rep``, the row that stands for all equal sets) and whether
    it is the one document of its component to keep, of every document."""
    order = _Order(docs)
    sets = _sets(docs, order)
    key = ["n", "fp1", "fp2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = sets.filter("n > 0").groupBy(*key, "g", "end").agg(first)
    classes = pinned(classes.withColumns({"rep": F.col("first.row"), "doc_id": F.col("first.doc_id")}), "classes")
    groups = pinned(classes.groupBy("g").agg(F.min("n").alias("n"), F.min("end").alias("end"), F.min("rep").alias("head")), "groups")
    shared = _shared(docs, order)

    # Pivots: classes with the head of their group, groups with the pivot that shares most of their prefix.
    stars = _stars(shared, groups)
    best = Window.partitionBy("ga").orderBy(F.desc("c"), "gb")
    stars = _may_link(stars, groups).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= TESTED)
    heads = groups.select("g", "head")
    stars = stars.join(heads.select(F.col("g").alias("ga"), F.col("head").alias("a")), "ga").join(heads.select(F.col("g").alias("gb"), F.col("head").alias("b")), "gb").select("a", "b")
    inside = classes.select("rep", "g").join(heads, "g").filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    tested = pinned(stars.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pivot-pairs")
    links = _verified(tested, classes, docs)
    known = _labelled(classes, links)

    # A group whose classes have different labels is unlike all others and itself.
    labels = known.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("n"), F.min("rep").alias("head"))
    labels = pinned(labels.withColumn("label", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-F.col("head") - 1)), "group-labels")
    mixed = labels.filter("low <> high").select("g")
    found = _remaining(shared, labels)
    found = found.union(mixed.select(F.col("g").alias("ga"), F.col("g").alias("gb")))
    one = known.select(F.col("g").alias("ga"), F.col("rep").alias("a"), F.col("label").alias("la"))
    two = known.select(F.col("g").alias("gb"), F.col("rep").alias("b"), F.col("label").alias("lb"))
    rest = (found.join(one, "ga").join(two, "gb").filter("la <> lb and (ga <> gb or a < b)")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    rest = pinned(rest, "other-pairs")
    if rest.head(1):
        # Only links between components are new; they join labels.
        ends = known.select(F.col("rep").alias("a"), F.col("label").alias("la")), known.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
        new = pinned(_verified(rest, classes, docs).join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "new-links")
        if new.head(1):
            moved = components(new).select(F.col("node").alias("label"), F.col("label").alias("_to"))
            known = pinned(known.join(moved, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to"), "relabelled")

    names = known.groupBy("label").agg(F.min("first").alias("first"))
    named = pinned(known.drop("first").join(names, "label").select(*key, "rep", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept_row")), "named")
    joined = sets.select("row", "doc_id", "text_hash", *key).join(named, key, "left")
    return joined.select("row", "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                         "rep", F.coalesce(F.col("row") == F.col("kept_row"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, and all documents without shingles.

    Of rows that repeat the kept one's doc_id (also null) and text, one stays, the least in all its columns.
    """
    found = pinned(near_duplicates(docs).select("doc_id", "text_hash", "n_shingles", "kept"), "duplicates")
    repeats = F.col("kept") & (F.col("n") > 1) & (F.col("n_shingles") > 0)
    keys = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.max("kept").alias("kept"), F.count("*").alias("n"), F.max(F.coalesce("n_shingles", F.lit(0))).alias("n_shingles"))
    gone = keys.filter(~F.col("kept") | repeats).select("_id", "_hash")
    again = pinned(keys.filter(repeats).select("_id", "_hash"), "repeats")
    own = F.expr("doc_id <=> _id") & (F.xxhash64("text") == F.col("_hash"))
    rest = docs.join(gone, own, "left_anti")
    if not again.head(1):
        return rest
    # The least row is combined before the shuffle, so that copies of one text do not meet in one task.
    least = docs.join(again, own, "left_semi").groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).agg(F.min(F.struct(*docs.columns)).alias("_least"))
    return rest.union(least.select("_least.*"))


def op6_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
