"""Collocations from a weighted de Bruijn graph.

Nodes are pairs of neighbouring words of a language, edges are runs of three words, from their first pair to their second; an
edge's weight is how often it occurs. Only edges are counted over the corpus. A run that a piece ends before its third word is
an edge to the end (``END``), so that every word of every piece begins exactly one edge; these are the corrections that make the
shorter counts exact: the flow out of a node, its ends included, is the pair's count, and the flow out of all nodes
with one first word is that word's count.

1. Words are counted and written down by a 64-bit hash of language and word; those with fewer than ``LEAST`` occurrences can be
   in no candidate, nor can a candidate's part be rarer than the candidate. Tasks know the others by a bit table of at most
   ``2 ** TABLE_BITS`` places; a rare word is ``RARE`` in the graph. A rare word that shares its place with another one
   only makes the graph larger.
2. Tasks count the edges of some hundred thousand words at a time and send them, packed, to the bucket of their first pair; each bucket is
   merged on its own, sorted by whole edges. Buckets are as many as the corpus needs, so one always fits in a task, and
   a pair that holds a third of all rows has been counted before it is sent.
3. Of the merged graph, nodes and edges of ``LEAST`` or more remain. A node whose whole flow comes in by one edge and leaves by one
   edge has no choice: edges that meet in such nodes are compacted into paths (pointers to the edge before, doubled in each round,
   written down). All nodes and edges on a path have the path's weight, so inside it no count is looked up; at its ends the
   node flows are.
4. Candidates are the nodes and the runs of three words on the paths. Products are exact decimals.

Defined cases: null texts count as empty; a null lang is ``und``; an empty table and texts without words give no rows; rows that
repeat count each. Two words, or two different edges of which one word differs, are taken for one with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rosterfold.llm.shared import partitions, pinned, table
from rosterfold.llm.words import _BYTE, _LOWER, _powers, buffers, mix, pieces, signed
from rosterfold.operators.skew import lookup

LEAST, TOP = 10, 2000
RARE, END = np.uint64(0), np.uint64(1)
TABLE_BITS, SLICE_BITS = 27, 14
#: Words whose edges a task counts at a time; a bucket holds about four times as many.
CHUNK = 1 << 18
#: Bytes of text that are split into words at a time.
READ = 1 << 19

_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_TO_LOWER = _LOWER.astype(np.uint8)
_FIRST, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# Words of texts.


class Pieces:
    """The words of several texts: ``ids`` of language and word, and ``piece``, a number that neighbours in one piece share."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offsets = buffers(texts)
        kind = _KIND[raw]
        word = kind == 0
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.raw, self.starts, self.ends = raw, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, back = _powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[:len(raw)], out=total[1:])
        plain = mix((total[self.ends] - total[self.starts]) * back[self.starts])
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        names = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        seeds = np.array([int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "big") for name in self.langs], np.uint64)
        self.lang = names.indices.to_numpy(zero_copy_only=False)[self.text]
        ids = mix(plain ^ seeds[self.lang]) if len(plain) else plain
        self.ids = np.where(ids <= END, ids + np.uint64(2), ids)
        self.piece = np.cumsum(kind == 2)[self.starts] + self.text

    def words(self, at: np.ndarray) -> pa.Array:
        """The lower-cased words at some places."""
        sizes = self.ends[at] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(self.starts[at] - offsets[:-1], sizes) + np.arange(offsets[-1])
        data = _TO_LOWER[self.raw[places]]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch in pieces(batches, limit=READ):
        found = Pieces(batch.column("text"), batch.column("lang"))
        if len(found.ids):
            yield found


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, id, word, n) of all words; rows without a word have the number of all words of a language."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _read(batches):
            _, at, n = np.unique(found.ids, return_index=True, return_counts=True)
            langs = pa.array(found.langs, pa.string())
            totals = np.bincount(found.lang, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([langs.take(pa.array(found.lang[at])), langs]), pa.array(np.concatenate([signed(found.ids[at]), np.zeros(len(langs), np.int64)])),
                pa.concat_arrays([found.words(at), pa.nulls(len(langs), pa.string())]), pa.array(np.concatenate([n, totals]).astype(np.int64))],
                names=["lang", "id", "word", "n"])

    rows = docs.select("text", "lang").mapInArrow(counted, "lang string, id bigint, word string, n bigint")
    return rows.groupBy("lang", "id", "word").agg(F.sum("n").alias("n"))


# The graph.


def _bit_table(words: DataFrame) -> tuple[int, np.ndarray]:
    """How many leading bits of an id are its place, and a bit for each place that a word has. At most ``TABLE_BITS`` bits."""
    bits = min(TABLE_BITS, max(SLICE_BITS, int(words.count() * 16).bit_length()))
    low = min(SLICE_BITS, bits)
    place = F.shiftrightunsigned("id", 64 - bits)
    rows = words.select(F.shiftright(place, low).alias("part"), place.bitwiseAND((1 << low) - 1).cast("int").alias("at"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bits_ = None, None

        def slice_() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(bits_).tobytes()])], names=["part", "packed"])

        for batch in batches:
            parts, places = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(parts)]):
                if begin == end:
                    continue
                if parts[begin] != part:
                    if part is not None:
                        yield slice_()
                    part, bits_ = int(parts[begin]), np.zeros(1 << low, bool)
                bits_[places[begin:end]] = True
        if part is not None:
            yield slice_()

    slices = rows.repartition(partitions(words.sparkSession), "part").sortWithinPartitions("part").mapInArrow(packed, "part bigint, packed binary")
    out = np.zeros((1 << bits) >> 3, np.uint8)
    width = (1 << low) >> 3
    for row in slices.collect():
        out[row["part"] * width:(row["part"] + 1) * width] = np.frombuffer(row["packed"], np.uint8)
    return bits, out


def _known(ids: np.ndarray, bits: int, bit_table: np.ndarray) -> np.ndarray:
    place = ids >> np.uint64(64 - bits)
    return (bit_table[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1


def edges_of(ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edge that each known word begins; what follows a rare word is left out."""
    second, third = np.full(len(ids), END), np.full(len(ids), END)
    two = piece[1:] == piece[:-1]
    second[:-1][two] = ids[1:][two]
    third[:-1] = second[1:]
    third[second == END], third[second == RARE] = END, RARE
    own = ids != RARE
    return ids[own], second[own], third[own]


def node_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Together with ``b`` it tells ``a``: both steps are one to one."""
    return mix(a * _FIRST + mix(b * _SECOND))


def summed(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray | None, whole: bool) -> tuple[np.ndarray, ...]:
    """Distinct edges by the hash of their node, with their hashes and weights. ``whole`` sorts by all of an edge; otherwise an edge
    may be left in two parts, with a chance of 2**-64, which a later sum adds up."""
    g = node_hash(a, b)
    if whole:
        order = np.lexsort((c, b, g))
    else:
        order = np.argsort((g & np.uint64(0xFFFFFFFF00000000)) | (mix(c ^ (g << np.uint64(32))) >> np.uint64(32)))
    a, b, c, g = a[order], b[order], c[order], g[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(a))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return a[first], b[first], c[first], g[first], weight.astype(np.int64)


def _pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Nodes once, each with its number of edges; then the edges."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a)))
    head = np.array([len(first), len(a)], np.int64)
    return b"".join(x.tobytes() for x in (head, a[first], b[first], c, n, size.astype(np.int32)))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    nodes, edges = np.frombuffer(data, np.int64, 2)
    at = 16
    a, b = (np.frombuffer(data, np.uint64, nodes, at + 8 * k * nodes) for k in range(2))
    at += 16 * nodes
    c = np.frombuffer(data, np.uint64, edges, at)
    n = np.frombuffer(data, np.int64, edges, at + 8 * edges)
    size = np.frombuffer(data, np.int32, nodes, at + 16 * edges)
    return np.repeat(a, size), np.repeat(b, size), c, n


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    parts = [_unpack(blob) for blob in blobs]
    return summed(*(np.concatenate(column) for column in zip(*parts)), whole=True)


def graph(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """The merged graph: rows (a, b, c, n). Without c, a node's flow; without b and c, the flow that a bucket has out of
    nodes whose first word is a; with all, an edge. Only nodes and edges of ``least`` and more are kept, and only between words."""
    spark = docs.sparkSession
    known = words.filter("word is not null")
    total = words.filter("word is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    bits, found_bits = _bit_table(known)
    bit_table = spark.sparkContext.broadcast(found_bits)
    log = max(int(total // (4 * CHUNK)).bit_length(), (partitions(spark) - 1).bit_length())
    shift = np.uint64(64 - log)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in _read(batches):
            held.append(edges_of(np.where(_known(found.ids, bits, bit_table.value), found.ids, RARE), found.piece))
            size += len(held[-1][0])
            if size >= CHUNK:
                yield flushed(held)
                held, size = [], 0
        if size:
            yield flushed(held)

    def flushed(held: list[tuple]) -> pa.RecordBatch:
        a, b, c, g, n = summed(*(np.concatenate(column) for column in zip(*held)), None, whole=False)
        bucket = (g >> shift).astype(np.int64) if log else np.zeros(len(g), np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.append(cuts, len(a))
        blobs = [_pack(a[s:e], b[s:e], c[s:e], n[s:e]) for s, e in zip(begins, ends)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array(blobs, pa.binary())], names=["bucket", "edges"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and blobs:
                    yield reduced(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield reduced(blobs)

    def reduced(blobs: list[bytes]) -> pa.RecordBatch:
        a, b, c, _, n = _merged(blobs)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        flow = np.add.reduceat(n, first)  # to the end and to rare words too
        na, nb = a[first], b[first]
        starts, inverse = np.unique(na, return_inverse=True)
        out = np.zeros(len(starts), np.int64)
        np.add.at(out, inverse, flow)
        node = (nb > END) & (flow >= least)
        edge = (c > END) & (n >= least)
        none = lambda k: pa.nulls(k, pa.int64())
        ids = lambda x: pa.array(signed(np.ascontiguousarray(x)))
        k, m = len(starts), int(node.sum())
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([ids(starts), ids(na[node]), ids(a[edge])]),
            pa.concat_arrays([none(k), ids(nb[node]), ids(b[edge])]),
            pa.concat_arrays([none(k + m), ids(c[edge])]),
            pa.array(np.concatenate([out, flow[node], n[edge]]))], names=["a", "b", "c", "n"])

    sent = docs.select("text", "lang").mapInArrow(counted, "bucket bigint, edges binary")
    # A few buckets to a task, so tasks do not grow with the corpus.
    dealt = sent.repartition(max(partitions(spark), (1 << log) >> 3), "bucket").sortWithinPartitions("bucket")
    return pinned(dealt.mapInArrow(merged, "a bigint, b bigint, c bigint, n bigint"), "phrase-graph")


# Paths.


def paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The compacted graph: (words, n, before, after), the words of a path, its weight, and the flows of its first and last node.

    ``nodes`` are (a, b, flow), ``edges`` (a, b, c, n). An edge that holds all of the flow of the node between joins the one before.
    """
    flows = lookup(edges, nodes.withColumnRenamed("flow", "before"), ["a", "b"], ["c"])
    heads = nodes.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("flow").alias("after"))
    flows = pinned(lookup(flows, heads, ["b", "c"], ["a"]), "phrase-edges")
    # What comes in by one edge and leaves by one edge, whole: at most one pair of edges for each node.
    inward = flows.filter("n = after").select(F.col("b").alias("a"), F.col("c").alias("b"), F.struct(F.col("a"), F.col("b"), F.col("c")).alias("to"))
    own = F.struct("a", "b", "c")
    linked = flows.filter("n = before").join(inward, ["a", "b"]).select(own.alias("e"), "to")
    resolved = pinned(_traced(linked), "phrase-links")
    rows = flows.withColumn("e", own).join(resolved, "e", "left").select(
        F.coalesce("to", "e").alias("path"), F.coalesce("step", F.lit(0)).alias("step"), "a", "b", "c", "n", "before", "after")
    # A path lies in one piece of a text, so its words fit in a row.
    held = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", "c", "after"))).alias("run"), F.min("n").alias("n"),
                                    F.min_by("before", "step").alias("before"))
    return held.select(F.concat(F.array("path.a", "path.b"), "run.c").alias("words"), "n", "before", F.element_at("run.after", -1).alias("after"))


def _traced(linked: DataFrame) -> DataFrame:
    """For edges (e, to the edge before it): the first edge of the path and how far it is. Edges of rings are left out."""
    done, left = None, None
    rows = pinned(linked.withColumn("step", F.lit(1).cast("bigint")), "phrase-trace")
    while True:
        onward = rows.select(F.col("e").alias("to"), F.col("to").alias("far"), F.col("step").alias("more"))
        joined = pinned(rows.join(onward, "to", "left").select("e", F.coalesce("far", "to").alias("to"), F.col("far").isNull().alias("ended"),
                                                              (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")), "phrase-trace")
        counts = {r["ended"]: r["count"] for r in joined.groupBy("ended").count().collect()}
        if not counts.get(False) or counts.get(False) == left:
            return joined.filter("ended").select("e", "to", "step")
        rows, left = joined.select("e", "to", "step"), counts[False]


# Candidates.


def _score(left: str, right: str) -> Column:
    """Whole part of 1000000 a a / (left right); counts have up to 16 digits, products up to 38."""
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    return F.expr(f"cast(1000000 as decimal(7, 0)) * ({wide('a')} * {wide('a')}) div ({wide(left)} * {wide(right)})")


def _named(rows: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """Candidates of ``size`` words with the words and their flows. The first word tells the language."""
    keys = [f"w{k + 1}" for k in range(size)]
    for k, key in enumerate(keys, 1):
        side = names.select(F.col("id").alias(key), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
        rows = lookup(rows, side, [key], [other for other in keys if other != key], "inner")
    return rows.withColumn("phrase", F.concat_ws(" ", *(f"t{k + 1}" for k in range(size))))


def phrases(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, a, l, r and score of all phrases that are not part of a longer one about as frequent.

    ``words`` are ``word_counts`` of the same rows, of ``least`` and more.
    """
    rows = graph(docs, words, least)
    nodes = rows.filter("b is not null and c is null").select("a", "b", F.col("n").alias("flow"))
    known = pinned(paths(nodes, rows.filter("c is not null")), "phrase-paths")

    # Inside a path every node has the path's weight; only its ends need their flows.
    last = F.size("words") - 3
    runs = known.select("words", "n", "before", "after", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    word = lambda k: F.get("words", F.col("k") + k)
    threes = runs.select(word(0).alias("w1"), word(1).alias("w2"), word(2).alias("w3"), F.col("n").alias("a"),
                         F.when(F.col("k") == 0, F.col("before")).otherwise(F.col("n")).alias("f12"),
                         F.when(F.col("k") == last, F.col("after")).otherwise(F.col("n")).alias("f23"))
    threes = pinned(threes, "candidates")
    longer = threes.select(F.explode(F.array(F.struct(F.col("w1").alias("a"), F.col("w2").alias("b")), F.struct(F.col("w2").alias("a"), F.col("w3").alias("b")))).alias("x"), "a")
    longer = longer.select("x.*", F.col("a").alias("longer")).groupBy("a", "b").agg(F.max("longer").alias("longer"))
    twos = nodes.join(longer, ["a", "b"], "left").filter("longer is null or 100 * longer < 50 * flow").select(
        F.col("a").alias("w1"), F.col("b").alias("w2"), F.col("flow").alias("a"))

    flows = rows.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("f"))
    names = pinned(words.filter("word is not null").join(flows, "id").select("id", "lang", "word", "f"), "phrase-words")
    shown = ["lang", "phrase", "a", "l", "r", "score"]
    two = _named(pinned(twos, "candidates"), names, 2).withColumns({"l": F.col("f1"), "r": F.col("f2"), "score": _score("f1", "f2")})
    three = _named(threes, names, 3).withColumns({"early": _score("f1", "f23"), "late": _score("f12", "f3")})
    early = F.col("early") <= F.col("late")
    three = three.withColumns({"l": F.when(early, F.col("f1")).otherwise(F.col("f12")), "r": F.when(early, F.col("f23")).otherwise(F.col("f3")), "score": F.least("early", "late")})
    return two.select(*shown).unionByName(three.select(*shown))


def best_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their rank, and n, the language's words."""
    words = pinned(word_counts(docs).filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # cut to ``top`` in each task before rows are sent
    ranked = phrases(docs, words, least).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    sizes = words.filter("word is null").select("lang", F.col("n").alias("_n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("_n").alias("n"), "score")


def op13_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of all documents."""
    return best_phrases(table(spark, sf_dir, "documents"))


OP13_SQL = f"""with texts as (select row_number() over () as id, coalesce(lang, 'und') as lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\x0C\r]')) as p from texts),
lists as (select row_number() over () as piece, lang, regexp_extract_all(p, '[^ \t]+') as ws from pieces),
words as (select piece, lang, unnest(ws) as w1, unnest(range(len(ws))) as nth from lists),
runs as (select lang, w1, lead(w1, 1) over (partition by piece order by nth) as w2, lead(w1, 2) over (partition by piece order by nth) as w3 from words),
ones as (select lang, w1, count(*) as f from runs group by all),
twos as (select lang, w1, w2, count(*) as f from runs where w2 is not null group by all),
threes as (select lang, w1, w2, w3, count(*) as f from runs where w3 is not null group by all),
sizes as (select lang, cast(sum(f) as bigint) as n from ones group by all),
longer as (select lang, x.a as w1, x.b as w2, max(f) as f from (select lang, f, unnest([{{'a': w1, 'b': w2}}, {{'a': w2, 'b': w3}}]) as x from threes where f >= {LEAST}) group by all),
cuts as (
 select t.lang, t.w1 || ' ' || t.w2 as phrase, 1 as k, t.f as a, l.f as l, r.f as r
 from twos t join ones l on t.lang = l.lang and t.w1 = l.w1 join ones r on t.lang = r.lang and t.w2 = r.w1
 left join longer g on t.lang = g.lang and t.w1 = g.w1 and t.w2 = g.w2 where t.f >= {LEAST} and (g.f is null or 100 * g.f < 50 * t.f)
 union all
 select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, l.f, r.f
 from threes t join ones l on t.lang = l.lang and t.w1 = l.w1 join twos r on t.lang = r.lang and t.w2 = r.w1 and t.w3 = r.w2 where t.f >= {LEAST}
 union all
 select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, l.f, r.f
 from threes t join twos l on t.lang = l.lang and t.w1 = l.w1 and t.w2 = l.w2 join ones r on t.lang = r.lang and t.w3 = r.w1 where t.f >= {LEAST}),
scored as (select *, cast(1000000 * cast(a as hugeint) * a // (cast(l as hugeint) * r) as bigint) as score from cuts),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= {TOP}"""
