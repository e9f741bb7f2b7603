"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon is every term whose share of documents lies between ``LOW`` and ``HIGH`` (a band of inverse document
frequency), counted over all documents. A document's distinct lexicon terms are sorted and hashed once for each of
``LEVELS`` x ``SUBSETS`` random subsets of the lexicon; a subset of level l keeps a term with a chance of 2**-l, so that
some level suits a text of any length. A fingerprint is the hex form of these 16-bit hashes, 0000 where a document
has no term of the subset. Likeness compares two fingerprints over the levels where at most ``BUSY`` of the subsets
have terms: the share of equal hashes among those where either has terms.

The lexicon is bounded whatever the number of documents: a document has so many distinct terms on average, and no more
than that number divided by ``LOW`` terms can be in a share of ``LOW`` of all documents.

Defined cases: null texts count as empty; a text without lexicon terms is hashed with all its terms, one without terms
has an all-zero fingerprint, and two of these are alike (1.0); documents follow each other in descending doc_id, null
last, equal doc_ids by the packed text; a single document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import new_folder, partitions, pinned, table
from rosterfold.llm.words import Words, mix, pieces, signed

LOW, HIGH = 1 / 2000, 0.1
LEVELS, SUBSETS = 12, 16
BUSY = 0.75
CANDIDATES = 2_000_000  # terms that may be sent to the tasks
_SALTS = np.random.Generator(np.random.PCG64(411)).integers(1, 1 << 63, SUBSETS, dtype=np.uint64)


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and in how many of them each occurs."""
    own = [np.unique(words.of(k)) for k in range(len(words))]
    return np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)


def _candidates(docs: DataFrame) -> DataFrame:
    """Terms in a share of ``LOW`` of the documents of at least one batch. A term in such a share of all documents is in
    such a share of some batch, so none is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_counted(Words(piece.column(0))) for piece in pieces(iter([batch]))]
            if parts:
                terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([n for _, n in parts]), len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(signed(terms[counts >= LOW * batch.num_rows]))], names=["term"])

    return docs.select("text").mapInArrow(run, "term bigint").distinct()


def document_counts(docs: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """The number of documents each term (hashed) occurs in; ``among``: only these terms, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            terms, counts = _counted(Words(batch.column(0)))
            if among is not None:
                kept = _inside(among, terms)[1]
                terms, counts = terms[kept], counts[kept]
            yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(counts.astype(np.int64))], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _inside(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash is among the sorted terms, and whether it is."""
    if not len(terms):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return at, terms[at] == hashes


def _sorted(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.select("term").toArrow().column(0).to_numpy().view(np.uint64))


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    total = docs.count()
    candidates = pinned(_candidates(docs), "terms")
    # Rare terms need not be shuffled, as long as the others fit in each task.
    among = _sorted(candidates) if candidates.count() <= CANDIDATES else None
    return _sorted(document_counts(docs, among).filter(F.col("n").between(max(1.0, LOW * total), max(1.0, HIGH * total))))


def subset_hashes(words: Words, terms: np.ndarray) -> np.ndarray:
    """A 16-bit hash for each text, level and subset; 0 where the text has no term of the subset."""
    n = len(words)
    owner, hashes = words.owners(), words.hashes
    inside = _inside(terms, hashes)[1]
    fallback = np.bincount(owner[inside], minlength=n) == 0
    kept = inside | fallback[owner]
    owner, hashes = owner[kept], hashes[kept]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    if len(owner):
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[first], hashes[first]
    out = np.zeros((n, LEVELS, SUBSETS), np.uint16)
    cells = n * LEVELS
    for k, salt in enumerate(_SALTS):
        drawn = mix(hashes ^ salt)
        # A term is in the subsets of levels 0 to its number of leading zero bits.
        level = np.minimum(LEVELS - 1, 63 - np.floor(np.log2(np.maximum(drawn, np.uint64(1)).astype(float))).astype(np.int64)).clip(0)
        cell = owner * LEVELS + level
        value = mix(drawn)
        sums = []
        for weights in (None, (value & np.uint64(0xFFFFFF)).astype(float), (value >> np.uint64(40)).astype(float)):
            upto = np.bincount(cell, weights=weights, minlength=cells).reshape(n, LEVELS)
            sums.append(upto[:, ::-1].cumsum(axis=1)[:, ::-1])
        hashed = mix(sums[1].astype(np.uint64) ^ (sums[2].astype(np.uint64) << np.uint64(31))) >> np.uint64(48)
        out[:, :, k] = np.where(sums[0] > 0, np.maximum(hashed, np.uint64(1)), np.uint64(0))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints in the form ``subset_hashes`` gives, pairwise."""
    either = ((a > 0) | (b > 0)).sum(axis=2)
    equal = ((a == b) & (a > 0)).sum(axis=2)
    busy = either > BUSY * SUBSETS
    first = np.where(busy.all(axis=1), LEVELS - 1, np.argmin(busy, axis=1))
    # Back to a level that has terms at all.
    used = np.cumsum(either[:, ::-1], axis=1)[:, ::-1]
    last_used = LEVELS - 1 - np.argmax((either > 0)[:, ::-1], axis=1)
    first = np.minimum(first, np.where(either.any(axis=1), last_used, 0))
    row = np.arange(len(a))
    equals = np.cumsum(equal[:, ::-1], axis=1)[:, ::-1][row, first]
    return np.where(either.any(axis=1), equals / np.maximum(1, used[row, first]), 1.0)


def _hex(hashes: np.ndarray) -> list[str]:
    return [h.astype(">u2").tobytes().hex() for h in hashes]


def _packed(hashes: np.ndarray) -> list[bytes]:
    return [h.astype(">u2").tobytes() for h in hashes]


def _unpacked(fingerprints: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(f, ">u2") for f in fingerprints]).reshape(-1, LEVELS, SUBSETS).astype(np.uint16)


def fingerprints(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``docs`` with a column ``fingerprint``."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = _hex(subset_hashes(Words(batch.column(place)), terms))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "fingerprint"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kind}, fingerprint string")


def _edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _result(ids: pa.Array, texts: list[str], hashes: np.ndarray, following: list[str], next_hashes: np.ndarray, terms: np.ndarray) -> list[pa.Array]:
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    changed = subset_hashes(Words(pa.array(edited, pa.string())), terms)
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest() for e in edited], pa.binary()),
            pa.array(_packed(hashes), pa.binary()), pa.array(_packed(changed), pa.binary()), pa.array(likeness(hashes, changed)), pa.array(likeness(hashes, next_hashes))]


def _readable(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def with_edits(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Texts are packed and range partitioned once; the document that follows is then the row before. Only the first row of each
    partition needs the last of an earlier one: these edge rows, two for each partition, are joined afterwards.
    """
    spark = docs.sparkSession
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor()
        for batch in batches:
            packed = [codec.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pack, "doc_id bigint, packed binary")
    placed = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "packed")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [codec.decompress(p.as_buffer()).decode("utf-8", "surrogatepass") for p in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple[str, np.ndarray] | None = None

        def edge(role: str, ids: pa.Array, text: str, hashes: np.ndarray) -> pa.RecordBatch:
            blank = [pa.nulls(1, kind) for kind in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            blank[2] = pa.array(_packed(hashes), pa.binary())
            return pa.RecordBatch.from_arrays([ids, *blank, pa.array([part], pa.int32()), pa.array([role]), pa.array([text], pa.string())], names=[*names, "part", "role", "text"])

        for batch in pieces(unpacked(batches)):
            texts = batch.column(1).to_pylist()
            hashes = subset_hashes(Words(batch.column(1)), terms)
            ids = batch.column(0)
            if last is None:
                yield edge("first", ids.slice(0, 1), texts[0], hashes[:1])
                before, before_hashes, at = texts[:-1], hashes[:-1], 1
            else:
                before, before_hashes, at = [last[0], *texts[:-1]], np.concatenate([last[1], hashes[:-1]]), 0
            n = len(texts) - at
            if n:
                columns = _result(ids.slice(at), texts[at:], hashes[at:], before, before_hashes, terms)
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*names, "part", "role", "text"])
            last, last_id = (texts[-1], hashes[-1:]), ids.slice(len(texts) - 1)
        if last is not None:
            yield edge("last", last_id, *last)

    folder = new_folder(spark, "fingerprints")
    # Much of a fingerprint is zero; this codec makes use of it.
    placed.mapInArrow(run, f"{_RESULT}, part int, role string, text string").write.option("compression", "zstd").parquet(folder)
    found = spark.read.parquet(folder)
    inner = found.filter("role is null").select(*names)
    parts = [r["part"] for r in found.filter("role = 'first'").select("part").orderBy("part").collect()]  # one for each partition
    if not parts:
        return _readable(inner)
    follows = spark.createDataFrame(list(zip(parts, parts[-1:] + parts[:-1])), "part int, of int")
    firsts = found.filter("role = 'first'").select("part", "doc_id", "text", "fingerprint").join(follows, "part")
    lasts = found.filter("role = 'last'").select(F.col("part").alias("of"), F.col("text").alias("next"), F.col("fingerprint").alias("next_fingerprint"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = _result(batch.column(0), batch.column(1).to_pylist(), _unpacked(batch.column(2).to_pylist()), batch.column(3).to_pylist(), _unpacked(batch.column(4).to_pylist()), terms)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    edges = firsts.join(lasts, "of").select("doc_id", "text", "fingerprint", "next", "next_fingerprint").mapInArrow(join, _RESULT)
    return _readable(inner.unionByName(edges))


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = table(spark, sf_dir, "documents")
    return with_edits(docs, lexicon(docs))
