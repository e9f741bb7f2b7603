"""Token ids as files of independently decodable blocks, coded with a static range asymmetric numeral system.

``tokenize`` gives every text its ids, ``write_ids`` counts them over all documents, makes one frequency table, and
writes the ids in ascending doc_id order; ``read_ids`` reads the files back.

Files: ``<folder>/table`` holds (token, freq), the frequencies summing to a power of two. ``<folder>/blocks`` holds a
row for each block: ``part`` (range of doc_id, ascending), ``block`` in that part, the offset of its first id in the part,
the doc_ids and id counts of its documents, and ``payload``. A block holds whole documents and closes at ``BLOCK`` ids.
Payload, little endian: ``RNS1``, then five 32-bit numbers (bits, lanes, ids, words, checkpoints), 32-bit crc of the
table, the checkpoints (32-bit step, 32-bit word offset, a 64-bit state for each lane), the 32-bit words, and the 32-bit
crc of all before it. Id k of a block belongs to lane k mod lanes. A decoder may start at any checkpoint.

Defined cases: a null text counts as empty and gets the end id only; equal doc_ids stand next to each other, null ones
first; an empty table gives no rows; very long texts make a longer block.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import new_folder, partitions, pinned, table
from rosterfold.llm.words import pieces

BLOCK = 1 << 20
LANES = 2048
CHECKPOINT = 256  # steps
CACHED = 500_000  # chunks after which a Python worker keeps those of late and forgets the ones before them
PUNCTUATION = ".,;:!?*#$%&@|()[]{}<>=+-~^/\\'\""  # neither letters, digits nor white space
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_ID = attrgetter("id")


class Chunks(dict):
    """Packed ids of chunks of text, found on first use.

    A word of letters with at most one space before it is a whole pre-token, and so is the punctuation behind it; a line
    break between visible characters is one too. Words go to the tokenizer's model at once, which leaves out its slower
    text handling; chunks of any other form are encoded by the tokenizer.
    """

    def __init__(self, tokenizer, kind: str, plain: bool, bare: Chunks | None = None):
        """``bare``: the chunks without a leading space; None for those themselves. Keys leave that space out."""
        super().__init__()
        self.bare, self.lead = (self, "") if bare is None else (bare, " ")
        self.tokenizer, self.model, self.plain, self.code = tokenizer, tokenizer.model, plain, "H" if kind == "<u2" else "I"
        # The letter that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next
        # free one from 256 on.
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*visible}))}
        self.letters = "".join(chr(letters[b]) for b in range(256))
        self.space = self.letters[32] if self.lead else ""
        self.earlier: dict[str, bytes] = {}

    def turn(self) -> None:
        """Remember what was used since the last turn, so that frequent chunks stay."""
        self.earlier = dict(self)
        self.clear()

    def __missing__(self, key: str) -> bytes:
        ids = self.earlier.get(key)
        if ids is not None:
            pass
        elif not self.plain:
            ids = self.whole(self.lead + key)
        elif "\n" in key and len(key) > 1 and _lines(key):
            first, *rest = key.split("\n")
            newline = self.bare["\n"]
            return self[first] + newline + newline.join([self.bare[p] for p in rest])
        else:
            word = key.rstrip(PUNCTUATION)
            if not word.isalpha():
                ids = self.whole(self.lead + key)
            elif len(word) < len(key):
                again = word in self
                ids = self[word] + self.bare[key[len(word):]]
                if not again:
                    return ids
            else:
                letters = word if word.isascii() else charmap_decode(word.encode(), "strict", self.letters)[0]
                ids = array(self.code, map(_ID, self.model.tokenize(self.space + letters))).tobytes()
        self[key] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _lines(key: str) -> bool:
    """Whether every line break stands between visible characters."""
    parts = key.split("\n")
    if parts == key.split():
        return True
    return all(parts) and not any(a[-1].isspace() or b[0].isspace() for a, b in pairwise(parts))


class Encoder:
    """Ids of texts, packed. Splits a text before every space that has a visible character behind it, where the
    tokenizer's own pre-tokenizer always splits too, and encodes each distinct chunk once."""

    # A space before white space or at the end: such texts are encoded whole.
    _odd = re.compile(r" (?=\s|\Z)")

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
        self.end = np.array([end], self.kind).tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        self.plain, self.bare = plain, Chunks(self.tokenizer, self.kind, plain)
        self.spaced = Chunks(self.tokenizer, self.kind, plain, self.bare)

    def encode(self, text: str) -> bytes:
        if not self.plain or self._odd.search(text) or any(s in text for s in self.special):
            return self.bare.whole(text) + self.end
        for known in (self.bare, self.spaced):
            if len(known) > CACHED:
                known.turn()
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest)) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def tokenize(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """doc_id and the packed ids (16 bits each, 32 for a larger vocabulary) of every text, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault((path, end), None) or Encoder(path, end)
        _encoders[path, end] = encoder
        for batch in pieces(batches):
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def id_type(path: str, end: int = 0) -> str:
    return Encoder(path, end).kind


class Table:
    """Frequencies of the ids, summing to ``1 << bits``."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, freqs = tokens[order].astype(np.int64), freqs[order].astype(np.uint64)
        self.total = int(freqs.sum())
        self.bits = max(0, self.total.bit_length() - 1)
        size = int(self.tokens[-1]) + 1 if len(tokens) else 0
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.tokens] = freqs
        self.cum[self.tokens] = np.cumsum(freqs) - freqs
        self.symbol = np.repeat(self.tokens, freqs.astype(np.int64)).astype(np.uint32)
        self.crc = zlib.crc32(self.tokens.astype("<u4").tobytes() + freqs.astype("<u4").tobytes())

    @staticmethod
    def scaled(tokens: np.ndarray, counts: np.ndarray) -> Table:
        """Counts scaled to a power of two, at least 1 each; what rounding leaves over goes to the most frequent ids."""
        if not len(tokens):
            return Table(tokens, counts)
        size = 1 << (max(8, int(len(tokens) - 1).bit_length()) + 4)
        freqs = np.maximum(1, np.floor(counts / counts.sum() * size)).astype(np.int64)
        left = size - int(freqs.sum())
        for k in np.lexsort((tokens, -freqs)):
            step = left if left > 0 else max(left, 1 - int(freqs[k]))
            freqs[k] += step
            left -= step
            if not left:
                break
        return Table(tokens, freqs)


def pack(ids: np.ndarray, table: Table) -> bytes:
    """One block."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    freqs, cums = table.freq[ids], table.cum[ids]
    limits = freqs << room
    state = np.full(lanes, _LOW)
    words, saved = [], []
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        x = state[:at.stop - at.start]
        over = x >= limits[at]
        words.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(over, x >> _WORD, x)
        f = freqs[at]
        q = x // f
        state[:len(x)] = (q << bits) + (x - q * f) + cums[at]
        if step % CHECKPOINT == 0:
            saved.append((step, state.copy()))
    words.reverse()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]) if words else np.zeros(1, np.int64)
    out = [b"RNS1", struct.pack("<6I", table.bits, lanes, n, int(before[-1]), len(saved), table.crc)]
    for step, states in reversed(saved):
        out += [struct.pack("<2I", step, int(before[step])), states.astype("<u8").tobytes()]
    out += [w.tobytes() for w in words]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(payload: bytes, table: Table) -> np.ndarray:
    """The ids of one block; raises ValueError when a checksum or a checkpoint does not hold."""
    if payload[:4] != b"RNS1" or zlib.crc32(memoryview(payload)[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged block")
    bits_, lanes, n, n_words, n_saved, crc = struct.unpack_from("<6I", payload, 4)
    if crc != table.crc:
        raise ValueError("the block was written with another table")
    at, saved = 28, []
    for _ in range(n_saved):
        step, word = struct.unpack_from("<2I", payload, at)
        saved.append((step, word, np.frombuffer(payload, "<u8", lanes, at + 8).astype(np.uint64)))
        at += 8 + 8 * lanes
    words = np.frombuffer(payload, "<u4", n_words, at).astype(np.uint64)
    bits, mask = np.uint64(bits_), np.uint64((1 << bits_) - 1)
    ids, steps = np.empty(n, np.uint32), -(-n // lanes)
    for k, (step, word, state) in enumerate(saved):
        end = saved[k + 1][0] if k + 1 < n_saved else steps
        state = state.copy()
        for now in range(step, end):
            a, b = now * lanes, min(n, (now + 1) * lanes)
            x = state[:b - a]
            slot = x & mask
            got = table.symbol[slot]
            ids[a:b] = got
            x = table.freq[got] * (x >> bits) + slot - table.cum[got]
            under = np.flatnonzero(x < _LOW)
            x[under] = (x[under] << _WORD) | words[word:word + len(under)]
            word += len(under)
            state[:b - a] = x
        if k + 1 < n_saved and (word != saved[k + 1][1] or (state != saved[k + 1][2]).any()):
            raise ValueError("a checkpoint does not hold")
    return ids


def write_ids(ids: DataFrame, kind: str, folder: str) -> None:
    """Write the packed ids of ``ids`` (doc_id, ids) to ``folder``."""
    spark = ids.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                got = np.bincount(np.frombuffer(packed.as_buffer(), kind))
                if len(got) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
                counts[:len(got)] += got
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["token", "n"])

    # At most as many rows as the vocabulary has ids.
    rows = ids.select("ids").mapInArrow(count, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").toPandas()
    table = Table.scaled(rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(t), int(table.freq[t])) for t in table.tokens], "token int, freq bigint").coalesce(1).write.parquet(f"{folder}/table")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, offset = TaskContext.get().partitionId(), 0, 0
        docs, packs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = [len(p) for p in packs]
            payload = pack(np.concatenate(packs), table)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([offset]), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "block", "offset", "docs", "lengths", "payload"])

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(packed.as_buffer(), kind)
                docs.append(doc)
                packs.append(own)
                held += len(own)
                if held >= BLOCK:
                    yield flush()
                    block, offset, docs, packs, held = block + 1, offset + held, [], [], 0
        if docs:
            yield flush()

    (ids.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(blocks, "part int, block int, offset bigint, docs array<bigint>, lengths array<bigint>, payload binary")
     .write.parquet(f"{folder}/blocks"))


def read_table(spark: SparkSession, folder: str) -> Table:
    rows = spark.read.parquet(f"{folder}/table").toPandas()
    return Table(rows["token"].to_numpy(np.int64), rows["freq"].to_numpy(np.int64))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (32 bits each) of every document written."""
    table, stored = read_table(spark, folder), spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], table).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                packed = [ids[a:b].tobytes() for a, b in zip(ends - lengths, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lengths), row["part"], np.int32)), pa.array(row["docs"], pa.int64()), pa.array(row["offset"] + ends - lengths), pa.array(lengths), pa.array(packed, pa.binary())],
                    names=["part", "doc_id", "start", "n_tokens", "ids"])

    decoded = stored.mapInArrow(run, "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary")
    # One row for each part.
    sizes = stored.select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    earlier, before = [], 0
    for row in sizes.orderBy("part").collect():
        earlier.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(earlier, "part int, before bigint")
    return decoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def op4_rans_token_ids(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of all documents, written and read back."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    path = str(path)
    ids = pinned(tokenize(table(spark, sf_dir, "documents"), path), "token-ids")
    folder = new_folder(spark, "id-files")
    write_ids(ids, id_type(path), folder)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
