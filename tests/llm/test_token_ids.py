import zlib

import numpy as np
import public_tokenizers
import pytest
from odd_rows import ODD
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rosterfold.llm import token_ids as T
from rosterfold.llm.shared import new_folder

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN = Tokenizer.from_file(PATH)


def expected(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


ENCODER = T.Encoder(PATH, 0)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z9é漢😀 \n\t.,'!?-²  \x1c\x85_#$")), max_size=60))
def test_chunks_equal_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text), ENCODER.kind).tolist() == expected(text)


@pytest.mark.parametrize("text", ["<|endoftext|> x", "it's they'll 'tis", "x.\nThe end", " lead", "trail ", "a\n\nb"])
def test_special_forms(text):
    assert np.frombuffer(ENCODER.encode(text), ENCODER.kind).tolist() == expected(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(1, 60))
def test_blocks_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.uint16)
    tokens, counts = np.unique(ids, return_counts=True)
    table = T.Table.scaled(tokens.astype(np.int64), counts)
    assert table.total == 1 << table.bits
    payload = T.pack(ids, table)
    assert (T.unpack(payload, table) == ids).all()
    for damaged in (payload[:-1], payload[:40] + bytes([payload[40] ^ 1]) + payload[41:]):
        with pytest.raises(Exception):
            T.unpack(damaged, table)


def test_checkpoints_hold_in_a_long_block():
    ids = np.random.default_rng(1).zipf(1.3, 2_000_000).clip(max=40_000).astype(np.uint16)
    tokens, counts = np.unique(ids, return_counts=True)
    table = T.Table.scaled(tokens.astype(np.int64), counts)
    assert (T.unpack(T.pack(ids, table), table) == ids).all()


def test_files_of_odd_rows(spark, frames):
    folder = new_folder(spark, "ids")
    T.write_ids(T.tokenize(frames.docs(ODD, extra=True), PATH), "<u2", folder)
    rows = sorted(T.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    start, keys = 0, []
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
        keys.append(r["doc_id"])
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    got = sorted((r["doc_id"] or 0, zlib.crc32(r["ids"])) for r in rows)
    assert got == sorted((d[0] or 0, zlib.crc32(np.array(expected(d[1]), "<u4").tobytes())) for d in ODD)


def test_empty_table(spark, frames):
    folder = new_folder(spark, "ids")
    T.write_ids(T.tokenize(frames.docs([]), PATH), "<u2", folder)
    assert T.read_ids(spark, folder).collect() == []


def test_recent_chunks_stay_when_a_worker_forgets(monkeypatch):
    encoder = T.Encoder(PATH, 0)
    want = encoder.encode("Über alpha beta\ngamma, delta")
    monkeypatch.setattr(T, "CACHED", 1)

    class Gone:
        def tokenize(self, word):
            raise AssertionError(word)

    encoder.spaced.model = encoder.bare.model = Gone()
    assert encoder.encode("Über alpha beta\ngamma, delta") == want
    assert len(encoder.spaced) <= 4
