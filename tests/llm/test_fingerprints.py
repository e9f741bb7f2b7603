import hashlib

import pyarrow as pa
from odd_rows import ODD, words_of

from rosterfold.llm.fingerprints import HIGH, LOW, fingerprints, lexicon, likeness, subset_hashes, with_edits
from rosterfold.llm.words import Words


def test_lexicon_is_the_band(frames):
    docs = [r["text"] for r in frames.given("documents").collect()]
    counts = {}
    for d in docs:
        for w in set(words_of(d)):
            counts[w] = counts.get(w, 0) + 1
    band = [w for w, n in counts.items() if max(1, LOW * len(docs)) <= n <= HIGH * len(docs)]
    assert sorted(Words(pa.array([" ".join(band)])).hashes.tolist()) == lexicon(frames.given("documents")).tolist()


def test_edits_follow_descending_ids(frames):
    rows = sorted(frames.given("documents").collect(), key=lambda r: -r["doc_id"])
    texts = [r["text"] for r in rows]
    terms = lexicon(frames.given("documents"))
    got = {r["doc_id"]: r for r in with_edits(frames.given("documents").repartition(5), terms).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for k, r in enumerate(rows):
        text, following, row = texts[k], texts[(k + 1) % len(texts)], got[r["doc_id"]]
        n = len(text) // 3
        edited = text[:len(text) - n] + following[:n]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(text)
        own, changed, after = (subset_hashes(Words(pa.array([t])), terms) for t in (text, edited, following))
        assert row["near_edited"] == likeness(own, changed)[0] and row["near_next"] == likeness(own, after)[0]
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
    assert sum(r["near_edited"] for r in got.values()) / len(got) > 0.3 > 0.05 > sum(r["near_next"] for r in got.values()) / len(got)


def test_order_and_repeats_of_terms_do_not_matter():
    one, two, other = (subset_hashes(Words(pa.array([t])), Words(pa.array(["a b c d"])).hashes.copy()) for t in ("a b c zz", "C b, yy c a a B", "d"))
    terms = sorted(Words(pa.array(["a b c d"])).hashes)
    import numpy as np

    one, two, other = (subset_hashes(Words(pa.array([t])), np.array(terms)) for t in ("a b c zz", "C yy c a a B", "d"))
    assert (one == two).all() and likeness(one, other)[0] < 0.1 and likeness(one, two)[0] == 1


def test_odd_rows(frames):
    frame = frames.docs(ODD, extra=True)
    rows = with_edits(frame, lexicon(frame)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == sorted((d[0] or 0, len(d[1] or "")) for d in ODD)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    single = with_edits(frames.docs(ODD[:1]), lexicon(frames.docs(ODD[:1]))).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1
    assert with_edits(frames.docs([]), lexicon(frames.docs([]))).collect() == []
    assert fingerprints(frame.select("doc_id", "text"), lexicon(frame)).columns == ["doc_id", "text", "fingerprint"]
