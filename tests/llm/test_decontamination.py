from odd_rows import ODD

from rosterfold.llm.decontamination import clean, overlaps

ITEM = "seven grey horses ran across the wide frozen field before anyone in the sleeping village woke to see them pass by"
NOISE = "lorem " * 40


def test_exact_substituted_and_partial(spark, frames):
    words = ITEM.split()
    changed = " ".join("changed" if k in (3, 8, 14) else w for k, w in enumerate(words))
    half = " ".join(words[2:16])
    apart = " ".join(w + " x" for w in words)
    few = " ".join(words[:9])
    docs = [(1, NOISE + ITEM + " " + NOISE, "en", "s"), (2, NOISE + changed.upper() + " end", "en", "s"), (3, half, "en", "s"), (4, apart, "en", "s"), (5, NOISE + few + " other", "en", "s"), (6, NOISE, "en", "s")]
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "the"), (7, ITEM)], "item_id bigint, text string")
    rows = overlaps(frames.docs(docs), bench).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3} and {r["item_id"] for r in rows} == {7}
    one = next(r for r in rows if r["doc_id"] == 2)
    assert (one["doc_word"], one["words"], one["same"]) == (40, len(words), len(words) - 3)
    assert sorted(r["doc_id"] for r in clean(frames.docs(docs, extra=True), bench).collect()) == [4, 5, 6]


def test_short_items_must_agree_whole(spark, frames):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "one two three four")], "item_id bigint, text string")
    docs = [(1, "so alpha beta gamma delta epsilon zeta then", "", ""), (2, "alpha beta gamma other epsilon zeta", "", ""), (3, "one two three four", "", "")]
    assert {(r["doc_id"], r["item_id"]) for r in overlaps(frames.docs(docs), bench).collect()} == {(1, 1)}


def test_given_passages_are_found_and_no_other(frames):
    docs, bench = frames.given("documents").collect(), frames.given("benchmark").collect()
    found = {r["doc_id"] for r in overlaps(frames.given("documents"), frames.given("benchmark")).collect()}
    assert found == {d["doc_id"] for d in docs if any(b["text"] in d["text"] for b in bench)}


def test_odd_and_empty(spark, frames):
    bench = spark.createDataFrame([(1, ODD[0][1])], "item_id bigint, text string")
    rows = overlaps(frames.docs(ODD, extra=True), bench).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 2]
    frame = frames.docs(ODD, extra=True)
    assert clean(frame, bench).columns == frame.columns and clean(frame, bench).count() == len(ODD) - 4
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert overlaps(frame, none).collect() == [] and clean(frame, none).count() == len(ODD)
    assert overlaps(frames.docs([]), bench).collect() == []


def test_no_pattern_of_substitutions_is_missed():
    from itertools import combinations

    import pyarrow as pa

    from rosterfold.llm.decontamination import Seeds
    from rosterfold.llm.words import Words

    for n in (*range(13, 21), 25):
        item = [f"w{k}" for k in range(n)]
        texts, most = [], min(n - 13, n // 5)
        for m in range(most + 1):
            for changed in combinations(range(1, n - 1), m):
                texts.append(" ".join("other" if k in changed else w for k, w in enumerate(item)))
        found = Seeds([1], [" ".join(item)]).overlaps(Words(pa.array(texts)))
        assert sorted(r[0] for r in found) == list(range(len(texts)))
        assert all(r[2:] == (0, 0, n, n - texts[r[0]].split().count("other")) for r in found)
