"""Rows that every operator must take, and the plain words of a text."""

import re

#: Columns that operators use inside, under the names they use.
CLASHING = {"size": 7, "row": -1, "n": 3, "_rank": 9, "shard": "x", "token": "y", "score": 0.5, "_key": "k", "_before": 1, "fp1": 2, "label": 1, "taken": 4, "_text": "z"}

LONG = " ".join(f"w{k % 977} the{k % 13}" for k in range(12_000))
PLAIN = "a quiet morning by the river with nothing much to tell but the weather and some birds"

#: Nulls in every column, empty, blank, one word, very long, equal texts, rows that repeat.
ODD = [
    (1, PLAIN, "en", "s1"), (2, PLAIN, "en", "s1"), (2, PLAIN, "en", "s1"), (3, None, "en", "s2"), (4, "", "de", "s2"), (5, " \t\n", None, None),
    (6, "word", "en", ""), (None, PLAIN + " more", "en", "s1"), (None, None, None, None), (7, LONG, "en", "s3"), (8, LONG, "fr", "s3"),
    (9, "Ünïcode straße 漢字 emoji 😀 text with nbsp and em space", "xx", "s1"), (10, "a\r\nb\x0bc\x0cd", "en", "s1"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def words_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)
