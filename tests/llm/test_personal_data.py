import hashlib
import re

from odd_rows import ODD

from rosterfold.llm.personal_data import KINDS, op5_contextual_personal_data, personal_data

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in match.split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(FORMS) for m in re.finditer(FORMS[kind], text or "") if fits(kind, m[0]))


def check(frame, docs):
    got = personal_data(frame).collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r["doc_id"], [tuple(s) for s in r["base"] or []]) for r in got), key=key) == sorted(((d[0], base(d[1])) for d in docs), key=key)
    return got


def test_forms(frames):
    texts = ["a.b@c.d_e@f.g, x@y", "é😀 +1 (499) 555-6503 and 4111 1111 1111 1111.", "1.2.3.4.5 300.1.1.1 010.0.0.255", "4111-1111-1111-1112 +12 +1234567890123456", "mail@@x.y me@a..b a@b.c@d.e",
             "9" * 30_000, "1.1.1.1+12345678901", "x" * 20_000 + "@" + "y" * 10 + ".z", "10.0.0.1 me@10.0.0.1 +4915112345678"]
    check(frames.docs([(k, t, "", "") for k, t in enumerate(texts)]), [(k, t) for k, t in enumerate(texts)])


def test_given_documents(spark, frames):
    docs = [tuple(r) for r in frames.given("documents").collect()]
    check(frames.given("documents"), docs)
    rows = {r["doc_id"]: r for r in op5_contextual_personal_data(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        spans = base(d[1])
        r, text = rows[d[0]], ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in FORMS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert {s for s in r["spans"].split(",") if s and not s.startswith("other")} == {s for s in text.split(",") if s}


def test_patterns_discover_what_the_forms_miss(frames):
    docs = [(k, f"some words here call me at +1 499 555 {1000 + k} thanks a lot", "", "") for k in range(12)]
    docs += [(50, "other words call me at 0049-555-1234567 thanks again", "", ""), (51, "the year was 1999-2000-1234567 in all", "", "")]
    rows = {r["doc_id"]: r for r in check(frames.docs(docs), docs)}
    text = docs[12][1]
    assert [(text[s["start"]:s["end"]], KINDS[s["like"]]) for s in rows[50]["found"]] == [("0049-555-1234567", "phone")]
    assert not rows[51]["found"] and not any(rows[k]["found"] for k in range(12))


def test_odd_rows(frames):
    docs = [*ODD, (20, "a@b.cd " * 4000, "", ""), (20, "a@b.cd " * 4000, "", "")]
    check(frames.docs(docs, extra=True), docs)
    assert personal_data(frames.docs([])).collect() == []


def test_spaced_and_spelled_identifiers_are_discovered(frames):
    docs = [(k, f"some words here call me at +1 499 555 {1000 + k} thanks a lot, or write to me{k}@host{k}.com soon", "", "") for k in range(12)]
    cases = {
        "words call me at 499 555 1000 thanks": ("499 555 1000", "phone"), "words call me at (499) 555-1000 thanks": ("(499) 555-1000", "phone"),
        "words call me at (499 555 1001), thanks": ("499 555 1001", "phone"), "words call me at 4990 - 555 - 1002 thanks": ("4990 - 555 - 1002", "phone"),
        "words call me at GB29 NWBK 6016 1331 9268 19 thanks": ("GB29 NWBK 6016 1331 9268 19", "phone"), "words call me at 0049-555-1234567 4 thanks": ("0049-555-1234567 4", "phone"),
        "or write to name at host dot com soon": ("name at host dot com", "email"), "or write to a.b [at] host [dot] co.uk soon": ("a.b [at] host [dot] co.uk", "email"),
        "the years 1999 2000 2001 2002 in all, we met at noon dot": None, "words call me at " + "12 " * 40 + "thanks": None,
    }
    docs += [(50 + k, t, "", "") for k, t in enumerate(cases)] + [(99, "words call me at " + "7 " * 30_000, "", "")]
    rows = {r["doc_id"]: r for r in check(frames.docs(docs), docs)}
    for k, (text, want) in enumerate(cases.items()):
        assert [(text[s["start"]:s["end"]], KINDS[s["like"]]) for s in rows[50 + k]["found"] or []] == ([want] if want else []), text
    assert not any(rows[k]["found"] for k in range(12))
