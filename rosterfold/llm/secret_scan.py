"""Secrets in texts through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression the driver derives a Boolean query over trigrams that every match must hold
(``trigram_query``): literals and small classes are multiplied out, alternatives are joined by OR, what stands in a row by AND,
and everything else says nothing. The query is kept as alternatives (clauses) of trigrams that must all occur. One pass over the
lower-cased texts makes the postings (trigram, text) of all trigrams that some rule asks for; a clause's postings are
intersected by counting them per text, and only texts in which a clause of a rule is complete are searched by the rule's
expression. A rule whose query says nothing, such as a run of hexadecimal digits, scans all texts, in the pass that makes the
postings. Trigrams that no rule asks for are not kept, so the index is as large as the rules need.

Texts are known by two 64-bit hashes of doc_id and text, so rows that repeat are searched once. The postings and the candidates
hold no text; searching candidates is a join of the texts with the candidates' hashes. Nothing depends on a key of the data:
rows are dealt out by hash, and only the clauses, whose number is that of the rules, are broadcast.

Defined cases: null texts count as empty and have no spans; rows that repeat have a row each; matches that fail a rule's
length are dropped without a second try; spans at one place are all kept, in the order start, kind; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op, _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rosterfold.llm.shared import pinned, table, text_or_empty

Query = frozenset[frozenset[str]]
#: What every text fulfils: one clause that asks for nothing.
ANYTHING: Query = frozenset([frozenset()])
LIMIT = 64

KEY = ["k1", "k2"]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: As asked for. A run of hexadecimal digits is taken whole, so its least length can stand in the expression.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further secrets with a published form, found through the index alone.
MORE = (
    Rule("pem", r"-----BEGIN\x20(?:[A-Z]{2,16}\x20)?PRIVATE\x20KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?i)bearer\x20{1,8}[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@"),
)
RULES = BASE + MORE


# The query of an expression.


def _least(clauses: set[frozenset[str]]) -> Query:
    """Without the clauses that ask for more than another one does."""
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _both(a: Query, b: Query) -> Query:
    joined = _least({x | y for x in a for y in b})
    # To ask for less is always right.
    return joined if len(joined) <= LIMIT else min(a, b, key=len)


def _grams(strings: frozenset[str]) -> Query:
    return _least({frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings})


def _chars(members: list) -> frozenset[str] | None:
    """The lower-cased characters of a small class of ASCII characters, else None."""
    found = set()
    for code, value in members:
        low, high = (value, value) if code is op.LITERAL else value if code is op.RANGE else (0, 1 << 20)
        if high > 127 or high - low > 8:
            return None
        found.update(chr(c).lower() for c in range(low, high + 1))
    return frozenset(found)


def _one(code, value) -> tuple[frozenset[str] | None, Query]:
    if code is op.LITERAL:
        return (frozenset([chr(value).lower()]), ANYTHING) if value < 128 else (None, ANYTHING)
    if code is op.IN:
        return _chars(value), ANYTHING
    if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset([""]), ANYTHING
    if code is op.SUBPATTERN:
        return _sequence(value[3])
    if code is op.ATOMIC_GROUP:
        return _sequence(value)
    if code is op.BRANCH:
        parts = [_sequence(part) for part in value[1]]
        if all(exact is not None for exact, _ in parts):
            return frozenset().union(*(exact for exact, _ in parts)), ANYTHING
        return None, _least(set().union(*(query for _, query in parts)))
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, part = value
        exact, query = _sequence(part)
        if exact is not None and high == 1 and low == 0:
            return exact | {""}, ANYTHING
        if low == 0:
            return None, ANYTHING
        if exact is None or len(exact) ** low > LIMIT:
            return None, query
        times = frozenset("".join(p) for p in product(exact, repeat=low))
        return (times, ANYTHING) if high == low else (None, _both(query, _grams(times)))
    return None, ANYTHING


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    """All strings the items can match, when these are few, and the query of their matches."""
    run, whole, query = frozenset([""]), True, ANYTHING
    for code, value in items:
        exact, asked = _one(code, value)
        if exact is not None and len(run) * len(exact) <= LIMIT:
            run = frozenset(a + b for a in run for b in exact)
            continue
        query, whole = _both(_both(query, _grams(run)), asked), False
        run = exact if exact is not None else frozenset([""])
    return run if whole else None, _both(query, _grams(run))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-cased trigrams: a text with a match has all trigrams of one of them. ``ANYTHING`` where the
    expression has no mandatory trigrams."""
    return _sequence(parser.parse(pattern))[1]


# The index.


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text, and the two hashes it is known by."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(12), "text", "doc_id")})


def _matches(rule: Rule) -> Column:
    """Each match with the length of the gap before it; null without any."""
    text, expression = F.col("text"), rule.pattern
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, expression, -1), 1, F.size(found)).alias("before"))
    return F.when(F.size(found) > 0, F.transform(pairs, lambda p: F.struct(p["m"].alias("m"), F.char_length(p["before"]).alias("gap"))))


def indexed(rows: DataFrame, queries: dict[str, Query], full: list[Rule]) -> DataFrame:
    """doc_id, the hashes, ``grams`` (the asked trigrams that the text has), and the matches of the rules that scan fully."""
    asked = sorted({gram for query in queries.values() for clause in query for gram in clause})
    low = rows.withColumn("low", F.lower("text"))
    grams = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in asked])) if asked else F.array().cast("array<string>")
    return pinned(low.select("doc_id", *KEY, grams.alias("grams"), *[_matches(rule).alias(rule.kind) for rule in full]), "trigrams")


def postings(index: DataFrame) -> DataFrame:
    """(trigram, hashes), each once."""
    return index.filter(F.size("grams") > 0).select(*KEY, "grams").dropDuplicates(KEY).select(*KEY, F.explode("grams").alias("gram"))


def candidates(spark: SparkSession, index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Hashes and ``rules``, the kinds whose query the text fulfils."""
    clauses = [(kind, n, gram, len(clause)) for kind, query in queries.items() for n, clause in enumerate(sorted(query, key=sorted)) for gram in clause]
    asked = spark.createDataFrame(clauses, "kind string, clause int, gram string, size int")  # as many rows as the rules have trigrams
    complete = (postings(index).join(F.broadcast(asked), "gram").groupBy(*KEY, "kind", "clause", "size").count()
                .filter(F.col("count") == F.col("size")))
    return complete.groupBy(*KEY).agg(F.collect_set("kind").alias("rules"))


def _spans(rows: DataFrame, rules: list[Rule], kinds: list[str]) -> DataFrame:
    """Hashes, kind (its rank), start and end of the matches in the rules' columns that are long enough."""
    def of(rule: Rule) -> DataFrame:
        found = rows.filter(F.col(rule.kind).isNotNull()).select(*KEY, F.posexplode(rule.kind).alias("n", "x")).select(*KEY, "n", "x.*")
        upto = Window.partitionBy(*KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        ends = found.withColumn("end", F.sum(F.col("gap") + F.char_length("m")).over(upto).cast("bigint"))
        kept = ends.filter(F.char_length(F.regexp_extract("m", rule.pattern, rule.group)) >= rule.least) if rule.least else ends
        return kept.select(*KEY, F.lit(kinds.index(rule.kind)).alias("kind"), (F.col("end") - F.char_length("m")).alias("start"), "end")

    return reduce(DataFrame.unionByName, map(of, rules))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found``, an array of (start, kind, end) by start and kind, where kind is the rule's place; null without spans."""
    spark, kinds = docs.sparkSession, [rule.kind for rule in rules]
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    full = [rule for rule in rules if queries[rule.kind] == ANYTHING]
    through = [rule for rule in rules if queries[rule.kind] != ANYTHING]
    rows = keyed(docs)
    index = indexed(rows, {rule.kind: queries[rule.kind] for rule in through}, full)
    held = reduce(lambda a, b: a | b, (F.col(rule.kind).isNotNull() for rule in full), F.lit(False))
    parts = [_spans(index.filter(held).dropDuplicates(KEY), full, kinds)] if full else []
    if through:
        asked = candidates(spark, index, {rule.kind: queries[rule.kind] for rule in through})
        chosen = rows.join(asked, KEY).dropDuplicates(KEY)
        verified = pinned(chosen.select(*KEY, *[F.when(F.array_contains("rules", rule.kind), _matches(rule)).alias(rule.kind) for rule in through]), "verified")
        parts.append(_spans(verified, through, kinds))
    spans = reduce(DataFrame.unionByName, parts)
    spans = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))  # one text's spans
    return index.select("doc_id", *KEY).join(spans, KEY, "left").select("doc_id", "found")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(rule.kind) for rule in RULES])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def op12_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    empty = F.expr("array()").cast("array<struct<start: bigint, kind: int, end: bigint>>")
    rows = secrets(table(spark, sf_dir, "documents")).withColumn("found", F.coalesce("found", empty))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{BASE[k].kind}")
    return rows.select("doc_id", *map(count, range(len(BASE))), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
