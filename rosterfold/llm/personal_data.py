"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are e-mail addresses, IP addresses, card and phone numbers found by their form. The words around them are lexical
patterns: the two words before, and the word before with the word behind. Candidates are all other tokens with a digit or
an at sign; runs of tokens with digits, parted by one blank, by a lone ``-``, ``/`` or ``.``, or by a group of capitals; and addresses
that spell out the at sign. The words around a run are those outside of it; tokens beside another token with a digit are
candidates too, but only the run counts in a pattern's confidence, and of found spans that lie in one another the longest
stays. A run of more than ``LONGEST`` letters and digits, an IBAN's most, is a list and no candidate. Patterns and the instances (seeds and candidates) that occur in them form a graph, scored in ``ROUNDS``
rounds: a pattern's confidence in a kind is the mean score of its instances for that kind; patterns with at least
``SUPPORT`` distinct good instances and ``CONFIDENCE`` pass their confidence on, and a candidate's score is
1 - product(1 - confidence). Candidates that reach ``ACCEPTED`` for a kind and have its characters become spans of the kind
``other``, so that the counts of the four kinds stay those of the seeds.

One pass over the texts keeps, for each match, its text, the length of the gap before it and ``AROUND`` characters on either
side; all later work is on that table. Offsets are running sums of gaps and matches. Instances are counted before
they are shuffled, and joins on patterns are ones whose large partitions Spark splits.

Defined cases: null texts count as empty; a text without spans has counts 0 and empty ``spans``; repeated rows are rows of
their own; spans at one place are all kept, in the order start, kind; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rosterfold.llm.shared import pinned, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "other")
_GROUP = r"[^\x20\x09-\x0D0-9@]*+[0-9][^\x20\x09-\x0D@]*+(?![^\x20\x09-\x0D])"
#: As asked for; quantifiers that can never give back are possessive, so that long runs need no stack.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
    # Candidates of several tokens; their spans have the kind ``other`` too.
    "run": rf"(?<![^\x20\x09-\x0D]){_GROUP}(?:\x20(?:[-/.]\x20|[A-Z]{{1,6}}+\x20)?{_GROUP})++",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20(?i:at)\x20|\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20(?i:dot)\x20|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++",
}
LONGEST = 34
AROUND, ROUNDS, SUPPORT, CONFIDENCE, ACCEPTED = 48, 3, 3, 0.6, 0.9
_BLANK = r"[\x20\x09-\x0D]+"


def _matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(FORMS[kind]), F.lit(0))
    return F.when(F.contains(text, F.lit("@")), found) if kind == "email" else found


def _found(docs: DataFrame) -> DataFrame:
    """row, doc_id and, for each kind, its matches with their surroundings."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumns({f"m_{k}": _matches(F.col("text"), k) for k in FORMS})

    def around(kind: str) -> Column:
        matches = F.col(f"m_{kind}")
        gaps = F.split("text", FORMS[kind], -1)
        pairs = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("before"), F.slice(gaps, 2, F.size(matches)).alias("behind"))
        kept = F.transform(pairs, lambda p: F.struct(
            p["m"].alias("m"), F.char_length(p["before"]).alias("gap"), F.right(p["before"], F.lit(AROUND)).alias("left"), F.left(p["behind"], F.lit(AROUND)).alias("right")))
        return F.when(F.size(matches) > 0, kept).alias(kind)

    return pinned(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *map(around, FORMS)), "personal-data")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(m: Column, kind: str) -> Column:
    digits = _digits(m)
    n = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "run":
        return (n >= 4) & (F.char_length(F.regexp_replace(m, "[^A-Za-z0-9]", "")) <= LONGEST)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _placed(found: DataFrame) -> DataFrame:
    """A row for each valid match: row, kind (the rank of its form), start, end, m and both sides."""
    every = reduce(DataFrame.union, (
        found.filter(F.col(kind).isNotNull()).select("row", F.lit(k).alias("kind"), F.posexplode(kind).alias("k", "x")) for k, kind in enumerate(FORMS)))
    rows = every.select("row", "kind", "k", "x.*").withColumn("n", F.char_length("m"))
    upto = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto))
    valid = F.lit(True)
    for k, kind in enumerate(FORMS):
        valid = F.when(F.col("kind") == k, _valid(F.col("m"), kind)).otherwise(valid)
    return rows.filter(valid).select("row", "kind", (F.col("end") - F.col("n")).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "m", "left", "right")


def _candidates(placed: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens, runs and spelled addresses without the punctuation around them, where they touch no base span.

    ``piece`` tells tokens beside another one with a digit.
    """
    other = KINDS.index("other")
    bracket = F.col("m").rlike(r"^[^A-Za-z0-9+@(]*\([^()]*\)[^()]*[A-Za-z0-9]")  # a bracket that is closed inside stays
    bare = F.when((F.col("kind") > other) & bracket, F.regexp_replace("m", "^[^A-Za-z0-9+@(]+", "")).otherwise(F.regexp_replace("m", "^[^A-Za-z0-9+@]+", ""))
    core = F.regexp_replace(F.col("_bare"), "[^A-Za-z0-9]+$", "")
    beside = F.col("left").rlike(r"[0-9][^\x20\x09-\x0D]*\x20$") | F.col("right").rlike(r"^\x20[^\x20\x09-\x0D0-9]*[0-9]")
    tokens = placed.filter(F.col("kind") >= other).withColumn("_bare", bare).withColumns({"_core": core, "piece": (F.col("kind") == other) & beside, "kind": F.lit(other)})
    start = F.col("start") + F.char_length("m") - F.char_length("_bare")
    tokens = tokens.withColumns({"start": start, "end": start + F.char_length("_core"), "m": F.col("_core")}).drop("_bare", "_core").filter("char_length(m) >= 4")
    joined = tokens.join(base, "row", "left")
    touched = F.exists("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return joined.filter(~F.coalesce(touched, F.lit(False))).drop("base")


def _patterns(spans: DataFrame) -> DataFrame:
    """(pattern, instance, kind or -1, whether a piece) edges, each once."""
    left = F.split(F.trim(F.regexp_replace(F.lower("left"), _BLANK, " ")), " ")
    right = F.split(F.trim(F.regexp_replace(F.lower("right"), _BLANK, " ")), " ")
    one, two, behind = F.element_at(left, -1), F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("")), F.element_at(right, 1)
    plain = lambda c: F.regexp_replace(c, "[0-9]", "0")
    texts = F.array(plain(F.concat(F.lit("before "), two, F.lit(" "), one)), plain(F.concat(F.lit("around "), one, F.lit(" "), behind)))
    kind = F.when(F.col("kind") == KINDS.index("other"), -1).otherwise(F.col("kind"))
    rows = spans.select(F.explode(texts).alias("pattern"), F.concat_ws(":", kind, F.lower("m")).alias("instance"), kind.alias("kind"), "piece")
    return rows.filter(F.trim(F.substring("pattern", 8, 1_000)) != "").distinct()


def _suits(kind: Column, m: Column) -> Column:
    """Whether a candidate has the characters of the kind it would be."""
    digits = F.char_length(_digits(m))
    return F.when(kind == KINDS.index("email"), F.contains(m, F.lit("@")) | m.rlike(r"(?i)[\x20\[({]at[\x20\])}]")).otherwise(digits >= F.when(kind == KINDS.index("ip"), 4).otherwise(7))


def _scored(edges: DataFrame) -> DataFrame:
    """instance and kind of the candidates that are accepted."""
    seeds = edges.filter("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, candidates = seeds, edges.filter("kind < 0").select("pattern", "instance").distinct()
    voting = edges.filter("not piece")
    sizes = voting.groupBy("pattern").agg(F.count("*").alias("size"))
    links = voting.select("pattern", "instance")
    for k in range(ROUNDS):
        held = links.join(scores, "instance")
        sums = held.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.sum((F.col("score") >= 0.5).cast("int")).alias("support"))
        good = sums.join(sizes, "pattern").withColumn("confidence", F.col("s") / F.col("size")).filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        raised = candidates.join(good.select("pattern", "kind", "confidence"), "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        suits = _suits(F.col("kind"), F.col("instance"))
        scores = pinned(seeds.union(raised.filter(suits)), f"instance-scores-{k}")
    best = Window.partitionBy("instance").orderBy(F.desc("score"), "kind")
    accepted = scores.filter((F.col("score") >= ACCEPTED) & F.col("instance").startswith("-1:"))
    return accepted.withColumn("k", F.row_number().over(best)).filter("k = 1").select("instance", F.col("kind").alias("like"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``found`` (arrays of start, kind, end; ``like`` is the kind a found span is like) of every text."""
    found = _found(docs)
    placed = pinned(_placed(found), "matches")
    other = KINDS.index("other")
    own = placed.filter(F.col("kind") < other)
    base = pinned(own.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("base")), "base-spans")  # one text's spans
    candidates = pinned(_candidates(placed, base), "candidates")
    edges = pinned(_patterns(own.withColumn("piece", F.lit(False)).unionByName(candidates)), "pattern-edges")
    accepted = _scored(edges)
    named = candidates.withColumn("instance", F.concat(F.lit("-1:"), F.lower("m")))
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)  # one text's spans
    spans = named.join(accepted, "instance").withColumn("_upto", F.max("end").over(earlier)).filter("_upto is null or end > _upto")
    more = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "like"))).alias("found"))
    return found.select("row", "doc_id").join(base, "row", "left").join(more, "row", "left").select("doc_id", "base", "found")


def op5_contextual_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; ``likely`` has the kinds that the spans of kind ``other`` are like."""
    rows = personal_data(table(spark, sf_dir, "documents"))
    empty = F.expr("array()").cast("array<struct<start: bigint, kind: int, end: bigint>>")
    base = F.coalesce("base", empty)
    found = F.coalesce(F.transform("found", lambda s: F.struct(s["start"], s["kind"], s["end"])), empty)
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    names = F.array(*map(F.lit, KINDS))
    likely = F.concat_ws(",", F.transform("found", lambda s: F.get(names, s["like"])))
    return rows.select("doc_id", *map(count, range(4)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.array_sort(F.concat(base, found))).alias("spans"), likely.alias("likely"))
