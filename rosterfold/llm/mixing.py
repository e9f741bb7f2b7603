"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in the order of a seeded hash, and the same again for a second pass. A
source gives the first ``floor(target)`` words of that stream, cut into blocks of ``block_words``. The blocks of all
sources are dealt out to the output shards by a tree: at each node the exact number of blocks for the left half is drawn
from the node's quotas without replacement, so quotas add up exactly and every shard has a like mixture. The blocks of
a source are permuted, the shards take disjoint ranges of the permuted order, and each shard is shuffled on its own.

Targets: weights 3, 1, 2 repeat over the sources in code point order, null last, and share 150 % of all words; a source
gives at most twice its words, and the excess is shared again by weight until no target is above that.

Only the list of sources, at most ``MAX_SOURCES``, comes to the driver. A source of a third of all rows is spread by its
hash order over many partitions.

Defined cases: null and empty texts have size 0 and are never drawn; a null source is a source of its own; rows that
repeat count each; null doc_ids are allowed; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import in_order, table

MAX_SOURCES = 100_000
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
BLOCK_WORDS = 1024
SHARDS = 8
MAX_BLOCKS = 500_000_000  # the generator draws from fewer than 10**9
PASSES = 2
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Shares of ``SHARE`` times all sizes by weight, none above ``LIMIT`` times its size."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = SHARE * sum(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        above = {k for k in open_ if left * weights[k] / total > LIMIT * sizes[k]}
        if not above:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in above:
            out[k] = float(LIMIT * sizes[k])
            left -= LIMIT * sizes[k]
        open_ -= above
    return out


def split(quotas: np.ndarray, shards: int, draw: np.random.Generator) -> list[np.ndarray]:
    """Quotas of each shard; they add up to ``quotas`` exactly, and totals differ by at most the tree's depth."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    total = int(quotas.sum())
    part = draw.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else np.zeros_like(quotas)
    return split(part, left, draw) + split(quotas - part, shards - left, draw)


@dataclass(frozen=True)
class Mixture:
    """Documents in stream order (``rows``), the plan of each source, and the words drawn (``draws``)."""

    rows: DataFrame
    sources: DataFrame
    draws: DataFrame


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _key() -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")))


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 7) -> Mixture:
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", _size().alias("size"), _key().alias("_key"))
    placed = in_order(rows, [F.asc_nulls_last("source"), F.col("_key"), F.col("doc_id"), F.col("size")], "size", "mix-rows")

    found = placed.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(found))]
    goals = targets(sizes, weights)
    words = [math.floor(t) for t in goals]
    while sum(words) > MAX_BLOCKS * block_words:
        block_words *= 2
    blocks = np.array([-(-w // block_words) for w in words], np.int64)
    draw = np.random.Generator(np.random.PCG64(seed))
    ends = np.cumsum(split(blocks, shards, draw), axis=0) if len(found) else np.zeros((shards, 0), np.int64)
    plan, start = [], 0
    for k, row in enumerate(found):
        count = int(blocks[k])
        factor = next(f for f in range(max(1, int(count * 0.618)), 2 * count + 2) if math.gcd(f, max(1, count)) == 1)
        plan.append((row["source"], sizes[k], start, goals[k], words[k], count, factor, int(draw.integers(0, max(1, count))), [int(e) for e in ends[:-1, k]]))
        start += sizes[k]
    sources = spark.createDataFrame(plan, "source string, source_size bigint, _start bigint, target double, words bigint, blocks bigint, factor bigint, shift bigint, cuts array<bigint>")

    joined = placed.alias("d").join(F.broadcast(sources.alias("s")), F.expr("d.source <=> s.source")).drop(F.col("s.source"))
    at = F.col("_before") - F.col("_start")
    passes = joined.withColumn("epoch", F.explode(F.array(*map(F.lit, range(PASSES))))).withColumn("lo", at + F.col("epoch") * F.col("source_size"))
    passes = passes.withColumn("hi", F.least(F.col("lo") + F.col("size"), "words")).filter("hi > lo")
    width = F.lit(block_words)
    pieces = passes.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}"))))
    first, last = F.greatest("lo", F.col("block") * width), F.least("hi", (F.col("block") + 1) * width)
    place = F.pmod(F.col("block") * F.col("factor") + F.col("shift"), F.col("blocks"))
    draws = (pieces.withColumn("_place", place)
             .select(F.col("_rank").alias("row"), F.col("_key").alias("key"), "doc_id", "source", "size", "epoch", "block", (first - F.col("lo")).alias("word"), (last - first).alias("words"),
                     F.size(F.filter("cuts", lambda c: c <= F.col("_place"))).alias("shard")))
    return Mixture(joined.select(F.col("_rank").alias("row"), "doc_id", "source", "size", "source_size", "target"), sources, draws)


def shuffled(draws: DataFrame, seed: int = 7) -> DataFrame:
    """The words drawn, with their place in the shard: each shard in the order of a seeded hash."""
    keyed = draws.withColumn("_key", F.xxhash64(F.lit(seed), "source", "doc_id", "epoch", "block", "row")).withColumn("_one", F.lit(1).cast("bigint"))
    placed = in_order(keyed, [F.col("shard"), F.col("_key"), F.col("row"), F.col("epoch"), F.col("block")], "_one", "mix-draws").withColumnRenamed("_before", "_at")
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(*draws.columns, (F.col("_at") - F.col("_first")).alias("place"))


def taken(mixture: Mixture) -> DataFrame:
    """Words the mix takes from each document, repeats counted."""
    drawn = mixture.draws.groupBy("row").agg(F.sum("words").alias("taken"))
    return mixture.rows.join(drawn, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents the mix draws, with all their columns: once for each pass in which the first word is drawn.

    A source's stream is in the order of (key, doc_id, size), so the last document of each pass, two rows for each
    source, tells for every document whether it is drawn, and the texts need not be joined or shuffled. Rows that agree
    in all three are drawn together.
    """
    place = F.struct("key", "doc_id", "size")
    last = [F.max(F.when(F.col("epoch") == k, place)).alias(f"_last{k}") for k in range(PASSES)]
    ends = mix(docs).draws.groupBy("source").agg(*last)
    keyed = docs.withColumns({"_key": _key(), "_size": _size()})
    joined = keyed.alias("d").join(F.broadcast(ends.alias("e")), F.expr("d.source <=> e.source"))
    own = F.struct(F.col("d._key").alias("key"), F.col("d.doc_id").alias("doc_id"), F.col("d._size").alias("size"))
    times = sum((F.coalesce(own <= F.col(f"e._last{k}"), F.lit(False)).cast("int") for k in range(PASSES)), F.lit(0))
    drawn = joined.filter("d._size > 0").select(*[F.col(f"d.{c}") for c in docs.columns], times.alias("_times")).filter("_times > 0")
    return drawn.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    mixture = mix(table(spark, sf_dir, "documents"))
    return taken(mixture).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || doc_id::varchar) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from s),
r as (select *, sum(w) over o as w_upto, sum(2 * source_size) over o as cap_upto, sum(source_size) over () as total, sum(w) over () as w_all
  from w window o as (order by 2.0 * source_size / w, source nulls last rows unbounded preceding)),
c as (select *, (1.5 * total - (cap_upto - 2 * source_size)) * w / (w_all - (w_upto - w)) > 2 * source_size as capped from r),
k as (select coalesce(sum(w) filter (capped), 0) as w_capped, coalesce(sum(2 * source_size) filter (capped), 0) as cap from c),
t as (select source, source_size, (case when capped then 2.0 * source_size else (1.5 * total - cap) * w / (w_all - w_capped) end)::double as target from c, k),
p as (select d.*, sum(size) over (partition by source order by k, doc_id, size rows unbounded preceding) - size as pos from d)
select doc_id, size, source_size, target,
  (greatest(0, least(pos + size, floor(target)) - pos) + greatest(0, least(pos + size + source_size, floor(target)) - pos - source_size))::bigint as taken
from p join t on p.source is not distinct from t.source
"""
