"""Merkle manifest of a data set, with a witness for every row that grows while rows are appended.

A row's leaf is the digest of its five fields. Leaves of a source, by doc_id, are appended one after the other to an open
tree (``OpenTree``) that holds one unfinished run of nodes for each level. A new node shares the run it stands in with its
siblings, so the run is its partial witness: each sibling that comes later extends it, and a full run becomes one node that
is appended one level up, which attaches the next part of the witness to everything below. So nothing is looked up twice,
and rows that come later change only open runs.

At scale the append is aligned: ``FAN ** depth`` consecutive leaves of a source are a block, and a full block always closes
to one node ``depth`` levels up whatever follows it. Blocks are built in separate tasks; their roots are appends to the
tree above, again in blocks, until each source has one node left; the sources' nodes are appended to a last tree. Going back
down, every block gets the witness of its root, one row, and adds it to those of its own nodes. No task holds more than
a block; the driver holds one row for each partition and the root.

Positions inside a source are counted in tasks over range partitions; a source of any size is many partitions.

Defined cases: null fields are ``-``; rows without doc_id come first in their source and are not tampered with; rows with one
doc_id stand in the order of their leaves, rows that repeat are leaves of their own; a null source is a source of its own,
before all others; a source of one row has its leaf as root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import partitions, pinned, table

FAN, DEPTH = 16, 3

_WITNESS = "array<struct<at: int, others: array<string>>>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Run:
    """Up to ``FAN`` sibling nodes; ``up`` is their node one level above, once it is there."""

    __slots__ = ("hashes", "up")

    def __init__(self):
        self.hashes, self.up = [], None

    def others(self, at: int) -> list[str]:
        return self.hashes[:at] + self.hashes[at + 1:]

    def beyond(self) -> list[tuple[int, list[str]]]:
        """The witness of the node above, which all nodes of the run share."""
        return self.up.witness() if self.up else []


class Node:
    """A digest with its place in a run. Its witness is as long as what has been appended so far allows."""

    __slots__ = ("hash", "run", "at")

    def __init__(self, digest_: str):
        self.hash, self.run, self.at = digest_, None, 0

    def witness(self) -> list[tuple[int, list[str]]]:
        """For each level upwards, the place in the run and the run's other nodes."""
        return [] if self.run is None else [(self.at, self.run.others(self.at)), *self.run.beyond()]


class OpenTree:
    """Nodes appended left to right; one open run for each level."""

    def __init__(self):
        self.open: list[Run] = []

    def append(self, node: Node, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append(Run())
        run = self.open[level]
        node.run, node.at = run, len(run.hashes)
        run.hashes.append(node.hash)
        if len(run.hashes) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run()
        run.up = Node(digest(run.hashes))
        self.append(run.up, level + 1)

    def seal(self, nodes: list[Node], depth: int | None = None) -> Node:
        """Close short runs from below: ``depth`` levels, or without it until one node remains. The remaining node."""
        level, left = 0, len(nodes)
        while left > 1 if depth is None else level < depth:
            if self.open[level].hashes:
                self._close(level)
            level, left = level + 1, -(-left // FAN)
        top = nodes[-1]
        for _ in range(level):
            top = top.run.up
        top.run = None
        return top


def grown(hashes: list[str], first: bool, depth: int = DEPTH) -> tuple[list[Node], Node]:
    """A block's nodes and its root. A short block that is not the ``first`` of its tree is closed to the same height as
    the full ones before it."""
    tree, nodes = OpenTree(), [Node(h) for h in hashes]
    for node in nodes:
        tree.append(node)
    return nodes, tree.seal(nodes, None if first else depth)


def folded(leaf: str, witness: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its witness give."""
    for at, others in witness:
        leaf = digest([*others[:at], leaf, *others[at:]])
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (grp, block), which stand together."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["grp"], row["block"]) != key:
                yield held
                held = []
            key = (row["grp"], row["block"])
            held.append(row)
    if held:
        yield held


def _emitted(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows a few thousand at a time, since a block may be one row."""
    while held := list(islice(rows, FAN ** DEPTH)):
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition(partitions(nodes.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "pos")


def _block_of(depth: int) -> Column:
    return F.floor(F.col("pos") / FAN ** depth).alias("block")


def _block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """(grp, pos, hash, label) of the next table: one node for each block of this one."""
    schema = "grp string, pos bigint, hash string"

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((block[0]["grp"], block[0]["block"], grown([r["hash"] for r in block], block[0]["block"] == 0, depth)[1].hash) for block in _blocks(batches))
        return _emitted(rows, pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("hash", pa.string())]))

    return _dealt(nodes.select("grp", _block_of(depth), "pos", "hash")).mapInArrow(roots, schema).withColumn("label", F.lit(None).cast("string"))


def _tower(nodes: DataFrame, name: str, depth: int) -> list[DataFrame]:
    """Tables of nodes from these upwards, each the block roots of the one before; in the last each group has one node."""
    levels = [nodes]
    while len(levels) == 1 or (levels[-1].agg(F.max("pos").alias("top")).first()["top"] or 0) > 0:
        levels.append(pinned(_block_roots(levels[-1], depth), f"{name}-{len(levels)}"))
    return levels


def _with_witnesses(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """(grp, pos, hash, label, subroot, witness) of nodes whose block roots have a row (grp, pos, subroot, witness) in ``outer``."""
    schema = f"grp string, pos bigint, hash string, label string, subroot string, witness {_WITNESS}"
    out = pa.schema([(c, pa.int64() if c == "pos" else pa.string()) for c in ("grp", "pos", "hash", "label", "subroot")]
                    + [("witness", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])))])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for above, *block in _blocks(batches):
            nodes_, _ = grown([r["hash"] for r in block], above["block"] == 0, depth)
            for r, node in zip(block, nodes_):
                own = [{"at": at, "others": others} for at, others in node.witness()]
                yield r["grp"], r["pos"], r["hash"], r["label"], above["subroot"], own + above["witness"]

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(rows_of(batches), out)

    rows = nodes.select("grp", _block_of(depth), "pos", "hash", "label", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_WITNESS).alias("witness"))
    return _dealt(rows.unionByName(_as_heads(outer, "hash string, label string"))).mapInArrow(extended, schema)


def _as_heads(outer: DataFrame, rest: str) -> DataFrame:
    """One row for each block, before its nodes, with the witness of its root."""
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in rest.split(", "))]
    return outer.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), *blank, "subroot", "witness")


def _field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _leaf(text: Column) -> Column:
    shown = F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(_field("doc_id"), _field("source"), _field("lang"), _field("n_chars"), shown), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """grp, doc_id, hash and, where ``tampered`` holds, the leaf of the row with its text in lower case."""
    return docs.select(F.col("source").alias("grp"), "doc_id", _leaf(F.col("text")).alias("hash"),
                       F.when(F.coalesce(tampered, F.lit(False)), _leaf(lowered(F.col("text")))).alias("altered"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, their place in ``grp`` by (doc_id, hash), from 0.

    Rows are range partitioned; each task counts inside the groups of its partition. Only a partition's first group can have
    begun before it, so one row for each partition tells what to add there.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", "doc_id", "hash")]
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",pos:bigint,part:int,head:boolean"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, key, at = TaskContext.get().partitionId(), True, None, -1
        for batch in batches:
            places, heads = [], []
            for grp in batch.column("grp").to_pylist():
                if at >= 0 and grp != key:
                    at, first = -1, False
                key, at = grp, at + 1
                places.append(at)
                heads.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array([part] * len(places), pa.int32()), pa.array(heads, pa.bool_())],
                                             names=[*batch.schema.names, "pos", "part", "head"])

    written = pinned(rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(counted, schema), "manifest-leaves")
    ends = written.groupBy("part").agg(
        F.max_by(F.col("grp"), F.struct(~F.col("head"), F.col("grp").isNotNull(), "grp")).alias("last"),
        F.max_by(F.col("pos") + 1, F.struct(~F.col("head"), F.col("grp").isNotNull(), "grp", "pos")).alias("n"),
        F.min_by(F.col("grp"), F.struct(~F.col("head"))).alias("first"), F.every("head").alias("one"))
    carry, before, group = [], 0, None
    for row in ends.orderBy("part").collect():
        before = before if row["first"] == group else 0
        carry.append((row["part"], before))
        before, group = row["n"] + (before if row["one"] else 0), row["last"]
    added = rows.sparkSession.createDataFrame(carry, "part int, before bigint")
    joined = written.join(F.broadcast(added), "part")
    return joined.withColumn("pos", F.col("pos") + F.when(F.col("head"), F.col("before")).otherwise(0)).select(*rows.columns, "pos")


def witnessed(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id and leaf of ``leaves`` with ``subroot``, ``root``, ``proof`` (the digest of all siblings on the way to the root),
    and ``back``, the root that the altered leaf, or else the leaf, gives with those siblings. Blocks have
    ``FAN ** depth`` rows."""
    nothing = F.lit(None).cast("string")
    base = pinned(placed(rows), "manifest-placed")
    sources = _tower(base.select("grp", "pos", "hash", nothing.alias("label")), "subtrees", depth)
    # The last table has the root of each source; those are the leaves of the tree above.
    subroots = placed(sources[-1].select(nothing.alias("grp"), F.col("grp").alias("doc_id"), "hash"))
    above = _tower(pinned(subroots.select("grp", "pos", "hash", F.col("doc_id").alias("label")), "subroots"), "top", depth)
    root = next((row["hash"] for row in above[-1].select("hash").collect()), None)
    outer = above[-1].select("grp", "pos", nothing.alias("subroot"), F.array().cast(_WITNESS).alias("witness"))
    for nodes in reversed(above[:-1]):
        outer = pinned(_with_witnesses(nodes, outer, depth), "top-witnesses")
    outer = outer.select(F.col("label").alias("grp"), F.lit(0).cast("bigint").alias("pos"), F.col("hash").alias("subroot"), "witness")
    for nodes in reversed(sources[1:-1]):
        outer = pinned(_with_witnesses(nodes, outer, depth), "witnesses").select("grp", "pos", "subroot", "witness")
    return _proofs(base, outer, depth).withColumn("root", F.lit(root).cast("string"))


def _proofs(base: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """The rows of ``base`` with what their witnesses give; ``outer`` has the witness of each block's root."""
    schema = "doc_id bigint, leaf string, subroot string, proof string, back string"

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for above, *block in _blocks(batches):
            outside = [(w["at"], w["others"]) for w in above["witness"]]
            nodes, _ = grown([r["hash"] for r in block], above["block"] == 0, depth)
            # For each run, its own node's digest, the witness of it, that witness as text, and the root it leads to.
            ways: dict[int, tuple[str, list, str, str]] = {}
            for r, node in zip(block, nodes):
                run, own = node.run, node.run.others(node.at) if node.run else []
                if id(run) not in ways:
                    beyond, up = [*(run.beyond() if run else []), *outside], run.up.hash if run else node.hash
                    ways[id(run)] = up, beyond, "".join(h for _, others in beyond for h in others), folded(up, beyond)
                up, beyond, text, end = ways[id(run)]
                back = folded(r["altered"] or r["hash"], [(node.at, own)] if run else [])
                # Leaves that give their run's node go one way from there.
                yield r["doc_id"], r["hash"], above["subroot"], digest([*own, text]), end if back == up else folded(back, beyond)

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(rows_of(batches), pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "proof", "back")]]))

    rows = base.select("grp", _block_of(depth), "pos", "doc_id", "hash", "altered", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_WITNESS).alias("witness"))
    return _dealt(rows.unionByName(_as_heads(outer, "doc_id bigint, hash string, altered string"))).mapInArrow(proved, schema)


def op11_incremental_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; documents whose doc_id has a checksum that 5 divides are checked
    against the manifest after their text was changed."""
    docs = table(spark, sf_dir, "documents")
    rows = witnessed(leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0))
    return rows.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("back").alias("folded_root"),
                       (F.col("back") == F.col("root")).alias("verified"))


def _sql(levels: int = 8) -> str:
    """The same rows in SQL, for sources of up to ``FAN ** levels`` rows; null and empty tables as above."""
    field = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{alphabet}', '{alphabet.lower()}')"
    parts = [f"""crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t)""",
             f"""leaves as (select row_number() over () as id, doc_id, source, sha256({head} || {field.format('text')}) as leaf,
  sha256({head} || {field.format(low)}) as low, coalesce(xor(4294967295, list_reduce(
   list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
   lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) % 5 = 0, false) as changed from documents, crc)""",
             """d0 as (select id, doc_id, leaf, dense_rank() over (order by source nulls first) as grp,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
  case when changed then low else leaf end as fold, '' as proof from leaves)""",
             "n0 as (select grp, pos, leaf as h from d0)"]

    def grow(n: str, d: str, k: int) -> None:
        parts.append(f"c{n}{k} as (select *, count(*) over (partition by grp) as of_all from {n}{k})")
        parts.append(f"""{n}{k + 1} as (select grp, pos // {FAN} as pos, case when max(of_all) = 1 then max(h) else sha256(string_agg(h, '' order by pos)) end as h
 from c{n}{k} group by grp, pos // {FAN})""")
        parts.append(f"""{d}{k + 1} as (select d.id, any_value(d.doc_id) as doc_id, any_value(d.leaf) as leaf, any_value(d.grp) as grp, any_value(d.pos) // {FAN} as pos,
  case when max(c.of_all) = 1 then any_value(d.fold) else sha256(string_agg(case when c.pos = d.pos then d.fold else c.h end, '' order by c.pos)) end as fold,
  any_value(d.proof) || coalesce(string_agg(c.h, '' order by c.pos) filter (c.pos <> d.pos), '') as proof{', any_value(d.subroot) as subroot' if d == 'e' else ''}
 from {d}{k} d join c{n}{k} c on d.grp = c.grp and d.pos // {FAN} = c.pos // {FAN} group by d.id)""")

    for k in range(levels):
        grow("n", "d", k)
    parts.append(f"m0 as (select 0 as grp, grp - 1 as pos, h from n{levels})")
    parts.append(f"e0 as (select d.id, d.doc_id, d.leaf, 0 as grp, d.grp - 1 as pos, d.fold, d.proof, n.h as subroot from d{levels} d join n{levels} n on d.grp = n.grp)")
    for k in range(levels):
        grow("m", "e", k)
    return "with " + ",\n".join(parts) + f"""
select e.doc_id, e.leaf, e.subroot, m.h as root, sha256(e.proof) as proof_sha256, e.fold as folded_root, e.fold = m.h as verified from e{levels} e, m{levels} m"""


OP11_SQL = _sql()
