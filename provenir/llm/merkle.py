"""Merkle manifest of a dataset: one tree of digests a group, one more over the groups' roots, and a proof for every row.

Every node is an event for its parent. A task keeps partial parents (digests by place among the children); a parent whose digests
have reached its arity, which follows from the group's size and its own place, becomes an event itself at once, so a run of
neighbouring leaves turns into its highest whole ancestors within the task. What stays partial at the end is the frontier: partial
parents are shuffled to wider and wider ranges of leaves and combined there until none is left. Each finished parent is kept with its
children: the reverse link by which proofs go down from the root, four levels a step, to tasks that hold one stretch of leaves each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import Scratch

ARITY = 8
#: Levels that a task of a proof step covers: it holds ARITY ** STEP leaves.
STEP = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_BITS = ARITY.bit_length() - 1
NODES = "key string, n long, level int, idx long, at array<int>, digests array<string>, digest string"
PATHS = "key string, idx long, path array<array<string>>, subroot string, root string"


def row_digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 over the fields, each '-' if null, else its UTF-8 byte count, a colon and its value."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def in_order(df: DataFrame, key: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``df`` with ``pos``, the place of a row (from 0) among the rows of its key by ``order``, and ``n``, their number.

    Rows are dealt to ranges of (key, order); rows equal in both are told apart by where they were read, so no run of equal rows is one task.
    """
    full = [F.col(key), *order, F.col("salt__")]
    dealt = df.withColumn("salt__", F.monotonically_increasing_id()).repartitionByRange(*full).sortWithinPartitions(*full).drop("salt__")
    dealt = scratch.table(dealt.withColumn("row__", F.monotonically_increasing_id()).withColumn("part__", F.shiftright("row__", 33)))
    heads = dealt.groupBy("part__", key).agg(F.min("row__").alias("head__"), F.count("*").alias("own__"))
    before = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("own__").over(before), F.lit(0)) - F.col("head__")
    heads = heads.select("part__", key, place.alias("shift__"), F.sum("own__").over(Window.partitionBy(key)).alias("n"))  # a row for each range and key
    return dealt.join(heads, ["part__", key]).select(*df.columns, (F.col("row__") + F.col("shift__")).alias("pos"), "n")


def _width(n: int, level: int) -> int:
    """How many nodes of a level a tree over n leaves has."""
    return -(-n // ARITY**level)


def _combine(arrow: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial parents in, finished parents (with ``digest``) and those still partial (without) out."""
    names = arrow.names[:-1]
    held: dict[tuple, dict[int, str]] = {}
    for b in batches:
        done = []
        for key, n, level, idx, at, digests in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            while True:
                children = held.setdefault((key, n, level, idx), {})
                children.update(zip(at, digests, strict=True))
                if len(children) < min(ARITY, _width(n, level - 1) - ARITY * idx):
                    break
                del held[key, n, level, idx]
                at = sorted(children)
                digests = [children[k] for k in at]
                digest = hashlib.sha256("".join(digests).encode()).hexdigest()
                done.append((key, n, level, idx, at, digests, digest))
                if _width(n, level) == 1:
                    break
                level, idx, at, digests = level + 1, idx // ARITY, [idx % ARITY], [digest]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow.types, strict=True)], schema=arrow)
    rest = [(*k, sorted(c), [c[x] for x in sorted(c)], None) for k, c in held.items()]
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest, strict=True), arrow.types, strict=True)], schema=arrow)


def grow(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The finished parents (NODES) of trees over ``leaves`` (key, n, pos, digest), and (key, n, digest) of each tree's top.

    A tree over one leaf has that leaf as its top and no parents.
    """
    place = F.col("pos")
    many = leaves.where("n > 1")
    frontier = many.select(
        "key", "n", F.lit(1).alias("level"), F.shiftright(place, _BITS).alias("idx"),
        F.array(F.pmod(place, F.lit(ARITY)).cast("int")).alias("at"), F.array("digest").alias("digests"),
    )
    links, reach = None, 0
    combine = partial(_combine, to_arrow_schema(StructType.fromDDL(NODES)))
    while True:
        out = scratch.table(frontier.mapInArrow(combine, StructType.fromDDL(NODES)))
        done = out.where("digest IS NOT NULL")
        links = done if links is None else links.union(done)
        left = out.where("digest IS NULL")
        if left.isEmpty():
            break
        # A wider range each time: all parts of a lowest partial parent meet, so each round finishes a level at least.
        reach += STEP * _BITS
        start = F.expr(f"shiftleft(idx, {_BITS} * level)")
        frontier = left.drop("digest").repartition("key", F.shiftright(start, min(reach, 60)))
    tops = links.where(F.expr(f"shiftleft(1L, {_BITS} * level) >= n")).select("key", "n", "digest")
    return links, tops.union(leaves.where("n = 1").select("key", "n", "digest"))


def _down(below: dict[tuple[int, int], list[str]], level: int, idx: int, levels: int, path: list) -> list:
    """The path of node idx of a level: for each level up to the step's top the run that it is in, its own place empty, then ``path``."""
    out = []
    for _ in range(levels):
        level, at, idx = level + 1, idx % ARITY, idx // ARITY
        run = below.get((level, idx))
        if run is None:  # the tree ends below
            break
        out.append([*run[:at], "", *run[at + 1 :]])
    return out + path


def _stage(paths: DataFrame, links: DataFrame, base: int) -> DataFrame:
    """PATHS of the nodes of level ``base``, from those of the nodes STEP levels above (or of the top, where the tree ends below)."""
    arrow = to_arrow_schema(StructType.fromDDL(PATHS))

    def run(table: pa.Table) -> pa.Table:
        below, top = _held(table)
        key, own = table.column("key")[0].as_py(), top
        nodes = [i * ARITY + k for (level, i), c in below.items() if level == base + 1 for k in range(len(c))] or [0]
        rows = [(key, i, _down(below, base, i, STEP, own[0]), own[1], own[2]) for i in nodes]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return _met(paths, links, base).groupBy("key", "g").applyInArrow(run, PATHS)


def _met(paths: DataFrame, links: DataFrame, base: int) -> DataFrame:
    """What the tasks of a step read: the links of its levels and the path of its top, by tree and top (``g``)."""
    inside = links.where(F.col("level").between(base + 1, base + STEP))
    up = F.expr(f"shiftright(idx, {_BITS} * ({base + STEP} - level))")
    return inside.select("key", up.alias("g"), "level", "idx", "digests").unionByName(
        paths.select("key", F.col("idx").alias("g"), "path", "subroot", "root"), allowMissingColumns=True
    )


def _held(table: pa.Table) -> tuple[dict, tuple]:
    cols = [table.column(c).to_pylist() for c in ("level", "idx", "digests", "path", "subroot", "root")]
    below, top = {}, ([], None, None)
    for level, idx, digests, path, subroot, root in zip(*cols, strict=True):
        if level is None:
            top = path, subroot, root
        else:
            below[level, idx] = digests
    return below, top


def _height(tops: DataFrame) -> int:
    n, h = tops.agg(F.max("n")).first()[0] or 1, 0  # one number
    while ARITY**h < n:
        h += 1
    return h


def fold(leaf: str, path: list[list[str]]) -> str:
    """The root that a leaf's digest leads to by its path: the runs of siblings from the lowest level up, the own place empty."""
    for run in path:
        leaf = hashlib.sha256("".join(x or leaf for x in run).encode()).hexdigest()
    return leaf


@dataclass
class Manifest:
    """Written trees of a dataset: ``leaves`` (the rows' own columns, key, pos, n, digest), ``links``, and ``tops``, PATHS of each group's root."""

    leaves: DataFrame
    links: DataFrame
    tops: DataFrame
    height: int

    def proofs(self, claimed: str = "digest", columns: tuple[str, ...] = ("doc_id",), whole: bool = False) -> DataFrame:
        """(columns, leaf, subroot, root, proof_sha256, folded_root, verified) for each leaf; with ``whole`` also its path.

        ``claimed`` names the column of ``leaves`` with the digest to verify, which the path of the leaf at that place folds to a root.
        """
        paths, base = self.tops, -(-max(self.height, 1) // STEP) * STEP - STEP
        while base > 0:
            paths, base = _stage(paths, self.links, base), base - STEP
        kinds = {f.name: f.dataType.simpleString() for f in self.leaves.schema.fields}
        ddl = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        ddl += ", path array<array<string>>" if whole else ""
        arrow = to_arrow_schema(StructType.fromDDL(ddl))

        def run(mine: pa.Table, other: pa.Table) -> pa.Table:
            below, (path, subroot, root) = _held(other)
            shas, folded, full = [], [], []
            for pos, claim in zip(mine.column("pos").to_pylist(), mine.column("claimed").to_pylist(), strict=True):
                p = _down(below, 0, pos, STEP, path)
                shas.append(hashlib.sha256("".join(x for run in p for x in run).encode()).hexdigest())
                folded.append(fold(claim, p))
                if whole:
                    full.append(p)
            n = mine.num_rows
            cols = [mine.column(c) for c in columns] + [mine.column("leaf"), [subroot] * n, [root] * n, shas, folded, [f == root for f in folded]]
            return pa.table([pa.chunked_array(c).cast(t) if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(cols + [full] * whole, arrow.types, strict=True)], schema=arrow)

        stretch = F.shiftright("pos", STEP * _BITS).alias("g")
        mine = self.leaves.select("key", stretch, "pos", F.col("digest").alias("leaf"), F.col(claimed).alias("claimed"), *columns)
        return mine.groupBy("key", "g").cogroup(_met(paths, self.links, 0).groupBy("key", "g")).applyInArrow(run, StructType.fromDDL(ddl))


def manifest(rows: DataFrame, scratch: Scratch, group: Column, order: list[Column]) -> Manifest:
    """The manifest of ``rows``, which have their digest in ``digest``; leaves ascend by ``order`` and then by digest in each group.

    ``group`` is text; groups are ordered bytewise, null first. Rows equal in order and digest are leaves each, in any order. An empty table
    gives a manifest without leaves.
    """
    key = F.coalesce(F.concat(F.lit("."), group), F.lit(""))
    leaves = in_order(rows.withColumn("key", key), "key", [*order, F.col("digest")], scratch)
    links, tops = grow(leaves.select("key", "n", "pos", "digest"), scratch)
    tops = scratch.table(tops)
    upper = in_order(tops.select(F.lit("").alias("key"), F.col("key").alias("tree"), "digest"), "key", [F.col("tree")], scratch)
    upper_links, root = grow(upper.select("key", "n", "pos", "digest"), scratch)
    paths = root.select("key", F.lit(0).cast("long").alias("idx"), F.array().cast("array<array<string>>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    base = -(-max(_height(root), 1) // STEP) * STEP - STEP
    while base >= 0:
        paths, base = _stage(paths, upper_links, base), base - STEP
    own = upper.join(paths.select(F.col("idx").alias("pos"), "path", "root"), "pos")
    own = own.select(F.col("tree").alias("key"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root")
    return Manifest(leaves, links, scratch.table(own), _height(tops))


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``digest`` of each row and ``claimed``, that of the row as it would be with its text in lower case (A-Z only)
    where 3 divides the unsigned crc32 of the decimal doc_id; a null doc_id counts as the empty text, whose crc32 is 0."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 0
    fields = [F.col(c) for c in FIELDS]
    return docs.select("doc_id", "lang", row_digest(fields).alias("digest"), F.when(chosen, row_digest([*fields[:-1], low])).alias("changed")).select(
        "doc_id", "lang", "digest", F.coalesce("changed", "digest").alias("claimed")
    )


def verified_manifest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs`` (doc_id, source, lang, n_chars, text).

    One tree a lang, null one of its own; leaves ascend by doc_id, null first, then by digest; proofs are tried on rows of which some are
    tampered with. An empty table gives no rows; other columns are ignored.
    """
    rows = scratch.table(tampered(docs))  # ranges are drawn from digests: the texts are read once
    m = manifest(rows, scratch, F.col("lang"), [F.col("doc_id").asc_nulls_first()])
    return m.proofs("claimed")
