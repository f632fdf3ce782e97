"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles, as 64-bit fingerprints. Each of M registers holds the floor of the base-b
logarithm of the smallest of exponential values, one for each element: registers of a union are maxima of registers, so
sketches merge, and registers of two sets are equal about as often as their Jaccard similarity says. Bands of four registers
propose pairs, the likelihood of (greater, less, equal) registers estimates their similarity jointly with the known
sizes, and full sets of both whole texts confirm.

A set's name is the smallest doc_id that has it with half of its digest: of one doc_id with several texts each set keeps its own name,
and links join them.

Groups are never expanded into all pairs. Equal sets become one representative first. In a bucket of a band each member is
compared with the bucket's smallest and largest id. Buckets whose members then still belong to several components
are compared in full, in blocks of CHUNK x CHUNK documents, and only linked pairs across components
leave a block. Thus every pair that shares a band is compared or already connected. A pair of similarity 0.8 shares none of
32 bands with probability 5e-8; one is lost by the estimate at five standard deviations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import Scratch
from .common import map_batches

REGISTERS, ROWS = 128, 4
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
CHUNK = 256
SALTS = 64
MARGIN = 5.0

_MASK = (1 << 64) - 1


def _draws(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Each register draws from a fingerprint's upper half by its own odd multiplier; 32-bit products run in vector instructions.
MULTIPLY, ADD = ((_draws(seed, REGISTERS) & np.uint64(_MASK >> 32)).astype(np.uint32) for seed in (11, 12))
BANDS = _draws(13, REGISTERS // ROWS)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, known: dict) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of ``size`` words; A-Z count as a-z."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    k = min(size, len(h))
    n = len(h) - k + 1
    s = np.full(n, 0x9E3779B97F4A7C15 * k & _MASK, np.uint64)
    for i in range(k):
        s = (s ^ h[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of fingerprints; an empty set has zeros."""
    if not len(s):
        return np.zeros(REGISTERS, np.uint16)
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, _MASK >> 32, np.uint32)
    for k in range(0, len(x), 2048):
        v = MULTIPLY[:, None] * x[None, k : k + 2048]
        v += ADD[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def _slope(j: np.ndarray, more, less, same, u, v) -> np.ndarray:
    """Derivative of the log-likelihood of the counts of greater, less and equal registers by the similarity; it falls."""
    c, ln = (BASE - 1) / BASE, np.log(BASE)
    xa, xb = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    pa_, pb_ = -np.log1p(-xa * c) / ln, -np.log1p(-xb * c) / ln
    da, db = -v * c / (1 - xa * c) / ln, -u * c / (1 - xb * c) / ln
    return more * da / pa_ + less * db / pb_ - same * (da + db) / np.maximum(1 - pa_ - pb_, 1e-12)


def _counts(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple:
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    return more, less, a.shape[-1] - more - less, na / (na + nb), nb / (na + nb)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, given the sets' sizes."""
    seen = _counts(a, b, na, nb)
    lo, hi = np.zeros(np.shape(seen[3])), np.minimum(seen[3] / seen[4], seen[4] / seen[3])
    for _ in range(24):
        j = (lo + hi) / 2
        up = _slope(j, *seen) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, regs): set size, 128-bit digest of the set, registers as bytes."""

    def make():
        known = _Words()

        def fn(b: dict) -> dict:
            out: dict = {"doc_id": b["doc_id"], "n_shingles": [], "h1": [], "h2": [], "regs": []}
            for t in b["text"]:
                s = shingle_set(t, size, known)
                h1, h2 = _digest(s)
                out["n_shingles"].append(len(s))
                out["h1"].append(h1)
                out["h2"].append(h2)
                out["regs"].append(registers(s).tobytes() if len(s) else None)
            return out

        return fn

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, h1 long, h2 long, regs binary")


def _keys(bands: np.ndarray) -> np.ndarray:
    """Bucket keys of rows of bands: four registers of 16 bits are one number of 64."""
    key = (bands * np.uint64(0x9E3779B97F4A7C15)) ^ BANDS
    return ((key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


NAME = "struct<id:bigint,h1:bigint>"


def _name(i: str = "doc_id") -> Column:
    return F.struct(F.col(i).alias("id"), F.col("h1"))


def _band_rows(sk: DataFrame) -> DataFrame:
    """(key, name): a row for each band of each sketch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                names = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), regs.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(_keys(regs).ravel()), names], ["key", "name"])

    return sk.select("name", "regs").mapInArrow(run, f"key long, name {NAME}")


def _likely(percent: int, a, b, na, nb) -> np.ndarray:
    """Pairs that sizes allow and whose estimate is within MARGIN standard deviations of the threshold.

    The likelihood has one maximum, so the estimate is above a value where the likelihood still rises there.
    """
    t = percent / 100
    na, nb = np.asarray(na, float), np.asarray(nb, float)
    least = t - MARGIN * np.sqrt(t * (1 - t) / REGISTERS)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (_slope(least, *_counts(a, b, na, nb)) >= 0)


def _estimated(pairs: DataFrame, sk: DataFrame, percent: int) -> DataFrame:
    one = lambda c, x: sk.select(F.col("name").alias(c), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in (2, 3))
                keep = _likely(percent, ra, rb, b.column(4).to_numpy(), b.column(5).to_numpy())
                yield b.select([0, 1]).filter(pa.array(keep))

    return pairs.join(one("b", "b"), "b").join(one("a", "a"), "a").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, f"a {NAME}, b {NAME}")


def _sets(docs: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """(name, s, half): full shingle sets of ``names`` (name, rows), and the distinct upper halves, as sorted bytes."""

    def make():
        known = _Words()

        def fn(b: dict) -> dict:
            sets = [shingle_set(t, size, known) for t in b["text"]]
            halves = [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
            half = [h[np.append(True, h[1:] != h[:-1])[: len(h)]].tobytes() for h in halves]
            return {"name": [{"id": i, "h1": _digest(s)[0]} for i, s in zip(b["doc_id"], sets, strict=True)], "s": [s.tobytes() for s in sets], "half": half}

        return fn

    def of(some: DataFrame) -> DataFrame:
        texts = docs.select("doc_id", "text").join(some.select(F.col("name.id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
        return map_batches(texts, make, f"name {NAME}, s binary, half binary").join(some.select("name"), "name", "left_semi").select("name", "s", "half")

    again = names.where("rows > 1")  # rows that repeat a doc_id with one set
    if again.isEmpty():
        return of(names)
    return of(names.where("rows = 1")).union(of(again).dropDuplicates(["name"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    rows = (
        pairs.join(sets.select(F.col("name").alias("b"), F.col("s").alias("sb")), "b")
        .join(sets.select(F.col("name").alias("a"), F.col("s").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
    )

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, f"a {NAME}, b {NAME}")


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """Linked pairs across components inside buckets, from rows (key, name, label, n_shingles, of, regs, half) dealt to pairs of chunks.

    A pair is looked at in the bucket of the first band that it shares. Its sets are compared by the upper halves of their elements. A
    set of n elements with h distinct halves hides at most n - h of them, which bounds the intersection from above; pairs that
    may then meet the threshold leave for the comparison in full.
    """
    k = F.greatest(F.ceil(F.col("of") / CHUNK).cast("int"), F.lit(1))
    m = members.withColumn("k", k).withColumn("c", F.pmod(F.xxhash64("name"), F.col("k")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.select("key", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "name", "label", "n_shingles", "regs", "half")
    kind = pa.struct([("id", pa.int64()), ("h1", pa.int64())])
    none = pa.table({"a": pa.array([], kind), "b": pa.array([], kind)})

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        one = lambda c, f: pc.struct_field(t[c], f).to_numpy()
        if (one("label", "id") == one("label", "id")[0]).all() and (one("label", "h1") == one("label", "h1")[0]).all():
            return none
        t = t.take(pa.array(np.lexsort((one("name", "h1"), one("name", "id"))))).combine_chunks()
        _, lab = np.unique(np.stack([one("label", "id"), one("label", "h1")], 1), axis=0, return_inverse=True)
        lab, n = lab.ravel(), t["n_shingles"].to_numpy()
        regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(len(t), -1)
        bands = regs.view(np.uint64)
        mine = np.argmax(_keys(bands) == np.int64(t["key"][0].as_py()), axis=1)  # the bucket's band
        half, sets = t["half"], {}

        def load(j: int) -> np.ndarray:
            if j not in sets:
                sets[j] = np.frombuffer(half[j].as_buffer(), np.uint32)
            return sets[j]

        a, b = [], []
        for i in range(len(t) - 1):
            far = np.flatnonzero(lab[i + 1 :] != lab[i]) + i + 1
            if len(far):
                far = far[np.argmax(bands[far] == bands[i], axis=1) == mine[i]]
            if len(far):
                far = far[_likely(percent, regs[i][None, :], regs[far], np.full(len(far), n[i]), n[far])]
            if len(far):
                own, others = load(i), [load(int(j)) for j in far]
                size = np.array([len(x) for x in others])
                flat = np.concatenate(others)
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size) - size)
                most = both + np.minimum(n[i] - len(own), n[far] - size)
                ok = far[100 * most >= percent * (n[i] + n[far] - most)]
                a.append(np.full(len(ok), i))
                b.append(ok)
        return pa.table({c: t["name"].take(pa.array(np.concatenate(x))) for c, x in (("a", a), ("b", b))}) if a else none

    return m.groupBy("key", "c1", "c2").applyInArrow(block, f"a {NAME}, b {NAME}").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * |A n B| >= percent * |A u B| for their sets of ``size``-word shingles; with fewer
    words, the whole sequence is the one shingle. Null or empty texts and texts without words have an empty set, link with
    nothing and are kept. Rows that repeat a doc_id are one document, also with different texts: whatever any of them is
    linked with is in the component of all that have words. A null doc_id has a null component and is kept. Empty input gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    sk = scratch.table(sketches(docs, size))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    full = sk.where("n_shingles > 0 and doc_id is not null")
    # Equal sets: the smallest id of each digest, by way of salted parts so that no task holds a whole group.
    parts = scratch.table(full.groupBy("h1", "h2", salt).agg(F.min("doc_id").alias("least")))
    reps = scratch.table(parts.groupBy("h1", "h2").agg(F.min("least").alias("doc_id")))
    firsts = full.join(reps, ["doc_id", "h1", "h2"]).groupBy(_name().alias("name"))
    firsts = scratch.table(firsts.agg(F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.count("*").alias("rows")))

    rows = _band_rows(firsts)
    buckets = scratch.table(rows.groupBy("key").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count("*").alias("of")).where("lo <> hi"))
    members = scratch.table(rows.join(buckets, "key"))
    star = members.select(F.col("lo").alias("a"), F.col("name").alias("b")).union(members.select("name", "hi")).where("a <> b").distinct()
    tried = scratch.table(_estimated(star, firsts, percent))
    sets = scratch.table(_sets(docs, firsts.select("name", "rows").join(members.select("name"), "name", "left_semi"), size))
    edges = scratch.table(_confirmed(tried, sets, percent).union(_one_document(full, reps, scratch)))
    label = connected_components(edges, scratch)

    # Buckets that still hold several components.
    named = members.join(label.select(F.col("id").alias("name"), "label"), "name", "left").select("key", "name", F.coalesce("label", "name").alias("label"))
    split = scratch.table(named.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("of")).where("l1 <> l2"))
    if not split.isEmpty():
        rest = named.join(split.select("key", "of"), "key").join(firsts.select("name", "n_shingles", "regs"), "name")
        rest = rest.join(sets.select("name", "half"), "name")
        more = scratch.table(_blocks(rest, percent))
        if not more.isEmpty():
            label = connected_components(edges.union(scratch.table(_confirmed(more, sets, percent))), scratch)

    label = label.select(F.col("id").alias("name"), F.col("label.id").alias("component"))
    ends = reps.withColumn("name", _name()).join(label, "name", "left").select("h1", "h2", F.coalesce("component", "doc_id").alias("component"))
    ends = parts.select("h1", "h2", "salt").join(ends, ["h1", "h2"])
    out = sk.select("doc_id", "n_shingles", "h1", "h2", salt)
    out = out.where("n_shingles > 0").join(ends, ["h1", "h2", "salt"], "left").select("doc_id", "n_shingles", "component").union(
        out.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _one_document(full: DataFrame, reps: DataFrame, scratch) -> DataFrame:
    """Links (a, b) between the sets of each doc_id that has several."""
    several = scratch.table(full.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id"))
    sets = full.join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct().join(reps.withColumnRenamed("doc_id", "rep"), ["h1", "h2"])
    sets = scratch.table(sets.select("doc_id", _name("rep").alias("name")))
    return sets.join(sets.groupBy("doc_id").agg(F.min("name").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("name").alias("b")).where("a <> b")
