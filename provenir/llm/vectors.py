"""Near-duplicate vectors by inverted lists and product quantisation.

The coarse quantiser has a codebook for each half of a vector; a list is a pair of codewords, so lists grow with the corpus (one
for about PER_LIST vectors of the largest label, up to MAX_WORDS squared) while the codebooks stay small. The residual from the list's
centroid is coded in SUBSPACES bytes. WIDTH lists that follow one another are a block.

Probes: a vector's halves have distances to the bisecting hyperplanes of own and other codewords; a partner lies in another list only if it is
off by that much across the hyperplane, so a block is searched if the two distances, squared and added, are within a radius. A partner is
off by the threshold's radius in all, and across one hyperplane by a share of it: the standard deviation of that share is at most that of the residuals in their
widest direction. The radius is DEVIATIONS of it, never more than the threshold's (where the search is exact whatever the directions). If
partners lie as the residuals do, the chance of missing one is below exp(-DEVIATIONS ** 2 / 2), some 4 in a million.

First round: a block's members come as codes only, in chunks of GROUP, and meet the vectors that search the block, VISITORS at a time, each
rounded to a byte a component; of two blocks only the lower one's vectors search the other's. Distances are asymmetric: a visitor has a table of its products
with all codewords, a member's distance is the sum of the entries that its codes name. What lies within the threshold plus both
roundings' errors is a candidate, so coding loses nothing. Second round: the vectors of candidates are fetched for just
these meetings and compared by cosine in double precision. Each linked pair is found once and counts
for both ends; a meeting returns counts and the smallest linked vector of each, never its pairs. Codebooks are
fitted on at most about BOUND vectors; every vector is indexed. Equal vectors are one entry with a multiplicity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components

BOUND, PER_LIST, MAX_WORDS, WIDTH = 20_000, 256, 2048, 64
SUBSPACES, CODES, SLICE, GROUP, VISITORS = 16, 256, 128, 16_384, 16_384
SALTS, DEVIATIONS = 64, 5.0


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    g = np.random.Generator(np.random.PCG64(6))
    c = x[g.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def _in_line(c: np.ndarray) -> np.ndarray:
    """Codewords in the order of their main direction, so that neighbours in number are near."""
    rest = c - c.mean(0)
    return c[np.argsort(rest @ np.linalg.svd(rest, full_matrices=False)[2][0], kind="stable")] if c.size else c


class Index:
    """Two coarse codebooks and CODES codewords for each subspace: bounded, whatever the corpus."""

    def __init__(self, sample: np.ndarray, most: int):
        dim = sample.shape[1]
        words = int(np.clip(np.ceil(np.sqrt(most / PER_LIST)), 1, MAX_WORDS))
        self.halves = np.array_split(np.arange(dim), 2)
        self.coarse = [_in_line(_kmeans(sample[:, h], words)) for h in self.halves]
        self.wide = -(-len(self.coarse[1]) // WIDTH)
        self.blocks = len(self.coarse[0]) * self.wide
        self.parts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        rest = sample - self._centroid(self._own(sample))
        self.books = [_kmeans(rest[:, p], CODES) for p in self.parts]
        spread = np.linalg.eigvalsh(rest.T @ rest)
        self.share = float(np.sqrt(spread[-1] / spread.sum())) if spread.sum() > 1e-9 else 1.0

    def _own(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(x[:, h], c) for h, c in zip(self.halves, self.coarse, strict=True)], 1)

    def _centroid(self, own: np.ndarray) -> np.ndarray:
        return np.concatenate([c[own[:, k]] for k, c in enumerate(self.coarse)], 1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List (two codewords), codes, quantisation error and squared length of the coded vector, for unit vectors."""
        own = self._own(x)
        rest = x - self._centroid(own)
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        coded = self._centroid(own)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            coded[:, p] += b[codes[:, k]]
        return own, codes, np.linalg.norm(x - coded, axis=1), (coded * coded).sum(1)

    def products(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(members, visitors): inner products of coded members and visitors, added up from the visitors' tables by code."""
        x = x.astype(np.float32)
        out = np.zeros((len(own), len(x)), np.float32)
        for k, (h, c) in enumerate(zip(self.halves, self.coarse, strict=True)):
            words, at = np.unique(own[:, k], return_inverse=True)
            out += (c[words].astype(np.float32) @ x[:, h].T)[at]
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (b.astype(np.float32) @ x[:, p].T)[codes[:, k]]
        return out

    def block(self, own: np.ndarray) -> np.ndarray:
        return own[:, 0] * self.wide + own[:, 1] // WIDTH

    def _gaps(self, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Squared distance of a half to the half-space beyond each bisecting hyperplane; 0 for its own codeword."""
        c = self.coarse[k]
        sq = (c * c).sum(1)
        d = sq - 2 * x[:, self.halves[k]] @ c.T
        apart = np.sqrt(np.maximum(sq[own[:, k]][:, None] + sq - 2 * c[own[:, k]] @ c.T, 0))
        return (np.maximum(d - d[np.arange(len(x)), own[:, k]][:, None] - 1e-9, 0) / (2 * apart + 1e-6)) ** 2

    def reach(self, x: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """(vectors, blocks): whether a block is searched for vectors within ``radius``."""
        radius *= min(1.0, DEVIATIONS * self.share)
        first, second = self._gaps(x, own, 0), self._gaps(x, own, 1)
        second = np.stack([second[:, k : k + WIDTH].min(1) for k in range(0, second.shape[1], WIDTH)], 1)
        return (first[:, :, None] + second[:, None, :] <= radius**2 + 1e-6).reshape(len(x), -1)


def _unit(v: pd.Series) -> np.ndarray:
    """Unit vectors; the largest component is made 1 first, so that no square under- or overflows."""
    x = np.stack(v.to_list())
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sound(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def near_vectors(vectors: DataFrame, scratch, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label); others are ignored.

    Vectors meet only in equal, non-null labels (of any type) and lengths. Vectors that are null, empty or zero, or hold null or
    non-finite components, have no links and are kept. Rows that repeat a vec_id with one label and vector are one and count once. A vec_id
    with several vectors or labels stands for as many vectors: each row has its own vector's links and component, named by the smallest
    vec_id in it. A null vec_id links with nothing. Lengths with at most CODES vectors in all need no codes. An empty table gives none.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    x = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    x = x.withColumn("ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _sound(F.col("v")))
    kind = x.schema["label"].dataType.simpleString()
    # Equal vectors of a label: one entry. Salted parts first, as one vector may be a third of all rows.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")
    rows = scratch.table(x.where("ok").select("vec_id", "label", "v", salt.alias("salt"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), F.col("v")).alias("h2")))
    parts = scratch.table(rows.groupBy("label", "h1", "h2", "salt").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("n")))
    heads = scratch.table(parts.groupBy("label", "h1", "h2").agg(F.min("least").alias("id"), F.sum("n").alias("n")))
    entries = scratch.table(rows.select(F.col("vec_id").alias("id"), "label", "h1", "h2", "v").join(heads, ["id", "label", "h1", "h2"]).dropDuplicates(["id", "label", "h1", "h2"]))

    # A length with more vectors than codewords gets an index; the others are compared as they are.
    per = entries.groupBy(F.size("v").alias("d"), "label").count().groupBy("d").agg(F.max("count").alias("most"), F.sum("count").alias("n"))
    sized = {r["d"]: r for r in per.where(F.col("n") > CODES).collect()}
    share = min(1.0, BOUND / max(sum(r["n"] for r in sized.values()), 1))
    chosen = F.size("v").isin(list(sized)) & (F.pmod(F.xxhash64("id", "h1"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = entries.where(chosen).select("id", "h1", "v").orderBy("id", "h1").toPandas() if sized else pd.DataFrame({"v": []})
    indexes = {}
    for d, r in sized.items():
        s = sample.v[sample.v.map(len) == d]
        indexes[d] = Index(_unit(s) if len(s) else np.ones((1, d)), r["most"])

    def deal(batches):
        for pdf in batches:
            for d, g in pdf.groupby(pdf.v.map(len)):
                step = 256 if d not in indexes else min(256, 4_000_000 // indexes[d].blocks + 1)
                for k in range(0, len(g), step):
                    yield one(g.iloc[k : k + step].reset_index(drop=True), d)

    def one(g: pd.DataFrame, d: int) -> pd.DataFrame:
        u = _unit(g.v)
        out = g[["id", "label", "h1", "h2", "n"]].assign(d=d, block=0, i=0, j=0, codes=b"", err=0.0, length=0.0, reach=[[]] * len(g), u=[x.tobytes() for x in u])
        step = np.abs(u).max(1) / 127
        near = np.rint(u / step[:, None])
        out = out.assign(bytes=[x.tobytes() for x in near.astype(np.int8)], step=step, off=np.linalg.norm(u - near * step[:, None], axis=1))
        if index := indexes.get(d):
            own, codes, err, length = index.encode(u)
            block = index.block(own)
            far = index.reach(u, own, radius) & (np.arange(index.blocks) > block[:, None])
            out = out.assign(block=block, i=own[:, 0], j=own[:, 1], codes=[c.tobytes() for c in codes], err=err, length=length, reach=[np.flatnonzero(f) for f in far])
        return out

    node = ["id", "h1", "h2"]
    fields = f"id long, label {kind}, h1 long, h2 long, n long, d int, block int, i int, j int, codes binary, err double, length double, reach array<int>, u binary, bytes binary, step double, off double"
    coded = scratch.table(entries.select("id", "label", "h1", "h2", "n", "v").mapInPandas(deal, fields))
    at = ["label", "d", "block"]
    visits = coded.withColumn("to", F.explode(F.concat(F.array("block"), "reach")))
    of = visits.groupBy("label", "d", F.col("to").alias("block")).agg(F.count("*").alias("visitors"))
    size = coded.groupBy(*at).agg(F.count("*").alias("members"))
    # A block that no other vector searches is still searched by its own.
    met = scratch.table(size.join(of, at).select(*at, F.ceil(F.col("members") / GROUP).cast("int").alias("chunks"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("turns")))
    deal_to = lambda n, seed: F.pmod(F.xxhash64(*node, F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = coded.join(met, at).withColumn("chunk", deal_to("chunks", 1)).withColumn("turn", every("turns"))
    shown = shown.select(*at, "chunk", "turn", F.lit(True).alias("held"), F.lit(True).alias("own"), *node, "i", "j", F.col("codes").alias("packed"), "err", F.col("length").alias("measure"))
    asking = visits.select("label", "d", F.col("to").alias("block"), (F.col("to") == F.col("block")).alias("own"), *node, "bytes", "step", "off").join(met, at)
    asking = asking.withColumn("turn", deal_to("turns", 2)).withColumn("chunk", every("chunks"))
    asking = asking.select(*at, "chunk", "turn", F.lit(False).alias("held"), "own", *node, F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("bytes").alias("packed"), F.col("off").alias("err"), F.col("step").alias("measure"))
    meeting = [*at, "chunk", "turn"]
    back = [*meeting, "held", "own", *node]

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = (pdf[pdf.held == h].sort_values(node, ignore_index=True) for h in (False, True))
        if not len(q) or not len(m):
            return pdf[back].iloc[:0]
        index = indexes.get(int(pdf.d.iloc[0]))
        if index is None:
            return pdf[back].iloc[: len(pdf) if len(pdf) > 2 else 0]
        rq, rm = _numbers(q, m)
        of_q, of_m = np.zeros(len(q), bool), np.zeros(len(m), bool)
        rows = lambda t, kind: np.frombuffer(b"".join(t.packed), kind).reshape(len(t), -1)
        own, codes, far = m[["i", "j"]].to_numpy(int), rows(m, np.uint8), radius + m.err.to_numpy() + 1e-4
        for s in range(0, len(q), SLICE):
            t = q.iloc[s : s + SLICE]
            v = rows(t, np.int8) * t.measure.to_numpy()[:, None]
            apart = m.measure.to_numpy()[:, None] + (v * v).sum(1) - 2 * index.products(v, own, codes)
            near = apart <= (far[:, None] + t.err.to_numpy()) ** 2
            near &= ~t.own.to_numpy(bool) | (rq[s : s + SLICE] < rm[:, None])  # in one block each pair once
            of_q[s : s + SLICE], of_m = near.any(0), of_m | near.any(1)
        return pd.concat([q[of_q], m[of_m]])[back]

    near = scratch.table(shown.union(asking).groupBy(*meeting).applyInPandas(candidates, f"label {kind}, d int, block int, chunk int, turn int, held boolean, own boolean, id long, h1 long, h2 long"))

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = (pdf[pdf.held == h].sort_values(node, ignore_index=True) for h in (False, True))
        out = [pd.DataFrame({c: [] for c in ("id", "h1", "h2", "links", "rid", "r1", "r2")}).astype("int64")]
        if not len(q) or not len(m):
            return out[0].assign(label=pdf.label.iloc[:0])[found_at]
        y = np.frombuffer(b"".join(m.u), np.float64).reshape(len(m), -1)
        nq, nm = _numbers(q, m)
        names = pd.concat([q[node], m[node]]).iloc[np.unique(np.append(nq, nm), return_index=True)[1]]
        qn, mn = q.n.to_numpy(), m.n.to_numpy()
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for s in range(0, len(q), SLICE):
            t = q.iloc[s : s + SLICE]
            ok = np.frombuffer(b"".join(t.u), np.float64).reshape(len(t), -1) @ y.T >= cosine
            ok &= ~t.own.to_numpy(bool)[:, None] | (nq[s : s + SLICE, None] < nm)
            a, b = np.nonzero(ok)
            np.add.at(links, nq[s + a], mn[b])
            np.add.at(links, nm[b], qn[s + a])
            a, b = nq[s + a], nm[b]
            while True:
                old = root.copy()
                least = np.minimum(root[a], root[b])
                np.minimum.at(root, a, least)
                np.minimum.at(root, b, least)
                if (old == root).all():
                    break
        k = np.flatnonzero(links)
        r = names.iloc[root[k]]
        out = names.iloc[k].assign(links=links[k], rid=r.id.to_numpy(), r1=r.h1.to_numpy(), r2=r.h2.to_numpy())
        return out.assign(label=pdf.label.iloc[0])[found_at]

    found_at = ["label", "id", "h1", "h2", "links", "rid", "r1", "r2"]
    full = near.join(coded.select("label", *node, "n", "u"), ["label", *node])
    found = scratch.table(full.groupBy(*meeting).applyInPandas(linked, f"label {kind}, id long, h1 long, h2 long, links long, rid long, r1 long, r2 long"))
    # A vector's name in the walk over links: its id first, so that the least name has the smallest id.
    name = lambda i, a, b: F.struct(F.col(i).alias("id"), "label", F.col(a).alias("h1"), F.col(b).alias("h2"))
    edges = found.select(name("id", "h1", "h2").alias("a"), name("rid", "r1", "r2").alias("b")).where("a <> b").distinct()
    label = connected_components(edges, scratch).select("id.*", F.col("label.id").alias("component"))
    links = found.groupBy("label", *node).agg(F.sum("links").alias("links"))
    ends = (
        heads.join(links, ["label", *node], "left")
        .join(label, ["label", *node], "left")
        .select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    by = parts.select("label", "h1", "h2", "salt").join(ends, ["label", "h1", "h2"])
    out = rows.select("vec_id", "label", "h1", "h2", "salt").join(by, ["label", "h1", "h2", "salt"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = x.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _numbers(q: pd.DataFrame, m: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the vectors of both in the order of their names; one name has one number."""
    n = pd.concat([q, m]).groupby(["id", "h1", "h2"]).ngroup().to_numpy()
    return n[: len(q)], n[len(q) :]
