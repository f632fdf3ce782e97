"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Rates are per coordinate and the L1 term zeroes most weights. Shards of the training rows are learned side by side as Spark
tasks; after each round of PASSES passes the changes of their states are averaged and the next round starts from the average (iterative parameter mixing). What
is left, some hundred non-zero weights, goes to every task. The model is fitted on at most about BOUND labelled rows, chosen by a
hash of doc_id, and on COORDINATES coordinates a shard, in the order of another hash; scores cover every row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, filter_batches, fold, label_rows, map_batches

BOUND = 24_000
BITS, SHARDS, ROUNDS, PASSES = 20, 4, 3, 2
COORDINATES = 32_000_000
ALPHA, BETA, L1, L2 = 8.0, 1.0, 4.0, 0.0
THRESHOLD = 0.3

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def coordinates(text: str | None) -> np.ndarray:
    """Hashed unigrams, bigrams and skip-grams (one word between) of a whole text; A-Z as a-z, other ASCII splits words."""
    ws = text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []
    h = np.fromiter(map(zlib.crc32, ws), np.uint32, len(ws))
    a = h * np.uint32(0x9E3779B1)
    parts = [a, (a[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + h[1:] * np.uint32(0xC2B2AE35), (a[:-2] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + h[2:] * np.uint32(0x2545F491)]
    x = np.concatenate(parts)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def weights(z: np.ndarray, n: np.ndarray, l1) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, seed: int) -> None:
    """One pass of FTRL over (coordinates, label) rows, in an order of its own; changes the state. The last coordinate is the bias."""
    for k in np.random.Generator(np.random.PCG64(seed)).permutation(len(rows)):
        i, y = rows[k]
        l1 = np.append(np.full(len(i) - 1, L1), 0.0)
        w = weights(z[i], n[i], l1)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
        z[i] += g - s * w
        n[i] += g * g


def _shards(batches, bound: int = COORDINATES) -> dict[int, list[tuple[np.ndarray, int]]]:
    """Rows by shard, in their order, up to the bound of coordinates a shard."""
    rows: dict[int, list] = {}
    held: dict[int, int] = {}
    for b in batches:
        for shard, x, y in zip(*(b.column(c) for c in ("shard", "x", "y")), strict=True):
            k, i = shard.as_py(), np.frombuffer(x.as_buffer(), np.uint32)
            if held.get(k, 0) < bound:
                held[k] = held.get(k, 0) + len(i)
                rows.setdefault(k, []).append((np.append(i, np.uint32(1 << BITS)), y.as_py()))
    return rows


def _squeezed(x: np.ndarray) -> bytes:
    """Bytes of one significance side by side, compressed."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _plain(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights by coordinate, the bias last; None without labels. Rows whose crc32(doc_id) mod 4 is 2 teach nothing."""
    chosen = bounded(label_rows(labels, "toxic", F.max).where(fold("doc_id", 4) != 2), BOUND, 2)
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # BOUND rows of 12 bytes

    def make():
        def fn(b: dict) -> dict:
            return {"k": b["doc_id"], "x": [np.unique(coordinates(t)).tobytes() for t in b["text"]], "y": b["y"]}

        return fn

    rows = map_batches(taught, make, "k long, x binary, y int").withColumn("shard", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(SHARDS)).cast("int"))
    # One range a shard, in a fixed order, kept for all rounds; what is lost with an executor is computed again.
    rows = rows.repartitionByRange(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("k", F.lit(4)), "k", "x", "y").select("shard", "x", "y").persist()
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def one_round(k: int, state):
        def run(batches):
            z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
            at, z_at, n_at = state.value
            z[at], n[at] = z_at, n_at
            for shard, held in _shards(batches).items():
                z1, n1 = z.copy(), n.copy()
                for p in range(PASSES):
                    learn(held, z1, n1, PASSES * k + p)
                seen = np.flatnonzero(n1 != n)
                # Many coordinates of a text have equal changes, and gaps between coordinates are small: they are sent squeezed.
                out = [np.diff(seen, prepend=0).astype(np.uint32), (z1 - z)[seen].astype(np.float32), (n1 - n)[seen].astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([_squeezed(x)], pa.binary()) for x in out)], ["shard", "at", "z", "n"])

        return rows.mapInArrow(run, "shard int, at binary, z binary, n binary").collect()  # a row for each shard, of 2^BITS numbers at most

    for k in range(ROUNDS):
        at = np.flatnonzero(n).astype(np.uint32)
        state = docs.sparkSession.sparkContext.broadcast((at, z[at].astype(np.float32), n[at].astype(np.float32)))  # 2^BITS coordinates at most
        got = sorted(one_round(k, state), key=lambda r: r["shard"])
        state.destroy()
        if not got:
            break
        for r in got:
            seen = np.cumsum(_plain(r["at"], np.uint32), dtype=np.int64)
            for total, c in ((z, "z"), (n, "n")):
                total[seen] += _plain(r[c], np.float32).astype(float) / len(got)
    rows.unpersist()
    return weights(z, n, np.append(np.full(1 << BITS, L1), 0.0)) if n[-1] else None


class Scorer:
    """Compact weights: the non-zero coordinates only travel to tasks."""

    def __init__(self, weights: np.ndarray | None):
        self.none = weights is None
        if not self.none:
            self.at = np.flatnonzero(weights[:-1]).astype(np.uint32)
            self.w, self.bias = weights[self.at].astype(np.float32), float(weights[-1])

    def start(self):
        if self.none:
            return lambda text: 0.0
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.at] = self.w

        def score(text):
            x = coordinates(text)
            x = np.unique(x[dense[x] != 0])
            return float(1 / (1 + np.exp(-np.clip(self.bias + dense[x].sum(dtype=np.float64), -30, 30))))

        return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; other columns are ignored.

    Null and empty texts score the bias alone; without labels every score is 0. Repeated rows score alike; repeated
    label rows of an id count once, as toxic if any is; an empty table gives none.
    """
    model = Scorer(fit(docs, labels))

    def make():
        score = model.start()
        return lambda b: {"doc_id": b["doc_id"], "score": [score(t) for t in b["text"]]}

    out = map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below THRESHOLD."""
    model = Scorer(fit(docs, labels))

    def make():
        score = model.start()
        return lambda texts: [score(t) < THRESHOLD for t in texts]

    return filter_batches(docs, "text", make)
