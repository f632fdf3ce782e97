"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

D random cosines approximate a Gaussian kernel over standardised statistics. Each partition of the training rows sums its
normal equations; a fixed number of sums is added on the driver and solved. Calibration pools adjacent violators over score
bins of a separate fifth of the training rows. The classifier is fitted on at most about BOUND labelled rows, chosen by a hash of
doc_id; statistics, scores and calibration cover every row that they concern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, label_rows, map_batches, words

BOUND = 200_000
FEATURES, RIDGE, BINS, SUMS = 256, 1e-3, 400, 8
N_STATS = 18

_KIND = np.zeros(256, np.int64)
for _i, _set in enumerate([b" ", b"\n", b"0123456789", bytes(range(65, 91)), b"#*$%&|<>", b".!?", b",;:", b"\"'()[]{}-", bytes(range(97, 123)), bytes(range(192, 256))], 1):
    _KIND[list(_set)] = _i


def statistics(text: str | None) -> list[float]:
    """N_STATS numbers about a whole text (lengths of words in UTF-8 bytes); an empty or null text has zeros."""
    if not text:
        return [0.0] * N_STATS
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=11) / len(raw)
    ws = words(text)
    n = max(len(ws), 1)
    pairs = set(zip(ws, ws[1:], strict=False))
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) if ws else np.zeros(1, np.int64)
    lines = text.split("\n")
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float((lengths <= 3).mean()), len(set(ws)) / n, len(pairs) / max(n - 1, 1),
        float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines), *(float(x) for x in kinds[1:]),
    ]


def all_statistics(docs: DataFrame) -> DataFrame:
    return map_batches(docs.select("doc_id", "text"), lambda: lambda b: {"doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]]}, "doc_id long, x array<double>")


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share): adjacent violators pooled over bins in ascending score."""
    blocks: list[list[float]] = []
    for s, g, k in zip(score, good, n, strict=True):
        blocks.append([s * k, g, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.5) / (b[:, 2] + 1)


class Model:
    """Standardisation, cosines, weights and calibration knots: some 60 kB, whatever the corpus."""

    def __init__(self, mean, scale, weights=None, prior=0.5, knots=None):
        g = np.random.Generator(np.random.PCG64(5))
        self.mean, self.scale, self.weights, self.prior, self.knots = mean, scale, weights, prior, knots
        self.w, self.phase = g.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, FEATURES)), g.uniform(0, 2 * np.pi, FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2) if self.weights is not None else np.full(len(x), self.prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return np.clip(np.interp(r, *self.knots) if self.knots is not None else r, 0, 1)


def _stack(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0; of these, remainder 1 calibrates and the rest fits."""
    chosen = bounded(label_rows(labels, "quality", F.min).where(fold("doc_id", 5) != 0), BOUND, 1)
    train = stats.join(chosen, "doc_id").withColumn("f", fold("doc_id", 5)).persist()
    try:
        # One row however many documents; nulls mean that nothing is labelled.
        row = train.where("f <> 1").select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)], F.avg("y").alias("p")).first()
        if row["p"] is None:
            return Model(np.zeros(N_STATS), np.ones(N_STATS))
        m = Model(np.array(row[:N_STATS]), np.maximum(np.array(row[N_STATS : 2 * N_STATS]), 1e-6), prior=row["p"])
        d = FEATURES + 1

        def sums(batches):
            g = np.zeros((d, d + 1))
            for b in batches:
                if b.num_rows:
                    z = m.features(_stack(b.column(0)))
                    g += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()])], ["g"])

        parts = train.where("f <> 1").repartition(SUMS, F.xxhash64("doc_id")).select("x", "y").mapInArrow(sums, "g binary").collect()
        g = sum(np.frombuffer(r["g"]).reshape(d, d + 1) for r in parts)
        m.weights = np.linalg.solve(g[:, :d] + RIDGE * max(g[d - 1, d - 1], 1) * np.eye(d) / 10, g[:, d])

        def scored(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(m.raw(_stack(b.column(0)))), b.column(1)], ["r", "y"])

        held = train.where("f = 1").select("x", "y").mapInArrow(scored, "r double, y int")
        bins = held.groupBy(F.floor(F.col("r") * BINS).alias("k")).agg(F.avg("r").alias("r"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("k").collect()  # 3 * BINS at most
        if bins:
            m.knots = isotonic(*(np.array([b[c] for b in bins], float) for c in ("r", "y", "n")))
        return m
    finally:
        train.unpersist()


def quality_scores(docs: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; other columns are ignored.

    Null and empty texts are scored from zero statistics. Without labels every score is 0.5; with one class only, that
    class's share. Ties in score share a calibrated value; repeated rows score alike; an empty table gives none.
    """
    stats = scratch.table(all_statistics(docs))
    m = fit(stats, labels)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(_stack(b.column(1))))], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
