"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character 1- to 3-grams, scaled to length 1. Each learned language has up to CENTROIDS
centroids, clustered by spherical k-means in one task a language over at most about BOUND rows; a text takes the language of
the centroid with the greatest cosine. Texts farther from all centroids than nearly all learned texts of that language are
marked as rejected (score 0 to 1 tells how near; the language stays, as only texts without letters are ``und``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches

BOUND, CENTROIDS, DIMS, ROUNDS = 1_000, 3, 4096, 8
FAR = 0.01  # share of learned texts beyond the rejection distance


def counts(text: str) -> np.ndarray:
    """Hashed counts of character 1- to 3-grams of a whole text in lower case; runs of non-letters are one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c < 65) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 192)), np.uint32(32), c)
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))] if len(c) else c
    h = c * np.uint32(0x9E3779B1)
    two = (h[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + c[1:] * np.uint32(0x27D4EB2F)
    three = (two[:-1] ^ np.uint32(0x165667B1)) * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA77)
    x = np.concatenate([h, two, three])
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    return np.bincount(x >> np.uint32(20), minlength=DIMS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(text)) * idf
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def fit(docs: DataFrame) -> dict:
    """Learns from rows with a language whose crc32(doc_id) mod 5 is not 0: idf, centroids, languages, rejection cosines."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 5) != 0))
    share = rows.groupBy("lang").agg(F.least(F.lit(BOUND) / F.count("*"), F.lit(1.0)).alias("share"))
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def make():
        return lambda b: {"lang": b["lang"], "doc_id": b["doc_id"], "x": [np.minimum(counts(t), 65535).astype(np.uint16).tobytes() if has_letter(t) else None for t in b["text"]]}

    counted = map_batches(chosen.select("lang", "doc_id", "text"), make, "lang string, doc_id long, x binary").where("x is not null").persist()

    def seen(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                df += np.frombuffer(x, np.uint16) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()]), pa.array([n])], ["df", "n"])

    try:
        parts = counted.select("x").coalesce(16).mapInArrow(seen, "df binary, n long").collect()
        if not parts:
            return {"langs": []}
        df = sum(np.frombuffer(r["df"], np.int64) for r in parts)
        idf = np.log((1 + sum(r["n"] for r in parts)) / (1 + df)) + 1

        def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id")
            x = np.log1p(np.stack([np.frombuffer(r, np.uint16) for r in pdf.x]).astype(np.float32)) * idf.astype(np.float32)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            c = x.mean(0, keepdims=True)
            while len(c) < min(CENTROIDS, len(x)):  # the farthest text opens the next cluster
                c = np.vstack([c, x[(x @ c.T).max(1).argmin()]])
            for _ in range(ROUNDS):
                near = (x @ c.T).argmax(1)
                c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            return pd.DataFrame({"lang": pdf.lang.iloc[0], "c": [k.astype(np.float32).tobytes() for k in c], "far": float(np.quantile((x @ c.T).max(1), FAR))})

        found = counted.groupBy("lang").applyInPandas(cluster, "lang string, c binary, far double").orderBy("lang", "c").collect()  # CENTROIDS rows a language
    finally:
        counted.unpersist()
    return {"idf": idf, "c": np.stack([np.frombuffer(r["c"], np.float32) for r in found]), "langs": [r["lang"] for r in found], "far": np.array([r["far"] for r in found])}


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of ``docs`` (doc_id, text, lang; others are ignored).

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language can be learned.
    Equal cosines go to the language that sorts first; repeated rows are judged alike; an empty table gives none.
    """
    m = fit(docs)

    def make():
        def one(text):
            if not m["langs"] or not has_letter(text):
                return "und", 0.0, True
            s = m["c"] @ vector(text, m["idf"])
            k = int(s.argmax())
            return m["langs"][k], float(np.clip(s[k], 0, 1)), bool(s[k] < m["far"][k])

        def fn(b: dict) -> dict:
            got = [one(t) for t in b["text"]]
            return {"doc_id": b["doc_id"]} | {c: [g[k] for g in got] for k, c in enumerate(("lang_pred", "score", "rejected"))}

        return fn

    out = map_batches(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
