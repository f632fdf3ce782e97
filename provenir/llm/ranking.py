"""Ranked lexical search: every document against a set of items, with thresholds seeded by stored impacts.

One pass over the texts keeps, for each segment, the postings of the items' terms (document, frequency) and the documents' lengths; the
corpus sums follow from them. A second pass over the postings stores each term's greatest and k-th greatest impact. The k-th impact of any of its
terms, times the term's repeats, is reached by k documents, so the best of them is a floor under an item's k-th score. With terms in
descending order of their greatest contribution, a document that has only terms of a suffix whose contributions sum to less than the floor cannot be
among the first k: candidates are the documents with a term before that suffix. In the third pass each segment scores its candidates
over all terms and keeps its first k; the first k of all segments' are the result. Only these rows are shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import Scratch
from .segments import blocks, map_segments, pack, unpack, words

#: The weight of a document's length in percent, the scale of an impact, and the share of a frequency.
LENGTH, SCALE, UNIT, DAMP = 75, 1_000_000_000, 1000, 8
K = 10

POSTINGS = "segment long, doc_ids array<long>, sizes binary, terms array<int>, held array<long>, docs binary, tfs binary"
IMPACTS = "term int, impact long"
SCORED = "item int, item_id long, doc_id long, score long"


class _Postings:
    """The postings of one segment for the terms asked for."""

    def __init__(self, terms: dict[bytes, int]):
        self.get = terms.get
        self.ids, self.sizes, self.keys = [], [], []

    def add(self, doc_id, w):
        found = np.array([t for t in map(self.get, w) if t is not None], np.int64)
        self.keys.append(found << 32 | len(self.ids))
        self.ids.append(doc_id)
        self.sizes.append(len(w))

    def rows(self, segment):
        keys, tfs = np.unique(np.concatenate(self.keys), return_counts=True)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(doc, prepend=0)
        step[first] = doc[first]
        return {
            "segment": [segment],
            "doc_ids": [self.ids],
            "sizes": [pack(np.array(self.sizes))[0]],
            "terms": [term[first]],
            "held": [np.diff(np.append(first, len(term)))],
            "docs": [pack(step)[0]],
            "tfs": [pack(tfs)[0]],
        }


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impacts(sizes: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Impacts of postings, without the weight of their term."""
    wide = sizes.astype(object) if len(sizes) and int(sizes.max()) * LENGTH * n_docs >= 1 << 63 else sizes
    m = (100 - LENGTH + (LENGTH * wide * n_docs) // total).astype(np.int64)
    return (SCALE * tf) // (UNIT * tf + DAMP * m[doc])


def _read(b: pa.RecordBatch, k: int):
    """Document ids, sizes, and (terms, first, held, document, frequency) of the postings of row k."""
    row = {c: b.column(c)[k].as_py() for c in b.schema.names if c != "doc_ids"}
    held = np.array(row["held"], np.int64)
    first = np.cumsum(held) - held
    step = unpack(row["docs"])
    total = np.cumsum(step)
    doc = total - np.repeat(total[first] - step[first], held) if len(step) else step
    return b.column("doc_ids")[k], unpack(row["sizes"]), np.array(row["terms"], np.int64), first, held, doc, unpack(row["tfs"])


def _stored_impacts(postings: DataFrame, weights: np.ndarray, n_docs: int, total: int, k: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The greatest and the k-th greatest impact of each term (0 where fewer documents hold it)."""
    schema = StructType.fromDDL(IMPACTS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(weights), k), np.int64)  # of the whole task
        for b in batches:
            for r in range(b.num_rows):
                _, sizes, terms, first, held, doc, tf = _read(b, r)
                x = _impacts(sizes, doc, tf, n_docs, total) * np.repeat(weights[terms], held)
                t = np.repeat(terms, held)
                order = np.lexsort((-x, t))
                place = np.arange(len(x)) - np.repeat(first, held)
                top = order[place < k]
                merged = np.zeros((len(terms), k), np.int64)
                merged[np.searchsorted(terms, t[top]), place[place < k]] = x[top]
                best[terms] = -np.sort(-np.concatenate((best[terms], merged), 1), 1)[:, :k]
        at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(best[at])], schema=arrow)

    ranked = postings.select("sizes", "terms", "held", "docs", "tfs", "doc_ids").mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    stored = ranked.withColumn("place", place).where(F.col("place") <= k)
    per = scratch.table(stored.groupBy("term").agg(F.max("impact").alias("most"), F.max(F.when(F.col("place") == k, F.col("impact"))).alias("kth")))
    most, kth = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    for r in per.collect():  # a row for each term of the block
        most[r["term"]], kth[r["term"]] = r["most"], r["kth"] or 0
    return most, kth


def _plan(asked: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, kth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each item its terms and repeats by descending greatest contribution, how many of them make candidates, and its floor."""
    out = []
    for terms, repeats in asked:
        bound = most[terms] * repeats
        order = np.argsort(-bound, kind="stable")
        terms, repeats, bound = terms[order], repeats[order], bound[order]
        floor = int((kth[terms] * repeats).max(initial=0))
        rest = np.cumsum(bound[::-1])[::-1]  # what a term and all after it can add
        out.append((terms, repeats, int((rest >= max(floor, 1)).sum()), floor))
    return out


def _block(docs: DataFrame, items: list[tuple[int | None, str]], k: int, scratch: Scratch) -> DataFrame:
    """SCORED rows of one block: the first k of each segment."""
    vocabulary = defaultdict(count().__next__)
    asked = []
    for _, text in items:
        t, n = np.unique(np.array([vocabulary[w] for w in words(text)], np.int64), return_counts=True)
        asked.append((t, n))
    terms, ids = dict(vocabulary), [i for i, _ in items]
    postings = scratch.table(map_segments(docs, lambda: _Postings(terms), POSTINGS))

    # Lengths stand in packed bytes; their sums come from the documents themselves.
    sums_schema = StructType.fromDDL("n long, total long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [unpack(x) for x in b.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [sum(int((s > 0).sum()) for s in sizes)], "total": [sum(int(s.sum()) for s in sizes)]})

    r = postings.select("sizes").mapInArrow(sums, sums_schema).agg(F.sum("n"), F.sum("total")).first()
    n_docs, total = r[0] or 0, r[1] or 0
    schema = StructType.fromDDL(SCORED)
    if not n_docs:
        return docs.sparkSession.createDataFrame([], schema)
    each = postings.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy("x.terms").agg(F.sum("x.held").alias("df"))
    df = np.zeros(len(terms), np.int64)
    for r in each.collect():  # a row for each term of the block
        df[r["terms"]] = r["df"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    most, kth = _stored_impacts(postings, weights, n_docs, total, k, scratch)
    plan = _plan(asked, most, kth)
    arrow = to_arrow_schema(schema)
    last = np.iinfo(np.int64).max  # null ids come last among equal scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                doc_ids, sizes, held_terms, first, held, doc, tf = _read(b, r)
                x = _impacts(sizes, doc, tf, n_docs, total) * np.repeat(weights[held_terms], held)
                at = np.full(len(weights), -1, np.int64)
                at[held_terms] = np.arange(len(held_terms))
                given = doc_ids.values.to_numpy(zero_copy_only=False)
                null = np.array(doc_ids.values.is_null())
                key = np.where(null, last, given).astype(np.int64)
                out = []
                for item, (ts, repeats, lead, floor) in enumerate(plan):
                    places = at[ts]
                    heads = places[:lead][places[:lead] >= 0]
                    if not len(heads):
                        continue
                    candidates = np.unique(np.concatenate([doc[first[p] : first[p] + held[p]] for p in heads]))
                    score = np.zeros(len(candidates), np.int64)
                    for p, n in zip(places.tolist(), repeats.tolist(), strict=True):
                        if p >= 0:
                            mine = doc[first[p] : first[p] + held[p]]
                            where = np.searchsorted(candidates, mine)
                            ok = where < len(candidates)
                            ok[ok] = candidates[where[ok]] == mine[ok]
                            score[where[ok]] += n * x[first[p] : first[p] + held[p]][ok]
                    good = np.flatnonzero((score > 0) & (score >= floor))
                    good = good[np.lexsort((key[candidates[good]], -score[good]))[:k]]
                    out += [(item, ids[item], None if null[d] else int(given[d]), int(s)) for d, s in zip(candidates[good], score[good], strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return postings.select("doc_ids", "sizes", "terms", "held", "docs", "tfs").mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the first ``k`` documents of each item with a score above 0, equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text. Every row of ``docs`` is a document; rows equal in id and text take
    ranks of their own, a null doc_id comes last among equal scores. Rows of ``items`` equal in id and text are one item, two texts of one id are
    two. Null and empty texts have no terms. Other columns are ignored; without documents or items there are no rows.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items):
        found = _block(docs, block, k, scratch)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        out = out.union(found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return out
