"""Benchmark decontamination: a distributed positional inverted index of the corpus, searched for phrases and for nearness.

Index: a row for each segment and term with the term's places in the segment, as packed differences, and a row for each segment with
its documents. It is written once and serves any number of test sets. A test set comes in blocks; a block's terms select the rows,
and a segment's rows meet in one task (their size is that of one segment). A window's lists, shifted by the place of the
term in the window, are intersected from the rarest to the most frequent, all windows at once.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import Scratch
from .segments import blocks, map_segments, pack, unpack, words

WINDOW = 10
#: Windows are intersected in parts with at most so many places of their rarest terms (one window: any number).
PLACES = 4_000_000

INDEX = "segment long, term string, n long, places binary, doc_ids array<long>, sizes array<long>"
FOUND = "segment long, doc long, doc_id long, item_id long, spans array<struct<start:long,end:long>>"


class _Postings:
    """The rows of one segment."""

    def __init__(self):
        self.known = defaultdict(count().__next__)
        self.ids, self.numbers = [], []

    def add(self, doc_id, w):
        self.ids.append(doc_id)
        self.numbers.append(np.fromiter(map(self.known.__getitem__, w), np.int32, len(w)))

    def rows(self, segment):
        term = np.concatenate(self.numbers).astype(np.int64)
        keys = np.sort(term << 32 | np.arange(len(term)))
        term, place = keys >> 32, keys & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(place, prepend=0)
        step[first] = place[first]
        data, ends = pack(step)
        n = np.diff(np.append(first, len(term)))
        cut = np.concatenate(([0], ends[first + n - 1])).astype(np.int32) if len(first) else np.zeros(1, np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data)])
        k = len(first)
        return {
            "segment": pa.array(np.full(k + 1, segment)),
            "term": pa.array([None, *(t.decode("utf-8", "surrogatepass") for t in self.known)], pa.string()),
            "n": pa.array(np.append(len(self.ids), n)),
            "places": pa.concat_arrays([pa.nulls(1, pa.binary()), held]),
            "doc_ids": pa.array([self.ids] + [None] * k, pa.list_(pa.int64())),
            "sizes": pa.array([[len(x) for x in self.numbers]] + [None] * k, pa.list_(pa.int64())),
        }


def index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text) as a written table: (segment, term, n, places, doc_ids, sizes).

    Every row of ``docs`` is a document of its own, null ids and repeated rows too; null and empty texts have no words and
    stand with size 0 in their segment's own row, the one whose term is null. Other columns are ignored; an empty table gives an empty index.
    """
    return scratch.table(map_segments(docs, _Postings, INDEX))


def documents(idx: DataFrame) -> DataFrame:
    """(segment, doc, doc_id, n_words) for each document of the index."""
    own = idx.where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("doc", "d"))
    return own.select("segment", F.col("doc").cast("long").alias("doc"), F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))


class _Windows:
    """The distinct windows of a block of items: term numbers, -1 beyond the end of a short one, and the items of each."""

    def __init__(self, items, size):
        vocabulary, seen = defaultdict(count().__next__), defaultdict(set)
        for k, (_, text) in enumerate(items):
            w = [vocabulary[x] for x in words(text)]
            for at in range(max(len(w) - size + 1, min(len(w), 1))):
                seen[tuple(w[at : at + size])].add(k)
        self.size, self.terms = size, {t.decode("utf-8", "surrogatepass"): k for t, k in vocabulary.items()}
        self.windows = np.full((len(seen), size), -1, np.int32)
        for k, w in enumerate(seen):
            self.windows[k, : len(w)] = w
        self.length = np.array([len(w) for w in seen], np.int64)
        self.items = np.array([i for s in seen.values() for i in sorted(s)], np.int64)
        self.ends = np.cumsum([len(s) for s in seen.values()], dtype=np.int64)

    def find(self, keys: np.ndarray, held: np.ndarray, until: np.ndarray):
        """(window, place) of every occurrence. keys: term << 32 | place, ascending; held: number of places of each term;
        until: the place where each document ends."""
        lists = np.where(self.windows < 0, np.int64(1) << 40, held[self.windows])
        order = np.argsort(lists, 1, kind="stable")
        first = np.cumsum(held) - held
        rows = np.flatnonzero(lists.min(1) > 0)
        load = np.cumsum(lists[rows].min(1))
        out = []
        for part in np.split(rows, np.searchsorted(load, np.arange(PLACES, load[-1], PLACES))) if len(rows) else ():
            if not len(part):
                continue
            rare = order[part, 0]
            t = self.windows[part, rare]
            n = held[t]
            win = np.repeat(part, n)
            at = np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            start = (keys[at] & 0xFFFFFFFF) - np.repeat(rare, n)
            ok = start >= 0
            win, start = win[ok], start[ok]
            for k in range(1, self.size):
                shift = order[win, k]
                t = self.windows[win, shift].astype(np.int64)
                want = t << 32 | (start + shift)
                i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                ok = (t < 0) | (keys[i] == want)
                win, start = win[ok], start[ok]
            inside = start + self.length[win] <= until[np.searchsorted(until, start, "right")]
            out.append((win[inside], start[inside]))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else (np.zeros(0, np.int64),) * 2


def _segment(table: pa.Table, terms: dict[str, int]):
    """A segment's lists as keys, the places of each term, its document ids and the places where its documents end."""
    own = table.column("doc_ids").is_valid()
    docs, lists = table.filter(own), table.filter(pa.compute.invert(own))
    number = np.array([terms[t] for t in lists.column("term").to_pylist()], np.int64)
    n = lists.column("n").to_numpy()
    step = unpack(b"".join(lists.column("places").to_pylist()))
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    place = total - np.repeat(total[first] - step[first], n) if len(step) else step
    held = np.zeros(len(terms), np.int64)
    held[number] = n
    return np.sort(np.repeat(number, n) << 32 | place), held, docs.column("doc_ids")[0].as_py(), np.cumsum(docs.column("sizes")[0].as_py())


def _search(idx: DataFrame, items: list, terms: dict[str, int], find) -> DataFrame:
    """Rows of FOUND of ``find(keys, held, until)``, which gives (document, item, start, end) arrays, for one block of items."""
    spark = idx.sparkSession
    chosen = spark.createDataFrame(pa.table({"term": pa.array(list(terms), pa.string())})) if terms else spark.createDataFrame([], "term string")
    rows = idx.join(chosen, "term", "left_semi").unionByName(idx.where("term IS NULL"))
    schema = StructType.fromDDL(FOUND)
    arrow = to_arrow_schema(schema)
    ids = [i for i, _ in items]

    def run(table: pa.Table) -> pa.Table:  # carries its block, which is bounded
        if table.num_rows == 1:
            return arrow.empty_table()
        keys, held, doc_ids, until = _segment(table, terms)
        doc, item, start, end = find(keys, held, until)
        order = np.lexsort((start, item, doc))
        spans, last = [], None
        begin = until - np.diff(until, prepend=0)
        for d, i, s, e in zip(doc[order].tolist(), item[order].tolist(), (start - begin[doc])[order].tolist(), (end - begin[doc])[order].tolist(), strict=True):
            if (d, i) != last:
                spans.append((d, i, []))
                last = d, i
            mine = spans[-1][2]
            if mine and s <= mine[-1]["end"]:
                mine[-1]["end"] = max(e, mine[-1]["end"])
            else:
                mine.append({"start": s, "end": e})
        segment = table.column("segment")[0].as_py()
        return pa.table([[segment] * len(spans), [d for d, _, _ in spans], [doc_ids[d] for d, _, _ in spans], [ids[i] for _, i, _ in spans], [s for _, _, s in spans]], schema=arrow)

    return rows.groupBy("segment").applyInArrow(run, schema)


def _all(idx: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = idx.sparkSession.createDataFrame([], FOUND)
    for p in parts:
        out = out.union(p)
    return out


def phrase_matches(idx: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(segment, doc, doc_id, item_id, spans): stretches of documents covered by windows of ``size`` words of an item.

    ``items`` has item_id and text; an item of fewer words, but not none, is one window. Spans are word places
    of the document, the end excluded, those that touch merged. A document is ``doc`` within ``segment``; distinct texts of one item_id are searched
    each and have rows of their own; null texts and texts without words match nothing; a null item_id stays null.
    """

    def of(block):
        w = _Windows(block, size)

        def find(keys, held, until):
            win, start = w.find(keys, held, until)
            many = w.ends[win] - np.where(win > 0, w.ends[win - 1], 0)
            at = np.repeat(w.ends[win] - np.cumsum(many), many) + np.arange(many.sum())
            win, start = np.repeat(win, many), np.repeat(start, many)
            return np.searchsorted(until, start, "right"), w.items[at], start, start + w.length[win]

        return _search(idx, block, w.terms, find)

    return _all(idx, [of(b) for b in blocks(items)])


def proximity_matches(idx: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """(segment, doc, doc_id, item_id, spans): for each item and document, the shortest stretch of at most ``within`` words with all the item's words.

    Words may stand in any order and count once each; of equally short stretches it is the first. Items and documents are
    those of ``phrase_matches``; items without words match nothing.
    """

    def of(block):
        vocabulary = defaultdict(count().__next__)
        asked = [list(dict.fromkeys(vocabulary[x] for x in words(text))) for _, text in block]
        terms = {t.decode("utf-8", "surrogatepass"): k for t, k in vocabulary.items()}

        def find(keys, held, until):
            first = np.cumsum(held) - held
            out = []
            for item, want in enumerate(asked):
                order = sorted(want, key=lambda t: held[t])
                if not order or not held[order[0]] or len(order) > within:
                    continue
                lists = [keys[first[t] : first[t] + held[t]] & 0xFFFFFFFF for t in order]
                docs = np.unique(np.searchsorted(until, lists[0], "right"))
                for x in lists[1:]:  # from the rarest
                    docs = docs[np.isin(docs, np.searchsorted(until, x, "right"))]
                    if not len(docs):
                        break
                for d in docs.tolist():
                    low, high = until[d - 1] if d else 0, until[d]
                    inside = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
                    place = np.concatenate(inside)
                    which = np.repeat(np.arange(len(inside)), [len(x) for x in inside])
                    by = np.argsort(place)
                    last = np.full(len(inside), -1)
                    best = None
                    for p, t in zip(place[by].tolist(), which[by].tolist(), strict=True):
                        last[t] = p
                        begin = int(last.min())
                        if begin >= 0 and p + 1 - begin <= within and (best is None or p + 1 - begin < best[1] - best[0]):
                            best = begin, p + 1
                    if best:
                        out.append((d, item, *best))
            return np.array(out, np.int64).reshape(-1, 4).T

        return _search(idx, block, terms, find)

    return _all(idx, [of(b) for b in blocks(items)])


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    n_hit: words inside any occurrence of a window; n_items: distinct item_ids with occurring windows, a null one written as the empty
    string; without hits items_sha256 is that of the empty string. Rows equal in doc_id and text are judged each, alike.
    """
    idx = index(docs, scratch)
    found = scratch.table(phrase_matches(idx, items, size))
    spans = F.array_sort(F.flatten(F.collect_list("spans")))  # of one document: no longer than it
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    ids = F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))))
    per = found.groupBy("segment", "doc").agg(merged.alias("n_hit"), ids.alias("ids"))
    out = documents(idx).join(per, ["segment", "doc"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
