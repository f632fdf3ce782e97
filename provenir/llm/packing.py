"""Packing documents into sequences by linear grouping.

Only longer documents are cut. Piece lengths are at most SIZE numbers, so their counts are a table of at most SIZE rows however large
the corpus; the plan is made from these counts alone. Lengths over a quarter of a sequence are large: sorted, they are put in
groups of equal cardinality and rounded up to the group's longest (a length that fills a group by itself, and the longest that fit
twice or three times, start groups of their own). Configurations hold at most three rounded sizes; a linear programme (revised simplex,
one row a group) finds how often to use which, and its solution is rounded down. Actual lengths take the places of the
rounded ones in whole configurations, some at a time, and the remainder is grouped and solved again. The few large pieces left, and the
small ones, go longest first to the tightest room. The
plan is a list of runs: so many sequences of the same lengths. Pieces of one length are numbered in a distributed way
(partition counts, then offsets) and each finds its run by its number.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Encoder, slices

SIZE, END_ID, GROUPS, ROUNDS = 2048, 0, (48, 96, 256), 24


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(part, rank, doc_id, piece, start, length, ids_crc32): rank numbers the pieces of one length in one task from 0."""
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        code, part = Encoder(tokenizer), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for b in batches:
            for s in slices(b, 1):
                out = []
                for i, x in zip(s.column(0).to_pylist(), code.batch(s.column(1)), strict=True):
                    ids = x + end
                    for p, a in enumerate(range(0, len(ids), 4 * size)):
                        x = ids[a : a + 4 * size]
                        n = len(x) // 4
                        out.append((part, seen[n], i, p, a // 4, n, zlib.crc32(x)))
                        seen[n] += 1
                if out:
                    c = list(zip(*out, strict=True))
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], ["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long")


def grouped(counts: dict[int, int], size: int, groups: int) -> list[tuple[int, int]]:
    """Large lengths in groups of equal cardinality, longest first: (rounded size, number of pieces)."""
    large = sorted((n for n in counts if n > size // 4 and counts[n]), reverse=True)
    each = -(-sum(counts[n] for n in large) // groups) if large else 1
    out: list[list[int]] = []
    room, last = 0, size
    for n in large:
        if counts[n] >= each or any(n <= size // k < last for k in (2, 3)):
            room = 0
        left, last = counts[n], n
        while left:
            if room <= 0:
                out.append([n, 0])
                room = max(each, counts[n])
            take = min(left, room)
            out[-1][1] += take
            left, room = left - take, room - take
    return [(n, c) for n, c in out]


def solve(sizes: list[int], need: np.ndarray, size: int, rounds: int = 5000) -> list[tuple[list[int], int]]:
    """How often to use which configuration of one to three of the sizes (longest first): the linear programme of least sequences, rounded down.

    Revised simplex: prices of the groups from the basis, the configuration worth most by them comes in. It is found from pairs: the
    best third is the greatest price among the sizes that fit the pair's room. Any basis on the way covers the need, so
    stopping after ``rounds`` costs sequences, never pieces.
    """
    m, s = len(sizes), np.array(sizes)
    times = size // s
    basis = [[k] * int(t) for k, t in enumerate(times)]
    inverse, x = np.diag(1 / times), need / times
    room = size - s[:, None] - s[None, :]
    thirds = np.searchsorted(s[::-1], room.ravel(), side="right").reshape(m, m)
    for k in range(rounds):
        if k % 200 == 199:  # rounding errors of the updates go
            inverse = np.linalg.inv(np.stack([np.bincount(c, minlength=m) for c in basis], 1).astype(float))
            x = np.maximum(inverse @ need, 0)
        price = inverse.sum(0)
        rising = price[::-1]
        best = np.maximum.accumulate(np.append(0, rising))
        worth = np.where(room >= 0, price[:, None] + price[None, :] + best[thirds], -1)
        i, j = divmod(int(worth.argmax()), m)
        if worth[i, j] <= 1 + 1e-9:
            break
        fit = int(thirds[i, j])
        entering = sorted([i, j] + ([m - 1 - int(rising[:fit].argmax())] if best[fit] > 0 else []))
        step = inverse @ np.bincount(entering, minlength=m)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out], basis[out] = row, entering
    left = need.copy()
    used = []
    for c, v in sorted(zip(basis, x, strict=True), key=lambda y: -y[1]):
        n = min([int(v + 1e-6), *(left[g] // k for g, k in Counter(c).items())])
        if n:
            used.append((c, int(n)))
            left -= int(n) * np.bincount(c, minlength=m)
    return used


def plan(counts: dict[int, int], size: int = SIZE, *groups: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in one sequence, number of such sequences) that hold every piece once.

    Of the roundings to so many ``groups`` (GROUPS by default) the one that needs the fewest sequences is taken, the first on a tie.
    """
    least = -(-sum(n * c for n, c in counts.items()) // size)
    plans = []
    for g in groups or GROUPS:
        runs, left = configured(counts, size, g)
        plans.append(_best_fit(runs, left + Counter({n: c for n, c in counts.items() if 0 < n <= size // 4}), size))
        if sum(n for _, n in plans[-1]) <= least:
            break
    return min(plans, key=lambda runs: sum(n for _, n in runs))


def configured(counts: dict[int, int], size: int, groups: int) -> tuple[Counter, Counter]:
    """Sequences of whole configurations, with actual lengths, and the few large pieces that no configuration took.

    A quarter of the programme's solution is used at a time, then what is left is grouped and solved again: actual lengths fill the
    room that rounding left, so the rest is shorter than it was planned. After ROUNDS rounds all of each solution is used.
    """
    left = Counter({n: c for n, c in counts.items() if n > size // 4 and c})
    runs: Counter = Counter()
    for k in itertools.count():
        group = grouped(left, size, groups)
        sizes = [n for n, _ in group]
        part = 1 if k >= ROUNDS or len(set(sizes)) == len(left) else 4
        used = [([sizes[g] for g in c], -(-n // part)) for c, n in solve(sizes, np.array([c for _, c in group]), size)] if group else []
        if not used:
            return runs, left
        for config, times in sorted(used, key=lambda u: sum(u[0]), reverse=True):
            _substitute(config, times, left, runs, size)


def _substitute(config: list[int], times: int, left: Counter, runs: Counter, size: int) -> None:
    """Actual lengths in place of a configuration's sizes: each the longest that leaves room for the sizes after it.

    That is at least the size or, where longer ones are gone, the longest below it; as a longer length taken early leaves shorter ones
    to the configurations after it, every place of every configuration finds its piece.
    """
    lengths = sorted(left)
    while times:
        taken: list[int] = []
        for k in range(len(config)):
            at = bisect.bisect_right(lengths, size - sum(taken) - sum(config[k + 1 :])) - 1
            while left[lengths[at]] <= taken.count(lengths[at]):
                at -= 1
            taken.append(lengths[at])
        step = min([times, *(left[n] // c for n, c in Counter(taken).items())])
        runs[tuple(taken)] += step
        times -= step
        for n, c in Counter(taken).items():
            left[n] -= c * step
            if not left[n]:
                del left[n]
                lengths.remove(n)


def _best_fit(runs: Counter, rest: Counter, size: int) -> list[tuple[tuple[int, ...], int]]:
    """The rest, longest first, to the tightest room."""
    spare: dict[int, Counter] = defaultdict(Counter)
    for lengths, times in runs.items():
        spare[size - sum(lengths)][lengths] += times
    rooms = sorted(spare)
    for n in sorted(rest, reverse=True):
        c = rest[n]
        while c:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                spare[size][()] += -(-c // (size // n))
                bisect.insort(rooms, size)
                continue
            r = rooms[at]
            lengths, times = spare[r].popitem()
            # As many of this length in each of these sequences as fit, when there are enough of them.
            each = max(1, min(r // n, c // times))
            used = min(times, c // each)
            if used < times:
                spare[r][lengths] += times - used
            if not spare[r]:
                del spare[r]
                rooms.pop(at)
            if r - each * n not in spare:
                bisect.insort(rooms, r - each * n)
            spare[r - each * n][lengths + (n,) * each] += used
            c -= each * used
    return [(lengths, times) for r in sorted(spare) for lengths, times in sorted(spare[r].items()) if lengths]


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list, list]]:
    """By length: first numbers, and (first number, times, first sequence, offsets in a sequence) of the runs with it."""
    out: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    given: Counter = Counter()
    sequence = 0
    for lengths, times in runs:
        offsets, at = defaultdict(list), 0
        for n in lengths:
            offsets[n].append(at)
            at += n
        for n, offs in offsets.items():
            out[n][0].append(given[n])
            out[n][1].append((given[n], sequence, offs))
            given[n] += times * len(offs)
        sequence += times
    return dict(out)


def pack(docs: DataFrame, scratch, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of ``docs`` (doc_id, text).

    Null and empty texts are the end id alone. Equal lengths are interchangeable; rows that repeat a doc_id are packed
    each; an empty table gives none. Other columns are ignored.
    """
    p = scratch.table(pieces(docs, tokenizer, size))
    per = p.groupBy("part", "length").agg(F.count("*").alias("n"))
    per = scratch.table(per.select("part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # SIZE rows at most
    found = places(plan(counts, size))

    def run(batches):
        for b in batches:
            got = {c: b.column(c).to_pylist() for c in ("length", "rank", "before")}
            ids, offs = [], []
            for n, k, before in zip(got["length"], got["rank"], got["before"], strict=True):
                firsts, rows = found[n]
                first, sequence, offsets = rows[bisect.bisect_right(firsts, k + before) - 1]
                s, o = divmod(k + before - first, len(offsets))
                ids.append(sequence + s)
                offs.append(offsets[o])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(ids, pa.int64()), pa.array(offs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Offsets are a row for each task and length, so they grow with the input: shuffled on both sides, never broadcast.
    placed = p.join(per.select("part", "length", "before").hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
