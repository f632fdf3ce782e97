"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose ratio exceeds a cutoff. In each stratum of length, cutoffs are tried from lenient to strict
on labelled good documents: a cutoff stands while the exact (Clopper-Pearson) upper bound of its share of rejected good
documents is at most RISK / rules, at level DELTA / (rules x strata); the first that fails ends the sequence. Testing in a
fixed sequence needs no further correction inside a sequence, and Bonferroni covers the sequences, so with probability
1 - DELTA no stratum loses more than RISK of its good documents. Where labels are too few to certify anything, the rule
rejects nothing.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_batches, label_rows, map_batches, words

RISK, DELTA = 0.02, 0.05
STRATA = (50, 200, 800)  # smallest word counts
#: Ratio and the step of its grid; a grid has STEPS cutoffs.
RULES = {"symbols": 0.01, "dup_lines": 0.0025, "repeats": 0.0025, "word_length": 0.1}
STEPS = 400
SYMBOLS = "#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text; null counts as empty."""
    text = text or ""
    ws = words(text)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeats = 0
    windows = list(zip(ws, ws[1:], ws[2:], strict=False))
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0  # words before it are counted
        for i, x in enumerate(windows):
            if seen[x] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return len(ws), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def ratios(m: tuple[int, ...]) -> dict[str, float]:
    n, chars, symbols, dups, repeats, lines = m
    return {"symbols": symbols / max(n, 1), "dup_lines": dups / max(lines, 1), "repeats": repeats / max(n, 1), "word_length": chars / max(n, 1)}


def base_failed(m: tuple[int, ...]) -> bool:
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def stratum(n_words: int) -> int:
    return max((k for k, least in enumerate(STRATA) if n_words >= least), default=0)


def measures(docs: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def make():
        def fn(b: dict) -> dict:
            rows = [measure(t) for t in b["text"]]
            return {"doc_id": b["doc_id"]} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

        return fn

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, " + MEASURES)


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction: some dozens of steps whatever a and b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def tail(k: int, n: int, p: float) -> float:
    """Probability of k or fewer of n at a share of p."""
    return 1.0 if k >= n else beta_share(1 - p, n - k, k + 1)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest p under which k or fewer of n are not rarer than ``level``."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if tail(k, n, p) > level else (lo, p)
    return hi


def most_lost(n: int, risk: float, level: float) -> int:
    """The greatest k whose upper bound of k of n is at most ``risk``; -1 if none: the bound rises with k, so this is one search."""
    lo, hi = -1, n
    while hi - lo > 1:
        k = (lo + hi) // 2
        lo, hi = (k, hi) if tail(k, n, risk) <= level else (lo, k)
    return lo


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, int], float]:
    """Certified cutoffs by (rule, stratum), from all labelled good documents; at most rules x strata x STEPS counts come back."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratio = {"symbols": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeats": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n}
    # A bin is the number of cutoffs below the ratio.
    bins = [F.struct(F.lit(r).alias("rule"), F.least(F.ceil(ratio[r] / step), F.lit(STEPS)).cast("int").alias("bin")) for r, step in RULES.items()]
    good = measured.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(label_rows(labels, "quality", F.min).where("y = 1"), "doc_id", "left_semi")
    s = sum(((F.col("n_words") >= least).cast("int") for least in STRATA[1:]), F.lit(0))
    counts = good.select(s.alias("s"), F.explode(F.array(*bins)).alias("x")).groupBy("s", "x.rule", "x.bin").count().collect()
    out = {}
    for rule, step in RULES.items():
        for k in range(len(STRATA)):
            at = Counter({r["bin"]: r["count"] for r in counts if r["rule"] == rule and r["s"] == k})
            total = sum(at.values())
            lost = at[STEPS]
            most = most_lost(total, risk / len(RULES), delta / (len(RULES) * len(STRATA)))
            for cut in range(STEPS - 1, -1, -1):  # documents in bins above ``cut`` are over cut * step
                if not total or lost > most:
                    break
                out[rule, k] = cut * step
                lost += at[cut]
    return out


def rejected(m: tuple[int, ...], cut: dict[tuple[str, int], float]) -> bool:
    k, r = stratum(m[0]), ratios(m)
    return base_failed(m) or any(math.ceil(r[x] / step) > round(cut[x, k] / step) for x, step in RULES.items() if (x, k) in cut)


def quality_rules(docs: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """(doc_id, measures, base_failed, kept) for each row of ``docs``; other columns are ignored.

    Null and empty texts have no words and fail the base. Labels without a document and documents without a label are
    used for nothing; repeated rows are judged alike; empty tables give empty results or no cutoffs.
    """
    m = scratch.table(measures(docs))
    cut = cutoffs(m, labels)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def make():
        def fn(b: dict) -> dict:
            rows = list(zip(*(b[n] for n in names), strict=True))
            return {n: b[n] for n in ["doc_id", *names]} | {"base_failed": [base_failed(r) for r in rows], "kept": [not rejected(r, cut) for r in rows]}

        return fn

    return map_batches(m, make, "doc_id long, " + MEASURES + ", base_failed boolean, kept boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    cut = cutoffs(scratch.table(measures(docs)), labels)
    return filter_batches(docs, "text", lambda: lambda texts: [not rejected(measure(t), cut) for t in texts])
