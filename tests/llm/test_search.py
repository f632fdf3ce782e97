"""Decontamination, manifests and ranked search against brute force, with small segments and blocks, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import contamination, merkle, queries, ranking, segments
from provenir.session import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, segment long, term string, key string, pos long"
ITEMS = "item_id long, text string, doc long, spans string"
LOW = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows():
    g = random.Random(5)
    vocabulary = ["a", "b", "c", "the", "Alpha", "βήτα", "x1", "ﬁ", "İ", "naïve", "zz", "Q"]
    text = lambda n: g.choice([" ", ", ", "\n", "-"]).join(g.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n ", "!!", "one", "One", "a b", "a\x1cb \x85c", "’s it's", "the " * 3000, text(40), "A B c"]
    texts += [text(g.randrange(1, 60)) for _ in range(60)]
    texts += [texts[-1]] * 12
    out = [(i * 3 + 1, t, g.choice(["en", "de", "", None]), g.choice(["s", None]), g.choice([None, i]), 1, "t", "k", 2) for i, t in enumerate(texts)]
    out += [out[20], out[20], (None, texts[25], None, None, None, 1, "t", "k", 2), (None, None, "en", None, None, 1, "t", "k", 2), (out[30][0], "another text of one id", "en", "s", 3, 1, "t", "k", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def asked(rows):
    g = random.Random(6)
    full = [r[1] for r in rows if r[1] and len(words(r[1])) > 14]
    cut = lambda t: " ".join(words(t)[2:14])
    items = [(k, cut(g.choice(full))) for k in range(8)]
    return [*items, (8, "one"), (9, None), (10, ""), (11, "A, b!"), (12, "the the the"), (3, cut(full[0])), (None, cut(full[1])), (0, items[0][1]), (13, "nowhere to be found in here"), (14, "c the a naïve")]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(params=[(4_000_000, 50_000, 32_000_000), (150, 7, 120)])
def sizes(request, monkeypatch):
    """As in production, and many segments with several blocks of items."""
    w, d, b = request.param
    monkeypatch.setattr(segments, "WORDS", w)
    monkeypatch.setattr(segments, "DOCS", d)
    monkeypatch.setattr(segments, "BLOCK_BYTES", b)


def test_packed_numbers():
    g = np.random.default_rng(1)
    x = np.concatenate([g.integers(0, 1 << k, 50) for k in range(1, 60, 4)] + [np.array([0, 127, 128, 16383, 16384])])
    data, ends = segments.pack(x)
    assert segments.unpack(data).tolist() == x.tolist() and ends[-1] == len(data)
    assert segments.unpack(segments.pack(np.zeros(0, np.int64))[0]).tolist() == []


def brute_hits(rows, items, size):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - size + 1, min(1, len(w)))):
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, held = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    held |= found
        out.append((r[0], len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("size", [10, 3])
def test_contamination(spark, rows, docs, asked, sizes, size):
    got = contamination.contamination(docs, spark.createDataFrame([(*a, 1, "s") for a in asked], ITEMS), Scratch(spark), size)
    want = brute_hits(rows, asked, size)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert any(r[5] for r in want)


def test_index_has_every_word(spark, rows, docs, sizes):
    idx = contamination.index(docs, Scratch(spark))
    want = Counter(w for r in rows for w in words(r[1]))
    assert {r["term"]: r["n"] for r in idx.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect()} == want
    assert idx.where("term IS NULL").agg(F.sum("n")).first()[0] == len(rows)


def test_proximity(spark, rows, docs, asked, sizes):
    idx = contamination.index(docs, Scratch(spark))
    within = 9
    got = contamination.proximity_matches(idx, spark.createDataFrame(asked, "item_id long, text string"), within)
    got = [(r["doc_id"], r["item_id"], *[(s["start"], s["end"]) for s in r["spans"]]) for r in got.collect()]
    want = []
    for i, text in set(asked):
        need = set(words(text))
        for r in rows:
            w, best = words(r[1]), None
            for e in range(1, len(w) + 1):
                for s in range(max(e - within, 0), e):
                    if need and need <= set(w[s:e]) and (best is None or e - s < best[1] - best[0]):
                        best = s, e
            if best:
                want.append((r[0], i, best))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, low=False: sha(map(field, [r[0], r[3], r[2], r[4], r[1].translate(LOW) if low and r[1] is not None else r[1]]))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, k):
        for level in levels[:-1]:
            at = k // 8 * 8
            yield level[at : at + 8], k - at
            k //= 8

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: grow([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = grow([trees[g][-1][0] for g in langs])
    out = []
    for n, g in enumerate(langs):
        for k, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [*path(trees[g], k), *path(top, n)]
            low = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            cur = leaf(r, low)
            for run, at in steps:
                cur = sha([*run[:at], cur, *run[at + 1 :]])
            proof = sha(x for run, at in steps for j, x in enumerate(run) if j != at)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return out


def manifest_rows(df):
    return sorted(repr(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in df.collect())


@pytest.mark.parametrize("step", [4, 1])
def test_manifest(spark, rows, docs, step, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", step)  # with one level a step paths go down through several tasks
    got = merkle.verified_manifest(docs, Scratch(spark))
    want = brute_manifest(rows)
    assert manifest_rows(got) == sorted(map(repr, want))
    assert {w[6] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 4097])
def test_manifest_sizes(spark, n):
    rows = [(k, f"Text {k}", "en", "s", k, 1, "t", "k", 2) for k in range(n)]
    got = merkle.verified_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark))
    assert manifest_rows(got) == sorted(map(repr, brute_manifest(rows)))


def test_frontier_meets_from_scattered_leaves(spark):
    """Leaves dealt at random: no parent is whole in one task, and the rounds still end with every node."""
    n = 600
    leaves = spark.range(n).select(F.lit("g").alias("key"), F.lit(n).cast("long").alias("n"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    links, tops = merkle.grow(leaves.repartition(7, F.xxhash64("pos")), Scratch(spark))
    level = [sha([str(k)]) for k in range(n)]
    want = set()
    height = 0
    while len(level) > 1:
        height += 1
        level = [sha(level[k : k + 8]) for k in range(0, len(level), 8)]
        want |= {(height, k, x) for k, x in enumerate(level)}
    assert {(r["level"], r["idx"], r["digest"]) for r in links.collect()} == want
    assert tops.first()["digest"] == level[0]


def test_whole_paths_fold_to_the_root(spark, docs):
    m = merkle.manifest(merkle.tampered(docs), Scratch(spark), F.col("lang"), [F.col("doc_id").asc_nulls_first()])
    found = m.proofs(columns=("doc_id", "lang"), whole=True).collect()
    assert len(found) == docs.count() and all(r["verified"] and merkle.fold(r["leaf"], r["path"]) == r["root"] for r in found)


def brute_search(rows, items, k=10):
    held = [(r[0], Counter(words(r[1]))) for r in rows]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for i, text in {(i, t) for i, t in items if t is not None}:
        asked, scores = Counter(words(text)), []
        for (d, c), n in zip(held, sizes, strict=True):
            m = 25 + 75 * n * n_docs // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, place + 1, d, -s) for place, (s, _, d) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("k", [10, 2])
def test_ranked_search(spark, rows, docs, asked, sizes, k):
    got = ranking.ranked_search(docs, spark.createDataFrame([(*a, 1, "s") for a in asked], ITEMS), Scratch(spark), k)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, brute_search(rows, asked, k)))


def test_search_of_real_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op13_ranked_search(spark, d)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, brute_search(rows, items)))


def test_floors_leave_terms_out():
    """The plan drops the suffix that cannot reach the floor, and nothing when fewer than k documents hold each term."""
    asked = [(np.array([0, 1, 2]), np.array([1, 1, 2]))]
    most, kth = np.array([100, 10, 20]), np.array([60, 5, 1])
    terms, repeats, lead, floor = ranking._plan(asked, most, kth)[0]
    assert terms.tolist() == [0, 2, 1] and repeats.tolist() == [1, 2, 1] and lead == 1 and floor == 60
    assert ranking._plan(asked, most, np.zeros(3, np.int64))[0][2:] == (3, 0)


def test_empty_tables(spark, docs, asked):
    none, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    items = spark.createDataFrame([(*a, 1, "s") for a in asked], ITEMS)
    s = Scratch(spark)
    assert contamination.contamination(none, items, s).count() == 0
    assert contamination.contamination(docs, no_items, s).where("contaminated OR n_items > 0").count() == 0
    assert merkle.verified_manifest(none, s).count() == 0
    assert ranking.ranked_search(none, items, s).count() == 0
    assert ranking.ranked_search(docs, no_items, s).count() == 0
    assert ranking.ranked_search(docs.where("text IS NULL"), items, s).count() == 0
