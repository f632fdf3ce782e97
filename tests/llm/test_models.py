"""Trained operators and certified cutoffs against plain versions that share no code with them; SQL of wrapped notices and of both passes."""

import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from provenir.llm import langid, licenses, quality, queries, rules
from provenir.session import Scratch

DIR = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def tables(spark):
    docs, marks = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    worst = {}
    for r in marks.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            worst[r["doc_id"]] = min(r["quality"], worst.get(r["doc_id"], 1))
    return docs, marks, worst


def plain_statistics(text):
    if not text:
        return [0.0] * 18
    raw = text.encode()
    sets = [b" ", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b".!?", b",;:", b"\"'()[]{}-", b"abcdefghijklmnopqrstuvwxyz", bytes(range(0xC0, 0x100))]
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    pairs, sizes, lines = list(zip(ws, ws[1:])), [len(w.encode()) for w in ws] or [0], text.split("\n")  # noqa: B905
    n, mean = max(len(ws), 1), sum(sizes) / len(sizes)
    out = [math.log(1 + n), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), sum(x <= 3 for x in sizes) / len(sizes)]
    out += [len(set(ws)) / n, len(set(pairs)) / max(n - 1, 1), math.log(1 + n / len(lines)), 1 - len(set(lines)) / len(lines)]
    return out + [sum(b in s for b in raw) / len(raw) for s in sets]


def test_quality_against_direct_ridge(spark):
    docs, marks, worst = tables(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len({i for i, _ in rows}) == len(rows)
    x = {i: np.array(plain_statistics(t)) for i, t in rows}
    fitted = [i for i in x if i in worst and crc(i) % 5 > 1]
    a = np.stack([x[i] for i in fitted])
    mean, scale = a.mean(0), np.maximum(a.std(0), 1e-6)
    model = quality.Model(mean, scale)  # for its random cosines alone

    def cosines(rows):
        z = np.clip((rows - mean) / scale, -6, 6)
        return np.column_stack([np.cos(z @ model.w + model.phase) * math.sqrt(2 / 256), np.ones(len(z))])

    z, y = cosines(a), np.array([worst[i] for i in fitted], float)
    # Ridge as least squares with one more row for each weight.
    more = np.sqrt(1e-3 * len(z) / 10) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.vstack([z, more]), np.append(y, np.zeros(len(more))), rcond=None)[0]
    raw = dict(zip(x, np.clip(cosines(np.stack(list(x.values()))) @ weights, -1, 2), strict=True))
    bins = defaultdict(list)
    for i in x:
        if i in worst and crc(i) % 5 == 1:
            bins[math.floor(raw[i] * 400)].append((raw[i], worst[i]))
    b = [(np.mean([r for r, _ in bins[k]]), sum(m for _, m in bins[k]), len(bins[k])) for k in sorted(bins)]
    # Isotonic regression by its minimum and maximum of means.
    share = [max(min(sum(v[1] for v in b[j : k + 1]) / sum(v[2] for v in b[j : k + 1]) for k in range(i, len(b))) for j in range(i + 1)) for i in range(len(b))]
    pools = defaultdict(list)
    for v, at in zip(b, share, strict=True):
        pools[round(at, 12)].append(v)
    knots = [(sum(r * n for r, _, n in p) / sum(n for *_, n in p), (sum(m for _, m, _ in p) + 0.5) / (sum(n for *_, n in p) + 1)) for _, p in sorted(pools.items())]
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, marks, Scratch(spark)).collect()}
    want = {i: float(np.clip(np.interp(r, *zip(*knots, strict=True)), 0, 1)) for i, r in raw.items()}
    assert max(abs(got[i]["score"] - want[i]) for i in x) < 1e-6
    assert all(got[i]["held_out"] == (crc(i) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3) for i in x)


def plain_measures(text):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    three = defaultdict(list)
    for i in range(len(ws) - 2):
        three[" ".join(ws[i : i + 3])].append(i)
    covered = {i + k for v in three.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def test_rules_kept_against_plain_cutoffs(spark):
    docs, marks, worst = tables(spark)
    m = {r["doc_id"]: plain_measures(r["text"]) for r in docs.collect()}
    ratio = {
        i: {"symbols": s / max(n, 1), "dup_lines": d / max(lines, 1), "repeats": r / max(n, 1), "word_length": c / max(n, 1)} for i, (n, c, s, d, r, lines) in m.items()
    }
    failed = {i: n < 50 or 100 * r > 50 * n for i, (n, _, _, _, r, _) in m.items()}
    stratum = {i: (v[0] >= 200) + (v[0] >= 800) for i, v in m.items()}
    good = [i for i in m if worst.get(i) == 1 and not failed[i]]

    def rare(k, n, p):
        """Probability of k or fewer of n, term by term."""
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))

    limit = {}
    for rule, step in {"symbols": 0.01, "dup_lines": 0.0025, "repeats": 0.0025, "word_length": 0.1}.items():
        for k in range(3):
            values = [math.ceil(ratio[i][rule] / step) for i in good if stratum[i] == k]
            for cut in range(399, -1, -1):
                lost = sum(v > cut for v in values)
                if not values or lost == len(values) or rare(lost, len(values), 0.02 / 4) > 0.05 / 12:
                    break
                limit[rule, k] = cut, step
    keep = {i: not failed[i] and not any((r, stratum[i]) in limit and math.ceil(v / limit[r, stratum[i]][1]) > limit[r, stratum[i]][0] for r, v in ratio[i].items()) for i in m}
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.quality_rules(docs, marks, Scratch(spark)).collect()}
    assert got == {i: (failed[i], keep[i]) for i in m}
    strict = {(r, k): c * s for (r, k), (c, s) in limit.items()}
    found = rules.cutoffs(rules.measures(docs), marks)
    assert set(found) == set(strict) and all(found[x] == pytest.approx(strict[x]) for x in strict)


def plain_grams(text):
    """Hashes of 1- to 3-grams in integers modulo 2 ** 32; counts by their top twelve bits."""
    c = []
    for ch in text.lower():
        v = 32 if ord(ch) < 65 or 90 < ord(ch) < 97 or 122 < ord(ch) < 192 else ord(ch)
        if v != 32 or not c or c[-1] != 32:
            c.append(v)
    full = 2**32 - 1
    out = np.zeros(4096)
    one = [v * 0x9E3779B1 & full for v in c]
    two = [((one[i] ^ 0x85EBCA6B) * 0xC2B2AE35 + c[i + 1] * 0x27D4EB2F) & full for i in range(len(c) - 1)]
    three = [((two[i] ^ 0x165667B1) * 0x9E3779B1 + c[i + 2] * 0x85EBCA77) & full for i in range(len(c) - 2)]
    for h in one + two + three:
        out[((h ^ h >> 16) * 0x7FEB352D & full) >> 20] += 1
    return out


def test_languages_against_plain_centroids(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id % 3 = 0")
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in docs.collect() if r["text"] and any(ch.isalpha() for ch in r["text"]))
    grams = {i: plain_grams(t) for i, t, _ in rows}
    learn = [(i, y) for i, _, y in rows if y is not None and crc(i) % 5 != 0]
    idf = np.log((1 + len(learn)) / (1 + sum(grams[i] > 0 for i, _ in learn))) + 1
    unit = lambda v: v / max(math.sqrt((v * v).sum()), 1e-12)
    vector = {i: unit(np.log(1 + g) * idf) for i, g in grams.items()}
    centroids = []
    for y in sorted({y for _, y in learn}):
        x = [vector[i] for i, lang in learn if lang == y]
        c = [sum(x) / len(x)]
        while len(c) < min(3, len(x)):
            c.append(min(x, key=lambda v: max(float(v @ k) for k in c)))  # noqa: B023
        for _ in range(8):
            own = defaultdict(list)
            for v in x:
                own[max(range(len(c)), key=lambda k: float(v @ c[k]))].append(v)  # noqa: B023
            c = [unit(sum(own[k]) / len(own[k]) if own[k] else c[k]) for k in range(len(c))]
        centroids += [(y, k) for k in c]
    got = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    near = 0
    for i, v in vector.items():
        y, best = max(((y, float(v @ c)) for y, c in centroids), key=lambda p: p[1])
        near += got[i]["lang_pred"] == y and abs(got[i]["score"] - best) < 1e-3
    assert near >= 0.995 * len(vector)  # single precision may move a text that lies between two clusters
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for i, r in got.items() if i not in vector)


def against_sql(spark, query, name, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = query(spark, None)
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    key = lambda r: [(v is not None, str(v)) for _, v in sorted(r.items())]
    return sorted((r.asDict() for r in got.collect()), key=key), sorted(want, key=key)


def test_license_sql_finds_wrapped_notices(spark, monkeypatch):
    texts = ["# ".join(t.split(" ", 5)).replace(" ", "\n", 4) for _, t in licenses.TEMPLATES]
    texts += ["a\n" + " ".join(t.split()[: -(-len(t.split()) * 9 // 10)]) for _, t in licenses.TEMPLATES] + [t.replace(" ", " z\n") for _, t in licenses.TEMPLATES]
    texts += [None, "", "MIT license\nthe the the", " ".join(t for _, t in licenses.TEMPLATES), "\n".join(t for _, t in licenses.TEMPLATES).replace(" ", "\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got, want = against_sql(spark, queries.op8_license_scan, "op8_license_scan", docs)
    assert got == want and sum(r["labels"] != "" for r in got) > 30


def test_mixing_positions_of_both_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 17), "abc"[i % 3 * (i % 5 > 0)], 1) for i in range(400)], "doc_id long, text string, source string, again int")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got, want = against_sql(spark, queries.op9_source_mixing, "op9_source_mixing", docs)
    assert got == want and sum(r["again"] is not None for r in got) > 50
    assert all(r["again"] > r["position"] and r["taken"] > r["size"] for r in got if r["again"] is not None)
    places = [r["position"] for r in queries.op9_source_mixing(spark, "").collect()]
    assert places == sorted(places, key=lambda p: (p is not None, p))
