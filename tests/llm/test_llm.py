"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from provenir.llm import langid, licenses, minhash, mixing, packing, quality, queries, rules, tokens, toxicity, vectors
from provenir.llm.common import Encoder, slices
from provenir.session import Scratch

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, size long, key string, a long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows; the last columns clash with names used inside."""
    g = random.Random(1)
    word = lambda: "".join(g.choice("abcdeéñ") for _ in range(g.randrange(1, 6)))
    base = " ".join(word() for _ in range(300))
    texts = [None, "", " \n\t ", "one", "one", "One", "a b", "b a", base, base, base.upper(), base + " tail", base.replace(" ", "\n", 3), "x " * 60_000, "123 456 !!", "a\x1cb \x85 c\x0bd", "ﬁ İ ß ΑΣ ’s it's <|endoftext|>"]
    texts += [" ".join(word() for _ in range(g.randrange(1, 80))) for _ in range(40)]
    for _ in range(30):  # a group of near copies around the threshold
        ws = base.split()
        for _ in range(g.randrange(1, 40)):
            ws[g.randrange(len(ws))] = word()
        texts.append(" ".join(ws))
    rows = [(i * 3 + 5, t, g.choice(["en", "de", None]), g.choice(["s1", "s2", None]), 1, "x", 7, "k", 9) for i, t in enumerate(texts)]
    rows.append(rows[8])
    rows.append((None, "some text here", "en", "s1", 1, "x", 7, "k", 9))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 200)] + [(5, None, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")


def real(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def shingles(text, size):
    ws = [w for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())


def components(docs, size, percent):
    """All pairs of documents, the slow way."""
    sets = {i: shingles(t, size) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    by = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            by[s].append(i)
    for a in ids:
        for b, both in Counter(b for s in sets[a] for b in by[s] if b > a).items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, odd, none, size):
    want = components([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None], size, 80)
    got = minhash.near_duplicates(odd, size, 80).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, c), (4, c + " tail"), (9, c + " end"), (5, a), (5, None), (6, "")] * 2
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    words = {(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"]}
    assert words == {(1, 1), (2, 1), (3, 1), (5, 1), (4, 4), (9, 4)}
    assert {(r["doc_id"], r["component_id"]) for r in got if not r["n_shingles"]} == {(5, 5), (6, 6)}


def test_near_duplicates_on_the_table(spark):
    docs = real(spark)[0].select("doc_id", "text")
    want = components([tuple(r) for r in docs.collect()], 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 2, 80).collect()} == want


def test_sketches_merge_and_estimate():
    g = np.random.default_rng(2)
    a, b, c = (g.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 200, 200))
    x, y = np.concatenate([a, b]), np.concatenate([a, c])
    rx, ry = minhash.registers(x), minhash.registers(y)
    assert (np.maximum(rx, ry) == minhash.registers(np.concatenate([x, y]))).all()
    e = minhash.estimate(rx[None], ry[None], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(e - 800 / 1200) < 0.2


def test_quality(spark, odd, none, labels):
    docs, marks = real(spark)
    got = quality.quality_scores(docs, marks, Scratch(spark)).toPandas()
    held = got[got.held_out].merge(marks.toPandas(), on="doc_id")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() >= 0.9
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert quality.quality_scores(odd, labels, Scratch(spark)).count() == odd.count()
    assert quality.quality_scores(none, labels, Scratch(spark)).count() == 0
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0), Scratch(spark)).collect()} == {0.5}


def test_isotonic_rises():
    s, share = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 5, 2, 9]), np.array([10.0, 10, 10, 10]))
    assert (np.diff(share) >= 0).all() and len(s) == 3


def test_toxicity(spark, odd, none, labels):
    g = random.Random(4)
    plain = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(1200):
        ws = [g.choice(plain) for _ in range(60)]
        if bad := i % 8 == 0:
            for w in ("grubble", "snark", "blot"):
                ws[g.randrange(60)] = w
        rows.append((i, " ".join(ws), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity_scores(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.99
    assert toxicity.toxicity_scores(odd, labels).count() == odd.count()
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.keep_clean(docs, docs.select("doc_id", "toxic"))
    assert kept.columns == docs.columns and kept.where("toxic = 1").count() < 15 and kept.where("toxic = 0").count() == docs.where("toxic = 0").count()


def test_toxicity_against_plain_ftrl(spark):
    """The model of the documents table against FTRL written out over dictionaries, shard by shard, averaged after each round of two passes."""
    docs, marks = real(spark)
    label = defaultdict(int)
    for r in marks.where("doc_id IS NOT NULL AND toxic IS NOT NULL").collect():
        label[r["doc_id"]] = max(label[r["doc_id"]], r["toxic"])
    teach = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    hashes = [F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(toxicity.SHARDS)).alias("shard"), F.xxhash64("doc_id", F.lit(4)).alias("order")]
    shards = defaultdict(list)
    for r in docs.where(teach).select("doc_id", "text", *hashes).orderBy("order").collect():
        if r["doc_id"] in label:
            shards[r["shard"]].append(([*np.unique(toxicity.coordinates(r["text"])).tolist(), "bias"], label[r["doc_id"]]))
    weight = lambda i, z, n: 0.0 if i != "bias" and abs(z) <= 4 else -(z - (0 if i == "bias" else math.copysign(4, z))) / ((1 + math.sqrt(n)) / 8)
    z0, n0 = defaultdict(float), defaultdict(float)
    for p in range(3):
        ends = []
        for rows in shards.values():
            z, n = z0.copy(), n0.copy()
            for k in [k for q in (0, 1) for k in np.random.Generator(np.random.PCG64(2 * p + q)).permutation(len(rows))]:
                ids, y = rows[k]
                w = {i: weight(i, z[i], n[i]) for i in ids}
                g = 1 / (1 + math.exp(-min(max(sum(w.values()), -30), 30))) - y
                for i in ids:
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 8 * w[i]
                    n[i] += g * g
            ends.append((z, n))
        for i in {i for z, _ in ends for i in z}:
            z0[i], n0[i] = (sum(e[k].get(i, 0.0) for e in ends) / len(ends) for k in (0, 1))
    want = {i: x for i in z0 if (x := weight(i, z0[i], n0[i]))}
    got = toxicity.fit(docs, marks)
    assert {i if i < len(got) - 1 else "bias" for i in np.flatnonzero(got)} == set(want)
    assert all(got[-1 if i == "bias" else i] == pytest.approx(x, abs=1e-3) for i, x in want.items())
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, marks).collect()}
    for r in docs.limit(200).collect():
        s = want["bias"] + sum(want.get(int(i), 0.0) for i in np.unique(toxicity.coordinates(r["text"])))
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-3)


def slow_measure(text):
    text = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    at = defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dups, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += 1
            dups += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), lines


def test_rules(spark, odd, none, labels):
    docs, marks = real(spark)
    for r in odd.collect():
        assert rules.measure(r["text"]) == slow_measure(r["text"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rules.quality_rules(docs, marks, Scratch(spark)).collect()
    assert all(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")) == slow_measure(texts[r["doc_id"]]) for r in got)
    assert all(not r["kept"] or not r["base_failed"] for r in got)
    assert rules.quality_rules(none, labels, Scratch(spark)).count() == 0
    assert rules.quality_rules(odd, labels, Scratch(spark)).count() == odd.count()


def test_rule_cutoffs_hold_their_risk(spark):
    """Brute force over the cutoffs: each stands, the next stricter one does not."""
    g = random.Random(7)
    rows = [(i, 100, 500, g.randrange(20) if g.random() < 0.97 else 90, 0, 0, 5) for i in range(4000)]
    m = spark.createDataFrame(rows, "doc_id long, " + rules.MEASURES)
    good = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    cut = rules.cutoffs(m, good, risk=0.2)
    step, level = rules.RULES["symbols"], rules.DELTA / (len(rules.RULES) * len(rules.STRATA))
    lost = lambda c: sum(r[3] / 100 > c + 1e-12 for r in rows)
    c = cut["symbols", 0]
    assert rules.upper_bound(lost(c), 4000, level) <= 0.05 < rules.upper_bound(lost(c - step), 4000, level)
    assert not any(k for _, k in cut)


def test_upper_bound():
    assert rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-6)
    assert rules.upper_bound(5, 5, 0.05) == 1
    for n, p in ((1, 0.3), (40, 0.02), (500, 0.005), (500, 0.97)):
        exact = 0.0
        for k in range(n):
            exact += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert rules.tail(k, n, p) == pytest.approx(exact, rel=1e-9, abs=1e-12)
    for n in (0, 5, 700, 20_000):
        k = rules.most_lost(n, 0.005, 0.004)
        assert (k < 0 or rules.upper_bound(k, n, 0.004) <= 0.005 + 1e-12) and rules.upper_bound(k + 1, n, 0.004) > 0.005
    z = (0.005e9 - rules.most_lost(10**9, 0.005, 0.004)) / math.sqrt(0.005 * 0.995e9)
    assert z == pytest.approx(2.652, abs=0.01)  # the normal quantile of 0.004


def test_encoder_equals_whole_texts(odd):
    t, e = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER, keep=50)
    for r in odd.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert e.encode(r["text"]) == np.array(ids, "<u4").tobytes()


def test_batches_equal_whole_texts(odd):
    t, e = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER, keep=50)
    g = random.Random(3)
    signs = [*map(chr, range(256)), "Ā", "ſ", "K", "İ", "\u0301", "\u0331", "’", "中", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "ªº", "²", "a<|startoftext|>", "..", "Word", "été", "ÀÉ", "µ", "ÿ"]
    texts = [None, *(r["text"] for r in odd.collect()), None, "", *signs, *("x" + s for s in signs), *(s + "H" for s in signs)]
    texts += ["".join(g.choice(signs) for _ in range(g.randrange(1, 9))) for _ in range(3000)] + [" ".join(g.choice(signs) for _ in range(30)) for _ in range(300)]
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    column = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for size in (1, 900, 1 << 20):
        parts = list(slices(column, 0, size))
        assert sum(p.num_rows for p in parts) == len(texts) and all(sum(len((x or "").encode()) for x in p.column(0).to_pylist()[1:]) < size for p in parts)
        assert [x for p in parts for x in e.batch(p.column(0))] == want
    assert list(e.batch(column.column(0).slice(7, 40))) == want[7:47] and list(e.batch(pa.array([], pa.string()))) == []
    assert list(e.batch(pa.array([None, ""], pa.string()))) == [b"", b""] and not list(slices(column.slice(0, 0), 0))


def test_batches_look_distinct_words_up_once():
    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

        def __contains__(self, x):
            self.n += 1
            return super().__contains__(x)

        def __getitem__(self, x):
            self.n += 1
            return super().__getitem__(x)

    texts = ["One word, one WORD; another one. été Été!"] * 500
    each, together = Encoder(TOKENIZER), Encoder(TOKENIZER)
    each.known, together.known = Counted(each.known), Counted(together.known)
    assert [each.encode(x) for x in texts] == list(together.batch(pa.array(texts)))
    assert set(together.known) >= {"one", "word", "another", "été"} and together.known.n == 4 and each.known.n > 8000


def test_tokens(spark, odd, none, tmp_path, monkeypatch):
    t = Tokenizer.from_file(TOKENIZER)
    folder = str(tmp_path / "out")
    files = Scratch(spark).table(tokens.write_tokens(odd, folder, TOKENIZER))
    got = sorted(tokens.read_tokens(spark, files).collect(), key=lambda r: r["start"])
    start = 0
    for r, q in zip(got, sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")), strict=True):
        ids = np.array([*t.encode(q["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (q["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = files.first()["path"]
    raw = bytearray(open(path, "rb").read())
    with open(path, "rb") as f:
        table = tokens.seek_table(f)
    wanted = table[-1][3][-1][0]
    assert set(tokens.read_documents(path, {wanted})) == {wanted}
    raw[table[0][0] + 8] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError), open(path, "rb") as f:
        list(tokens.read_frame(f, table[0]))
    assert tokens.token_output(none, Scratch(spark), TOKENIZER).count() == 0
    monkeypatch.setattr(tokens, "FILE_BYTES", 2000)
    more = Scratch(spark).table(tokens.write_tokens(odd, folder + "2", TOKENIZER))
    assert more.count() > 2 * files.count() and sorted(tokens.read_tokens(spark, more).collect(), key=lambda r: r["start"]) == got


def test_tokens_look_distinct_words_up_once(spark, tmp_path, monkeypatch):
    """500 texts of the same words: a task that looked each text's words up would need thousands of lookups."""

    class Few(dict):
        left = 100

        def spend(self):
            self.left -= 1
            assert self.left >= 0, "looked up text by text"

        def get(self, *a):
            self.spend()
            return super().get(*a)

        def __contains__(self, x):
            self.spend()
            return super().__contains__(x)

        def __getitem__(self, x):
            self.spend()
            return super().__getitem__(x)

    class Limited(Encoder):
        def __init__(self, path):
            super().__init__(path)
            self.known = Few(self.known)

    monkeypatch.setattr(tokens, "Encoder", Limited)
    texts = ["One word, one WORD; another one. été Été!", None, "", "One  word\n\tit's <|endoftext|> 中"] * 500
    docs = spark.createDataFrame([(len(texts) - k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    files = Scratch(spark).table(tokens.write_tokens(docs, str(tmp_path / "out"), TOKENIZER))
    got, start, t = sorted(tokens.read_tokens(spark, files).collect(), key=lambda r: r["start"]), 0, Tokenizer.from_file(TOKENIZER)
    want = {x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in set(texts)}
    for k, (r, x) in enumerate(zip(got, reversed(texts), strict=True)):
        assert tuple(r) == (k + 1, start, len(want[x]), zlib.crc32(want[x].tobytes()))
        start += len(want[x])


def packed_well(rows, texts):
    t = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    at = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in at.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    return len(at), -(-total // 2048)


def test_packing(spark, odd, none):
    rows = packing.pack(odd, Scratch(spark), TOKENIZER).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    packed_well(rows, texts)
    counts = Counter(r["doc_id"] for r in odd.collect())
    assert sum(r["piece"] == 0 for r in rows) == sum(counts.values())
    docs = real(spark)[0]
    n, least = packed_well(packing.pack(docs, Scratch(spark), TOKENIZER).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert n <= 1.02 * least + 1
    assert packing.pack(none, Scratch(spark), TOKENIZER).count() == 0


def test_plan_holds_every_piece():
    g = random.Random(5)
    for _ in range(30):
        counts = Counter(g.randrange(1, 101) for _ in range(g.randrange(1, 400)))
        runs = packing.plan(counts, 100, 6)
        held = Counter()
        for lengths, times in runs:
            assert sum(lengths) <= 100 and times > 0
            for n in lengths:
                held[n] += times
        assert held == counts


def best_fit(counts, size):
    """Best-fit decreasing, piece by piece: the number of sequences."""
    rooms, n_rooms, used = [], Counter(), 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            at = bisect.bisect_left(rooms, n)
            r = rooms[at] if at < len(rooms) else size
            if at == len(rooms):
                used += 1
            else:
                n_rooms[r] -= 1
                if not n_rooms[r]:
                    rooms.pop(at)
            if r > n:
                if not n_rooms[r - n]:
                    bisect.insort(rooms, r - n)
                n_rooms[r - n] += 1
    return used


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "halves", "thirds", "narrow", "few", "small"])
@pytest.mark.parametrize("n", [200, 6000])
def test_plan_is_never_worse_than_best_fit(shape, n):
    g = np.random.default_rng(n)
    x = {
        "uniform": lambda: g.integers(1, 2049, n), "lognormal": lambda: np.exp(g.normal(6, 1, n)), "halves": lambda: g.integers(900, 1150, n), "thirds": lambda: g.integers(513, 900, n),
        "narrow": lambda: g.normal(700, 60, n), "few": lambda: g.choice([1024, 1025, 683, 682, 700, 1365, 400], n), "small": lambda: g.integers(1, 300, n),
    }[shape]()
    counts = Counter(np.clip(x, 1, 2048).astype(int).tolist())
    n_plan = sum(times for _, times in packing.plan(counts))
    assert n_plan <= best_fit(counts, 2048)
    if shape in ("thirds", "narrow") and n > 1000:  # configurations of three save sequences
        assert n_plan < 0.98 * best_fit(counts, 2048)


def test_large_pieces_lie_in_whole_configurations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.pieces(docs, TOKENIZER).groupBy("length").count().collect()
    counts = Counter({r["length"]: r["count"] for r in rows})
    large = sum(c for n, c in counts.items() if n > 512)
    for groups in packing.GROUPS:
        runs, left = packing.configured(counts, 2048, groups)
        held = Counter(left)
        for lengths, times in runs.items():
            assert 1 <= len(lengths) <= 3 and sum(lengths) <= 2048 and min(lengths) > 512
            for n in lengths:
                held[n] += times
        assert held == {n: c for n, c in counts.items() if n > 512} and left.total() < 0.01 * large
    assert sum(times for _, times in packing.plan(counts)) <= best_fit(counts, 2048)


def test_licenses(spark, odd, none):
    low = str.maketrans(licenses._UPPER, licenses._LOWER)
    split = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", x.translate(low))
    extra = [(900, "x\nPermission is hereby GRANTED, free of charge, to any person obtaining a copy of this software and documentation\nMIT  license mit\n\nlicense"), (901, "cc by cc by"), (902, "apachelicense gnu general public")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.license_scan(docs).collect()}
    for i, text in docs.collect():
        ws = split(text or "")
        hits = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        share = {}
        for line in (text or "").split("\n"):
            have = set(split(line))
            for label, t in licenses.TEMPLATES:
                need = set(t.split())
                if 100 * len(have & need) >= licenses.CONTAINMENT * len(need):
                    share[label] = max(share.get(label, 0), len(have & need) / len(need))
        own = {label for _, label in hits}
        r = got[i, len(ws)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r["base_labels"] == ",".join(sorted(own)) and r["labels"] == ",".join(sorted(own | set(share)))
        assert r["score"] == pytest.approx(1.0 if own else max(share.values(), default=0.0))
    assert licenses.license_scan(odd).count() == odd.count()
    assert licenses.license_scan(none).count() == 0


def test_licenses_of_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    agpl = "# You should have received a copy of the GNU Affero General Public License\r\n# along with this program.  If not, see the web."
    apache = "you may not use this file except in\ncompliance with the License.\nYou may obtain a copy\nof the License at"
    narrow = "permission\nto use copy\nmodify and or\n\ndistribute this\nsoftware for any\npurpose with or\nwithout fee is\nhereby granted"
    far = "permission is hereby granted free of charge\n" + "z " * 30 + "\nto any person obtaining a copy of this software and associated documentation files"
    short = "you should have received a copy of the\ngnu affero general public"  # 12 of 17 words
    texts = {1: mit, 2: bsd, 3: agpl, 4: apache, 5: narrow, 6: far, 7: short, 8: "z\n" * 100 + mit + "\nz" * 100, 9: bsd + "\n" + mit}
    got = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("agpl", 1.0), 4: ("apache", 1.0), 5: ("isc", 1.0), 6: ("", 0.0), 7: ("", 0.0), 8: ("mit", 1.0), 9: ("bsd,mit", 1.0)}


def test_mixing(spark, odd, none):
    rows = [r.asDict() for r in mixing.mix(odd).collect()]
    texts = odd.select("doc_id", "source", "text").collect()
    assert len(rows) == len(texts)
    size = Counter()
    for r in texts:
        size[r["source"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:  # share by weight, stop, share again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    by = {(r["source_size"], round(r["target"], 6)) for r in rows}
    assert by == {(size[s], round(target[s], 6)) for s in order}
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[size[s]] - target[s]) <= 1 for s in order)
    again = [r.asDict() for r in mixing.mix(odd.repartition(3)).collect()]
    key = lambda r: repr([r[c] for c in ("doc_id", "size", "taken", "position")])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    clash = odd
    for c in ("h", "copy__", "position__", "position", "row", "i", "at", "copies", "passes", "share"):
        clash = clash.withColumn(c, F.lit(f"keep {c}"))
    out = mixing.curriculum(clash)
    held = out.collect()
    assert out.columns == clash.columns and len(held) == sum(r["passes"] for r in rows)
    assert all(r[c] == f"keep {c}" for r in held for c in clash.columns[len(odd.columns) :])
    passes = defaultdict(list)
    for r in rows:
        passes[r["doc_id"]].append(r["passes"])
    assert Counter(r["doc_id"] for r in held) == +Counter({i: sum(n) for i, n in passes.items()})
    again = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e f g", "s")], "doc_id long, text string, source string")
    m = mixing.mix(again).collect()
    assert mixing.curriculum(again).count() == sum(r["passes"] for r in m) > 0
    assert mixing.mix(none).count() == 0 and mixing.curriculum(none).count() == 0


def test_targets_of_many_sources(spark):
    """Against the same rule in plain Python: more sources than tasks, ties, null and empty names, sources without words."""
    g = random.Random(9)
    sizes = {f"s{k:03d}": g.choice([0, 5, 5, 40, 1000]) * g.randrange(1, 4) for k in range(150)} | {None: 77, "": 3}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark)).collect()
    assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(x, 6) for s, x in target.items()}
    assert [r["slope"] for r in sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))] == [(0.5, -0.5, 0.0)[k % 3] for k in range(152)]


def test_vectors(spark):
    g = np.random.default_rng(3)
    rows = []
    for k in range(400):
        if k % 3 == 0 or not rows:
            v = g.normal(size=16)
        else:
            v = np.array(rows[g.integers(0, len(rows))][1]) + g.normal(size=16) * 0.3
        rows.append((k, v.tolist(), int(g.integers(0, 3))))
    rows += [(500 + k, rows[0][1], rows[0][2]) for k in range(40)] + [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0, None], 1), (603, [float("nan")] * 16, 1), (604, rows[0][1], None), (605, [1.0, 2.0], 1), (606, [1.0, 2.0], 1), (607, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = {i: (np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0 and y is not None}
    links = {i: {j for j, (w, z) in ok.items() if j != i and z == y and len(w) == len(u) and float(u @ w) >= 0.93} for i, (u, y) in ok.items()}
    up = {i: i for i, *_ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, js in links.items():
        for j in js:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, Scratch(spark)).collect()}
    assert set(got) == set(up)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.9 * sum(map(len, links.values()))
    assert all(got[i]["n_links"] <= len(links.get(i, ())) for i in got)
    assert sum(got[i]["component_id"] == find(i) for i in got) >= 0.95 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert vectors.near_vectors(df.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("group", [4096, 300])
def test_vectors_search_every_list_in_reach(spark, monkeypatch, group):
    monkeypatch.setattr(vectors, "PER_LIST", 2)
    monkeypatch.setattr(vectors, "BOUND", 1000)  # about 1000 lists, fitted on a third of the vectors
    monkeypatch.setattr(vectors, "GROUP", group, raising=False)
    g = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(g.normal(size=(1500, 64)))
    side = g.normal(size=base.shape)
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    c = g.uniform(0.9301, 0.932, (1500, 1))
    v = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])
    linked = unit(v) @ unit(v).T >= 0.93
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, Scratch(spark)).collect()}
    assert linked.sum() >= 3000
    assert got == {k: (row.sum(), k % 1500) for k, row in enumerate(linked)}


def test_languages(spark, odd, none):
    docs = real(spark)[0]
    got = langid.languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95
    und = {r["doc_id"]: r["lang_pred"] for r in langid.languages(odd).collect()}
    assert und[5] == und[8] == und[11] == "und" and und[5 + 3 * 14] == "und"
    assert langid.languages(none).count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input: decisions recomputed in plain Python, then the packing of what was taken."""
    docs, marks = real(spark)
    scratch = Scratch(spark)
    first = scratch.table(corpus_pipeline.STAGES[0][1](spark, docs, DIR))
    cut = rules.cutoffs(rules.measures(docs), marks)
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in docs.collect() if not rules.rejected(slow_measure(r["text"]), cut)}
    second = scratch.table(corpus_pipeline.STAGES[1][1](spark, first, DIR))
    scored = toxicity.toxicity_scores(first, marks).where("predicted = 0")
    assert {r["doc_id"] for r in second.collect()} == {r["doc_id"] for r in scored.collect()}
    third = scratch.table(corpus_pipeline.STAGES[2][1](spark, second, DIR))
    want = components([(r["doc_id"], r["text"]) for r in second.collect()], 5, 80)
    assert {r["doc_id"] for r in third.collect()} == {i for i, (_, c) in want.items() if c == i}
    fourth = scratch.table(corpus_pipeline.STAGES[3][1](spark, third, DIR))
    assert fourth.columns == docs.columns
    passes = Counter({r["doc_id"]: r["passes"] for r in mixing.mix(third).collect()})
    assert Counter(r["doc_id"] for r in fourth.collect()) == +passes
    last = corpus_pipeline.STAGES[4][1](spark, fourth, DIR).collect()
    n, least = packed_well(last, {r["doc_id"]: r["text"] for r in third.collect()})
    assert n <= 1.02 * least + 1
    whole = corpus_pipeline.run(spark, DIR).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, last))


def test_queries_are_registered():
    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted((n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(queries.QUERIES) == 11 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def brute_links(rows):
    """Links and components of (vec_id, vector, label) rows, the slow way; rows of one id with other vectors are nodes of their own."""
    nodes = sorted({(i, tuple(v), y) for i, v, y in rows})
    unit = {n: np.array(n[1]) / np.abs(n[1]).max() for n in nodes}
    unit = {n: u / np.linalg.norm(u) for n, u in unit.items()}
    links, up = Counter(), {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a] @ unit[b] >= 0.93:
                links.update([a, b])
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {n: (links[n], find(n)[0]) for n in nodes}


def test_vectors_of_extreme_lengths_and_repeated_ids(spark):
    base = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (5, [1.0, 1.0], "x"), (7, [1e-200, 1e-200], "x"), (8, [1e200, 1e200], "x"), (9, [3e-310, 0.0], "x")]
    twice = [(20, [1.0, 0.0, 0.0], "x"), (20, [0.0, 1.0, 0.0], "x"), (20, [0.0, 1.0, 0.0], "y"), (21, [1.0, 0.1, 0.0], "x"), (22, [0.0, 1.0, 0.1], "x"), (23, [0.0, 1.0, 0.1], "y"), (24, [0.0, 1.0, 0.2], "y")]
    rows = base + twice
    df = spark.createDataFrame([(i, v, y, "k", 1, "z") for i, v, y in rows], "vec_id long, embedding array<double>, label string, id string, n int, h1 string")
    want = brute_links(rows)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df, Scratch(spark)).collect())
    assert got == sorted((i, *want[i, tuple(v), y], want[i, tuple(v), y][1] == i) for i, v, y in rows)
    assert [r[:3] for r in got if r[0] == 20] == [(20, 1, 20), (20, 1, 20), (20, 2, 20)]


def test_vectors_many_lists_recall(spark, monkeypatch):
    """Planted pairs at 0.93 to 0.95 in clustered vectors: at least 50 lists, chunks and turns, two lengths, float components."""
    monkeypatch.setattr(vectors, "PER_LIST", 8)
    monkeypatch.setattr(vectors, "GROUP", 64)
    monkeypatch.setattr(vectors, "VISITORS", 100)
    monkeypatch.setattr(vectors, "WIDTH", 2)
    g = np.random.default_rng(8)
    rows = []
    for dim, n in ((24, 900), (10, 200)):
        centre = g.normal(size=(30, dim)) * 2
        base = centre[g.integers(0, 30, n)] + g.normal(size=(n, dim))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        side = g.normal(size=base.shape)
        side -= (side * base).sum(1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        c = g.uniform(0.931, 0.95, (n, 1))
        v = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side]).astype(np.float32)
        rows += [(len(rows) + k, x.tolist(), k % n % 2) for k, x in enumerate(v)]
    index = vectors.Index(np.array([r[1] for r in rows[:1800]]), 900)
    assert len(index.coarse[0]) * len(index.coarse[1]) >= 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, Scratch(spark)).collect()}
    want = {n[0]: w for n, w in brute_links(rows).items()}
    found, there = sum(x for x, _ in got.values()), sum(x for x, _ in want.values())
    print(f"recall {found / there:.4f} of {there} link ends")
    assert there >= 2000 and got == want
