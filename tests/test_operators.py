import random

import pytest
from pyspark.sql import functions as F

from provenir.operators import evidence, graph
from provenir.session import Scratch
from provenir.sources import gedcom, pages
from provenir.streaming import intake


def test_folded_status(spark):
    rows = [(1, "accepted"), (1, "rejected"), (2, "rejected"), (2, "rejected"), (3, "rejected"), (3, "undecided"), (4, None)]
    df = spark.createDataFrame(rows, "k int, s string").groupBy("k").agg(evidence.folded_status(F.col("s")).alias("b"))
    assert dict(map(tuple, df.collect())) == {1: "accepted", 2: "rejected", 3: "undecided", 4: "undecided"}


def test_components_match_union_find(spark):
    g = random.Random(3)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(400, 450)] + [(None, 3), (7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    assert got == {x: find(x) for x in up}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_walks(spark):
    s = Scratch(spark)
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    closure = graph.ancestors(tree, s)
    assert {tuple(r) for r in closure.where("id = 'c'").collect()} == {("c", "c", 0), ("c", "b", 1), ("c", "a", 2)}
    sets = spark.createDataFrame([(1, "a"), (1, "c"), (2, "c"), (2, "d")], "group_id int, id string")
    assert dict(map(tuple, graph.most_specific(sets, closure).collect())) == {1: "c", 2: None}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    seeds = spark.createDataFrame([("a", 1), ("d", 0)], "id string, pos int")
    assert {tuple(r) for r in graph.distances(edges, seeds, s, 5).collect()} == {("a", 0, 1), ("d", 0, 0), ("b", 1, 1), ("c", 1, 0)}
    kin = spark.createDataFrame([("a", "b", 1), ("b", "a", -1), ("b", "c", 0), ("c", "b", 0), ("c", "d", -1)], "a string, b string, step int")
    home = spark.createDataFrame([("a",)], "id string")
    assert dict(map(tuple, graph.generations(kin, home, s).collect())) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_distances_run_to_the_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 91)], "a long, b long")
    seeds = spark.createDataFrame([(0, 1), (24, 0), (0, 2)], "id long, pos int")
    got = {r["id"]: (r["depth"], r["origin"]) for r in graph.distances(edges, seeds, Scratch(spark)).collect()}
    assert got == {k: min((k, 1), (abs(k - 24), 0)) for k in range(31)}
    assert graph.distances(edges, spark.createDataFrame([(0, 1)], "id long, pos int"), Scratch(spark)).count() == 31


def test_generations_of_a_long_chain(spark):
    steps = [(1, -1), (-1, 1), (0, 0)]  # parent, child, spouse, over and over
    rows = [r for k in range(60) for r in ((k, k + 1, steps[k % 3][0]), (k + 1, k, steps[k % 3][1]))]
    kin = spark.createDataFrame(rows, "a long, b long, step int")
    got = dict(map(tuple, graph.generations(kin, spark.createDataFrame([(0,)], "id long"), Scratch(spark)).collect()))
    assert got == {k: int(k % 3 == 1) for k in range(61)}


def test_nearest(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    left = spark.createDataFrame([(1, 1, at(10)), (2, 1, at(20)), (3, 2, at(5)), (4, 3, at(5))], "id int, k int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    right = spark.createDataFrame([(11, 1, at(9)), (12, 1, at(18)), (13, 1, at(22)), (14, 2, at(5)), (15, 2, at(5))], "rid int, k int, rt string").withColumn("rt", F.col("rt").cast("timestamp"))
    got = {r["id"]: (r["nearest_id"], r["ambiguous"]) for r in evidence.nearest(left, right, ["k"], "ts", "rt", "rid").collect()}
    assert got == {1: (11, False), 2: (None, True), 3: (None, True), 4: (None, False)}


def test_complete_link_is_not_transitive(spark):
    df = spark.createDataFrame([("x", 1, 10), ("x", 2, 12), ("x", 3, 14), ("y", 4, 10)], "k string, id int, v int")
    got = evidence.complete_link(df, ["k"], ["id"], lambda a, b: abs(a["v"] - b["v"]) <= 2, "k string, id int, v int, side int")
    assert {r["id"]: r["side"] for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_plan_and_upsert(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "k int")
    held = spark.createDataFrame([(2, "open"), (3, "gone"), (4, "closed"), (5, "open"), (6, "closed")], "k int, status string")
    got = dict(map(tuple, evidence.diff_plan(wanted, held, "k").collect()))
    assert got == {1: "insert", 2: "keep", 3: "reopen", 4: "leave closed", 5: "close", 6: "leave closed"}
    a, b = spark.createDataFrame([(1, "n")], "k int, v string"), spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    assert {tuple(r) for r in evidence.upsert(a, b, ["k"]).collect()} == {(1, "n"), (2, "o")}
    assert {tuple(r) for r in evidence.upsert(a, b, ["k"], replace=False).collect()} == {(1, "o"), (2, "o")}


def test_lineage_file(spark, tmp_path):
    text = "0 HEAD\n1 CHAR UTF-8\n0 @I1@ INDI\n1 NAME Nora /Arden/\n1 SEX F\n1 BIRT\n2 DATE 4 MAR 1901\n2 PLAC Elm,\n3 CONC  Utah\n0 @I2@ INDI\n1 NAME Tom /Arden/\n0 @F1@ FAM\n1 WIFE @I1@\n1 CHIL @I2@\n0 TRLR\n"
    for name, raw in (("a", text.encode()), ("b", text.encode("utf-16"))):
        (tmp_path / f"{name}.ged").write_bytes(raw)
    tree = gedcom.scan(spark, str(tmp_path / "*.ged"))
    assert {(r["person"], r["name"], r["sex"]) for r in gedcom.people(tree).collect()} == {("I1", "Nora /Arden/", "F"), ("I2", "Tom /Arden/", None)}
    assert {(r["owner"], r["fact"], r["date"], r["place"]) for r in gedcom.facts(tree).collect()} == {("I1", "BIRT", "4 MAR 1901", "Elm, Utah")}
    assert {(r["family"], r["person"], r["role"]) for r in gedcom.members(tree).collect()} == {("F1", "I1", "partner"), ("F1", "I2", "child")}
    with pytest.raises(ValueError):
        gedcom.decode(b"0 HEAD\n1 CHAR ANSEL\n")


def test_pages(spark):
    html = "<html lang='en'><head><title> A  b</title><script>x</script></head><body><p style='display: none'>no</p><a href='/x'>go</a><table><tr><th>Born:</th><td>1901</td></tr></table></body></html>"
    rows = spark.createDataFrame([(1, "http://h.example/a", html), (2, None, None)], "page_id long, url string, html string")
    a, b = pages.extract(rows).orderBy("page_id").collect()
    assert (a["title"], a["lang"], a["n_links"], a["host"]) == ("A b", "en", 1, "h.example")
    assert [tuple(f) for f in a["fields"]] == [("Born", "1901")] and a["text_length"] == len("goBorn:1901")
    assert (b["title"], b["n_links"], b["fields"]) == ("", 0, [])
    kinds = rows.select(pages.page_kind(F.coalesce("html", F.lit("")), [("table", "<table"), ("other", "<p")]).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["table", "unknown"]


def test_intake_takes_each_content_once(spark, tmp_path):
    box, held, log = (str(tmp_path / x) for x in ("in", "held", "log"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(b"one")
    (tmp_path / "in/b").write_bytes(b"one")
    intake.archive_files(spark, box, held, log).awaitTermination()
    (tmp_path / "in/c").write_bytes(b"two")
    (tmp_path / "in/d").write_bytes(b"one")
    intake.archive_files(spark, box, held, log).awaitTermination()
    assert sorted(bytes(r["content"]) for r in spark.read.parquet(held).collect()) == [b"one", b"two"]


def test_simple_paths_match_brute_force(spark):
    g = random.Random(5)
    edges = sorted({(a, b) for a, b in ((g.randrange(9), g.randrange(9)) for _ in range(16)) if a != b}) + [(20, 21)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walk(path, goal):
        if path[-1] == goal:
            return [tuple(path)]
        return [p for n in near.get(path[-1], ()) if n not in path for p in walk([*path, n], goal)]

    pairs = [(0, 5), (1, 7), (3, 3), (0, 20), (None, 2)]
    want = set()
    for a, b in pairs[:4]:
        found = walk([a], b)
        want |= {(a, b, p) for p in found if len(p) <= min(map(len, found)) + 2}
    df = spark.createDataFrame([*edges, (None, 1), (4, 4)], "a long, b long")
    paths = graph.simple_paths(df, spark.createDataFrame(pairs, "start long, goal long"), Scratch(spark), slack=2)
    assert {(r["start"], r["goal"], tuple(r["path"])) for r in paths.collect()} == want
    assert len(want) > 5 and paths.count() == len(want)
    none = spark.createDataFrame([], "a long, b long")
    assert {tuple(r["path"]) for r in graph.simple_paths(none, spark.createDataFrame(pairs, "start long, goal long"), Scratch(spark)).collect()} == {(3,)}


def test_simple_paths_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(15)]
    df = spark.createDataFrame([*chain, (7, 20), (20, 21), (21, 8), (0, 30), (30, 31), (31, 1), (50, 51)], "a long, b long")
    pairs = spark.createDataFrame([(0, 15), (12, 15), (50, 15)], "start long, goal long")
    got = sorted(tuple(r["path"]) for r in graph.simple_paths(df, pairs, Scratch(spark), slack=2).collect())
    first, last, line = (0, 30, 31, 1), (7, 20, 21, 8), tuple(range(16))
    assert got == sorted([line, first + line[2:], line[:7] + last + line[9:], line[12:]])


def test_path_standing(spark):
    paths = spark.createDataFrame([("a", "c", ["a", "b", "c"]), ("a", "c", ["a", "x", "c"]), ("a", "c", ["a", "y", "z", "c"]), ("d", "d", ["d"])], "start string, goal string, path array<string>")
    links = spark.createDataFrame([("b", "a", 0), ("b", "c", 3), ("a", "x", 1), ("x", "c", 1), ("c", "x", 2), ("a", "y", 0)], "a string, b string, rank int")
    got = {tuple(r["path"]): (r["n_links"], r["weakest"], r["owed"], r["place"]) for r in graph.path_standing(paths, links).collect()}
    assert got == {("a", "x", "c"): (2, 1, 0, 1), ("a", "b", "c"): (2, 3, 0, 2), ("a", "y", "z", "c"): (3, 0, 2, 3), ("d",): (0, None, 0, 1)}


def test_checklist(spark):
    people = spark.createDataFrame([(1, 1900), (2, None)], "k int, born int")
    rules = [("census", F.col("born") < 1950), ("birth", F.lit(True)), ("index", F.col("born") > 1940)]
    found = spark.createDataFrame([(1, "birth", False), (1, "birth", True), (2, "census", None), (1, "index", False), (9, "birth", True)], "k int, rule string, held boolean")
    got = {(r["k"], r["rule"]): r["status"] for r in evidence.checklist(people, rules, found, "k").collect()}
    assert got == {(1, "census"): "missing", (1, "birth"): "held", (1, "index"): "cited", (2, "census"): "cited", (2, "birth"): "missing", (2, "index"): "n/a"}


def test_lineage_lines_and_levels():
    rows = gedcom.nodes("0 HEAD\n1 NOTE a\x0cb c d\n0 @I1@ INDI\r2 NAME x\r2 SEX F\r\n1 BIRT\n3 DATE 1900")
    by = {r[5]: r for r in rows}
    assert by["NOTE"][6] == "a\x0cb c d"
    assert by["NAME"][2] == by["SEX"][2] == by["INDI"][1] and by["DATE"][2] == by["BIRT"][1]
    head = b"0 HEAD\r1 NOTE " + b"x" * 9000 + b"\r1 CHAR ANSI\r"
    assert gedcom.decode(head + b"1 NOTE \xe9").endswith("é") and gedcom.decode(b"0 HEAD\n1 CHAR UTF8\n1 NOTE \xc3\xa9").endswith("é")
    with pytest.raises(ValueError):
        gedcom.decode(b"0 HEAD\n1 CHAR UNICODE\n")


def test_current_rows(spark):
    log = spark.createDataFrame([("k", 1, "r2", "old"), ("k", 2, None, "new"), ("m", 1, None, "a"), ("m", 3, None, "b"), ("z", 1, "r9", "gone")], "key string, at int, superseded_by string, v string")
    assert sorted((r["key"], r["v"]) for r in intake.current(log, "key", "at").collect()) == [("k", "new"), ("m", "b")]
    assert intake.current(log, "key", "at").columns == log.columns
