"""Readers, the splitting source, import tables, label facts, snapshots and streams on small invented inputs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from provenir.functions import names, places
from provenir.session import Scratch
from provenir.sources import fields, gedcom, lineage, readers, snapshot
from provenir.streaming import runs

MEMORIAL = """<title>x</title><script>var a = "<li>";</script><h1 id=bio-name>Ann <i>Roe</i> Lee <span class="badge v">V<span>Veteran</span></span></h1>
<time id=birthDateLabel>1 May 1900</time><div id=cemeteryNameLabel>Hill</div><div id=cemeteryStateName>Ohio</div>
<b id=l1>Parents</b><ul class="x member-family" aria-labelledby=l1><li><a href="/m/1"><h3>Tom Lee <span class=badge>V</span></h3></a><span itemprop=birthDate>1870</span><span itemprop=deathDate>1930</span>
<li><a href="/m/2"><h3>Eve <i>Fox</i> Lee</h3></a><li><p>no name</p></ul><ul class=member-family><li><h3>Sam</h3></ul>
<ul id=source><li class="a citation">Source Hide citation Book 3</li><li>Added: 2001</li><li>other</li><li>Created by: me</ul>
<div class="viewer-item" data-photo-id=4><img src=/p/4><p class="photo-text">Stone &amp; tree</p>Photo type: Grave</div><div class=viewer-item>no id</div>"""


def kept(rows):
    columns = [x.split()[0] for x in readers.ROWS.split(", ")]
    return [{k: v for k, v in zip(columns, r, strict=True) if v is not None} for r in rows]


def test_memorial_page(spark):
    want = [
        {"kind": "field", "n": 1, "label": "Name", "value": "Ann Roe Lee"}, {"kind": "field", "n": 2, "label": "Birth Date", "value": "1 May 1900"}, {"kind": "field", "n": 3, "label": "Burial Place", "value": "Hill, Ohio"},
        {"kind": "member", "n": 1, "section": "Parents", "name": "Tom Lee", "birth": "1870", "death": "1930", "url": "/m/1"}, {"kind": "member", "n": 2, "section": "Parents", "name": "Eve Fox Lee", "role": "Fox", "url": "/m/2"},
        {"kind": "member", "n": 3, "section": "Family", "name": "Sam"}, {"kind": "source", "n": 1, "label": "citation", "value": "Book 3"}, {"kind": "source", "n": 2, "label": "added", "value": "Added: 2001"},
        {"kind": "source", "n": 4, "label": "created", "value": "Created by: me"}, {"kind": "picture", "n": 1, "label": "Grave", "value": "Stone & tree", "url": "/p/4"},
    ]
    assert kept(readers.memorial(MEMORIAL)) == want
    df = spark.createDataFrame([(1, MEMORIAL, "k"), (2, None, "k"), (3, "", "k"), (1, MEMORIAL, "k")], "page_id long, html string, kind string")
    got = [tuple(r) for r in readers.memorials(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, *r) for r in readers.memorial(MEMORIAL)] * 2))


RECORD = """<html><head><title>t</title></head><body><table><tr><th>Menu</th><td>x</td></tr></table><main><h2>Mentioned in the Record of <a href="/s">Tom</a></h2><h1>Ann Lee</h1><h2>Ohio Births</h2>
<table><tbody><tr><th>Event Date<td>1 May 1900<div style="DISPLAY:none"><div><b>1900</b></div><div><b>May 1900</b></div></div><tr><th></th><td>none</td></tr><tr><td>no label</td><td>x</td></tr></tbody></table>
<table><tr><th>Later</th><td>not own</td></tr></table>
<h3>Household</h3><table><tr><th>Name</th><th>Sex</th></tr><tr><th><a href="/p/1">Tom Lee</a> Head</th><td>M</td><td>40</td><td>Ohio</td><td></td></tr><tr><td><table><tr><th>Job</th><td>Smith<i style="display:none">Smyth</i></td></tr></table></td></tr>
<tr><th>Eve Lee</th><td>Wife</td><td>F</td><td>38</td><td>Kent</td><td></td></tr></table><h3>Document Information</h3><table><tr><th>Film</th><td>77</td></tr></table></main></body></html>"""


def test_record_page():
    want = [
        {"kind": "head", "section": "Ohio Births", "name": "Ann Lee"}, {"kind": "mentioned", "name": "Tom", "url": "/s"}, {"kind": "field", "label": "Event Date", "value": "1 May 1900"},
        {"kind": "alternate", "label": "Event Date", "value": "1900"}, {"kind": "alternate", "label": "Event Date", "value": "May 1900"},
        {"kind": "member", "n": 1, "section": "Household", "label": "M", "value": "40", "name": "Tom Lee", "role": "Head", "birth": "Ohio", "url": "/p/1"}, {"kind": "member field", "n": 1, "label": "Job", "value": "Smith"},
        {"kind": "member alternate", "n": 1, "label": "Job", "value": "Smyth"}, {"kind": "member", "n": 2, "section": "Household", "label": "F", "value": "38", "name": "Eve Lee", "role": "Wife", "birth": "Kent"},
        {"kind": "document", "label": "Film", "value": "77"},
    ]
    assert kept(readers.record(RECORD)) == want
    assert list(readers.record(None)) == [] and list(readers.record("<table><tr><td>" * 5000)) == []


LINES = ["0 HEAD", "1 CHAR UTF-8", "0 @I1@ INDI", "1 NAME Ann /Lee/", "2 NICK é", "1 NAME Nan", "1 SEX F", "1 BIRT", "2 DATE 1 MAY 1900", "2 PLAC Ohio", "2 SOUR @S1@", "3 PAGE p. 3", "3 _APID 1:2", "3 DATA", "4 WWW http://x", "1 BIRT", "2 DATE 1 MAY 1900",
         "2 PLAC Ohio", "1 NOTE long", "2 CONC er", "2 CONT 0 not a level", "1 OBJE @M1@", "1 FAMS @F1@", "junk", "", "0 @I2@ INDI", "1 NAME /Fox/", "1 OBJE", "2 FILE b.jpg", "0 @F1@ FAM", "1 HUSB @I2@", "1 WIFE @I1@", "1 CHIL @I9@", "1 MARR", "0 @S1@ SOUR", "1 TITL Book", "0 @M1@ OBJE", "1 FILE a.jpg", "1 TITL Stone", "0 TRLR"]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_record_once(spark, tmp_path, end, size):
    raw = end.join(LINES).encode()
    (tmp_path / "a.ged").write_bytes(raw)
    reader = lineage._Reader({"path": str(tmp_path / "a.ged"), "rangebytes": str(size)})
    parts = reader.partitions()
    assert len(parts) == -(-len(raw) // size)
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    place = {n: k for k, n in enumerate(r[2] for r in got)}
    assert [(place[r[1]], place[r[2]], place.get(r[3]), *r[4:]) for r in got] == [tuple(n) for n in gedcom.nodes(raw.decode())]


def test_chunks_do_not_cut_lines(monkeypatch, tmp_path):
    monkeypatch.setattr(lineage, "_CHUNK", 3)
    (tmp_path / "a.ged").write_bytes("\r\n".join(LINES).encode())
    reader = lineage._Reader({"path": str(tmp_path), "rangebytes": "50"})
    got = [r["tag"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == [n[5] for n in gedcom.nodes("\n".join(LINES))]


def test_source_reads_folders_and_other_sets(spark, tmp_path):
    (tmp_path / "a.ged").write_bytes(b"\xef\xbb\xbf" + "\n".join(LINES).encode())
    (tmp_path / "b.ged").write_bytes("\n".join(LINES).encode("utf-16"))
    (tmp_path / "c.ged").write_bytes("0 HEAD\n1 CHAR ANSI\n0 @I1@ INDI\n1 NAME Zoë /Lee/".encode("cp1252"))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / "d.ged").write_bytes(b"")
    tree = lineage.scan(spark, str(tmp_path), 40)
    assert tree.rdd.getNumPartitions() > 10
    n = {r["path"][-5:]: r["n"] for r in tree.groupBy("path").agg(F.count("*").alias("n")).collect()}
    whole = len(gedcom.nodes("\n".join(LINES)))
    assert n == {"a.ged": whole, "b.ged": whole, "c.ged": 4}
    assert [r["value"] for r in tree.where("tag = 'NAME'").where(F.endswith("path", F.lit("c.ged"))).collect()] == ["Zoë /Lee/"]


def test_import_tables(spark, tmp_path):
    (tmp_path / "a.ged").write_text("\n".join(LINES))
    tree = Scratch(spark).table(lineage.scan(spark, str(tmp_path / "a.ged"), 30))
    m = lineage.import_tables(tree)
    got = {k: v.collect() for k, v in m.items()}
    person = {r["xref"]: r["id"] for r in got["persons"]}
    assert {(r["xref"], r["sex"], r["display_name"]) for r in got["persons"]} == {("I1", "F", "Ann Lee"), ("I2", None, "Fox")}
    assert {(r["written"], r["given"], r["surname"], r["is_primary"]) for r in got["names"]} == {("Ann /Lee/", "Ann", "Lee", True), ("Nan", "Nan", None, False), ("/Fox/", None, "Fox", True)}
    family = got["families"][0]["id"]
    assert {(r["family"], r["role"]) for r in got["members"]} == {(family, "partner"), (family, "child")} and len(got["members"]) == 3
    events = {(r["owner"], r["type"], r["place"], r["date"]["start"] if r["date"] else None): r["id"] for r in got["events"]}
    assert set(events) == {(person["I1"], "Birth", "Ohio", "1900-05-01"), (family, "Marriage", None, None)}
    # The two births written alike are one event with two statements: what cites the book, and the file's own.
    birth = events[person["I1"], "Birth", "Ohio", "1900-05-01"]
    assert sorted((r["event"] == birth, r["source"] or "", r["page"] or "", r["record"] or "") for r in got["statements"]) == [(False, "", "", ""), (True, "", "", ""), (True, "S1", "p. 3", "1:2")]
    assert [(r["title"], r["url"]) for r in got["citations"]] == [("Book", "http://x")]
    assert {(r["owner"], r["file"], r["title"]) for r in got["media"]} == {(person["I1"], "a.jpg", "Stone"), (person["I2"], "b.jpg", None)}
    again = lineage.import_tables(lineage.scan(spark, str(tmp_path / "a.ged")))
    assert {r["id"] for r in again["statements"].collect()} == {r["id"] for r in got["statements"]}
    assert all(v.count() == 0 for v in lineage.import_tables(tree.where("false")).values())


FIELD = "page long, n int, label string, value string, alternate boolean, fact string"


def test_labels_are_mapped_row_by_row(spark):
    f = spark.createDataFrame([("Birth Date", "1900"), ("Birth Date", "1900"), (" SEX ", "F"), ("Odd", "x"), (None, "y")], "label string, value string")
    got = sorted(map(repr, (tuple(r) for r in fields.map_labels(f).collect())))
    assert got == sorted(map(repr, [("Birth Date", "1900", "Birth", "date")] * 2 + [(" SEX ", "F", "Sex", "value"), ("Odd", "x", "Unknown", "value"), (None, "y", "Unknown", "value")]))


def test_field_facts(spark):
    rows = [
        (1, 1, "Name", "Ann Lee"), (1, 2, "Birth Date", "1 May 1900"), (1, 3, "Birth Place", "Ohio"), (1, 4, "Place of Birth", "Kent"), (1, 5, "Event Type", "Census"), (1, 6, "Event Date", "1920"), (1, 7, "Event Place (Original)", "Troy"),
        (1, 8, "Home in 1915", "Same house"), (1, 9, "Odd", "x"), (1, 10, "Odd", "x"), (1, 11, "Father's Name", "Tom"), (1, 12, "Residence Date", "1918"), (1, 13, "Occupation", " "), (2, 1, "Birth Year (Estimated)", "about 1899-1900"), (2, 2, "Event Date", "10:30 AM"), (2, 3, None, "x"), (2, 4, "Sex", None),
    ]
    beneath = [(1, 20, "Birth Date", "1 May, 1900"), (1, 21, "Birth Date", "2 May 1900"), (1, 22, "Father", "Thomas"), (1, 23, "Odd", "X!"), (1, 24, "Odd", "z")]
    f = spark.createDataFrame([(*r, False, "clash") for r in rows] + [(*r, True, "clash") for r in beneath] + [(3, 1, "Age", "4", None, "clash")], FIELD)
    got = {(r["page"], r["fact"], r["value"], r["date"], r["place"], tuple(r["labels"]), r["alternate"]) for r in fields.field_facts(f).collect()}
    assert got == {
        (1, "Name", "Ann Lee", None, None, ("Name",), False), (1, "Birth", None, "1 May 1900", "Ohio", ("Birth Date", "Birth Place"), False), (1, "Birth", None, None, "Kent", ("Place of Birth",), False),
        (1, "Residence", None, "1920", "Troy", ("Residence Date", "Residence Place"), False), (1, "Residence", None, "1915", "Troy", ("Home in 1915", "Home in 1915"), False), (1, "Residence", None, "1918", None, ("Residence Date",), False),
        (1, "Unknown", "Odd: x", None, None, ("Odd",), False), (1, "Birth", None, "2 May 1900", "Ohio", ("Birth Date",), True), (1, "Unknown", "Odd: z", None, None, ("Odd",), True),
        (2, "Birth", None, "CAL 1899", None, ("Birth Year (Estimated)",), False), (2, "Unknown", "Event Date: 10:30 AM", None, None, ("Event Date",), False), (3, "Age", "4", None, None, ("Age",), False),
    }
    assert fields.field_facts(f).where("value = 'Odd: x'").count() == 2  # repeats stay
    assert [tuple(r) for r in fields.relatives(f).collect()] == [(1, "father", "Tom", ["Thomas"])]
    timed = fields.field_facts(f, default_type="Death").where("page = 2 AND fact = 'Unknown'").collect()
    assert [r["value"] for r in timed] == ["Death Time: 10:30 AM"]
    assert fields.field_facts(f.where("false")).count() == 0


def test_snapshot_finds_a_flipped_byte(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    df = spark.range(300).select("id", (F.col("id") % 3).alias("p"), F.lit(None).cast("string").alias("empty"))
    df = df.union(spark.createDataFrame([(900, None, "x"), (900, None, "x")], df.schema))
    assert {(r["part"], r["n"], r["state"]) for r in snapshot.write_snapshot(df, root, "p").collect()} == {("0", 100, "new"), ("1", 100, "new"), ("2", 100, "new"), ("__HIVE_DEFAULT_PARTITION__", 2, "new")}
    assert {r["state"] for r in snapshot.verify(spark, root).collect()} == {"ok"}
    assert sorted(map(repr, snapshot.read_snapshot(spark, root).collect())) == sorted(map(repr, df.collect()))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s/data").rglob("*.parquet")}
    new = df.where("NOT p <=> 2 AND NOT (id = 4)")  # a part gone, a row gone
    assert {r["part"]: r["state"] for r in snapshot.write_snapshot(new, root, "p").collect()} == {"0": "same", "1": "changed", "2": "gone", "__HIVE_DEFAULT_PARTITION__": "same"}
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "s/data").rglob("*.parquet")}
    assert {f: m for f, m in after.items() if "part__=1" not in str(f)} == {f: m for f, m in before.items() if "part__=0" in str(f) or "HIVE" in str(f)}
    assert sorted(map(repr, snapshot.read_snapshot(spark, root).collect())) == sorted(map(repr, new.collect()))
    files = sorted(f for f in after if "part__=0" in str(f))
    raw = bytearray(files[0].read_bytes())
    raw[len(raw) // 2] ^= 1
    files[0].write_bytes(bytes(raw))
    other = next(f for f in after if "part__=1" in str(f))
    other.rename(other.with_name("other.parquet"))
    for f in files[0].parent.glob(".*.crc"):
        f.unlink()
    states = [r["state"] for r in snapshot.verify(spark, root).collect() if r["state"] != "ok"]
    assert sorted(states) == ["damaged", "missing", "unlisted"]


RUN = "step long, source int, ts timestamp, id long, outcome string, asked string"


def test_run_log_takes_up_after_a_stop(spark, tmp_path):
    inbox, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    row = lambda step, day, i, outcome, asked="q": (step, 1, f"2020-01-{day:02}", i, outcome, asked)
    batches = [[row(1, 5, 1, "found"), row(2, 1, 2, "none"), (None, 1, "2020-01-01", 9, "found", "q")], [row(1, 6, 3, "reopen"), row(1, 3, 4, "none"), row(2, 1, 5, "found", "w")], [row(1, 7, 6, "found", "z"), row(3, 1, 7, "error")], []]
    frame = lambda rows: spark.createDataFrame([(a, b, None, i, o, q) for a, b, _, i, o, q in rows], RUN).withColumn("ts", F.element_at(F.create_map(F.lit(-1), F.lit("2020-01-01"), *[F.lit(x) for _, _, t, i, _, _ in rows for x in (i, t)]), F.col("id").cast("int")).cast("timestamp"))
    want = [
        {1: ("found", "q", "done", False, 1), 2: ("none", "q", "planned", False, 1)},
        {1: ("found", "q", "planned", True, 3), 2: ("found", "w", "done", False, 2)},
        {1: ("found", "z", "done", False, 4), 2: ("found", "w", "done", False, 2), 3: (None, None, "planned", False, 1)},
    ]
    want.append(want[-1])
    for k, rows in enumerate(batches):  # each is a query of its own: stopped, and started again on the same checkpoint
        if rows:
            frame(rows).coalesce(1).write.mode("append").parquet(inbox)
        runs.log_runs(spark.readStream.schema(RUN).parquet(inbox), out, mark).awaitTermination()
        got = {r["step"]: (r["outcome"], r["asked"], r["status"], r["again"], r["runs"]) for r in runs.latest_states(spark, out).collect()}
        assert got == want[k], k


def test_people_resume_exactly_once(spark, tmp_path):
    inbox, out, mark, waiting = (f"{tmp_path}/{x}" for x in ("in", "out", "mark", "waiting"))
    spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12), (3, 12)], "person long, page long").write.parquet(waiting)
    say = lambda *pages: spark.createDataFrame([(p,) for p in pages], "page long").coalesce(1).write.mode("append").parquet(inbox)
    run = lambda: runs.resume_waiting(spark.readStream.schema("page long").parquet(inbox), waiting, out, mark).awaitTermination()
    say(11, 11, None, 99)
    run()
    say(10, 11)
    run()
    run()
    got = sorted((r["batch"], r["person"], r["n_came"], r["n_open"]) for r in spark.read.parquet(f"{out}/people").collect())
    assert got == [(0, 1, 1, 1), (0, 2, 1, 0), (1, 1, 1, 0)]
    # A failure after the batch wrote and before it was noted: the batch comes again and gives the same.
    (next((tmp_path / "mark/commits").glob("1"))).unlink()
    for f in (tmp_path / "mark/commits").glob(".1*"):
        f.unlink()
    run()
    assert got == sorted((r["batch"], r["person"], r["n_came"], r["n_open"]) for r in spark.read.parquet(f"{out}/people").collect())


def test_block_ratio_is_that_of_the_recursive_algorithm(spark):
    g = random.Random(2)
    word = lambda: "".join(g.choice("abc é0") for _ in range(g.randrange(0, 12)))
    pairs = [(k, word(), word()) for k in range(10_000)]
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    got = {r["k"]: r["r"] for r in df.select("k", places.block_ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    want = {k: SequenceMatcher(None, a, b).ratio() for k, a, b in pairs}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want if pairs[k][1] or pairs[k][2])
    kept_ = {r["k"] for r in df.where(places.block_ratio(F.col("a"), F.col("b"), 0.7).isNotNull()).collect()}
    assert kept_ == {k for k, r in want.items() if r >= 0.7 and (pairs[k][1] or pairs[k][2])} or kept_ == {k for k, r in want.items() if r >= 0.7}
    near = spark.createDataFrame([("North Hampton", "Northampton"), ("Troy", "Kent"), (None, "x")], "a string, b string").select(places.near_name(F.col("a"), F.col("b"), blocks=True).alias("n"))
    assert [r["n"] for r in near.collect()] == [True, False, False]


def test_granular_places_and_whole_names(spark):
    p = spark.createDataFrame([("New York City, New York", "New York < New York < New York < USA"), ("Troy, Ohio", "Troy < Kent County < Ohio"), ("Kent, Ohio", "Troy < Kent < Ohio")], "a string, b string")
    assert [r[0] for r in p.select(places.same_granular(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    pairs = [("Y J", "Y.J.", True), ("John Y Lee", "John Young Lee", True), ("John A Lee", "John B Lee", False), ("Lee, John", "John Lee", True), ("John Harris", "John Haris", True), ("Jon Lee", "John Lee", False), ("John", "John Lee", False), (None, "x", False), ("!", "!", False)]
    got = spark.createDataFrame(pairs, "a string, b string, ok boolean").withColumn("is", names.names_agree(F.col("a"), F.col("b"))).collect()
    assert [(r["a"], r["b"], r["is"]) for r in got] == pairs
