"""Event fold, scans, listings, names and places as written, created persons and cards."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from provenir.functions import names, places
from provenir.operators import folds, records
from provenir.sources import pages, scans

DATE = "struct<start:string,end:string,qualifier:string>"
EVENT = f"owner int, type string, once boolean, id int, date {DATE}, place string, value string, owner_axes array<string>, rule_axes array<string>, accepted int, statements int, held array<{DATE}>"


def day(text, q="exact"):
    return (text, None, q) if text else None


def plain_fold(events):
    """The rule one event after another; places are single words here, dates plain or about."""
    near = lambda d: d[2] == "about"
    one_place = lambda a, b: not a or not b or a == b
    one_date = lambda a, b: bool(a and b) and (a[0].startswith(b[0]) or b[0].startswith(a[0])) and "before" not in (a[2], b[2])

    def agrees(a, b):
        if len(a[0]) == len(b[0]) == 10:
            return a[0] == b[0]
        if near(a) or near(b):
            return abs(int(a[0][:4]) - int(b[0][:4])) <= 2
        return one_date(a, b)

    out, owners = [], {}
    for e in events:
        if e[0] is not None:
            owners.setdefault((e[0], e[1]), []).append(e)
    for (owner, kind), es in owners.items():
        groups = []
        for e in sorted(es, key=lambda e: (not e[7], not e[8], -(e[9] or 0), -(e[10] or 0), e[3])):
            same = lambda m: one_place(m[5], e[5]) and (m[6] or "") == (e[6] or "") and (e[2] or one_date(m[4], e[4]))  # noqa: E731, B023
            g = next((g for g in groups if all(same(m) for m in g)), None)
            groups.append([e]) if g is None else g.append(e)
        for g in groups:
            if len(g) < 2:
                continue
            k, decided, refused = g[0], {*(g[0][7] or []), *(g[0][8] or [])}, sum(bool(e[7]) for e in g) > 1
            date, place, held = k[4], k[5], list(k[11] or [])
            for m in g[1:] if not refused else []:
                held += m[11] or []
                bad = m[4] and any(not agrees(h, m[4]) for h in held)
                if m[4] and "date" not in decided and not bad:
                    fuller = not date or (agrees(m[4], date) and (len(m[4][0]), not near(m[4])) > (len(date[0]), not near(date)))
                    date = m[4] if fuller else date
                place = place or (m[5] if "place" not in decided else None)
            out.append((owner, kind, k[3], len(g), refused, date and date[0], place))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_against_the_plain_rule(spark, seed):
    r = random.Random(seed)
    said = ["1900", "1901", "1900-03", "1900-03-07", "1900-04", "1901-05-02", None]
    pick = lambda: day(r.choice(said), r.choice(["exact", "exact", "about"]))
    events = []
    for i in range(400):
        once = r.random() < 0.5
        held = [d for d in (pick() for _ in range(r.choice([0, 0, 1]))) if d]
        axes = lambda p: r.sample(["date", "place"], 1) if r.random() < p else r.choice([[], None])
        events.append((r.choice([*range(25), None]), "Birth" if once else "Residence", once, i, pick(), r.choice(["Salem", "Boston", None, " ", "Salem"]) or None, r.choice([None, "", "", "x"]), axes(0.1), axes(0.1), r.choice([None, 0, 1, 2]), r.choice([1, 2]), held or None))
    events = [(*e[:5], (e[5] or "").strip() or None, *e[6:]) for e in events]
    df = spark.createDataFrame(events, EVENT)
    got = [(x.owner, x.type, x.kept, x.n, x.refused, x.date and x.date.start, x.place) for x in folds.fold_events(df, ["owner"]).collect()]
    assert sorted(got, key=repr) == plain_fold(events)
    assert len(got) > 30


def test_fold_edges(spark):
    none = (None,) * 5
    rows = [(1, "Birth", True, 1, None, "USA", *none, None), (1, "Birth", True, 2, None, "USA", *none, None), (1, "Birth", True, 3, day("1900"), None, *none, None), (2, "Residence", False, 4, None, None, *none, None), (2, "Residence", False, 5, None, None, *none, None)]
    (one,) = folds.fold_events(spark.createDataFrame(rows, EVENT), ["owner"]).collect()
    assert (one.kept, one.n, one.date.start, one.place) == (1, 2, "1900", "USA")  # two countries alone are not one place, and undated residences not one event
    assert folds.fold_events(spark.createDataFrame([], EVENT), ["owner"]).count() == 0


def test_first_fit_is_not_transitive(spark):
    df = spark.createDataFrame([([1, 3, 2, 5],), ([],)], "x array<int>")
    got = [r.g for r in df.select(folds.first_fit(F.col("x"), lambda a, b: F.abs(a - b) <= 1).alias("g")).collect()]
    assert got == [[[1, 2], [3], [5]], []]


def test_names_as_written(spark):
    rows = [("John Alan Doe Jr",), ("Doe, John A",), ('John "Jack" Doe',), ("Madonna",), ("Jr",), ("",), (None,), ("Rob't O'Connell III",), ("Dr. Mary Roe",)]
    df = spark.createDataFrame(rows, "s string").select(names.split_name(F.col("s")).alias("n"), names.key_words(F.col("s")).alias("w"))
    got = [(tuple(r.n), r.w) for r in df.collect()]
    assert [g[0] for g in got] == [("John Alan", "Doe", "Jr"), ("John A", "Doe", None), ("John Jack", "Doe", None), ("Madonna", None, None), ("Jr", None, None), (None, None, None), (None, None, None), ("Rob't", "O'Connell", "III"), ("Dr. Mary", "Roe", None)]
    assert got[2][1] == ["john", "doe"] and got[8][1] == ["mary", "roe"] and got[0][1] == ["john", "alan", "doe"]


def test_why_a_written_name_differs(spark):
    cases = [("John Doe", False, "detail"), ("John Doe P412", False, "context_glue"), ("John Roe", True, "married_name"), ("John Dow", False, "typo"), ("J Doe", False, "abbreviation"), ("Bill Doe", False, "unclassified"), ("Jon Doe", False, "typo"), ("John Quincy Doe", False, "detail"), ("John Vandoelen", False, "detail"), ("John Smith", None, "unclassified")]
    df = spark.createDataFrame(cases, "w string, m boolean, k string")
    name = F.struct(F.lit("John").alias("given"), F.lit("Doe").alias("surname"), F.lit("Jr").alias("suffix"))
    assert [r.g for r in df.select(names.written_kind(F.col("w"), name, F.col("m")).alias("g")).collect()] == [c[2] for c in cases]


def test_place_notes(spark):
    rows = [("Northampton, Massachusetts", "Northampton < Hampshire < Massachusetts", "agrees", None), ("North Hampton, Massachusetts", "Northampton < Hampshire < Massachusetts", "disagrees", None), ("Village of Lindenhurst, Suffolk, New York", "Lindenhurst < Babylon < Suffolk < New York", "agrees", "granular"), (None, "Salem", "absent", None), ("Ogau Tonan", "Morioka < Iwate", "agrees", "dated"), ("Tonanu", "Morioka < Iwate", "disagrees", None), ("Kings County", "New York", "agrees", "supplied"), ("Kings County, Ohio", "New York", "disagrees", None)]
    df = spark.createDataFrame(rows, "a string, b string, v string, n string")
    got = df.select(places.full_place_verdict(F.col("a"), F.col("b"), F.lit("New York"), F.array(F.lit("Tonan"))).alias("x")).collect()
    assert [r.x.verdict for r in got] == [r[2] for r in rows]
    assert [r.x.note for r in got[1:]] == [r[3] for r in rows[1:]]


def test_scans(spark):
    hit = '{"results":[{"scheduleId":"1","names":["A"],"highlight":"x"}]}'
    texts = ['{"results":[{"scheduleId":"1","names":["A","B"]}]}', hit, '{"p1":{"full_text":"words"}}', '[{"profile":{"Name":"Doe-1"}}]', '{"ia":"i","q":"x","matches":[{"text":"<b>a</b>","par":[{"page":1}]},{"text":"c","par":[{"page":2}]}]}', "{}", "[]", "no json", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r.scan for r in scans.json_scan(df, "text").orderBy("id").collect()]
    assert [g.kind for g in got] == ["schedule", None, "page_text", "profile", "inside", None, None, None, None, None]
    assert got[0].names == ["A", "B"] and got[2].full_text == "words" and got[3].name == "Doe-1" and got[4].full_text == "a\nc"
    some = scans.json_scan(df.withColumn("pages", F.array(F.lit(2).cast("long"))), "text").where("id = 4").first()
    assert some.scan.full_text == "c"
    files = [(1, 'a,b\r\nx,"1,2"\r\nX ,3\n\n'), (2, "a,b\nx,1\ny,2"), (3, "b,a\nx,1"), (4, "a,b"), (5, None), (6, "")]
    rows = scans.delimited_scan(spark.createDataFrame(files, "k int, t string"), "k", "t", ["a", "b"], "a").orderBy("seq").collect()
    assert [(r.k, r.seq, r.row.b) for r in rows] == [(1, 1, "1,2"), (1, 2, "3")]
    wide = [(1, "DOE 01\nDOE   "), (2, "DOE 01\nother line"), (3, "DOE 01\nROE 02"), (4, None)]
    rows = scans.fixed_scan(spark.createDataFrame(wide, "k int, t string"), "k", "t", [("n", 1, 4), ("x", 5, 2)], r"[A-Z]{3} [\d ]{2}", "n").orderBy("seq").collect()
    assert [(r.k, r.seq, r.row.n, r.row.x) for r in rows] == [(1, 1, "DOE", "01"), (1, 2, "DOE", None)]


def test_listing_and_hidden_text(spark):
    html = [
        "<table><tr><th>Name<th>Born<tr><td>A <b>B</b><td>1900<tr><td>C</table><table><tr><td>x<td>y</tr></table>",
        "<div><p hidden>secret</div>seen<div style='display: none'><div>a</div>b</div>c<embed>d",
        "", None,
    ]
    df = spark.createDataFrame([(k, "http://h.example/", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    got = [(r.page_id, r.row, r.cells) for r in pages.listings(df).collect()]
    assert got == [(0, 0, {"Name": "A B", "Born": "1900"})]
    assert {r.page_id: r.text_length for r in pages.extract(df).collect()}[1] == len("seencd")


def test_creates_and_cards(spark):
    tie = lambda k, w, acc=True, comp=False, res=False: (k, w, acc, comp, res)
    cases = [
        (False, "T1 register", False, "John Doe", True, False, [tie("child", "Son")], "stated"), (False, "T3", True, "John Doe", True, True, [tie("child", None)], "stands"), (True, "T1", False, "John Doe", True, False, [tie("child", "Son")], "anyone edits the page"),
        (None, "T3", False, "John Doe", True, False, None, "tier"), (False, None, True, "John Doe", True, False, None, "tier"), (False, "T2", False, "Mr. John", True, False, [tie("child", "Son")], "no full name"), (False, "T2", False, "John D", True, False, None, "no full name"),
        (False, "T2", False, "John Doe", None, False, [tie("child", "Son")], "the matcher has not looked"), (False, "T2", False, "John Doe", True, False, [tie("other", "Father-in-law")], "no family relationship"), (False, "T2", False, "John Doe", True, False, [tie("other", "Father-in-law", res=True)], "stated"),
        (False, "T2", False, "John Doe", True, False, [tie("spouse", "Wife", comp=True)], "computed by the indexer"), (False, "T2", False, "John Doe", True, False, [tie("child", "Son", acc=False)], "related to nobody accepted"), (False, "T2", False, None, True, False, None, "no full name"),
    ]
    df = spark.createDataFrame(cases, "e boolean, t string, o boolean, n string, l boolean, m boolean, ties array<struct<kind:string,word:string,accepted:boolean,computed:boolean,resolved:boolean>>, why string")
    got = df.select(records.creates(*[F.col(c) for c in ("e", "t", "o", "n", "l", "m", "ties")]).alias("x")).collect()
    assert [r.x.why for r in got] == [c[7] for c in cases]
    assert reduce(lambda n, r: n + r.x.creates, got, 0) == 3
    p = spark.createDataFrame([(1, "x"), (2, "y")], "id int, findings_note string")
    f = spark.createDataFrame([(1, "date", "agrees")], "id int, axis string, verdict string")
    r = spark.createDataFrame([(1, k, k % 2) for k in range(6)], "id int, rival int, points int")
    a, b = records.cards(p, f, r, "id", 2).orderBy("id").collect()
    assert [tuple(x) for x in a.rivals] == [(1, 1), (3, 1)] and a.n_rivals == 6 and tuple(a.findings[0]) == ("date", "agrees")
    assert (b.findings, b.rivals, b.n_rivals, b.findings_note) == ([], [], 0, "y")
