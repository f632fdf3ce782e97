from pyspark.sql import functions as F

from provenir.functions import dates, kin, places
from provenir.operators import evidence, records
from provenir.session import Scratch
from provenir.sources import gedcom

TEXT = """0 HEAD
1 SOUR TREEPROG
2 NAME Branch Writer
2 CORP Example House
0 @S1@ SOUR
1 TITL Parish book
0 @I1@ INDI
1 NAME Ann /Low/
1 BIRT
2 DATE 1850
2 SOUR @S1@
3 PAGE 12
3 DATA
4 WWW http://example.org/12
1 SOUR @S2@
0 @F1@ FAM
1 SOUR @S1@
"""


def _tree(spark):
    rows = [("f", *r) for r in gedcom.nodes(TEXT)]
    return spark.createDataFrame(rows, gedcom.SCHEMA)


def test_citations_and_exporter(spark):
    tree = _tree(spark)
    got = {(r["source"], r["title"], r["page"], r["url"], r["record"]) for r in gedcom.citations(tree).collect()}
    assert got == {("S1", "Parish book", "12", "http://example.org/12", None), ("S2", None, None, None, None), ("S1", "Parish book", None, None, None)}
    assert {r["source"]: r["owners"] for r in gedcom.cited_records(tree).collect()} == {"S1": ["F1", "I1"], "S2": ["I1"]}
    registry = spark.createDataFrame([(3, "Other"), (5, "branch"), (7, "Example")], "id int, name string")
    assert [r["id"] for r in gedcom.exporter(tree, registry).collect()] == [5]
    assert [r["id"] for r in gedcom.exporter(tree, registry.where("id = 3")).collect()] == [None]
    assert gedcom.citations(tree.where("false")).count() == 0


def test_households(spark):
    rows = [(1, 1, 1, "a", True), (2, 1, 2, "b", False), (3, 1, 4, "a", False), (4, 1, 6, "c", False), (5, 1, 7, "a", True), (6, None, 3, "a", False), (7, 2, 1, None, None), (8, 2, 1, None, None)]
    e = spark.createDataFrame(rows, "id int, page int, line int, surname string, head boolean")
    of = records.households(e, Scratch(spark))
    assert dict(map(tuple, of.collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 7: 7, 8: 7}
    state = {r["household"]: (r["n"], r["has_head"], r["missing"], r["complete"]) for r in records.household_state(e, of).collect()}
    assert state == {1: (3, True, [3], False), 4: (1, False, [], False), 5: (1, True, [], True), 7: (2, False, [], False)}
    assert records.households(e.where("false"), Scratch(spark)).count() == 0


def test_withdraw_against_a_plain_loop(spark):
    import random

    g = random.Random(5)
    taken = list(range(60))
    grounds = [(g.randrange(60), g.choice([None, g.randrange(70), g.randrange(70)])) for _ in range(110)]
    for need in (1, 2):
        stands = set(taken)
        while True:
            after = {i for i in stands if sum(1 for a, b in grounds if a == i and (b is None or b in stands)) >= need}
            if after == stands:
                break
            stands = after
        got = records.withdraw(spark.createDataFrame([(i,) for i in taken], "id int"), spark.createDataFrame(grounds, "id int, rests_on int"), Scratch(spark), need)
        assert dict(map(tuple, got.collect())) == {i: i in stands for i in taken}


def test_kin_words(spark):
    p, c, s = "parent", "child", "spouse"
    cases = [([p], "F", "mother"), ([p] * 4, "M", "great-great-grandfather"), ([c] * 2, None, "grandchild"), ([p, c], "M", "brother"), ([p, p, c], "F", "aunt"), ([p, c, c, c], "M", "great-nephew"),
             ([p, p, c, c, c], "M", "first cousins once removed"), ([s], "F", "wife"), ([p, s], "F", "related by marriage"), ([c, p], "F", "related through a child"), ([], "F", None), ([p] * 13 + [c] * 13, None, "12th cousins")]
    df = spark.createDataFrame([(k, list(a), b) for k, (a, b, _) in enumerate(cases)], "n int, kinds array<string>, sex string")
    got = dict(map(tuple, df.select("n", kin.kin_words(F.col("kinds"), F.col("sex"))).collect()))
    assert got == {k: w for k, (_, _, w) in enumerate(cases)}


def test_near_names_and_scores(spark):
    rows = [("Hemp.", "Hempstead", True), ("Oak Hill", "Oak Hill Cemetery", True), ("Worchester", "Worcester", True), ("Oak", "Oak", False), ("Oak", "Elm", False), (None, "Elm", False), ("", "Elm", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(places.near_name(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(["oak", "kent"], "uk", "uk", 1.0), (["oak", "kent"], "uk", "us", 0.4), (["oak", "hill"], None, "us", 0.5), ([], None, "us", 0.0)], "c array<string>, k string, own string, want double")
    got = df.select(places.verify_score(F.col("c"), F.array(F.lit("oak"), F.lit("kent")), F.col("k"), F.col("own")).alias("s"), "want").collect()
    assert all(abs(r["s"] - r["want"]) < 1e-12 for r in got)


def test_sides_of_repeated_values(spark):
    df = spark.createDataFrame([("x", 1, 10), ("x", 2, 12), ("x", 3, 14), ("x", 4, 10), ("x", 5, None), (None, 6, 1), (None, 7, 1)], "k string, id int, v int")
    agree = lambda a, b: a["v"] is not None and b["v"] is not None and abs(a["v"] - b["v"]) <= 2
    got = {r["id"]: r["side"] for r in evidence.event_sides(df, ["k"], ["v"], "id", agree).collect()}
    assert got[1] == got[2] == got[4] == 0 and got[3] == 1 and got[5] == 2 and got[6] == got[7] == 0


def test_family_facts_of_spouses(spark):
    text = """0 @I1@ INDI
1 FAMS @F1@
1 MARR
2 DATE 4 May 1870
0 @I2@ INDI
1 FAMS @F1@
1 FAMS @F2@
1 MARR
2 DATE 4 May 1870
1 MARR
2 DATE 1880
1 MARR
2 DATE 1899
0 @F1@ FAM
1 MARR
2 DATE 4 May 1870
0 @F2@ FAM
1 MARR
2 DATE 1 Jun 1880
0 @I3@ INDI
1 MARR
"""
    tree = spark.createDataFrame([("f", *r) for r in gedcom.nodes(text)], gedcom.SCHEMA)
    got = {(r["owner"], r["date"]): r["said_by"] for r in gedcom.spouse_facts(tree).collect()}
    assert got == {("F1", "4 May 1870"): ["I1", "I2"], ("F2", "1 Jun 1880"): [], ("F2", "1880"): ["I2"], ("I2", "1899"): ["I2"], ("I3", None): ["I3"]}


def test_source_dates_and_districts(spark):
    df = spark.createDataFrame([("06/11/1946", "1810-06-25"), ("02-00-1915", "1863-00-00"), ("00/11/1946", "0000-00-00"), ("17/11/1946", "1863-05-00"), (None, None), ("x", "x")], "a string, b string")
    got = [tuple(r) for r in df.select(dates.month_first_date(F.col("a")), dates.zero_filled_date(F.col("b"))).collect()]
    assert got == [("1946-06-11", "1810-06-25"), ("1915-02", "1863"), ("1946", None), ("1946", "1863-05"), (None, None), (None, None)]
    df = spark.createDataFrame([("Oak, A.D. 01, E.D. 06-2B, Kent",), ("WARD 3, Skyward 9",), ("Ward 3, Ward 4",), (None,)], "p string")
    got = [r[0] for r in df.select(places.districts(F.col("p"))).collect()]
    assert got == [{"assembly_district": "01", "enumeration_district": "06-2B"}, {}, {"ward": "3"}, {}]
