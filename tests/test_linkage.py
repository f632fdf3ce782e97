"""Copies, candidate branches, merges, reconsideration and disagreements against plain versions, on small invented tables."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provenir.functions import names
from provenir.operators import copies, disagreements, matching, merging, reconsider
from provenir.session import Scratch

ENTRY = "record string, entry string, name string, role string, editable boolean, entry_id string, number string, year int"
WORD = "a string, b string, same boolean, at int, id int"


def found_copies(spark, entries, cited, words):
    got = copies.copies(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(cited, "record string, citation string"), spark.createDataFrame(words, WORD), Scratch(spark))
    return {r["node"]: (r["record"], r["n"]) for r in got.collect()}


def test_one_cut_edge_splits_a_chain(spark):
    """a-b by citation, b-c by another: one chain, until a person keeps b and c apart."""
    e = [(r, "", "Ann Lee", "own", False, None, None, None) for r in "abc"]
    cited = [("a", "x"), ("b", "x"), ("b", "y"), ("c", "y")]
    assert found_copies(spark, e, cited, []) == {k: ("a", 3) for k in "abc"}
    assert found_copies(spark, e, cited, [("c", "b", False, 1, 1)]) == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}
    # The last word counts, and a word joins across the tiers.
    assert found_copies(spark, e, cited, [("c", "b", False, 1, 1), ("b", "c", True, 2, 2)])["c"] == ("a", 3)


def test_a_cut_inside_a_group_leaves_other_ways(spark):
    """Three copies of one citation: a and b apart are still one record by way of c; two copies alone are not."""
    e = [(r, "", "Ann Lee", "own", False, None, None, None) for r in "abc"]
    cited = [(r, "x") for r in "abc"]
    assert found_copies(spark, e, cited, [("a", "b", False, 1, 1)]) == {k: ("a", 3) for k in "abc"}
    assert found_copies(spark, e[:2], cited[:2], [("a", "b", False, 1, 1)]) == {"a": ("a", 1), "b": ("b", 1)}
    assert found_copies(spark, e, cited, [(*p, False, 1, k) for k, p in enumerate(itertools.combinations("abc", 2))]) == {k: (k, 1) for k in "abc"}


def test_tiers_and_results_and_nulls(spark):
    e = [("a", "", "Ann Lee", "own", False, None, None, None), ("b", "", "Ann Lee", "own", True, None, None, None), ("c", "", "Ann Lee", "result", False, None, None, None),
         ("d", "", None, "own", False, None, None, None), (None, "", "Ann Lee", "own", False, None, None, None), ("f", "7", "Ann Lee", "own", False, None, "No. 012", 1900), ("g", "9", "Lee, Ann", "own", False, None, "12", 1900),
         ("h", "3", "Ann Lee", "own", False, None, "12", 1901), ("a", "", "Ann Lee", "own", False, None, None, None)]
    cited = [(r, "x") for r in "abcd"] + [("a", "x"), (None, "x"), ("a", None)]
    got = found_copies(spark, e, cited, [("a", None, True, 1, 1), ("a", "a", False, 1, 2)])
    assert got.pop("f@7") == got.pop("g@9") == ("f@7", 2)
    assert set(got.values()) == {(k, 1) for k in [*"abcdfgh", "h@3"]}
    assert found_copies(spark, [], [], []) == {}


def test_copies_against_all_pairs(spark):
    g = random.Random(3)
    name = lambda: " ".join(filter(None, [g.choice(["Ann", "Anna", "J"]), g.choice(["", "K", "Kay", "Mae"]), g.choice(["Harris", "Haris", "Keller", "Kellar"])]))
    rows = [(f"r{g.randrange(40):02}", str(k), name(), g.choice(["own", "own", "result"]), g.random() < 0.3, g.choice([None, "e1", "e2", "e3"]), g.choice([None, "No 1", "2"]), g.choice([1900, 1901])) for k in range(120)]
    tier = {}
    rows = [(*r[:4], tier.setdefault(r[0], r[4]), *r[5:]) for r in rows]
    cited = [(f"r{k:02}", f"c{g.randrange(12)}") for k in range(40) for _ in range(2)]
    words = [(f"r{g.randrange(40):02}", f"r{g.randrange(40):02}", g.random() < 0.3, k, k) for k in range(60)]
    pairs = list({(x[2], y[2]) for x in rows for y in rows})
    agree = {(r["a"], r["b"]): r["ok"] for r in spark.createDataFrame(pairs, "a string, b string").withColumn("ok", names.names_agree(F.col("a"), F.col("b"))).collect()}
    said = {}
    for a, b, same, _, _ in words:
        if a != b:
            said[frozenset((a, b))] = same
    cites = defaultdict(set)
    for r, c in cited:
        cites[r].add(c)
    links = {tuple(sorted(p)) for p, same in said.items() if same}
    for x, y in itertools.combinations([r for r in rows if r[3] != "result"], 2):
        if x[4] != y[4] or not agree[x[2], y[2]]:
            continue
        if (cites[x[0]] & cites[y[0]] or (x[5] and x[5] == y[5])) and x[0] != y[0] and said.get(frozenset((x[0], y[0]))) is not False:
            links.add(tuple(sorted((x[0], y[0]))))
        if x[6] and y[6] and x[6][-1] == y[6][-1] and x[7] == y[7]:
            links.add((f"{x[0]}@{x[1]}", f"{y[0]}@{y[1]}"))
    nodes = {r[0] for r in rows} | {f"{r[0]}@{r[1]}" for r in rows if r[6]} | {x for p in links for x in p}
    label = {n: n for n in nodes}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    got = found_copies(spark, rows, cited, words)
    assert {n: r for n, (r, _) in got.items()} == label


def test_decisions_carried_to_copies(spark):
    p = spark.createDataFrame([("p1", "a", "Ann Lee"), ("p2", "b", "Ann M Lee"), ("p3", "b", "Tom Lee"), ("p4", "c", "Ann Lee"), ("p5", "c", "Ann K Lee")], "persona string, node string, name string")
    found = spark.createDataFrame([(n, "a", 3) for n in "abc"], "node string, record string, n long")
    d = spark.createDataFrame([(1, "p1", "accepted"), (2, "p1", "rejected"), (2, "p2", "accepted"), (3, "p3", "undecided")], "person long, persona string, status string")
    got = sorted(map(tuple, copies.carried(d, p, found).collect()))
    # Two on c agree with Ann Lee, so none is; person 2 has a word of their own on p2, which agrees with p1 only by its own decision; p2 and p5 differ in the middle.
    assert got == [(1, "p2", "accepted", "p1"), (2, "p4", "accepted", "p2")]


@pytest.mark.parametrize("limit", [50_000, 3])
def test_candidates_against_all_pairs(spark, limit):
    g = random.Random(4)
    letter = lambda w: w if g.random() < 0.5 else (lambda k: w[:k] + g.choice("abcehr") + w[k + g.randrange(2) :])(g.randrange(len(w)))
    row = lambda k: (k, letter(g.choice(["Robert", "Bob", "Anna", "J", "Katherine", "William"])) if g.random() < 0.95 else None, letter(g.choice(["Harris", "Keller", "Brandt", "Moritz"])), g.choice([None, *range(1850, 1875)]))
    left = spark.createDataFrame([row(k) for k in range(150)], "id long, given string, surname string, birth int")
    right = spark.createDataFrame([(*row(k), g.choice([True, True, False, None])) for k in range(200)], "id long, given string, surname string, birth int, linked boolean")
    got = matching.candidates(left, right, limit=limit).select("l_id", "r_id").collect()
    a, b = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]), right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    near = F.coalesce(F.abs(F.col("l_birth") - F.col("r_birth")) <= 3, F.lit(True))
    fits = (names.same_surname(F.col("l_surname"), F.col("r_surname")) != "") & (names.same_given(F.col("l_given"), F.col("r_given")) | ~F.coalesce("r_linked", F.lit(False)))
    want = a.crossJoin(b).where(near & fits).select("l_id", "r_id").collect()
    assert sorted(got) == sorted(want) and len(want) > 300


def test_candidate_rows_follow_true_candidates(spark):
    """With ten times the persons over ten times the years, the join makes about ten times the rows, not a hundred."""
    def met(n):
        df = spark.range(n).select("id", F.lit("Anna").alias("given"), F.lit("Keller").alias("surname"), (F.col("id") % n).cast("int").alias("birth"), F.lit(True).alias("linked"))
        keys = F.array(F.lit("k"))
        return matching.ranged_pairs(df.drop("linked"), df, keys, keys, "birth", 3, F.lit(True)).count()

    assert met(1000) == 7 * 1000 - 12 and met(100) == 7 * 100 - 12


def test_branches_are_tagged(spark):
    e = spark.createDataFrame([(1, 10, "Ann", "Lee", 1900, "m1"), (2, 11, None, None, None, None)], "id long, record long, given string, surname string, birth int, identifier string")
    p = spark.createDataFrame([(5, "Ann", "Lee", 1901, True), (6, "Tom", "Roe", 1870, True), (7, "Zed", "Roe", 1850, True), (8, "Ann", "Lee", 1950, False)], "id long, given string, surname string, birth int, linked boolean")
    own = spark.createDataFrame([(10, 6), (10, 6), (None, 5), (11, 99)], "record long, person long")
    kin = spark.createDataFrame([(6, 7), (6, 6), (99, 7), (6, None)], "a long, b long")
    ids = spark.createDataFrame([(8, "m1"), (7, None)], "person long, identifier string")
    got = {(r["entry"], r["person"]): r["sources"] for r in matching.candidate_branches(e, p, own, kin, ids).collect()}
    assert got == {(1, 5): ["names"], (1, 6): ["record"], (1, 7): ["relative"], (1, 8): ["identifier"], (2, 7): ["relative"]}


def plain_reconsider(decisions, cards, grounds):
    order = {i: o for i, o, _ in decisions}
    need = {i: n or 1 for i, _, n in decisions} | {i: n or 1 for i, n in cards}
    fell, took, k = {}, {}, 0
    holds = lambda i: sum(r is None or (r in order and order[r] < order[i] and r not in fell) for j, r in grounds if j == i)
    while new := [i for i in order if i not in fell and holds(i) < need[i]]:
        fell |= dict.fromkeys(new, k)
        k += 1
    open_, stands, k = [i for i in need if i not in order or i in fell], set(order) - set(fell), 0
    while new := [i for i in open_ if i not in took and sum(r is None or r in stands or r in took for j, r in grounds if j == i) >= need[i]]:
        took |= dict.fromkeys(new, k)
        k += 1
    cause = lambda i, at, ok: min((r for j, r in grounds if j == i and at.get(r) == at[i] - 1 and ok(r)), default=None)
    out = []
    for i in need:
        outcome = ("retaken" if i in took else "withdrawn" if i in fell else "kept") if i in order else "taken" if i in took else "left"
        why = cause(i, took, lambda r: True) if i in took else cause(i, fell, lambda r: order[r] < order[i]) if i in fell else None
        out.append((i, outcome, took.get(i, fell.get(i)), why))
    return sorted(out)


def test_reconsider_against_plain(spark):
    for seed in range(3):
        g = random.Random(seed)
        n = 60
        decisions = [(k, g.randrange(50), g.choice([None, 1, 1, 2])) for k in range(n)]
        cards = [(k, g.choice([None, 1, 2])) for k in range(n, n + 20)]
        grounds = [(g.randrange(n + 20), g.choice([None, g.randrange(n + 20), g.randrange(n + 25)])) for _ in range(170)]
        got, _ = reconsider.reconsider(spark.createDataFrame(decisions, "id long, order int, need int"), spark.createDataFrame(cards, "id long, need int"), spark.createDataFrame(grounds, "id long, rests_on long"), Scratch(spark))
        assert sorted(map(tuple, got.collect())) == plain_reconsider(decisions, cards, grounds)


def test_rounds_touch_only_dependents(spark):
    """A chain of six that loses its foot beside a thousand that stand: each round touches one."""
    n = 1000
    decisions = spark.range(n).select("id", F.col("id").alias("order"), F.lit(1).alias("need"))
    grounds = spark.range(6, n).select("id", F.lit(None).cast("long").alias("rests_on")).union(spark.range(1, 6).select("id", (F.col("id") - 1).alias("rests_on")))
    got, trace = reconsider.reconsider(decisions, spark.createDataFrame([], "id long, need int"), grounds, Scratch(spark))
    assert got.where("outcome = 'withdrawn'").count() == 6
    fell = [r for r in trace if r["pass"] == "withdraw"]
    assert [r["touched"] for r in fell] == [1, 1, 1, 1, 1, 0] and [r["changed"] for r in fell] == [1, 1, 1, 1, 1, 0]


def tree(spark, **rows):
    kinds = {
        "persons": "id long, merged_into long", "links": "person long, persona long, status string, proposal long, decided_at string", "members": "family long, person long, role string",
        "aliases": "id long, person long, value string", "questions": "id long, person long, key string, status string", "steps": "id long, person long, step_key string", "runs": "id long, step long",
        "proposals": "id long, kind string, persons map<string,long>",
        "events": "id long, owner_kind string, owner long, type string, once boolean, accepted long, statements long, date struct<start:string,end:string,qualifier:string>, place string, value string, owner_axes array<string>, rule_axes array<string>, held array<struct<start:string,end:string,qualifier:string>>",
        "statements": "id long, subject_kind string, subject long, family long, role string, fact long, vouch boolean",
    }
    return merging.Tree(**{t: spark.createDataFrame(rows.get(t, []), k) for t, k in kinds.items()})


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_over_all_tables(spark):
    event = lambda i, kind, owner, acc, place=None: (i, kind, owner, "Birth" if kind == "person" else "Marriage", True, acc, acc, None, place, None, [], [], [])
    t = tree(
        spark,
        persons=[(1, None), (2, None), (3, None), (4, None), (9, 4)],
        links=[(1, 70, "undecided", 1, "a"), (2, 70, "accepted", 2, "b"), (3, 71, "rejected", 3, "c"), (9, 72, "accepted", 4, "d"), (4, 72, "rejected", 5, "e")],
        members=[(50, 1, "partner"), (50, 4, "partner"), (50, 8, "child"), (51, 3, "partner"), (51, 4, "partner"), (51, 8, "child"), (51, 7, "child"), (52, 4, "partner"), (53, 4, "partner")],
        aliases=[(1, 1, "Ann"), (2, 2, "Ann"), (3, 3, "Anny")],
        questions=[(1, 1, "gap:birth", "closed"), (2, 2, "gap:birth", "open"), (3, 3, "gap:death", "open"), (4, 1, "duplicate_person:2", "open"), (5, 1, "duplicate_person:7", "open")],
        steps=[(1, 1, "s"), (2, 2, "s"), (3, 3, "z")],
        runs=[(1, 2), (2, 3)],
        proposals=[(1, "person", {"person_id": 3, "other": 8}), (2, "duplicate_person", {"duplicate_person_id": 3})],
        events=[event(1, "person", 1, 1), event(2, "person", 2, 5), event(3, "person", 4, 0), event(4, "family", 50, 0), event(5, "family", 51, 2), event(6, "person", 8, 1), event(7, "person", 8, 1)],
        statements=[(1, "event", 1, None, None, 11, False), (2, "event", 2, None, None, 11, False), (3, "event", 1, None, None, 12, False), (4, "event", 1, None, None, None, True), (5, "person", 3, None, None, None, False), (6, "member", 3, 51, "partner", None, False)],
    )
    merges = spark.createDataFrame([(3, 2), (2, 1), (5, 5), (None, 1)], "dup long, kept long")
    m = merging.merge_tree(t, merges, Scratch(spark))
    assert taken(m.persons) == [(1, None), (2, 1), (3, 1), (4, None), (9, 4)]
    assert taken(m.links) == [(1, 70, "accepted", 2, "b"), (1, 71, "rejected", 3, "c"), (4, 72, "rejected", 5, "e")]
    # Families 50 and 51 have the same partners now, and so do 52 and 53, but nobody was merged into 4's own... who was, in an earlier merge.
    assert taken(m.members) == [(50, 1, "partner"), (50, 4, "partner"), (50, 7, "child"), (50, 8, "child"), (52, 4, "partner")]
    assert taken(m.aliases) == [(1, 1, "Ann"), (3, 1, "Anny")]
    assert taken(m.questions) == [(1, 1, "gap:birth", "closed"), (2, 2, "gap:birth", "answered"), (3, 1, "gap:death", "open"), (4, 1, "duplicate_person:2", "answered"), (5, 1, "duplicate_person:7", "open")]
    assert taken(m.steps) == [(2, 1, "s"), (3, 1, "z")] and taken(m.runs) == [(1, 2), (2, 3)]
    assert {r["id"]: r["persons"] for r in m.proposals.collect()} == {1: {"person_id": 1, "other": 8}, 2: {"duplicate_person_id": 3}}
    # The event with more accepted statements is kept, wherever it came from; what is folded away stays where it was. Person 8 was not touched.
    assert {r["id"]: r["owner"] for r in m.events.collect()} == {1: 1, 2: 1, 3: 4, 4: 50, 5: 50, 6: 8, 7: 8}
    assert {r["id"]: r["subject"] for r in m.statements.where("subject_kind = 'event'").collect()} == {1: 1, 2: 2, 3: 2, 4: 2}
    assert taken(m.statements.where("subject_kind <> 'event'").select("id", "subject", "family")) == [(5, 1, None), (6, 1, 50)]
    again = merging.merge_tree(m, merges, Scratch(spark))
    for name in ("persons", "links", "members", "aliases", "questions", "steps", "runs"):
        assert taken(getattr(again, name)) == taken(getattr(m, name)), name


def test_merges_in_a_circle_raise(spark):
    t = tree(spark, persons=[(1, None), (2, None)])
    with pytest.raises(RuntimeError):
        merging.merge_tree(t, spark.createDataFrame([(1, 2), (2, 1)], "dup long, kept long"), Scratch(spark))
    empty = merging.merge_tree(tree(spark), spark.createDataFrame([], "dup long, kept long"), Scratch(spark))
    assert all(getattr(empty, f).count() == 0 for f in ("persons", "links", "members", "events", "statements", "steps", "runs"))


def test_sides_of_a_disagreement(spark):
    e = spark.createDataFrame([(1, "N1, AFRICA"), (2, None), (3, "X")], "event long, place string").withColumn("value", disagreements.place_value(F.col("place")))
    rows = [(1, "4", 1, True, "AFRICA"), (1, "42", 2, True, "N2, AFRICA"), (1, "7", 3, False, "N1, AFRICA"), (1, "9", 4, True, "ASIA"), (1, "10", 5, False, "ASIA"), (2, "a", 1, True, "P, Q"), (2, "b", 2, False, "R, Q"), (2, "c", 3, False, "Q"), (3, "u", 1, False, "Y")]
    v = spark.createDataFrame(rows, "event long, record string, first int, accepted boolean, place string").withColumn("value", disagreements.place_value(F.col("place")))
    got = {(r["event"], tuple(r["a"]), tuple(r["b"])) for r in disagreements.disagreements(v, e, disagreements.place_verdict, True).collect()}
    # AFRICA is a part of both places, so it disagrees with neither; it is on a side only by its quarrel with ASIA. An undecided value alone raises nothing.
    tree_side = ("4", "7", None)
    assert got == {(1, tree_side, ("42",)), (1, ("10", "9"), ("42",)), (1, tree_side, ("10", "9")), (2, ("a",), ("b",))}


def test_record_values(spark):
    d = lambda s: None if s is None else (s, None, "exact")
    rows = [(1, "a", 1, "1", "undecided", False, False, True, d("1900"), " "), (1, "a2", 2, "2", "accepted", None, None, None, d("1900-05"), "P"), (1, "b", 3, "3", "accepted", True, False, True, d("1800"), "Z"), (1, "c", 4, "4", "rejected", False, False, True, d("1801"), "Z"),
            (1, "e", 5, "5", "accepted", False, True, True, d("1802"), "Z"), (1, "f", 6, "6", "accepted", False, False, False, d("1803"), "Z"), (None, "g", 7, "7", "accepted", False, False, True, d("1804"), "Z"), (1, "h", 8, "8", "accepted", False, False, True, None, None)]
    st = spark.createDataFrame(rows, f"event long, node string, id int, at string, status string, marked boolean, withdrawn boolean, own_type boolean, date {disagreements.DATE}, place string")
    held = spark.createDataFrame([("a", "a"), ("a2", "a")], "node string, record string")
    got = {r["record"]: (r["accepted"], r["date"] and r["date"]["start"], r["place"]) for r in disagreements.record_values(st, held).collect()}
    assert got == {"a": (True, "1900-05", "P"), "h": (True, None, None)}
