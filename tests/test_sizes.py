"""Queries over small invented tables that show what only larger ones show, against their SQL or a plain version."""

import datetime
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provenir.operators import disagreements, matching
from provenir.plans import linkage
from provenir.sources import fields, readers

TESTDATA = "/root/testdata/sf0.001"


def as_sql(spark, tmp_path, name, tables, dims=()):
    """Both results of a query over ``tables``, as sorted rows; ``dims`` are taken from the smallest tables."""
    for t, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.table(rows), tmp_path / f"{t}.parquet")
    for t in dims:
        pq.write_table(pq.read_table(f"{TESTDATA}/{t}.parquet"), tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    for t in [*tables, *dims]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    show = lambda r: repr([r[c] if r[c] is None or isinstance(r[c], (str, bool)) else float(r[c]) for c in sorted(cols)])
    want = sorted(show(dict(zip(cols, r, strict=True))) for r in cur.fetchall())
    df = entry.queries()[name](spark, str(tmp_path))
    assert sorted(df.columns) == sorted(cols)
    return sorted(show(r.asDict()) for r in df.collect()), want


def test_kin_words_beyond_those_of_the_sql(spark, tmp_path):
    """orders with so many lines that cousins are beyond the tenth degree, or removed more than eight times."""
    lines = [(o, f) for o in (2, 3, 4, 5, 7, 11, 12, 18) for f in "A" * {2: 2, 3: 12, 4: 11, 5: 2, 7: 2, 11: 2, 12: 14, 18: 1}[o] + "N" * {2: 11, 3: 12, 4: 11, 5: 10, 7: 12, 11: 30, 12: 13, 18: 20}[o]]
    got, want = as_sql(spark, tmp_path, "q_kin_words", {"lineitem": {"l_orderkey": pa.array([o for o, _ in lines], pa.int64()), "l_returnflag": [f for _, f in lines]}})
    assert got == want and sum("None" in x for x in want) == 3


def test_nearest_event_in_rounded_seconds(spark, tmp_path):
    """seconds are rounded, halves to even, not cut off."""
    day = datetime.datetime(2024, 1, 1)
    at = lambda s: day + datetime.timedelta(microseconds=round(s * 1e6))
    rows = [(1, "signup", 10.0), (1, "purchase", 8.6), (1, "purchase", 11.4), (2, "signup", 10.6), (2, "purchase", 9.4), (2, "purchase", 12.0), (3, "signup", 10.5), (3, "purchase", 9.5), (3, "purchase", 11.5), (4, "signup", 20.499999), (4, "purchase", 19.0), (4, "purchase", 22.0), (5, "signup", 1.0)]
    g = random.Random(1)
    rows += [(u, g.choice(["signup", "purchase"]), g.randrange(80) / 8) for u in range(10, 40) for _ in range(8)]
    table = pa.table({"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([at(s) for _, _, s in rows], pa.timestamp("us")), "user_id": pa.array([u for u, _, _ in rows], pa.int64()), "event_type": [e for _, e, _ in rows]})
    got, want = as_sql(spark, tmp_path, "q_nearest_event", {"events": table})
    assert got == want


def people(n_customers, n_suppliers, n_orders, seed=2):
    """Customers and suppliers in a few nations, and orders of some customers."""
    g = random.Random(seed)
    ints = lambda xs, kind=None: pa.array(xs, kind or pa.int64())
    return {
        "customer": {"c_custkey": ints(range(n_customers)), "c_nationkey": ints([g.randrange(3) for _ in range(n_customers)], pa.int32())},
        "supplier": {"s_suppkey": ints(range(n_suppliers)), "s_nationkey": ints([g.randrange(3) for _ in range(n_suppliers)], pa.int32())},
        "orders": {"o_custkey": ints([g.randrange(n_customers) for _ in range(n_orders)]), "o_orderkey": ints(range(n_orders)), "o_orderpriority": [g.choice(["1-URGENT", "5-LOW"]) for _ in range(n_orders)]},
    }


@pytest.mark.parametrize("name", ["q_proposals", "q_pair_findings", "q_block_candidates", "q_two_passes", "q_possible_relatives", "q_duplicate_join"])
def test_values_that_many_persons_share(spark, tmp_path, name):
    """Rows of one set of values are taken together and come out one by one."""
    got, want = as_sql(spark, tmp_path, name, people(800, 150, 500))
    assert got == want and len(want) > 15


def plan_rows(spark, df):
    """The most rows that a join makes in a run of ``df``."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        else:
            if "Join" in p.nodeName():
                most = max(most, p.metrics().apply("numOutputRows").value())
            todo.extend(p.children().apply(k) for k in range(p.children().size()))
    return most


@pytest.mark.parametrize("name", ["q_proposals", "q_possible_relatives"])
def test_persons_of_the_same_values_make_no_pairs(spark, tmp_path, name):
    """With four times the persons of the same values the joins make about four times the rows at most, not sixteen."""
    made = []
    for n in (2160, 8640):
        at = tmp_path / str(n)
        at.mkdir()
        t = people(n, n // 4, 10)
        t["customer"]["c_nationkey"] = pa.array([0] * n, pa.int32())
        t["supplier"]["s_nationkey"] = pa.array([0] * (n // 4), pa.int32())
        for k, v in t.items():
            pq.write_table(pa.table(v), at / f"{k}.parquet")
        made.append(plan_rows(spark, entry.queries()[name](spark, str(at))))
    assert 0 < made[1] <= 6 * made[0]


def test_branches_make_each_pair_once(spark):
    """a pair that comes by several ways comes once, with all of them, and without a shuffle of pairs."""
    g = random.Random(6)
    word = lambda: g.choice(["Keller", "Kellar", "Brandt", "Anna", "Anne", "J", None])
    row = lambda k: (k, word(), word(), g.choice([None, 1900, 1902, 1907]))
    entries = [(*row(k), g.choice([None, 1, 2, 3]), g.choice([None, 1, 2, 3])) for k in range(40)]
    persons = [(*row(k), g.choice([None, True, False])) for k in range(60)]
    own = [(g.choice([None, 1, 2, 3]), g.randrange(70)) for _ in range(20)]
    kin = [(g.randrange(70), g.choice([None, *range(70)])) for _ in range(60)]
    ids = [(g.randrange(70), g.choice([None, 1, 2, 3])) for _ in range(60)]
    e = spark.createDataFrame(entries, "id long, given string, surname string, birth int, record long, identifier long")
    p = spark.createDataFrame(persons, "id long, given string, surname string, birth int, linked boolean")
    df = matching.candidate_branches(e, p, spark.createDataFrame(own, "record long, person long"), spark.createDataFrame(kin, "a long, b long"), spark.createDataFrame(ids, "person long, identifier long"))
    got = [(r["entry"], r["person"], tuple(r["sources"])) for r in df.collect()]
    named = {(r["l_id"], r["r_id"]) for r in matching.candidates(e.select("id", "given", "surname", "birth"), p).select("l_id", "r_id").collect()}
    want = []
    for a in entries:
        for b in persons:
            record = (a[4], b[0]) in own and a[4] is not None
            relative = a[4] is not None and any(r == a[4] and (q, b[0]) in kin and q != b[0] for r, q in own)
            said = [("identifier", a[5] is not None and (b[0], a[5]) in ids), ("names", (a[0], b[0]) in named), ("record", record), ("relative", relative)]
            if any(ok for _, ok in said):
                want.append((a[0], b[0], tuple(w for w, ok in said if ok)))
    assert sorted(got) == want and len({w for *_, w in want}) > 8
    assert "bit_or(by" not in str(df._jdf.queryExecution().optimizedPlan()).split("Union")[0]


def test_verdicts_are_made_once_a_pair(spark):
    """no filter is moved below the table of verdicts, which would make it again for each look at it."""
    verdict = lambda a, b: F.when(F.levenshtein(a, b) < 2, "agrees").otherwise("disagrees")
    values = spark.createDataFrame([(1, "r1", 1, True, "aaaa"), (1, "r2", 2, False, "aaab"), (1, "r3", 3, True, "bbbb"), (2, "r4", 1, True, "cccc")], "event int, record string, first int, accepted boolean, value string")
    df = disagreements.disagreements(values, spark.createDataFrame([(1, "aaaa"), (2, "cccc")], "event int, value string"), verdict)
    assert [tuple(r) for r in df.collect()] == [(1, ["r1", "r2", None], ["r3"])]
    assert str(df._jdf.queryExecution().optimizedPlan()).count("levenshtein(") == 1


def test_plain_pages_are_read_as_by_the_parser(spark):
    """one expression reads plain pages, with the tree that the parser makes of them; rows go by batches."""
    g = random.Random(1)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<h2>", "</h2>", "a &amp; b", " x ", "&lt", "<br>", "<div style='display: none'>", "</div>", '<a href="/x">', "</a>", "<B x a=1 a=2>", "</b >"]
    odd = ["<", "<!-- c -->", "<br/>", "<script>", "</", "<a href='a&amp;b'>", "<x y = 'z'>", "\0", "<title>"]
    tree = lambda e: [e.tag, e.attrs, [x if isinstance(x, str) else tree(x) for x in e.items]]
    plain = 0
    for k in range(3000):
        html = "".join(g.choice(bits if k % 3 else bits + odd) for _ in range(g.randrange(25)))
        b = readers._Builder()
        b.feed(html)
        b.close()
        found = readers._parse_plain(html)
        plain += found is not None
        assert found is None or re.sub(r"', '", "", str(tree(found))) == re.sub(r"', '", "", str(tree(b.root))), html
    assert plain > 1500
    page = "<main><h1>Ann</h1><table><tr><th>Event Date<td>1900</table></main>"
    df = readers.records(spark.createDataFrame([(1, page), (2, None), (3, page + "<!-- x -->")], "page_id long, html string"))
    assert sorted((r["page_id"], r["kind"], r["value"]) for r in df.collect()) == [(1, "field", "1900"), (1, "head", None), (3, "field", "1900"), (3, "head", None)]
    assert "MapInArrow" in str(df._jdf.queryExecution().optimizedPlan())


def test_rule_broadcasts_nations_alone(spark, monkeypatch):
    """parts, customers and persons are not sent to the driver, however small their estimates."""
    sent = []
    monkeypatch.setattr(linkage.Scratch, "table", lambda self, df: sent.append(df) or df.limit(0))
    linkage.q_rule(spark, TESTDATA)
    nodes = []
    for df in sent[:2]:
        todo = [df._jdf.queryExecution().sparkPlan()]
        while todo:
            p = todo.pop()
            nodes.append(p)
            todo.extend(p.children().apply(k) for k in range(p.children().size()))
    hashed = [p for p in nodes if p.nodeName() == "BroadcastHashJoin"]
    built = [(p.left() if "BuildLeft" in p.buildSide().toString() else p.right()).toString() for p in hashed]
    assert built and all("n_nationkey" in b or "r_regionkey" in b for b in built) and not any(x in b for b in built for x in ("c_custkey", "p_partkey", "o_orderkey"))


def test_labels_are_matched_where_they_stand(spark):
    """rows are not moved by their labels, of which there are few."""
    df = fields.map_labels(spark.createDataFrame([("Born",), (" sex ",), (None,), ("Hat",)], "label string"))
    assert sorted((r["fact"], r["part"]) for r in df.collect()) == [("Birth", "date"), ("Sex", "value"), ("Unknown", "value"), ("Unknown", "value")]
    assert "Join" not in str(df._jdf.queryExecution().optimizedPlan())
