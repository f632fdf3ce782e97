"""Registered queries of the event fold, scans, listings, names as written, created persons and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, places
from ..operators import folds, records
from ..sources import pages, scans
from .queries import query, t

_PLACES = ["Salem, Essex County", "Essex", "Boston, Suffolk"]
_EVENTS = f"""SELECT o_custkey AS owner, o_orderstatus AS type, o_orderkey AS id, o_orderstatus = 'P' AS once, left(o_orderdate::DATE::VARCHAR, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 END::INT) AS date,
{_PLACES!r}[(o_orderkey // 8 % 4)::INT] AS place, o_orderkey % 3 AS accepted, o_orderkey % 11 = 0 AS word FROM orders"""


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY owner, type ORDER BY NOT word, -accepted, id) AS n FROM ({_EVENTS}) WHERE once OR date IS NOT NULL),
bad AS (SELECT a.owner, a.type, a.n, coalesce(list(b.n) FILTER (b.n IS NOT NULL), []) AS bad FROM e a LEFT JOIN e b ON a.owner = b.owner AND a.type = b.type AND b.n < a.n
AND NOT ((a.place IS NULL OR b.place IS NULL OR (a.place LIKE 'Boston%') = (b.place LIKE 'Boston%')) AND (a.once OR starts_with(a.date, b.date) OR starts_with(b.date, a.date))) GROUP BY ALL),
s AS (SELECT owner, type, 0::BIGINT AS n, []::BIGINT[] AS sides FROM e GROUP BY ALL UNION ALL SELECT owner, type, bad.n, list_append(sides, list_min(list_filter(range(0, bad.n), lambda g: NOT list_contains(list_transform(bad.bad, lambda b: sides[b]), g)))) FROM s JOIN bad USING (owner, type) WHERE bad.n = s.n + 1),
m AS (SELECT e.*, s.sides[e.n] AS side FROM e JOIN s USING (owner, type, n)),
g AS (SELECT owner, type, side, min_by(id, n) AS kept, count(*) AS n, (count(*) FILTER (word)) > 1 AS refused, min_by(word, n) AS spoken, list(coalesce(date, '') ORDER BY n) AS dates, min_by(place, n) FILTER (place IS NOT NULL) AS given, list(place ORDER BY n) AS places FROM m GROUP BY ALL)
SELECT owner, type, kept, n, refused, nullif(CASE WHEN refused OR spoken THEN dates[1] ELSE list_reduce(dates, lambda a, b: CASE WHEN starts_with(b, a) AND length(b) > length(a) THEN b ELSE a END) END, '') AS date,
CASE WHEN refused THEN places[1] ELSE given END AS place FROM g WHERE n > 1""")
def q_event_fold(spark, d):
    """Events of one customer and kind that are one event; the kept one takes a fuller date and a lacking place."""
    k = F.col("o_orderkey")
    n = F.when(k % 4 == 0, 4).when(k % 4 == 1, 7).when(k % 4 == 2, 10)
    day = F.substring(F.col("o_orderdate").cast("date").cast("string"), F.lit(1), n)
    none = F.lit(None).cast("string")
    date = F.struct(day.alias("start"), none.alias("end"), F.lit("exact").alias("qualifier"))
    at = (F.floor(k / 8) % 4).cast("int")
    place = F.when(at > 0, F.get(F.array(*map(F.lit, _PLACES)), at - 1))
    axes = F.array().cast("array<string>")
    e = t(spark, d, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("type"), k.alias("id"), (F.col("o_orderstatus") == "P").alias("once"), date.alias("date"), place.alias("place"), none.alias("value"),
        F.when(k % 11 == 0, F.array(F.lit("date"))).otherwise(axes).alias("owner_axes"), axes.alias("rule_axes"), (k % 3).alias("accepted"), F.lit(3).alias("statements"), F.array().cast("array<struct<start:string,end:string,qualifier:string>>").alias("held"),
    )
    return folds.fold_events(e, ["owner"]).select("owner", "type", "kept", "n", "refused", F.col("date.start").alias("date"), "place")


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'schedule' WHEN 1 THEN 'page_text' WHEN 2 THEN 'profile' WHEN 3 THEN 'inside' END AS kind, CASE c_custkey % 5 WHEN 0 THEN 's' || c_custkey END AS schedule,
CASE c_custkey % 5 WHEN 0 THEN 2::BIGINT END AS n_names, CASE c_custkey % 5 WHEN 1 THEN c_mktsegment WHEN 3 THEN c_mktsegment || chr(10) || c_name END AS full_text, CASE c_custkey % 5 WHEN 2 THEN c_name END AS name FROM customer""")
def q_json_scan(spark, d):
    """Responses in four shapes, told apart and read; every fifth is a search hit that no shape claims."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    names_ = F.array(name, segment)
    schedule = lambda hit: F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("s"), k).alias("scheduleId"), names_.alias("names"), hit.alias("highlight"))).alias("results")))
    match = lambda c: F.struct(F.concat(F.lit("<b>"), c, F.lit("</b>")).alias("text"), F.array(F.struct(F.lit(1).alias("page"))).alias("par"))
    text = (
        F.when(k % 5 == 0, schedule(F.lit(None).cast("string")))
        .when(k % 5 == 1, F.to_json(F.create_map(F.lit("seg"), F.struct(segment.alias("full_text")))))
        .when(k % 5 == 2, F.to_json(F.array(F.struct(F.struct(name.alias("Name")).alias("profile")))))
        .when(k % 5 == 3, F.to_json(F.struct(F.lit("item").alias("ia"), F.lit("x").alias("q"), F.array(match(segment), match(name)).alias("matches"))))
        .otherwise(schedule(F.lit("hit")))
    )
    s = scans.json_scan(t(spark, d, "customer").select(k.alias("id"), text.alias("text")), "text")
    return s.select("id", "scan.kind", "scan.schedule", F.when(F.col("scan.names").isNotNull(), F.size("scan.names")).cast("long").alias("n_names"), "scan.full_text", "scan.name")


_INDEX = "SELECT c_nationkey, c_mktsegment, c_custkey, c_name, c_nationkey % 3 = 0 AS whole FROM customer"


@query(f"""SELECT c_nationkey AS scan, c_mktsegment AS surname, c_name AS given, c_custkey::VARCHAR AS number FROM ({_INDEX}) WHERE NOT whole AND c_mktsegment = 'BUILDING'
UNION ALL SELECT c_nationkey + 100, c_mktsegment, c_name, c_custkey::VARCHAR FROM ({_INDEX}) WHERE NOT whole AND c_mktsegment = 'BUILDING'""")
def q_index_rows(spark, d):
    """Index rows under a header and in fixed columns; texts with several surnames are whole files and give none."""
    whole = F.col("c_nationkey") % 3 == 0
    c = t(spark, d, "customer").where(whole | (F.col("c_mktsegment") == "BUILDING"))
    number = F.col("c_custkey").cast("string")
    csv = F.concat_ws(",", "c_mktsegment", F.concat(F.lit('"'), "c_name", F.lit('"')), number)
    fixed = F.concat(F.rpad("c_mktsegment", 12, " "), F.rpad("c_name", 20, " "), F.rpad(number, 10, " "))
    by = c.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(csv)), "\n").alias("csv"), F.array_join(F.array_sort(F.collect_list(fixed)), "\r\n").alias("fixed"))
    head = ["surname", "given", "number"]
    a = scans.delimited_scan(by.select("c_nationkey", F.concat_ws("\n", F.lit(",".join(head)), "csv").alias("text")), "c_nationkey", "text", head, "surname")
    b = scans.fixed_scan(by, "c_nationkey", "fixed", [("surname", 1, 12), ("given", 13, 20), ("number", 33, 10)], r"[A-Z ]{12}.{20}\d+ *", "surname")
    return a.select(F.col("c_nationkey").alias("scan"), "row.*").union(b.select(F.col("c_nationkey") + 100, "row.*"))


@query("""SELECT c_nationkey AS page_id, c_name AS name, c_mktsegment AS trade FROM customer""")
def q_listing(spark, d):
    """Rows of a results table by its headings; one page for each nation, with a layout table and a row that does not fit."""
    row = F.concat(F.lit("<tr><td><a href='/x'>"), "c_name", F.lit("</a><td> "), "c_mktsegment", F.lit("\n</td></tr>"))
    rows = F.array_join(F.array_sort(F.collect_list(row)), "<tr><td colspan=2>&nbsp;</td></tr>")
    html = F.concat(F.lit("<html><table><tr><td>menu</td><td>x</td></tr></table><table><tr><th>Name</th><th>Trade</th></tr>"), rows, F.lit("</table></html>"))
    p = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("page_id")).agg(html.alias("html"))
    return pages.listings(p).select("page_id", F.col("cells")["Name"].alias("name"), F.col("cells")["Trade"].alias("trade"))


@query("""WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, CASE WHEN p_size % 3 = 0 THEN '' ELSE ['', ' Jr.', ' III', ' of'][(p_size % 4 + 1)::INT] END AS tail FROM part)
SELECT id, CASE WHEN len(w) = 1 THEN w[1] ELSE array_to_string(w[1:len(w) - (tail <> ' of')::INT], ' ') END AS given, CASE WHEN tail = ' of' THEN 'of' WHEN len(w) > 1 THEN w[len(w)] END AS surname, CASE WHEN tail IN (' Jr.', ' III') THEN trim(tail) END AS suffix FROM p""")
def q_split_name(spark, d):
    """given names, surname and suffix of names as written, some with the surname first."""
    w = F.split("p_name", " ")
    tail = F.get(F.array(*map(F.lit, ["", " Jr.", " III", " of"])), F.col("p_size") % 4)
    turned = F.concat(F.element_at(w, -1), F.lit(", "), F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " "))
    text = F.when(F.col("p_size") % 3 > 0, F.concat("p_name", tail)).when(F.size(w) > 1, turned).otherwise(F.col("p_name"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), names.split_name(text).alias("n")).select("id", "n.*")


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'granular' WHEN 1 THEN 'supplied' WHEN 2 THEN 'dated' WHEN 5 THEN 'coarser' END AS note, CASE WHEN c_custkey % 6 = 3 THEN 'disagrees' WHEN c_custkey % 6 = 4 THEN 'absent' ELSE 'agrees' END AS verdict FROM customer""")
def q_place_notes(spark, d):
    """why places agree that differ as written: a finer or coarser unit, a supplied state, a former name."""
    n = F.col("c_custkey") % 6
    said = F.get(F.array(*map(F.lit, ["Town of Hempstead, New York", "Nassau County", "Upper Oldham", "Boston, Massachusetts", " ", "New York"])), n.cast("int"))
    tree = F.when(n == 1, "New York < USA").when(n == 0, "Hempstead < Nassau < New York < USA").when(n == 2, "Newham < Essex < USA").otherwise("Nassau < New York < USA")
    v = places.full_place_verdict(said, tree, F.lit("New York"), F.when(n == 2, F.array(F.lit("Oldham"))).otherwise(F.array().cast("array<string>")))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), v.alias("v")).select("id", "v.note", "v.verdict")


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 17 = 0 AS editable, left(o_orderpriority, 1)::INT AS tier, o_orderkey % 13 <> 0 AS named, o_orderkey % 19 <> 0 AS looked, o_custkey % 2 = 0 AS made, (count(*) FILTER (l_returnflag = 'A' AND l_linenumber % 2 = 1)) AS stated,
count(*) FILTER (l_returnflag = 'A') AS computed, count(*) FILTER (l_returnflag <> 'R') AS accepted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
y AS (SELECT id, CASE WHEN editable THEN 'anyone edits the page' WHEN tier > 3 OR (tier = 3 AND id % 2 = 0) THEN 'tier' WHEN NOT named THEN 'no full name' WHEN NOT looked AND NOT made THEN 'the matcher has not looked' WHEN stated > 0 THEN CASE WHEN made THEN 'stands' ELSE 'stated' END
WHEN computed > 0 THEN 'computed by the indexer' WHEN accepted > 0 THEN 'no family relationship' ELSE 'related to nobody accepted' END AS why FROM x) SELECT id, why IN ('stands', 'stated') AS creates, why FROM y""")
def q_creates(spark, d):
    """Whether an entry makes a new person, and why; the lines of an order stand for the ties of an entry."""
    o, k = t(spark, d, "orders"), F.col("id")
    flag = F.col("l_returnflag")
    tie = F.struct(F.when(flag == "A", F.when(F.col("l_linenumber") > 3, "other").otherwise("child")).otherwise("other").alias("kind"), F.when(flag == "A", "Grandson").otherwise("Lodger").alias("word"), (flag != "R").alias("accepted"), (F.col("l_linenumber") % 2 == 0).alias("computed"), F.lit(False).alias("resolved"))
    ties = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(tie).alias("ties"))
    e = o.select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_custkey").join(ties, "id")
    name = F.when(k % 13 == 0, "Dr. John A").otherwise("John Doe")
    out = records.creates(k % 17 == 0, F.concat(F.lit("T"), F.substring("o_orderpriority", 1, 1)), k % 2 == 1, name, k % 19 != 0, F.col("o_custkey") % 2 == 0, F.col("ties"))
    return e.select("id", out.alias("x")).select("id", "x.*")


@query("""WITH f AS (SELECT l_orderkey AS id, string_agg(l_linenumber || '=' || l_returnflag, ', ' ORDER BY l_linenumber, l_returnflag) AS findings FROM lineitem WHERE l_linenumber < 3 GROUP BY l_orderkey),
r AS (SELECT l_orderkey AS id, l_partkey AS rival, max(l_linenumber)::INT AS points FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL), b AS (SELECT id, string_agg(rival || ':' || points, ', ' ORDER BY points DESC, rival) AS rivals FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY points DESC, rival) <= 3) GROUP BY id)
SELECT o_orderkey AS id, coalesce(findings, '') AS findings, coalesce(rivals, '') AS rivals, coalesce(n, 0)::BIGINT AS n_rivals FROM orders LEFT JOIN f ON f.id = o_orderkey LEFT JOIN b ON b.id = o_orderkey LEFT JOIN (SELECT id, count(*) AS n FROM r GROUP BY id) c ON c.id = o_orderkey""")
def q_cards(spark, d):
    """A card for each proposal, with its findings and first three rivals."""
    l_ = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id")
    f = l_.where("l_linenumber < 3").select("id", F.col("l_linenumber").cast("string").alias("axis"), F.col("l_returnflag").alias("verdict"))
    r = l_.where("l_linenumber > 1").groupBy("id", F.col("l_partkey").alias("rival")).agg(F.max("l_linenumber").cast("int").alias("points"))
    c = records.cards(t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), f, r, "id")
    text = lambda c, a, b, mark: F.array_join(F.transform(c, lambda x: F.concat(x[a].cast("string"), F.lit(mark), x[b].cast("string"))), ", ")
    return c.select("id", text("findings", "axis", "verdict", "=").alias("findings"), text("rivals", "rival", "points", ":").alias("rivals"), "n_rivals")
