"""Registered queries of the evidence operators over the provided tables, with DuckDB SQL of the same rows.

Lines stand for statements on orders: return flag A is accepted, R rejected, N undecided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, names
from ..operators import evidence, graph
from ..session import Scratch
from ..sources import pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_STATUS = "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'undecided' END"
_FOLD = "CASE WHEN count({s}) = 0 THEN 'undecided' WHEN bool_or({s} = 'accepted') THEN 'accepted' WHEN bool_and({s} = 'rejected') THEN 'rejected' ELSE 'undecided' END"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return t(spark, d, "lineitem").withColumn("status", F.when(flag == "A", "accepted").when(flag == "R", "rejected").otherwise("undecided"))


@query(f"""SELECT o_orderkey, {_FOLD.format(s="status")} AS basis, count(status)::BIGINT AS n, count(*) FILTER (status = 'accepted')::BIGINT AS n_accepted
FROM orders LEFT JOIN (SELECT l_orderkey, {_STATUS} AS status FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_basis(spark, d):
    """Three-state status of every order, those without a statement too."""
    # Folding before the join lets the large side shrink map-side.
    s = _statements(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(evidence.folded_status(F.col("status")).alias("basis"), F.count("*").alias("n"), F.count_if(F.col("status") == "accepted").alias("n_accepted"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return t(spark, d, "orders").select("o_orderkey").join(s, "o_orderkey", "left").select("o_orderkey", F.coalesce("basis", F.lit("undecided")).alias("basis"), zero("n"), zero("n_accepted"))


_ORDER = ["l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, status FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE status WHEN 'accepted' THEN 0 ELSE 1 END, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rn
FROM (SELECT *, {_STATUS} AS status FROM lineitem) WHERE status <> 'rejected') WHERE rn = 1""")
def q_canonical(spark, d):
    """The best statement of each order that is not rejected, by a total order."""
    s = _statements(spark, d).where("status <> 'rejected'")
    order = [F.when(F.col("status") == "accepted", 0).otherwise(1), F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    return evidence.top_per_group(s, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "status")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def q_unsupported(spark, d):
    """Orders without an accepted statement."""
    ok = t(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey")
    return t(spark, d, "orders").join(ok, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT p_name, p_brand, count(*)::BIGINT AS n, min(p_partkey) AS first_key FROM part GROUP BY ALL HAVING count(*) > 1")
def q_collision(spark, d):
    """A1: keys that should be unique and are not."""
    return t(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@query("""SELECT s_suppkey, count(l_suppkey)::BIGINT AS n, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END)::BIGINT AS n_good
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey HAVING count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END) < 400""")
def q_under_replicated(spark, d):
    """Suppliers with fewer than 400 orders not rejected, by a conditional distinct count before the join."""
    c = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))).alias("n_good"))
    out = t(spark, d, "supplier").select("s_suppkey").join(c, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return out.select("s_suppkey", zero("n"), zero("n_good")).where("n_good < 400")


@query("SELECT 'customer' AS kind, c_custkey AS id, lower(c_name) AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, lower(s_name) FROM supplier")
def q_search_key(spark, d):
    """One search list of two kinds of entity."""
    return t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.lower("c_name").alias("name")).unionByName(
        t(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.lower("s_name").alias("name"))
    )


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def q_current(spark, d):
    """The latest reading of each key, by one partial aggregation."""
    return evidence.latest(t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), c AS (SELECT id, id AS ancestor, 0 AS depth FROM n UNION ALL
SELECT c.id, n.parent, depth + 1 FROM c JOIN n ON n.id = c.ancestor WHERE n.parent IS NOT NULL) SELECT id, ancestor, depth FROM c""")
def q_chain(spark, d):
    """Closure of a hierarchy of suppliers, nations and regions."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = t(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = n.union(t(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(t(spark, d, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey")))
    return graph.ancestors(n, Scratch(spark))


@query("""WITH n AS (SELECT s_suppkey, 's' || s_suppkey AS s, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT o AS group_id, CASE WHEN count(DISTINCT n) = 1 AND count(DISTINCT s) = 1 THEN min(s) END AS id FROM (
SELECT l_orderkey AS o, s, n FROM lineitem JOIN n ON s_suppkey = l_suppkey) GROUP BY o""")
def q_place_on_chain(spark, d):
    """The most specific node if an order's suppliers and nations lie on one chain."""
    sup = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey")).alias("s"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("n"))
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(sup, "s_suppkey")
    sets = line.select("group_id", F.explode(F.array("s", "n")).alias("id"))
    return graph.most_specific(sets, QUERIES["q_chain"](spark, d))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS component FROM documents")
def q_components(spark, d):
    """Copies of a record as edges to the first copy, then connected components."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    edges = docs.join(first, "h").where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    comp = graph.connected_components(edges, Scratch(spark))
    return docs.select("doc_id").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("component"))


@query("SELECT source, count(*)::BIGINT AS n, count(DISTINCT sha256(text))::BIGINT AS n_records FROM documents GROUP BY source")
def q_copies_rollup(spark, d):
    """One record however many copies."""
    return t(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("h").alias("n_records"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS name_key FROM part")
def q_name_key(spark, d):
    """F1."""
    return t(spark, d, "part").select("p_partkey", names.name_key(F.col("p_name")).alias("name_key"))


@query()
def q_soundex_block(spark, d):
    """Sizes of Soundex blocks of part names."""
    return t(spark, d, "part").groupBy(F.soundex(names.name_key(F.col("p_name"))).alias("block")).agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("n_names"))


@query("""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '')
SELECT a.w AS l_w, b.w AS r_w, levenshtein(a.w, b.w)::INT AS edits FROM w a JOIN w b ON a.w < b.w AND substr(a.w, 1, 1) = substr(b.w, 1, 1) AND levenshtein(a.w, b.w) <= 2""")
def q_edit_match(spark, d):
    """Words within two edits, blocked on the first letter."""
    w = t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where("w <> ''").distinct()
    first = F.substring("w", 1, 1)
    m = evidence.blocked_pairs(w, w, [(first, first)], (F.col("l_w") < F.col("r_w")) & (F.levenshtein("l_w", "r_w", 2) >= 0))
    return m.select("l_w", "r_w", F.levenshtein("l_w", "r_w").alias("edits"))


def _partial(col: Column, k: Column) -> Column:
    return F.when(k % 3 == 0, F.date_format(col, "yyyy")).when(k % 3 == 1, F.date_format(col, "yyyy-MM")).otherwise(F.date_format(col, "yyyy-MM-dd"))


_PARTIAL = "CASE {k} % 3 WHEN 0 THEN strftime({c}, '%Y') WHEN 1 THEN strftime({c}, '%Y-%m') ELSE strftime({c}, '%Y-%m-%d') END"


def _as_date(iso: Column, qualifier: str = "exact") -> Column:
    none = F.lit(None).cast("string")
    return F.struct(iso.alias("start"), none.alias("end"), F.lit(qualifier).alias("qualifier"), F.lit("gregorian").alias("calendar"))


@query(f"""SELECT o_orderkey, p AS iso, CASE length(p) WHEN 4 THEN (p || '-01-01')::DATE WHEN 7 THEN (p || '-01')::DATE ELSE p::DATE END AS lo,
CASE length(p) WHEN 4 THEN (p || '-12-31')::DATE WHEN 7 THEN last_day((p || '-01')::DATE) ELSE p::DATE END AS hi FROM (SELECT o_orderkey, {_PARTIAL.format(k="o_orderkey", c="o_orderdate")} AS p FROM orders)""")
def q_partial_date_span(spark, d):
    """Spans of dates known to the year, month or day."""
    o = t(spark, d, "orders").select("o_orderkey", _partial(F.col("o_orderdate"), F.col("o_orderkey")).alias("iso"))
    span = dates.date_span(dates.parse_date(F.when(F.length("iso") == 7, F.concat(F.date_format(F.concat("iso", F.lit("-01")).cast("date"), "MMM"), F.lit(" "), F.substring("iso", 1, 4))).otherwise(F.col("iso"))))
    return o.withColumn("s", span).select("o_orderkey", "iso", "s.lo", "s.hi")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN length(a) = 10 AND length(b) = 10 THEN CASE WHEN a = b THEN 'agrees' ELSE 'disagrees' END
WHEN least(length(a), length(b)) >= 7 AND substr(a, 6, 2) <> substr(b, 6, 2) THEN 'disagrees' WHEN substr(a, 1, 4) = substr(b, 1, 4) THEN 'agrees' ELSE 'disagrees' END AS verdict,
CASE WHEN substr(a, 1, 4) = substr(b, 1, 4) THEN CASE WHEN substr(a, 1, least(length(a), length(b))) <> substr(b, 1, least(length(a), length(b))) THEN 3 WHEN least(length(a), length(b)) = 10 THEN 0 WHEN least(length(a), length(b)) = 7 THEN 1 ELSE 2 END END AS closeness
FROM (SELECT *, {_PARTIAL.format(k="o_orderkey", c="o_orderdate")} AS a, {_PARTIAL.format(k="l_linenumber", c="l_shipdate")} AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def q_date_verdict(spark, d):
    """order date against ship date at mixed precision."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _as_date(_partial(F.col("o_orderdate"), F.col("o_orderkey"))).alias("a"))
    line = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", _as_date(_partial(F.col("l_shipdate"), F.col("l_linenumber"))).alias("b"))
    return line.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", dates.verdict_of(F.col("a"), F.col("b")).alias("verdict"), dates.date_closeness(F.col("a"), F.col("b")).alias("closeness"))


_NEAR = """WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS pid, user_id, ts AS pts FROM events WHERE event_type = 'purchase'),
m AS (SELECT s.event_id, s.user_id, pid, rank() OVER (PARTITION BY s.event_id ORDER BY abs(epoch(pts)::BIGINT - epoch(s.ts)::BIGINT)) AS r FROM s LEFT JOIN p ON p.user_id = s.user_id)
SELECT event_id, user_id, CASE WHEN count(pid) = 1 THEN min(pid) END AS nearest_id, count(pid) > 1 AS ambiguous FROM m WHERE r = 1 GROUP BY event_id, user_id"""


@query(_NEAR)
def q_nearest_event(spark, d):
    """The purchase nearest to each signup of the same user, ties ambiguous; times in whole seconds."""
    # Rounded, halves to the even second, as the SQL's cast does.
    second = F.timestamp_seconds(F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))
    e = t(spark, d, "events").select("event_id", "user_id", second.alias("ts"), "event_type")
    s, p = e.where("event_type = 'signup'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")
    return evidence.nearest(s, p, ["user_id"], "ts", "ts", "event_id").select("event_id", "user_id", "nearest_id", "ambiguous")


@query("""WITH s AS (SELECT o_custkey, o_orderstatus AS status, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.status AS status_a, b.status AS status_b FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.status < b.status AND a.lo <= b.hi AND b.lo <= a.hi""")
def q_range_overlap(spark, d):
    """States of a customer's orders whose spans of dates meet."""
    s = t(spark, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("status")).agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    a, b = (s.select("o_custkey", *[F.col(c).alias(f"{c}_{x}") for c in ("status", "lo", "hi")]) for x in "ab")
    return a.join(b, "o_custkey").where("status_a < status_b AND lo_a <= hi_b AND lo_b <= hi_a").select("o_custkey", "status_a", "status_b")


@query(f"""WITH l AS (SELECT *, {_STATUS} AS status FROM lineitem), c AS (SELECT l_orderkey, l_tax AS tax FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
ORDER BY CASE status WHEN 'accepted' THEN 0 ELSE 1 END, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rn FROM l WHERE status <> 'rejected') WHERE rn = 1)
SELECT l_orderkey, count(*)::BIGINT AS n_against, count(DISTINCT l_tax)::BIGINT AS n_values FROM l JOIN c USING (l_orderkey) WHERE status <> 'rejected' AND l_tax <> tax GROUP BY l_orderkey""")
def q_conflict_pairs(spark, d):
    """Statements of an order that disagree with its canonical one; one window, no self-join."""
    s = _statements(spark, d).where("status <> 'rejected'")
    order = [F.when(F.col("status") == "accepted", 0).otherwise(1), F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    own = F.first("l_tax").over(Window.partitionBy("l_orderkey").orderBy(*order))
    return s.withColumn("tax", own).where("l_tax <> tax").groupBy("l_orderkey").agg(F.count("*").alias("n_against"), F.count_distinct("l_tax").alias("n_values"))


@query("""SELECT o_orderkey, coalesce(max(CASE WHEN l_shipdate::DATE = o_orderdate::DATE THEN 3 WHEN date_trunc('month', l_shipdate) = date_trunc('month', o_orderdate) THEN 2 WHEN year(l_shipdate) = year(o_orderdate) THEN 1 ELSE 0 END), 0)::INT AS level
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' GROUP BY o_orderkey""")
def q_value_level(spark, d):
    """How much of a date the accepted statements give."""
    line = t(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    same = lambda f: F.date_trunc(f, "l_shipdate") == F.date_trunc(f, "o_orderdate")
    level = F.when(same("day"), 3).when(same("month"), 2).when(same("year"), 1).otherwise(0)
    return t(spark, d, "orders").select("o_orderkey", "o_orderdate").join(line, "o_orderkey", "left").groupBy("o_orderkey").agg(F.max(level).alias("level"))


@query("""SELECT l_orderkey, min(n)::INT AS first, max(n)::INT AS last, count(*)::BIGINT AS n FROM (SELECT l_orderkey, l_linenumber AS n, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, run""")
def q_gaps_islands(spark, d):
    """Runs of consecutive lines."""
    return evidence.islands(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT l_orderkey, max(l_linenumber)::INT AS last, count(DISTINCT l_linenumber)::BIGINT AS n, count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey")
def q_household_complete(spark, d):
    """Groups of which every line is held."""
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"), F.count_distinct("l_linenumber").alias("n"))
    return g.withColumn("complete", F.col("n") == F.col("last"))


@query("SELECT c_nationkey, c_custkey, c_acctbal, rn::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def q_topk(spark, d):
    """Three candidates a group by a composite key."""
    order = [F.desc("c_acctbal"), F.col("c_custkey")]
    top = evidence.top_per_group(t(spark, d, "customer"), ["c_nationkey"], order, 3)
    return top.select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order)).alias("place"))


@query("(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def q_set_ops(spark, d):
    """U1, U3."""
    o = t(spark, d, "orders")
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return c.intersect(o.select("o_custkey")).subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N'), e AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'gone' ELSE 'closed' END AS status FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(w.k, e.k) AS k, CASE WHEN w.k IS NOT NULL THEN CASE coalesce(status, '') WHEN '' THEN 'insert' WHEN 'open' THEN 'keep' WHEN 'gone' THEN 'reopen' ELSE 'leave closed' END WHEN status = 'open' THEN 'close' ELSE 'leave closed' END AS action
FROM w FULL JOIN e ON w.k = e.k""")
def q_diff_plan(spark, d):
    """U4: wanted against existing keys; a plan exists for every order that is not of low priority."""
    w = t(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("k"))
    s = F.col("o_orderstatus")
    e = t(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.when(s == "O", "open").when(s == "P", "gone").otherwise("closed").alias("status"))
    return evidence.diff_plan(w, e, "k")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || c_nationkey AS a, 'm' || c_mktsegment || (c_custkey % 97) AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT count(DISTINCT a) AS n FROM u),
w AS (SELECT id, pos, 0 AS depth FROM (VALUES ('c0', 1), ('c7', 0)) s(id, pos) UNION SELECT u.b, pos, depth + 1 FROM w JOIN u ON u.a = w.id, n WHERE depth < n)
SELECT id, min(depth)::INT AS depth, min_by(pos, depth * 10 + pos)::INT AS origin FROM w GROUP BY id""")
def q_graph_bfs(spark, d):
    """Distances from two seeds in a bipartite graph, until nothing new is reached, and the seed that each node is nearest to."""
    c = t(spark, d, "customer")
    edges = c.select(F.concat(F.lit("c"), F.col("c_nationkey")).alias("a"), F.concat(F.lit("m"), F.col("c_mktsegment"), (F.col("c_custkey") % 97).cast("string")).alias("b"))
    seeds = spark.createDataFrame([("c0", 1), ("c7", 0)], "id string, pos int")
    return graph.distances(edges, seeds, Scratch(spark)).select("id", "depth", "origin")


@query()
def q_page_extract(spark, d):
    """Title, language, links, visible text and labelled rows of each page."""
    return pages.extract(t(spark, d, "pages"))


@query(r"""SELECT doc_id, k::INT AS at, w[greatest(k - 3, 1) : k + 3] AS context FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
WHERE lower(w[k]) = 'license' OR lower(w[k]) = 'licensed'""")
def q_kwic(spark, d):
    """A keyword with three words on either side."""
    docs = t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")).where(F.exists("w", lambda x: F.lower(x).isin("license", "licensed")))
    hit = docs.select("doc_id", "w", F.posexplode("w").alias("k", "x")).where(F.lower("x").isin("license", "licensed"))
    start = F.greatest(F.col("k") - 2, F.lit(1))
    return hit.select("doc_id", (F.col("k") + 1).alias("at"), F.slice("w", start, F.col("k") + 5 - start).alias("context"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def q_json_fields(spark, d):
    """a field of JSON text; bad text gives null."""
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT sha256(text) AS sha256, octet_length(encode(any_value(text)))::BIGINT AS bytes, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY sha256(text)")
def q_hash_archive(spark, d):
    """Distinct objects by content."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return docs.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT user_id, min(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END)::INT AS class_rank, arg_min(event_type, ts) AS first_type, min(ts) AS first_at, count(*)::BIGINT AS n FROM events GROUP BY user_id""")
def q_origins(spark, d):
    """First event and best class of each user."""
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return t(spark, d, "events").groupBy("user_id").agg(F.min(rank).alias("class_rank"), F.min_by("event_type", "ts").alias("first_type"), F.min("ts").alias("first_at"), F.count("*").alias("n"))


@query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def q_turn_log(spark, d):
    """W7, ST1: the latest turn of each conversation and role."""
    return evidence.latest(t(spark, d, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn"])


@query("""WITH d AS (SELECT doc_id, lang, source, sha256(text) AS h, n_chars FROM documents), f AS (SELECT h, min(doc_id) AS first_id FROM d GROUP BY h HAVING count(*) > 1),
p AS (SELECT x.doc_id, y.doc_id AS other, (2 + (x.source = y.source)::INT + (x.n_chars = y.n_chars)::INT)::INT AS points, x.lang <> y.lang AS veto FROM d x JOIN f USING (h) JOIN d y ON y.doc_id = first_id WHERE x.doc_id <> first_id)
SELECT doc_id, other, points, points >= 3 AND NOT veto AS taken FROM p""")
def q_points(spark, d):
    """Points for a duplicate and its first copy, with a veto on another language."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min_by(F.struct("doc_id", "lang", "source", "n_chars"), "doc_id").alias("f"), F.count("*").alias("n")).where("n > 1")
    p = docs.join(first, "h").where("doc_id <> f.doc_id")
    one = lambda c: (F.col(c) == F.col(f"f.{c}")).cast("int")
    return p.select("doc_id", F.col("f.doc_id").alias("other"), (2 + one("source") + one("n_chars")).alias("points"), (F.col("lang") != F.col("f.lang")).alias("veto")).select(
        "doc_id", "other", "points", ((F.col("points") >= 3) & ~F.col("veto")).alias("taken")
    )


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount FROM customer),
b AS (SELECT c_custkey AS id, c_name || '*' AS name, 0.0::DOUBLE AS amount FROM customer WHERE c_acctbal < 0 UNION ALL SELECT -s_suppkey, s_name, s_acctbal FROM supplier)
SELECT id, name, amount FROM b UNION ALL SELECT id, name, amount FROM a WHERE id NOT IN (SELECT id FROM b)""")
def q_upsert(spark, d):
    """K3: new rows replace old ones by key: debts are cleared, suppliers join under negative keys."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    cleared = c.where("amount < 0").withColumn("name", F.concat("name", F.lit("*"))).withColumn("amount", F.lit(0.0))
    added = t(spark, d, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    return evidence.upsert(cleared.union(added), c, ["id"])


@query("""SELECT o_custkey, home, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, home) AS rn FROM (SELECT o_custkey, o_orderpriority AS home, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey, o_orderpriority)) WHERE rn = 1""")
def q_mode(spark, d):
    """A10: the commonest value, the first in order on a tie."""
    c = t(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("home")).agg(F.count("*").alias("n"))
    return evidence.top_per_group(c, ["o_custkey"], [F.desc("n"), F.col("home")])


@query("""SELECT s_suppkey, p_brand FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R') JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING min(p_size) >= 5 AND max(p_size) <= 45""")
def q_era_gate(spark, d):
    """Pairs whose values all lie in a permitted range."""
    line = t(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    return line.join(t(spark, d, "part"), "p_partkey").groupBy("s_suppkey", "p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).where("lo >= 5 AND hi <= 45").select("s_suppkey", "p_brand")


@query("""SELECT o_custkey, listagg(k, ',' ORDER BY k) AS keys FROM (SELECT o_custkey, o_orderpriority AS k FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def q_group_concat(spark, d):
    """A4: distinct values in one text."""
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("keys"))


_RANK = "CASE WHEN c_acctbal >= 9000 THEN 0 WHEN c_acctbal >= 5000 THEN 1 ELSE 2 END"


@query(f"""WITH RECURSIVE e AS (SELECT 'c' || c_nationkey AS a, 'm' || c_mktsegment AS b, min({_RANK})::INT AS rank FROM customer GROUP BY ALL), u AS (SELECT a, b, rank FROM e UNION ALL SELECT b, a, rank FROM e),
w AS (SELECT 'c0' AS id, ['c0'] AS path, -1 AS weakest UNION ALL SELECT u.b, list_append(path, u.b), greatest(weakest, u.rank) FROM w JOIN u ON u.a = w.id WHERE w.id <> 'c1' AND len(path) < 7 AND NOT list_contains(path, u.b)),
f AS (SELECT *, len(path) - 1 AS n_links, min(len(path) - 1) OVER () AS shortest FROM w WHERE id = 'c1')
SELECT array_to_string(path, '>') AS path, n_links::INT AS n_links, weakest::INT AS weakest, row_number() OVER (ORDER BY n_links, weakest, path)::INT AS place FROM f WHERE n_links <= shortest + 2""")
def q_simple_paths(spark, d):
    """Paths between two nations over the segments of their customers, with their weakest link, in order."""
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey")).alias("a"), F.concat(F.lit("m"), F.col("c_mktsegment")).alias("b"), F.expr(_RANK).alias("rank"))
    links = c.groupBy("a", "b").agg(F.min("rank").alias("rank"))
    paths = graph.simple_paths(links, spark.createDataFrame([("c0", "c1")], "start string, goal string"), Scratch(spark), slack=2)
    return graph.path_standing(paths, links).select(F.array_join("path", ">").alias("path"), "n_links", "weakest", "place")


@query("""WITH r AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS rule, unnest([-1e9, 0, 2500, 5000, 7500]) AS least),
b AS (SELECT o_custkey AS c_custkey, o_orderpriority AS rule, bool_or(o_orderstatus = 'F') AS held FROM orders GROUP BY ALL)
SELECT c.c_custkey, r.rule, CASE WHEN held THEN 'held' WHEN NOT held THEN 'cited' WHEN c_acctbal >= least THEN 'missing' ELSE 'n/a' END AS status
FROM customer c CROSS JOIN r LEFT JOIN b ON b.c_custkey = c.c_custkey AND b.rule = r.rule""")
def q_checklist(spark, d):
    """What each customer should have by rule, and what is held, cited or missing of it."""
    least = {"1-URGENT": -1e9, "2-HIGH": 0.0, "3-MEDIUM": 2500.0, "4-NOT SPECIFIED": 5000.0, "5-LOW": 7500.0}
    found = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("rule"), (F.col("o_orderstatus") == "F").alias("held"))
    return evidence.checklist(t(spark, d, "customer"), [(n, F.col("c_acctbal") >= x) for n, x in least.items()], found, "c_custkey")
