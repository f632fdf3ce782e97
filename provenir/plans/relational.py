"""Registered queries of joins, windows, sets and counts over evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, names
from ..operators import evidence, graph
from ..session import Scratch
from .queries import query, t

_PERIODS = "(SELECT n_nationkey AS nation, n_name || ' I' AS name, NULL::INT AS lo, (1996 + n_nationkey % 3)::INT AS hi FROM nation UNION ALL SELECT n_nationkey, n_name || ' II', (1997 + n_nationkey % 3)::INT, NULL FROM nation)"


@query(f"SELECT o_orderkey, name FROM orders JOIN customer ON c_custkey = o_custkey JOIN {_PERIODS} ON nation = c_nationkey AND coalesce(lo <= year(o_orderdate), true) AND coalesce(year(o_orderdate) <= hi, true)")
def q_valid_name(spark, d):
    """The name of a place that was valid in the year of a record; null ends are open."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", (F.col("n_nationkey") % 3).alias("k"))
    name = n.select("nation", F.concat("n_name", F.lit(" I")).alias("name"), F.lit(None).cast("int").alias("lo"), (1996 + F.col("k")).alias("hi"))
    name = name.union(n.select("nation", F.concat("n_name", F.lit(" II")), 1997 + F.col("k"), F.lit(None).cast("int")))
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")).join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    valid = F.coalesce(F.col("lo") <= F.col("y"), F.lit(True)) & F.coalesce(F.col("y") <= F.col("hi"), F.lit(True))
    return o.join(name, "nation").where(valid).select("o_orderkey", "name")


@query("""WITH f AS (SELECT * FROM (VALUES ('1-URGENT', 1995, 1997, 'form A'), ('1-URGENT', 1998, 2002, 'form B'), ('2-HIGH', 1996, 1999, 'form C')) f(kind, lo, hi, form))
SELECT o_orderkey, form FROM orders LEFT JOIN f ON kind = o_orderpriority AND year(o_orderdate) BETWEEN lo AND hi""")
def q_form_lookup(spark, d):
    """The form of a record by its kind and year, from a small dimension; none where no range holds."""
    forms = spark.createDataFrame([("1-URGENT", 1995, 1997, "form A"), ("1-URGENT", 1998, 2002, "form B"), ("2-HIGH", 1996, 1999, "form C")], "kind string, lo int, hi int, form string")
    o = t(spark, d, "orders")
    return o.join(F.broadcast(forms), (F.col("kind") == F.col("o_orderpriority")) & F.year("o_orderdate").between(F.col("lo"), F.col("hi")), "left").select("o_orderkey", "form")


_NEXT = "SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders"


@query(f"""WITH RECURSIVE s AS ({_NEXT}), w AS (SELECT id, id AS now_, 0 AS n FROM s UNION ALL SELECT w.id, s.superseded_by, n + 1 FROM w JOIN s ON s.id = w.now_ WHERE s.superseded_by IS NOT NULL)
SELECT id, arg_max(now_, n) AS latest, max(n)::INT AS steps FROM w GROUP BY id""")
def q_supersession_end(spark, d):
    """The end of each chain of readings, by pointer jumping."""
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("superseded_by"))
    return graph.chain_ends(s, "id", "superseded_by", Scratch(spark))


@query("""WITH r AS (SELECT l_partkey AS a, l_suppkey AS b, l_linestatus = 'O' AS same, l_returnflag = 'A' AS owner, l_shipdate AS day, l_orderkey * 100 + l_linenumber AS id FROM lineitem)
SELECT a, b, owner AS by_owner, same FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY owner DESC, CASE WHEN owner THEN -epoch(day) ELSE epoch(day) END, CASE WHEN owner THEN -id ELSE id END, same) AS rn FROM r) WHERE rn = 1""")
def q_decision_precedence(spark, d):
    """Of decisions on a pair the owner's last stands above code's first."""
    r = t(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_linestatus") == "O").alias("same"), (F.col("l_returnflag") == "A").alias("owner"), "l_shipdate", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    return evidence.decided(r, ["a", "b"], "same", "owner", ["l_shipdate", "id"])


@query("SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || ':' || k END AS key FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS k FROM part)")
def q_key_suffix(spark, d):
    """Keys that occur again are numbered."""
    k = F.row_number().over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey"))
    return t(spark, d, "part").withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(":"), F.col("k").cast("string"))).alias("key"))


@query("SELECT e.user_id, count(*)::BIGINT AS n, min(e.event_id) AS first_id FROM events e JOIN (SELECT user_id, max(event_id) AS mark FROM events WHERE event_type = 'error' GROUP BY user_id) m ON m.user_id = e.user_id AND e.event_id > mark GROUP BY e.user_id")
def q_after_mark(spark, d):
    """Rows after the last mark of each key."""
    e = t(spark, d, "events").select("user_id", "event_id", "event_type")
    mark = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("mark"))
    return e.join(mark, "user_id").where("event_id > mark").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS o, ((l_linenumber - 1) // 2)::INT AS page FROM lineitem), m AS (SELECT o, unnest(range(0, max(page) + 2)) AS page FROM h GROUP BY o)
SELECT o, min(page)::INT AS next_page FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.o = m.o AND h.page = m.page) GROUP BY o""")
def q_missing_page(spark, d):
    """The first page of two lines that is not held."""
    h = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(F.floor((F.col("l_linenumber") - 1) / 2).cast("int")).alias("held"))
    return h.select("o", F.array_min(F.array_except(F.sequence(F.lit(0), F.array_max("held") + 1), "held")).alias("next_page"))


@query("""SELECT c_custkey, last_order FROM (SELECT c_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
ORDER BY last_order IS NOT NULL, last_order, c_custkey LIMIT 8""")
def q_null_order(spark, d):
    """O1, O2: the first eight, those without a value first (a top-k report)."""
    o = t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    return t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").orderBy(F.col("last_order").isNotNull(), "last_order", "c_custkey").limit(8)


@query("""WITH c AS (SELECT s_suppkey, n_regionkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS near, (CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END + CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END + CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 0 END) / 3.0::DOUBLE AS score
FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT s_suppkey, n_regionkey, round(score, 6) AS score, row_number() OVER (PARTITION BY n_regionkey ORDER BY score DESC, near DESC, s_suppkey)::INT AS place FROM c""")
def q_place_rank(spark, d):
    """Candidates of a region by the share of components that hold, then by how many are near."""
    s = t(spark, d, "supplier").join(t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    parts = F.array(F.col("s_acctbal") > 5000, F.col("s_acctbal") > 0, F.col("s_nationkey") % 2 == 0)
    score = F.aggregate(parts, F.lit(0), lambda n, x: n + x.cast("int")) / F.lit(3.0)
    s = s.withColumn("score", score).withColumn("near", F.count("*").over(Window.partitionBy("s_nationkey")))
    return s.select("s_suppkey", "n_regionkey", F.round("score", 6).alias("score"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("score"), F.desc("near"), "s_suppkey")).alias("place"))


@query("""WITH s AS (SELECT l_orderkey AS o, array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR)), ',') AS partners FROM lineitem GROUP BY l_orderkey) SELECT o, min(o) OVER (PARTITION BY partners) AS first_same FROM s""")
def q_equal_sets(spark, d):
    """Families with the same set of partners fold into the first."""
    s = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("partners"))
    return s.join(s.groupBy("partners").agg(F.min("o").alias("first_same")), "partners").select("o", "first_same")


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000")
def q_union_distinct(spark, d):
    """U1."""
    return t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")).union(t(spark, d, "supplier").where("s_acctbal < 1000").select("s_nationkey")).distinct()


@query("""SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS n_open, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS n_waiting, count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS n_urgent
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey""")
def q_waiting(spark, d):
    """Waiting counts by kind."""
    o = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    urgent = F.count_distinct(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")))
    return o.groupBy("c_nationkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "P").alias("n_waiting"), urgent.alias("n_urgent"))


_FOOT = "SELECT DISTINCT l_suppkey AS record, o_custkey AS person FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query(f"""WITH f AS ({_FOOT}), n AS (SELECT record, c_nationkey AS nation, count(*)::BIGINT AS n, min(person) AS first FROM f JOIN customer ON c_custkey = person
JOIN supplier ON s_suppkey = record WHERE s_nationkey <> c_nationkey GROUP BY ALL) SELECT record, nation, n, first, row_number() OVER (PARTITION BY nation ORDER BY n DESC, record)::INT AS place FROM n""")
def q_footprint(spark, d):
    """Records that name most people of a nation, those of the nation itself left out."""
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("record"))
    f = line.join(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person")), "o_orderkey").select("record", "person").distinct()
    f = f.join(t(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("nation")), "person")
    own = t(spark, d, "supplier").select(F.col("s_suppkey").alias("record"), F.col("s_nationkey").alias("nation"))
    n = f.join(own, ["record", "nation"], "left_anti").groupBy("record", "nation").agg(F.count("*").alias("n"), F.min("person").alias("first"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("n"), "record")))


@query("""SELECT l_suppkey AS page, count(DISTINCT o_custkey)::BIGINT AS n_waiting, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' ') AS kinds FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY l_suppkey""")
def q_who_waits(spark, d):
    """Who waits for each page, and the kinds of it."""
    o = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return t(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("page")).join(o, "l_orderkey").groupBy("page").agg(
        F.count_distinct("o_custkey").alias("n_waiting"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), " ").alias("kinds")
    )


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING' OR (regexp_matches(p_brand, '[0-9]{2}') AND p_type ILIKE 's%')")
def q_like(spark, d):
    """P5."""
    return t(spark, d, "part").where(F.col("p_name").ilike("%RING") | (F.col("p_brand").rlike("[0-9]{2}") & F.col("p_type").ilike("s%"))).select("p_partkey")


@query("""SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS has_accepted, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_rejected,
EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R' AND l_quantity > 5 AND l_linestatus = 'O') AS visible FROM orders""")
def q_exists_flags(spark, d):
    """What exists for each order, as flags, by one aggregation before the join."""
    visible = (F.col("l_returnflag") != "R") & (F.col("l_quantity") > 5) & (F.col("l_linestatus") == "O")
    f = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(visible).alias("v"))
    no = lambda c, n: F.coalesce(c, F.lit(False)).alias(n)
    return t(spark, d, "orders").select("o_orderkey").join(f, "o_orderkey", "left").select("o_orderkey", no("a", "has_accepted"), no("r", "has_rejected"), no("v", "visible"))


@query("""WITH k AS (SELECT n_nationkey AS q, n_nationkey::VARCHAR AS word FROM nation), m AS (SELECT q, s_suppkey, CASE WHEN s_suppkey::VARCHAR = word THEN 0 WHEN ends_with(s_name, word) THEN 1 ELSE 2 END AS stage FROM k JOIN supplier ON contains(s_name, word) OR s_suppkey::VARCHAR = word),
b AS (SELECT *, min(stage) OVER (PARTITION BY q) AS best FROM m) SELECT q, stage::INT AS stage, CASE WHEN count(*) = 1 THEN min(s_suppkey) END AS found, count(*)::BIGINT AS n FROM b WHERE stage = best GROUP BY q, stage""")
def q_lookup(spark, d):
    """An id, else an ending, else a part of the name; of several in the first stage that has any none is taken."""
    words = F.broadcast(t(spark, d, "nation").select(F.col("n_nationkey").alias("q"), F.col("n_nationkey").cast("string").alias("word")))  # the words asked for, few
    own = F.col("s_suppkey").cast("string") == F.col("word")
    m = t(spark, d, "supplier").join(words, F.col("s_name").contains(F.col("word")) | own)
    m = m.select("q", "s_suppkey", F.when(own, 0).when(F.endswith("s_name", F.col("word")), 1).otherwise(2).alias("stage"))
    g = m.groupBy("q", "stage").agg(F.min("s_suppkey").alias("least"), F.count("*").alias("n"))
    best = g.groupBy("q").agg(F.min(F.struct("stage", "least", "n")).alias("b"))
    return best.select("q", "b.stage", F.when(F.col("b.n") == 1, F.col("b.least")).alias("found"), "b.n")


@query("""WITH c AS (SELECT l_orderkey AS o, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_shipdate AS at, CASE WHEN l_returnflag = 'A' THEN 'ark ' || l_partkey WHEN l_returnflag = 'R' THEN 'memorial ' || l_suppkey ELSE 'number ' || l_linenumber END AS k FROM lineitem)
SELECT k, count(*)::BIGINT AS n, count(DISTINCT o)::BIGINT AS n_records FROM c GROUP BY k""")
def q_identity_key(spark, d):
    """One key a row, by the first identity it has."""
    flag = F.col("l_returnflag")
    key = F.coalesce(F.when(flag == "A", F.concat(F.lit("ark "), "l_partkey")), F.when(flag == "R", F.concat(F.lit("memorial "), "l_suppkey")), F.concat(F.lit("number "), "l_linenumber"))
    return t(spark, d, "lineitem").groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_records"))


@query("""WITH j AS (SELECT o_custkey AS c, to_json(list_sort(list(DISTINCT o_orderpriority))) AS held FROM orders GROUP BY o_custkey), x AS (SELECT c, unnest(from_json(held, '["VARCHAR"]')) AS kind FROM j)
SELECT kind, count(*)::BIGINT AS n, min(c) AS first FROM x GROUP BY kind""")
def q_json_members(spark, d):
    """Members of JSON arrays meet by an equi-join, never by looking for text inside text."""
    j = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.to_json(F.array_sort(F.collect_set("o_orderpriority"))).alias("held"))
    return j.select("c", F.explode(F.from_json("held", "array<string>")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.min("c").alias("first"))


@query("""WITH h AS (SELECT l_partkey AS part, l_suppkey AS holder, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT part, holder, n_name AS region FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, holder) AS rn FROM h) JOIN supplier ON s_suppkey = holder JOIN nation ON n_nationkey = s_nationkey WHERE rn = 1""")
def q_routing(spark, d):
    """The preferred holder of each part and where it is."""
    h = t(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("holder")).agg(F.count("*").alias("n"))
    best = h.groupBy("part").agg(F.min(F.struct(-F.col("n"), "holder")).alias("b")).select("part", F.col("b.holder").alias("holder"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("holder"), F.col("s_nationkey").alias("n_nationkey"))
    return best.join(s, "holder").join(t(spark, d, "nation"), "n_nationkey").select("part", "holder", F.col("n_name").alias("region"))


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*)::BIGINT AS n, count(*) FILTER (regexp_matches(url, '^https?://[^\\s]+$'))::BIGINT AS n_safe, min(page_id) AS first_id FROM pages GROUP BY 1")
def q_same_page(spark, d):
    """Pages of one host, by a derived key; how many addresses are safe to follow."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").rlike(r"^https?://\S+$")).alias("n_safe"), F.min("page_id").alias("first_id"))


@query("""WITH x AS (SELECT l_suppkey AS file, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_suppkey), o AS (SELECT l_suppkey AS file, l_orderkey FROM lineitem GROUP BY ALL),
lone AS (SELECT min(file) AS file FROM o GROUP BY l_orderkey HAVING count(*) = 1) SELECT file, n::BIGINT AS n_statements, n_orders::BIGINT AS n_orders, (SELECT count(*) FROM lone WHERE lone.file = x.file)::BIGINT AS n_left_bare FROM x""")
def q_tombstone(spark, d):
    """What rests on a file: statements, records, and records that nothing else supports."""
    line = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey")
    x = line.groupBy("file").agg(F.count("*").alias("n_statements"), F.count_distinct("l_orderkey").alias("n_orders"))
    bare = line.groupBy("l_orderkey").agg(F.min("file").alias("file"), F.max("file").alias("other")).where("file = other").groupBy("file").agg(F.count("*").alias("n_left_bare"))
    return x.join(bare, "file", "left").select("file", "n_statements", "n_orders", F.coalesce("n_left_bare", F.lit(0).cast("long")).alias("n_left_bare"))


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN sha256(text || '!') ELSE sha256(text) END AS said, n_chars FROM documents)
SELECT m.doc_id, said = sha256(text) AS sound, m.n_chars = length(text) AS length_sound FROM m JOIN documents USING (doc_id)""")
def q_fixity(spark, d):
    """Contents against the digests and lengths of their manifest."""
    docs = t(spark, d, "documents")
    sha = F.sha2("text", 256)
    said = F.when(F.col("doc_id") % 10 == 3, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(sha)  # a manifest with faults
    m = docs.select("doc_id", said.alias("said"), F.col("n_chars").alias("length"))
    return docs.join(m, "doc_id").select("doc_id", (F.col("said") == sha).alias("sound"), (F.col("length") == F.length("text")).alias("length_sound"))


_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'found' WHEN 'view' THEN 'none' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'reopen' ELSE 'unread' END"


@query(f"""WITH r AS (SELECT user_id AS step, (props::JSON ->> '$.k')::INT % 3 AS source, ts, event_id, {_OUTCOME} AS outcome, (props::JSON ->> '$.k')::INT AS asked FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY step, source ORDER BY ts DESC, event_id DESC) AS rn FROM r WHERE outcome NOT IN ('error', 'reopen')),
x AS (SELECT step, source, max(ts) AS reopened FROM r WHERE outcome = 'reopen' GROUP BY ALL)
SELECT l.step, l.source, outcome, asked, coalesce(reopened > ts, false) AS again FROM l LEFT JOIN x ON x.step = l.step AND x.source = l.source WHERE rn = 1""")
def q_run_log(spark, d):
    """ST2, W7: the latest answered run of a step at a source, what it asked, and whether it was reopened since."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_type")
    outcome = F.when(e == "purchase", "found").when(e == "view", "none").when(e == "error", "error").when(e == "signup", "reopen").otherwise("unread")
    r = t(spark, d, "events").select(F.col("user_id").alias("step"), (k % 3).alias("source"), "ts", "event_id", outcome.alias("outcome"), k.alias("asked"))
    last = evidence.latest(r.where("outcome NOT IN ('error', 'reopen')"), ["step", "source"], ["ts", "event_id"])
    again = r.where("outcome = 'reopen'").groupBy("step", "source").agg(F.max("ts").alias("reopened"))
    return last.join(again, ["step", "source"], "left").select("step", "source", "outcome", "asked", F.coalesce(F.col("reopened") > F.col("ts"), F.lit(False)).alias("again"))


@query("""WITH x AS (SELECT o_orderkey AS id, count(l_orderkey) FILTER (l_returnflag <> 'R') AS claims, count(l_orderkey) FILTER (l_returnflag = 'A') AS accepted, count(l_orderkey) AS n, bool_or(l_returnflag = 'A' AND l_linestatus = 'O') AS direct, count(DISTINCT l_tax) FILTER (l_returnflag = 'A') AS sides
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT id, CASE WHEN n = 0 THEN 'no claim' WHEN claims = 0 THEN 'rejected' WHEN accepted = 0 THEN 'no record accepted' WHEN NOT coalesce(direct, false) OR sides > 1 THEN 'argument owed' WHEN o_orderstatus = 'O' THEN 'research open' ELSE 'meets the standard' END AS verdict
FROM x JOIN orders ON o_orderkey = id""")
def q_proof(spark, d):
    """The proof verdict of each order from its statements."""
    flag = F.col("l_returnflag")
    x = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(flag != "R").alias("claims"), F.count_if(flag == "A").alias("accepted"), F.bool_or((flag == "A") & (F.col("l_linestatus") == "O")).alias("direct"), F.count_distinct(F.when(flag == "A", F.col("l_tax"))).alias("sides"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus").join(x, "id", "left")
    verdict = F.when(F.col("claims").isNull(), "no claim").when(F.col("claims") == 0, "rejected").when(F.col("accepted") == 0, "no record accepted").when(~F.col("direct") | (F.col("sides") > 1), "argument owed")
    return o.select("id", verdict.when(F.col("o_orderstatus") == "O", "research open").otherwise("meets the standard").alias("verdict"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name || '  /' || p_brand), '[^A-Za-z0-9_\\s''-]', ' ', 'g'), '\\s+', ' ', 'g') AS cleaned, lower(regexp_replace(p_name || '-' || p_brand, '[^A-Za-z0-9]+', '-', 'g')) AS slug,
CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'SMALL' THEN 'sm' ELSE lower(p_type) END AS short FROM part""")
def q_text_keys(spark, d):
    """cleaned names, file names, and words replaced by a dictionary."""
    short = F.create_map(F.lit("ECONOMY"), F.lit("eco"), F.lit("SMALL"), F.lit("sm"))
    return t(spark, d, "part").select("p_partkey", names.clean(F.concat("p_name", F.lit("  /"), "p_brand")).alias("cleaned"), names.slug(F.concat_ws("-", "p_name", "p_brand")).alias("slug"), F.coalesce(short[F.col("p_type")], F.lower("p_type")).alias("short"))


@query("""WITH x AS (SELECT doc_id, regexp_extract(text, '\\b(1[5-9][0-9][0-9]|20[0-9][0-9])\\b', 1) AS y FROM documents) SELECT doc_id, CASE WHEN y <> '' THEN y::INT END AS year FROM x""")
def q_year_in_text(spark, d):
    """the first year that stands alone in a text."""
    return t(spark, d, "documents").select("doc_id", dates.year_in(F.col("text")).alias("year"))


def _plan_sql() -> str:
    return """WITH w AS (SELECT l_orderkey AS k, max(l_returnflag) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey), e AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'skipped' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'gone' ELSE 'closed' END END AS status,
    o_orderpriority = '1-URGENT' AS owner, o_orderpriority = '2-HIGH' AS runs, o_orderpriority = '3-MEDIUM' AS done FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT coalesce(w.k, e.k) AS k, CASE WHEN w.k IS NOT NULL THEN CASE WHEN status IS NULL THEN 'insert' WHEN status = 'skipped' THEN 'plan again' WHEN status = 'gone' THEN 'reopen' WHEN status = 'open' THEN 'keep' ELSE 'leave closed' END
    WHEN status IN ('gone', 'closed') THEN 'leave closed' WHEN done OR owner THEN 'keep' WHEN runs THEN 'skip' ELSE 'delete' END AS action FROM w FULL JOIN e ON w.k = e.k"""


@query(_plan_sql())
def q_step_plan(spark, d):
    """What becomes of each step of a plan: done and owner's steps stay, steps with runs are skipped, others go."""
    w = t(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    status = F.when(s == "O", "open").when(s == "P", "skipped").when(F.col("o_custkey") % 2 == 0, "gone").otherwise("closed")
    e = t(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), status.alias("status"), (p == "1-URGENT").alias("owner"), (p == "2-HIGH").alias("runs"), (p == "3-MEDIUM").alias("done"))
    return evidence.step_plan(w, e, "k")


@query("""WITH c AS (SELECT doc_id, sha256(text) AS h, source, lang, n_chars FROM documents), f AS (SELECT h, lang, min(doc_id) AS a FROM c GROUP BY ALL)
SELECT c.doc_id, f.a AS record, c.doc_id <> f.a AS is_copy FROM c JOIN f USING (h, lang)""")
def q_copy_joins(spark, d):
    """Copies by content that agree in language are one record; edges to the first, then components."""
    c = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    first = c.groupBy("h", "lang").agg(F.min("doc_id").alias("a"))
    edges = c.join(first, ["h", "lang"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    comp = graph.connected_components(edges, Scratch(spark)).select(F.col("id").alias("doc_id"), "label")
    return c.select("doc_id").join(comp, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("record"), F.coalesce(F.col("label") != F.col("doc_id"), F.lit(False)).alias("is_copy"))


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 2 END AS parent FROM customer), w AS (SELECT 149::BIGINT AS id, 0 AS generation
UNION ALL SELECT parent, generation + 1 FROM w JOIN p USING (id) WHERE parent IS NOT NULL AND generation < 12)
SELECT id, generation FROM w""")
def q_walk_up(spark, d):
    """Generation by generation from a person to the last known parent."""
    k = F.col("c_custkey")
    p = t(spark, d, "customer").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).alias("parent"))
    up = graph.ancestors_of(p, spark.createDataFrame([(149,)], "id long"), Scratch(spark), 12)
    return up.select(F.col("ancestor").alias("id"), F.col("depth").alias("generation"))
