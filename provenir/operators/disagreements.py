"""Where accepted statements say something else than the event they are of, or than one another: the sides of each question.

Statements of one record, wherever its copies are held, are one value. Values of an event are compared as an array of distinct values in
built-in functions, so an event is one row and no statement meets another by a join; equal values meet once, with all that give them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

DATE = "struct<start:string,end:string,qualifier:string>"


def record_values(statements: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(event, record, first, accepted, date, place): one row for each event and record.

    ``statements`` (event, node, id, at, status, marked, withdrawn, own_type, date, place): date a struct (start, end, qualifier). Rejected,
    marked and withdrawn statements and those of another type than the event's say nothing, nor do rows without an event. ``copies`` (node, record)
    names the record that a node is a copy of; a node that it lacks is its own. A record's date is its most specific (the longest start or end,
    the earliest statement of several), its place the first given, and it is accepted if one of its statements is. Statements are in order of at and id.
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    s = statements.where(F.col("event").isNotNull() & (F.coalesce("status", F.lit("undecided")) != "rejected") & no("marked") & no("withdrawn") & F.coalesce("own_type", F.lit(True)))
    if copies is None:
        s = s.withColumn("record", F.col("node"))
    else:
        s = s.join(copies.select("node", "record"), "node", "left").withColumn("record", F.coalesce("record", "node"))
    order = F.struct("at", "id")
    said = F.coalesce(F.length(F.coalesce("date.start", "date.end")), F.lit(0))
    known = F.col("date").isNotNull() & (said > 0)
    return s.groupBy("event", "record").agg(
        F.min(order).alias("first"),
        F.max(F.col("status") == "accepted").alias("accepted"),
        F.min_by(F.when(known, F.col("date")), F.when(known, F.struct((-said).alias("n"), order.alias("o")))).cast(DATE).alias("date"),
        F.min_by(F.when(F.trim("place") != "", F.col("place")), F.when(F.trim("place") != "", order)).alias("place"),
    )


def date_value(date: Column) -> Column:
    """A date with its span, made once for each value: what ``date_verdict`` compares."""
    d = date.cast(DATE)
    span = dates.date_span(d)
    return F.when(date.isNotNull(), F.struct(d["start"].alias("start"), d["end"].alias("end"), d["qualifier"].alias("qualifier"), span["lo"].alias("lo"), span["hi"].alias("hi")))


def date_verdict(a: Column, b: Column) -> Column:
    return dates.verdict_of_spans(a, b, a, b)


def place_value(place: Column) -> Column:
    """The units of a place as written, from the smallest up, in lower case; null without one."""
    units = F.filter(F.transform(F.split(F.lower(place), ","), lambda u: F.trim(u)), lambda u: u != "")
    return F.when(F.size(units) > 0, units)


def place_verdict(a: Column, b: Column) -> Column:
    """Two places as units: agrees where the units of one are all among the other's, in order; absent where either is missing, else disagrees."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    found = F.aggregate(long, F.lit(0), lambda k, u: F.when(F.get(short, k) == u, k + 1).otherwise(k))
    return F.when(a.isNull() | b.isNull(), "absent").when(a == b, "agrees").when(found == F.size(short), "agrees").otherwise("disagrees")


def disagreements(values: DataFrame, events: DataFrame, verdict: Callable[[Column, Column], Column], tree_parts: bool = False) -> DataFrame:
    """(event, a, b): pairs of sides that disagree; a side is an array of records, the tree's own value as null, the side with the tree first.

    ``values`` (event, record, first, accepted, value), ``events`` (event, value): the tree's value, null where it has none. Every accepted value is
    compared with the tree's and with every other value, two accepted ones once. With ``tree_parts`` (places) two values that both agree with the tree's are
    parts of one, and no disagreement. Among the values found in some disagreement a side is a set of which all agree with one another: in the order in
    which values were found each joins the first side that it agrees with throughout. A value without counterpart on the tree's side is compared with the
    others alone. Values that are null say nothing; make them with ``date_value`` or ``place_value``, so that no comparison parses one again.

    The work in a task is that of the distinct values of one event.
    """
    # One exchange for both aggregations and the join; a number of its own, as the work lies in comparing, not in bytes that would be brought together.
    n_parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = values.where("value IS NOT NULL").repartition(n_parts, "event")
    v = v.groupBy("event", "value").agg(F.min(F.when(F.col("accepted"), F.col("first"))).alias("sure"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "record"))).alias("by"))
    g = v.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("first", "value", "sure", "by"))).alias("vs"))
    g = g.join(events.select("event", F.col("value").alias("tree")), "event")
    n = F.size("vs")
    # Verdicts once for each pair of places among the values; place 0 is the tree's.
    at = lambda k: F.when(k == 0, F.col("tree")).otherwise(F.get("vs", k - 1)["value"])
    grid = F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(F.sequence(F.lit(0), n), lambda j: F.when(i == j, "agrees").otherwise(F.coalesce(verdict(at(i), at(j)), F.lit("absent")))))
    g = g.withColumn("grid", grid)
    said = lambda i, j: F.get(F.get("grid", i), j)
    sure = lambda k: F.get("vs", k - 1)["sure"].isNotNull()
    places = F.sequence(F.lit(1), n)
    pair = lambda i, j: F.struct(i.alias("a"), j.alias("b"))
    parts = (lambda i, j: (said(i, F.lit(0)) == "agrees") & (said(j, F.lit(0)) == "agrees")) if tree_parts else (lambda i, j: F.lit(False))
    others = lambda i: F.filter(places, lambda j: (i != j) & ~(sure(j) & (j < i)) & ~parts(i, j) & (said(i, j) == "disagrees"))
    against = lambda i: F.concat(F.filter(F.array(F.lit(0)), lambda k: said(i, k) == "disagrees"), others(i))
    pairs = F.flatten(F.transform(F.filter(places, sure), lambda i: F.transform(against(i), lambda j: F.when(j == 0, pair(j, i)).otherwise(pair(i, j)))))
    g = g.withColumn("pairs", pairs)
    # Nodes in the order in which the comparisons found them, each joining the first side it agrees with throughout.
    nodes = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))))
    g = g.withColumn("nodes", nodes)

    def join(sides: Column, x: Column) -> Column:
        fits = F.array_position(F.transform(sides, lambda s: F.forall(s, lambda m: said(m, x) == "agrees")), True)
        return F.when(fits > 0, F.transform(sides, lambda s, k: F.when(k + 1 == fits, F.array_append(s, x)).otherwise(s))).otherwise(F.array_append(sides, F.array(x)))

    g = g.withColumn("sides", F.aggregate("nodes", F.array().cast("array<array<int>>"), join))
    side_of = lambda k: F.array_position(F.transform("sides", lambda s: F.array_contains(s, k)), True).cast("int")
    between = F.array_distinct(F.filter(F.transform("pairs", lambda p: F.struct(F.least(side_of(p["a"]), side_of(p["b"])).alias("x"), F.greatest(side_of(p["a"]), side_of(p["b"])).alias("y"))), lambda p: p["x"] != p["y"]))
    # A filter on pairs or on what explode is given would be moved below all of this and make it again for each verdict looked at; one on what comes out stays.
    out = g.select("event", "vs", "sides", F.explode_outer(between).alias("p")).where("p IS NOT NULL")
    # The side with the tree comes first, else the one found first.
    swap = F.array_contains(F.get("sides", F.col("p.y") - 1), 0)
    records = lambda k: F.flatten(F.transform(F.get("sides", k - 1), lambda m: F.when(m == 0, F.array(F.lit(None).cast("string"))).otherwise(F.transform(F.get("vs", m - 1)["by"], lambda b: b["record"].cast("string")))))
    a, b = F.when(swap, F.col("p.y")).otherwise(F.col("p.x")), F.when(swap, F.col("p.x")).otherwise(F.col("p.y"))
    return out.select("event", F.array_sort(records(a)).alias("a"), F.array_sort(records(b)).alias("b"))
