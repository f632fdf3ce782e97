"""The fold of one owner's events into one event for each thing that happened, and what the kept event takes from the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, places


def first_fit(items: Column, agree: Callable[[Column, Column], Column]) -> Column:
    """Greedy complete-link groups of an array, in its order: each item joins the first group all of which agree with it, or opens one.

    An array of arrays; ``agree`` takes two items as Columns, so the work stays in built-in functions.
    """

    def place(groups: Column, x: Column) -> Column:
        fits = F.array_position(F.transform(groups, lambda g: F.forall(g, lambda m: agree(m, x))), True)
        joined = F.transform(groups, lambda g, k: F.when(k + 1 == fits, F.array_append(g, x)).otherwise(g))
        return F.when(fits > 0, joined).otherwise(F.array_append(groups, F.array(x)))

    return F.aggregate(items, F.slice(F.array(items), 1, 0), place)


def _same_event(a: Column, b: Column) -> Column:
    return places.keys_one(a["place"], b["place"]) & a["value"].eqNullSafe(b["value"]) & (a["once"] | dates.dates_one(a["date"], b["date"]))


def _grouped(events: DataFrame, owner: list[str]) -> DataFrame:
    """The events that can be one with another, with their ``side`` among those of their owner and type (see ``fold_events``)."""
    none = F.array().cast("array<string>")
    axes = lambda c: F.coalesce(F.col(c), none)
    d = F.col("date").cast("struct<start:string,end:string,qualifier:string>")
    order = F.struct((F.size(axes("owner_axes")) == 0).alias("o"), (F.size(axes("rule_axes")) == 0).alias("r"), (-F.coalesce("accepted", F.lit(0))).cast("long").alias("a"), (-F.coalesce("statements", F.lit(0))).cast("long").alias("s"), F.col("id").alias("id"))
    keys = [*owner, "type"]
    e = events.select(*keys, "id", order.alias("order"), F.coalesce("once", F.lit(False)).alias("once"), d.alias("date"), places.place_keys(F.col("place")).alias("keys"), F.when(F.trim("place") != "", F.col("place")).alias("place"), F.coalesce("value", F.lit("")).alias("value"), axes("owner_axes").alias("owner_axes"), F.array_union(axes("owner_axes"), axes("rule_axes")).alias("decided"), F.coalesce(F.col("held").cast("array<struct<start:string,end:string,qualifier:string>>"), F.array().cast("array<struct<start:string,end:string,qualifier:string>>")).alias("held"))
    e = e.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).where(F.col("once") | dates.dates_one(F.col("date"), F.col("date")))
    # A place that names a country alone agrees with no other naming, not even its like: each such event stands for itself.
    alone = F.when(F.size("keys") == 0, F.col("id"))
    e = e.withColumn("item", F.struct(F.col("keys").alias("place"), "value", "once", "date")).withColumn("v", F.to_json(F.struct("item", alone.alias("alone"))))
    values = e.groupBy(*keys, "v").agg(F.min("order").alias("order"), F.first("item").alias("item"))
    listed = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order", "v", "item"))).alias("items"))
    grouped = listed.select(*keys, F.posexplode(first_fit(F.col("items"), lambda a, b: _same_event(a["item"], b["item"]))).alias("side", "g"))
    side = grouped.select(*keys, "side", F.explode("g.v").alias("v"))
    return e.join(side, [*keys, "v"])


def fold_sides(events: DataFrame, owner: list[str]) -> DataFrame:
    """(id, kept, refused) of each event that is one with another of its owner and type, by the rule of ``fold_events``; the kept one names itself."""
    g = [*owner, "type", "side"]
    m = _grouped(events, owner)
    kept = m.groupBy(*g).agg(F.min(F.struct("order", "id"))["id"].alias("kept"), F.count("*").alias("n"), (F.count_if(F.size("owner_axes") > 0) > 1).alias("refused"))
    return m.select(*g, "id").join(kept.where("n > 1"), g).select("id", "kept", "refused")


def fold_events(events: DataFrame, owner: list[str]) -> DataFrame:
    """(owner..., type, kept, n, refused, date, place): the groups of two or more events of one owner and type that are one event.

    ``events`` has owner..., type, once (a life holds the type once), id, date (struct start, end, qualifier), place, value (of an
    attribute; else null), owner_axes and rule_axes (arrays of date and place: what has been decided), accepted and statements
    (counts), held (array of dates that accepted statements give). Events are one where their places are one or one is absent, their
    values are equal and the type is held once or the dates are one. They join groups in the order in which the kept event is
    chosen: the owner's word, a decision of the rule, most accepted and most statements, smallest id.

    The kept event takes a fuller date that agrees with its own and with which no held date disagrees, and a place where it lacks
    one, never on a decided axis. A group with the owner's word on two events is refused and takes nothing. Null counts are zero, null
    arrays empty, a null or blank place absent; events of a null owner are nobody's and fold with nothing. An id that repeats is two events.

    Equal compared values always meet in one group, so the greedy rule sees each value of an owner and type once, and those that can
    agree with nothing (no whole date of a type that may repeat) never; what one task holds follows the different values of one
    owner, not its rows.
    """
    keys = [*owner, "type"]
    m = _grouped(events, owner)
    g = [*keys, "side"]
    spoken = F.count_if(F.size("owner_axes") > 0)
    place = F.min(F.when(F.col("place").isNotNull(), F.struct("order", "place")))["place"]
    kept = m.groupBy(*g).agg(F.min(F.struct("order", "id", "date", "place", "decided")).alias("k"), F.count("*").alias("n"), (spoken > 1).alias("refused"), place.alias("given")).where("n > 1")
    # A date matters where it is first given; held dates count from the event that holds them on, that event's own step included.
    # Spans are made once for each date, so that a step compares columns and stays a small expression.
    full = "struct<start:string,end:string,qualifier:string,lo:date,hi:date>"
    null_date, no_dates = F.lit(None).cast(full), F.array().cast(f"array<{full}>")
    spanned = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.*", dates.date_span(F.col(c))["lo"].alias("lo"), dates.date_span(F.col(c))["hi"].alias("hi")))
    given = m.groupBy(*g, F.col("date").alias("d")).agg(F.min("order").alias("order")).select(*g, F.struct("order", F.lit(1).alias("step"), spanned("d").alias("date"), null_date.alias("held")).alias("x"))
    held = m.select(*g, "order", F.explode("held").alias("h")).groupBy(*g, "h").agg(F.min("order").alias("order")).select(*g, F.struct("order", F.lit(0).alias("step"), null_date.alias("date"), spanned("h").alias("held")).alias("x"))
    steps = given.union(held).groupBy(*g).agg(F.array_sort(F.collect_list("x")).alias("steps"))
    state = lambda own, seen: F.struct(own.alias("date"), seen.alias("held"))
    verdict = lambda a, b: dates.verdict_of_spans(a, b, a, b)

    def step(s: Column, x: Column) -> Column:
        free = ~F.exists(s["held"], lambda h: verdict(h, x["date"]) == "disagrees")
        takes = (x["step"] == 1) & free & dates.fuller_by(verdict(x["date"], s["date"]), s["date"], x["date"])
        return state(F.when(takes, x["date"]).otherwise(s["date"]), F.when(x["step"] == 0, F.array_append(s["held"], x["held"])).otherwise(s["held"]))

    last = F.aggregate("steps", state(F.col("own"), no_dates), step)["date"]
    last = F.when(last.isNotNull(), F.struct(last["start"].alias("start"), last["end"].alias("end"), last["qualifier"].alias("qualifier")))
    free = lambda axis: ~F.col("refused") & ~F.array_contains("k.decided", axis)
    date = F.when(free("date"), last).otherwise(F.col("k.date"))
    given_place = F.when(free("place"), F.coalesce("k.place", "given")).otherwise(F.col("k.place"))
    kept = kept.withColumn("d", F.col("k.date")).withColumn("own", spanned("d"))
    return kept.join(steps, g).select(*keys, F.col("k.id").alias("kept"), "n", "refused", date.alias("date"), given_place.alias("place"))
