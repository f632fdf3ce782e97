"""Operators on readings of records: households of a page, decisions carried to a new reading, withdrawal, place resolution, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, places
from ..session import Scratch
from .evidence import top_per_group
from .graph import connected_components


def households(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, household) of entries (id, page, line, surname, head); a household is named by its smallest id.

    A line with a head opens a run. In a run, lines without a gap are one household, and so are lines of one surname across
    gaps. Entries without a page or line are in none. No window sees more than the lines of a page.
    """
    held = entries.where("page IS NOT NULL AND line IS NOT NULL")
    by_line = Window.partitionBy("page").orderBy("line")
    lines = held.groupBy("page", "line").agg(F.coalesce(F.bool_or("head"), F.lit(False)).alias("opens"))
    lines = lines.withColumn("run", F.sum(F.col("opens").cast("int")).over(by_line)).withColumn("island", F.col("line") - F.row_number().over(by_line))
    e = held.join(lines.drop("opens"), ["page", "line"]).select("id", "page", "run", "island", "surname")
    least = lambda *by: F.min("id").over(Window.partitionBy("page", "run", *by))
    e = scratch.table(e.select("id", least("island").alias("a"), F.when(F.col("surname").isNotNull(), least("surname")).alias("b")))
    edges = e.select("a", F.col("id").alias("b")).union(e.select("b", "id"))
    comp = connected_components(edges, scratch).select("id", "label")
    return e.select("id").join(comp, "id", "left").select("id", F.coalesce("label", "id").alias("household"))


def household_state(entries: DataFrame, of: DataFrame) -> DataFrame:
    """(household, n, has_head, missing, complete): missing holds the lines between the first and the last that no entry has."""
    g = entries.join(of, "id").groupBy("household").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("head"), F.lit(False)).alias("has_head"), F.collect_set("line").alias("held"))
    missing = F.array_except(F.sequence(F.array_min("held"), F.array_max("held")), "held")
    return g.select("household", "n", "has_head", missing.alias("missing"), (F.col("has_head") & (F.size(missing) == 0)).alias("complete"))


def carried(links: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(person, entry, status): decided links (entry, person, status) on an old reading, moved to the same entries of the new one.

    Readings are (page, entry, key, identity, name, role). An entry is the one with its key on the page; without one, the only
    one of its name and role, where it was the only one on its own reading too and the two keys are not both identities. Other
    links stay behind, and undecided ones are no decisions.
    """
    decided = links.where("status IN ('accepted', 'rejected')").join(old, "entry")
    to = new.select("page", "key", F.col("entry").alias("to"))
    keyed = decided.join(to, ["page", "key"], "left")
    by = ["page", "name", "role"]

    def alone(reading: DataFrame, entry: str, identity: str) -> DataFrame:
        one = reading.groupBy(*by).agg(F.count("*").alias("n"), F.min("entry").alias(entry), F.bool_or("identity").alias(identity))
        return one.where("n = 1").drop("n")

    rest = keyed.where("to IS NULL").select("entry", "person", "status", *by)
    rest = rest.join(alone(old, "entry", "was"), [*by, "entry"]).join(alone(new, "to", "is"), by).where("NOT (was AND is)")
    return keyed.where("to IS NOT NULL").select("person", F.col("to").alias("entry"), "status").union(rest.select("person", "to", "status"))


def withdraw(taken: DataFrame, grounds: DataFrame, scratch: Scratch, need: int = 1) -> DataFrame:
    """(id, stands) of taken decisions: one falls when fewer than ``need`` of its grounds stand, and others may fall with it, until none does.

    Grounds are (id, rests_on); those that rest on no decision (null) always stand. Each round only sees what stands, so the
    rounds end.
    """
    standing = scratch.table(taken.select("id").distinct())
    n = standing.count()
    own = grounds.where("rests_on IS NULL").select("id")
    leaning = grounds.where("rests_on IS NOT NULL")
    while True:
        held = own.union(leaning.join(standing.withColumnRenamed("id", "rests_on"), "rests_on", "left_semi").select("id"))
        enough = held.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("id")
        after = scratch.table(standing.join(enough, "id", "left_semi"))
        scratch.drop(standing)
        left = after.count()
        if left == n:
            break
        standing, n = after, left
    return taken.select("id").distinct().join(after.withColumn("s", F.lit(True)), "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("stands"))


def resolve(said: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, place, best, n_full) of places as written (id, components from the leaf up, country).

    Candidates (place, names, units, country) share the leaf's name; a place is resolved where just one candidate agrees in
    every component. ``best`` is the highest score, null without a candidate.
    """
    key = lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9]", "")
    g = gazetteer.select("place", F.explode(F.array_distinct(F.transform("names", key))).alias("leaf"), F.concat("names", "units").alias("all"), F.col("country").alias("own"))
    c = said.select("id", "components", "country", key(F.get("components", F.lit(0))).alias("leaf")).join(g, "leaf")
    lower = lambda a: F.transform(a, F.lower)
    c = c.select("id", "place", places.verify_score(lower(F.col("components")), lower(F.col("all")), F.col("country"), F.col("own")).alias("score"))
    full = F.col("score") == 1.0
    r = c.groupBy("id").agg(F.max("score").alias("best"), F.count_if(full).alias("n_full"), F.min(F.when(full, F.col("place"))).alias("one"))
    r = said.select("id").join(r, "id", "left")
    return r.select("id", F.when(F.col("n_full") == 1, F.col("one")).alias("place"), "best", F.coalesce("n_full", F.lit(0).cast("long")).alias("n_full"))


def rendered(fields: Column, revisions: Column) -> Column:
    """A map of fields as a person left them: excluded ones go, revised values (map to struct include, value) stand for the own."""
    kept = F.map_filter(fields, lambda k, v: F.coalesce(revisions[k]["include"], F.lit(True)))
    return F.transform_values(kept, lambda k, v: F.coalesce(F.when(revisions[k]["value"] != "", revisions[k]["value"]), v))


def same_fields(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b)), F.lit(False))


def stale_readings(readings: DataFrame, versions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The current reading of each page whose reader now has another version; ``versions`` (reader, now) is a small dimension."""
    rest = [c for c in readings.columns if c not in by]
    last = readings.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*by, "r.*")
    return last.join(versions, "reader").where("version <> now")


def unplaced(facts: DataFrame, events: DataFrame, once: list[str]) -> DataFrame:
    """(id, reason, choices) of facts (id, owner, kind, year) whose event (event, owner, kind, year) is a choice.

    An undated fact has several events of its kind; a dated one fits several, or none of several where a life has its kind once.
    Events are gathered by owner, kind and year before the facts come; no pair of rows is made.
    """
    by = ["owner", "kind"]
    every = events.groupBy(*by).agg(F.array_sort(F.collect_set("event")).alias("every"))
    fit = events.where("year IS NOT NULL").groupBy(*by, "year").agg(F.array_sort(F.collect_set("event")).alias("fit"))
    f = facts.join(every, by).join(fit, [*by, "year"], "left")
    n, fits = F.size("every"), F.coalesce(F.size("fit"), F.lit(0))
    reason = F.when(F.col("year").isNull(), F.when(n > 1, "undated")).when(fits > 1, "several fit").when((fits < 1) & (n > 1) & F.col("kind").isin(once), "none fits")
    f = f.withColumn("reason", reason).where("reason IS NOT NULL")
    return f.select("id", "reason", F.when(F.col("reason") == "several fit", F.col("fit")).otherwise(F.col("every")).alias("choices"))


def resumed(waiting: DataFrame, arrived: DataFrame) -> DataFrame:
    """(person, n_open, resumes) of people waiting (person, page): how many of their pages are still out, and whether one of these arrived."""
    a = arrived.select("page").where("page IS NOT NULL").distinct().withColumn("here", F.lit(True))
    w = waiting.select("person", "page").distinct().join(a, "page", "left")
    return w.groupBy("person").agg(F.count_if(F.col("here").isNull()).alias("n_open"), F.coalesce(F.bool_or("here"), F.lit(False)).alias("resumes"))


#: Words of a relationship, besides the four kinds, on which a person may be created.
FAMILY_WORD = r"(?i)\bhalf\b|grand(?:son|daughter|child)|in-law"


def creates(editable: Column, tier: Column, obituary: Column, name: Column, looked: Column, made: Column, ties: Column) -> Column:
    """Struct (creates, why): whether a record's entry makes a new person.

    A page that anyone edits makes nobody. The record is of tier T1 or T2, or an obituary of T3 that has been read; it gives a given
    name and another word; the present matcher has ``looked`` and found nobody, unless the person is ``made`` already; and the record
    itself, not its indexer, states a family relationship to a person accepted on it. ``ties`` are structs (kind, word, accepted,
    computed, resolved); an in-law tie counts where it resolves to one person. A null flag is false, a null tier none.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    words = names.key_words(name)
    word = lambda x: F.coalesce(x["word"], F.lit(""))
    family = F.filter(
        F.coalesce(ties, F.array().cast("array<struct<kind:string,word:string,accepted:boolean,computed:boolean,resolved:boolean>>")),
        lambda x: yes(x["accepted"]) & (yes(x["kind"].isin("child", "parent", "spouse", "sibling")) | (yes(x["kind"] == "other") & word(x).rlike(FAMILY_WORD) & (~F.lower(word(x)).contains("in-law") | yes(x["resolved"])))),
    )
    trusted = yes(F.substring(tier, 1, 2).isin("T1", "T2")) | (yes(obituary) & yes(F.substring(tier, 1, 2) == "T3"))
    named = yes((F.size(words) > 1) & F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.length(w) > 1)) & yes(name != "(unnamed)")
    why = (
        F.when(yes(editable), "anyone edits the page")
        .when(~trusted, "tier")
        .when(~named, "no full name")
        .when(~yes(looked) & ~yes(made), "the matcher has not looked")
        .when(F.exists(family, lambda x: ~yes(x["computed"])), F.when(yes(made), "stands").otherwise("stated"))
        .when(F.size(family) > 0, "computed by the indexer")
        .when(F.exists(ties, lambda x: yes(x["accepted"])), "no family relationship")
        .otherwise("related to nobody accepted")
    )
    return F.struct(why.isin("stands", "stated").alias("creates"), why.alias("why"))


def cards(proposals: DataFrame, findings: DataFrame, rivals: DataFrame, key: str, k: int = 3) -> DataFrame:
    """``proposals`` with what a decision needs: findings (array of axis, verdict) by axis, the first k rivals by points, and their number.

    ``findings`` has (key, axis, verdict), ``rivals`` (key, rival, points). Both are aggregated by key first, rivals to k each before
    the arrays are made, so that a proposal with many rivals is one small row. Without any the arrays are empty; equal points go by rival.
    """
    f = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("axis", "verdict"))).alias("findings"))
    n = rivals.groupBy(key).agg(F.count("*").alias("n_rivals"))
    best = top_per_group(rivals, [key], [F.desc("points"), F.col("rival")], k)
    r = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("minus"), F.col("rival").alias("rival")))).alias("r"))
    ordered = F.transform("r", lambda x: F.struct(x["rival"].alias("rival"), (-x["minus"]).alias("points")))
    out = proposals.join(f, key, "left").join(n, key, "left").join(r, key, "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    points = rivals.schema["points"].dataType.simpleString()
    kind = rivals.schema["rival"].dataType.simpleString()
    return out.select(
        *[F.col(c) for c in proposals.columns], none(F.col("findings"), "array<struct<axis:string,verdict:string>>").alias("findings"),
        none(ordered, f"array<struct<rival:{kind},points:{points}>>").alias("rivals"), F.coalesce("n_rivals", F.lit(0)).alias("n_rivals"),
    )
