r"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Source s has a target of T_s words and a weight schedule over training time t in [0, 1] that falls or rises linearly:
T_s * (1 + g_s * (2t - 1)). Its integral, T_s * ((1 - g_s) t + g_s t^2), is the words of s demanded until t. Documents of
a source stand in the order of a hash of their id, repeated for a second pass; the words before a document give its
position by inverting the demand. Words before a document come from bucket totals and a window inside one bucket, so no
task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

WEIGHTS, SLOPES = (3, 1, 2), (0.5, -0.5, 0.0)
SHARE, EPOCHS = 1.5, 2
#: Documents of a source are dealt out by the first three hexadecimal digits of their hash: 4096 buckets in hash order.

_SIZE = r"[^\x20\x09-\x0D]+"


def _by(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def _in_order(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over the rows before (name) and over all rows (all_name), in a total order.

    Rows are dealt to ranges of the order; a window sees one range, and one more window a row for each range.
    """
    dealt = df.repartitionByRange(*order).withColumn("range__", F.spark_partition_id())
    dealt = scratch.table(dealt.select("*", *[x.cast("long").alias(f"own_{n}") for n, x in sums.items()]))
    per = dealt.groupBy("range__").agg(*[F.sum(f"own_{n}").alias(f"own_{n}") for n in sums])
    ranges = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = [c for n in sums for c in (F.coalesce(F.sum(f"own_{n}").over(ranges), F.lit(0)).alias(f"off_{n}"), F.sum(f"own_{n}").over(every).alias(f"all_{n}"))]
    inside = Window.partitionBy("range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"own_{n}").over(inside), F.lit(0)).alias(f"in_{n}") for n in sums]
    met = dealt.select("*", *before).join(per.select("range__", *offsets), "range__")
    return met.select(*df.columns, *[(F.col(f"off_{n}") + F.col(f"in_{n}")).alias(n) for n in sums], *[f"all_{n}" for n in sums])


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, slope): a row for each source of ``sizes`` (source, source_size).

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share share * total. A target stops at
    epochs * source_size and the excess goes to the others by weight: with sources in ascending epochs * size / weight, the first
    so many are at their stop, and the level of the rest is one division. No task sees all sources.
    """
    ranked = _in_order(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"k": F.lit(1)}, scratch)
    t = ranked.select("source", "source_size", "k", _by(weights, F.col("k")).alias("weight"), _by(slopes, F.col("k")).alias("slope"), (F.col("source_size") * epochs).alias("stop"))
    t = t.withColumn("ratio", F.col("stop") / F.col("weight"))
    t = _in_order(t, [F.col("ratio"), F.col("k")], {"stopped": F.col("stop"), "lighter": F.col("weight"), "words": F.col("source_size")}, scratch)
    # The level if this source and all after it are below their stop.
    level = (F.col("all_words") * share - F.col("stopped")) / (F.col("all_lighter") - F.col("lighter"))
    t = scratch.table(t.select("source", "source_size", "weight", "slope", "stop", level.alias("level")))
    # Levels rise up to the first source below its stop and fall after it: the greatest below a stop is the level of the rest.
    final = t.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level")))).first()[0]  # one number
    stop = F.col("stop").cast("double")
    target = stop if final is None else F.least(stop, F.lit(final) * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"), "slope")


def _position(y: Column, g: Column) -> Column:
    """The time at which the demanded share reaches y."""
    r = 1 - g
    return F.when(g == 0, y).otherwise((F.sqrt(r * r + 4 * g * y) - r) / (2 * g))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, passes, position, again) for each row of ``docs`` (doc_id, text, source).

    taken: words of the document before its source's target in the repeated order; the document at the target is taken in
    part, so a source takes its target rounded to whole words. passes: taken as whole documents, halves up. position: time
    of the first word; again: time of its second pass; null where nothing is taken. Null texts have size 0; a null source is a source of its own, the last;
    rows of equal id follow one another by the hash of their texts, and equal rows in any order; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(_SIZE)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", size.alias("size"), digest.alias("digest"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("bucket", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    # One pass over the texts; what follows reads numbers.
    rows = scratch.table(rows.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source"))
    per = rows.groupBy("s", "none", "bucket").agg(F.sum("size").alias("words"))
    per = per.withColumn("before", F.sum("words").over(Window.partitionBy("s", "none").orderBy("bucket")) - F.col("words"))
    sizes = per.groupBy("s", "none").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(~F.col("none"), F.col("s")))
    targets = source_targets(sizes, scratch).withColumn("s", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    placed = per.select("s", "none", "bucket", "before").join(targets.drop("source"), ["s", "none"])

    inside = Window.partitionBy("s", "none", "bucket").orderBy("digest", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(placed, ["s", "none", "bucket"])
    whole = F.round("target").cast("long")
    start = F.col("before") + F.col("own")
    part = lambda e: F.greatest(F.least(whole - (start + e * F.col("source_size")), F.col("size")), F.lit(0))
    taken = sum((part(e) for e in range(1, EPOCHS)), part(0))
    y = lambda words: F.least(words / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
    return out.select(
        "doc_id", "h", "size", "source_size", "target", taken.alias("taken"),
        F.floor(taken / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias("passes"),
        F.when(taken > 0, _position(y(start), F.col("slope"))).alias("position"),
        F.when(part(1) > 0, _position(y(start + F.col("source_size")), F.col("slope"))).alias("again"),
        (start / F.greatest(F.col("target"), F.lit(1.0))).alias("share"), "slope",
    )


def curriculum(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns whatever their names, each as often as it is taken (to the nearest whole pass).

    Rows are sorted by position: the range that a task holds follows the one before. Rows equal in id and text share their places,
    each copy keeps its own by number; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    m = mix(docs).select("doc_id", "h", "passes", "share", "slope", (F.col("source_size") / F.greatest(F.col("target"), F.lit(1.0))).alias("once"))
    place = lambda k: _position(F.least(F.col("share") + k * F.col("once"), F.lit(1.0)), F.col("slope"))
    own = F.transform(F.sequence(F.lit(0), F.col("passes") - 1), place)
    own = m.select("doc_id", "h", F.when(F.col("passes") > 0, own).otherwise(F.array().cast("array<double>")).alias("own"))
    at = scratch.table(own.groupBy("doc_id", "h").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("at"), F.count("*").alias("copies")))
    # Original rows travel as one struct, so that none of their columns meets a name used here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if docs.columns else F.struct().alias("row")
    d = docs.select(whole, F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))

    def met(some: DataFrame, places: DataFrame) -> DataFrame:
        p = places.select(F.col("doc_id").alias("pi"), F.col("h").alias("ph"), "at", "copies")
        return some.join(p, F.col("i").eqNullSafe(F.col("pi")) & (F.col("h") == F.col("ph")))

    out = met(d, at.where("copies = 1 AND size(at) > 0")).select("row", F.explode("at").alias("position"), "i")
    several = at.where("copies > 1 AND size(at) > 0")
    if not several.isEmpty():
        numbered = met(d, several).withColumn("copy", F.row_number().over(Window.partitionBy("i", "h").orderBy(F.lit(0))) - 1)
        mine = F.filter("at", lambda x, k: F.pmod(k, F.col("copies")) == F.col("copy"))
        out = out.union(numbered.select("row", F.explode(mine), "i"))
    return out.repartitionByRange("position", "i").sortWithinPartitions("position", "i").select("row.*")
