"""Evidence operators: three-state status, top-1 choices, supersession, islands, nearest match, folds, plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded_status(status: Column, empty: str = "undecided") -> Column:
    """Aggregate: accepted if any is, rejected if all are, else undecided; ``empty`` for no statement."""
    return (
        F.when(F.count(status) == 0, F.lit(empty))
        .when(F.max(F.when(status == "accepted", 1).otherwise(0)) == 1, "accepted")
        .when(F.min(F.when(status == "rejected", 1).otherwise(0)) == 1, "rejected")
        .otherwise("undecided")
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group by a total order. Spark's group limit prunes before and after the shuffle."""
    return df.withColumn("rn__", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn__") <= k).drop("rn__")


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``: one partial aggregation, so a hot key costs no large task."""
    rest = [c for c in df.columns if c not in by and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("r")
    return df.groupBy(*by).agg(row).select(*by, *[F.col(f"r.{c}") for c in [*order, *rest]])


def islands(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive whole numbers: (by..., first, last, n)."""
    w = Window.partitionBy(*by).orderBy(at)
    d = df.select(*by, at).distinct().withColumn("run__", F.col(at) - F.row_number().over(w))
    return d.groupBy(*by, "run__").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("run__")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, right_id: str) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time; ``ambiguous`` where two are equally near.

    Two running windows over the union find the last before and the first after: no pair of rows is made.
    """
    keys = [F.col(c) for c in on]
    null = lambda c: F.lit(None).cast(right.schema[c].dataType)
    l_ = left.withColumn("left__", F.struct(*left.columns)).select(*keys, F.col(left_at).alias("at__"), "left__", null(right_id).alias("id__"), F.lit(0).alias("n__"))
    r_ = right.groupBy(*on, F.col(right_at).alias("at__")).agg(F.min(right_id).alias("id__"), F.count("*").alias("n__"))
    r_ = r_.select(*keys, "at__", F.lit(None).cast(l_.schema["left__"].dataType).alias("left__"), "id__", F.col("n__").cast("int"))
    hit = F.when(F.col("n__") > 0, F.struct("at__", "id__", "n__"))
    w = Window.partitionBy(*on).orderBy("at__")
    before = F.last(hit, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # Backwards from the end, so that this frame grows row by row as well.
    back = Window.partitionBy(*on).orderBy(F.desc("at__")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.last(hit, ignorenulls=True).over(back)
    m = l_.unionByName(r_).withColumn("b__", before).withColumn("a__", after).where("left__ IS NOT NULL")
    gap = lambda c: F.abs(F.col(f"{c}.at__").cast("long") - F.col("at__").cast("long"))
    first = F.col("a__").isNull() | (gap("b__") <= gap("a__"))
    one = F.when(F.col("b__").isNull() & F.col("a__").isNull(), None).when(F.col("b__").isNotNull() & first, F.col("b__")).otherwise(F.col("a__"))
    tie = (gap("b__") == gap("a__")) & (F.col("b__.at__") != F.col("a__.at__"))
    m = m.withColumn("o__", one).withColumn("ambiguous", F.coalesce((F.col("o__.n__") > 1) | tie, F.lit(False)))
    return m.select("left__.*", F.when(~F.col("ambiguous"), F.col("o__.id__")).alias("nearest_id"), "ambiguous")


def diff_plan(wanted: DataFrame, existing: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, action): insert, keep, reopen, leave closed or close. ``status`` of existing rows is open, gone or closed."""
    w = wanted.select(key, F.lit(True).alias("w__")).dropDuplicates([key])
    both = w.join(existing.select(key, status), key, "full_outer")
    s = F.col(status)
    action = (
        F.when(F.col("w__") & s.isNull(), "insert")
        .when(F.col("w__") & (s == "open"), "keep")
        .when(F.col("w__") & (s == "gone"), "reopen")
        .when(F.col("w__"), "leave closed")
        .when(s == "open", "close")
        .otherwise("leave closed")
    )
    return both.select(key, action.alias("action"))


def upsert(new: DataFrame, old: DataFrame, key: list[str], replace: bool = True) -> DataFrame:
    """Rows of both by key; the new row wins, or the old one with ``replace=False``."""
    first, second = (new, old) if replace else (old, new)
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


def blocked_pairs(left: DataFrame, right: DataFrame, blocks: list[tuple[Column, Column]], fits: Column) -> DataFrame:
    """Candidate pairs that share a blocking key and fit; left columns are prefixed l_, right r_; a pair comes once.

    Each row has one entry for each distinct key, and a pair counts in the first key that it shares.
    """
    def side(df: DataFrame, p: str, k: int) -> DataFrame:
        keys = F.array_distinct(F.filter(F.array(*[F.concat(F.lit(f"{i}:"), b[k]) for i, b in enumerate(blocks)]), lambda x: x.isNotNull()))
        return df.select(*[F.col(c).alias(p + c) for c in df.columns], keys.alias(p + "keys"))

    a = side(left, "l_", 0).withColumn("key__", F.explode("l_keys"))
    b = side(right, "r_", 1).withColumn("key__", F.explode("r_keys"))
    return a.join(b, "key__").where((F.element_at(F.array_intersect("l_keys", "r_keys"), 1) == F.col("key__")) & fits).drop("key__", "l_keys", "r_keys")


def complete_link(df: DataFrame, by: list[str], order: list[str], agree, schema: str) -> DataFrame:
    """Greedy complete-link groups: in ``order`` each row joins the first group of its key with every member of which it agrees.

    The rule depends on order and is not transitive, so each key's rows meet in one task; a key is one subject's events, not a
    share of the corpus.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        groups: list[list[int]] = []
        out = []
        rows = pdf.to_dict("records")
        for i, r in enumerate(rows):
            k = next((k for k, g in enumerate(groups) if all(agree(r, rows[j]) for j in g)), len(groups))
            if k == len(groups):
                groups.append([])
            groups[k].append(i)
            out.append(k)
        return pdf.assign(side=out)

    return df.groupBy(*by).applyInPandas(group, schema)


def event_sides(df: DataFrame, by: list[str], compared: list[str], order: str, agree) -> DataFrame:
    """``df`` with its ``side``: complete-link groups over the distinct compared values of each key, so that repeats cost a task nothing.

    ``agree`` takes two rows as dicts. Values come in the order of their smallest ``order``.
    """
    one = df.groupBy(*by, *compared).agg(F.min(order).alias(order))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in one.schema) + ", side int"
    sided = complete_link(one, by, [order], agree, schema).select(*[F.col(c).alias(c + "__") for c in [*by, *compared]], "side")
    same = [F.col(c).eqNullSafe(F.col(c + "__")) for c in [*by, *compared]]
    return df.join(sided, same).select(*df.columns, "side")


def fill_from(kept: DataFrame, others: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Fills nulls of the kept rows with the first non-null of the others in ascending order: one partial aggregation, no window."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], F.col(c).alias("v"))))["v"]
    best = others.groupBy(*by).agg(*[first(c).alias(c + "__") for c in columns])
    out = kept.join(best, by, "left")
    return out.select(*[F.coalesce(c, c + "__").alias(c) if c in columns else F.col(c) for c in kept.columns])


def checklist(subjects: DataFrame, rules: list[tuple[str, Column]], found: DataFrame, key: str) -> DataFrame:
    """(key, rule, status) for each subject and rule: held, cited, missing or n/a.

    ``rules`` are names with the condition under which they apply to a subject; ``found`` (key, rule, held) has the citations.
    A citation counts whether the rule applies or not: held where one of them is, else cited. Without any, the status is
    missing where the rule applies and n/a where it does not or cannot be told. Citations of unknown subjects are ignored.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(applies, F.lit(False)).alias("applies")) for n, applies in rules])).alias("r")
    best = found.groupBy(key, "rule").agg(F.max(F.coalesce("held", F.lit(False))).alias("held"))
    status = F.when(F.col("held"), "held").when(~F.col("held"), "cited").when(F.col("applies"), "missing").otherwise("n/a")
    return subjects.select(key, rows).select(key, "r.*").join(best, [key, "rule"], "left").select(key, "rule", status.alias("status"))


def decided(log: DataFrame, by: list[str], value: str, owner: str, at: list[str]) -> DataFrame:
    """(by..., by_owner, value): the standing decision of each key, the owner's last or else code's first; ties go to the smaller value."""
    last = F.max(F.when(F.col(owner), F.struct(*at))).alias("last")
    first = F.min(F.when(~F.col(owner), F.struct(*at))).alias("first")
    g = log.groupBy(*by).agg(last, first)
    here = F.when(F.col("last").isNotNull(), F.col(owner) & (F.struct(*at) == F.col("last"))).otherwise(~F.col(owner) & (F.struct(*at) == F.col("first")))
    return log.join(g, by).where(here).groupBy(*by).agg(F.bool_or(owner).alias("by_owner"), F.min(value).alias(value))


def step_plan(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, action) for the steps of a plan; ``existing`` has (key, status, owner, runs, done), status open, skipped, gone or closed.

    Wanted: insert, keep, plan again (skipped), reopen (gone) or leave closed. Not wanted: closed ones stay so; done and the owner's
    are kept, those with runs are skipped, the rest is deleted.
    """
    both = wanted.select(key, F.lit(True).alias("w__")).dropDuplicates([key]).join(existing.select(key, "status", "owner", "runs", "done"), key, "full_outer")
    s, w = F.col("status"), F.col("w__")
    action = (
        F.when(w & s.isNull(), "insert")
        .when(w, F.when(s == "skipped", "plan again").when(s == "gone", "reopen").when(s == "open", "keep").otherwise("leave closed"))
        .when(s.isin("gone", "closed"), "leave closed")
        .when(F.col("done") | F.col("owner"), "keep")
        .when(F.col("runs"), "skip")
        .otherwise("delete")
    )
    return both.select(key, action.alias("action"))
