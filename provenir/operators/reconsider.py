"""Decisions of a rule examined again: what falls with what, what a fall or a decision opens, and why.

Both passes are semi-naive: a round looks at the dependents of what changed in the round before and at nothing else. The number of grounds of each
decision is counted once; a round joins the changed ids with the grounds that name them, and the counts with the ids touched.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

_COMPACT = 8


def _rounds(base: DataFrame, leaning: DataFrame, first: DataFrame, sign: int, scratch: Scratch, trace: list[dict]) -> DataFrame:
    """(id, round, cause) of the ids that pass from one side of their need to the other, round by round.

    ``base`` (id, n, need): grounds at the start; ``leaning`` (id, rests_on); ``first`` (id): what changed at the start. With sign -1 grounds are
    lost and an id falls below its need, with 1 they are gained and it rises to it.
    """
    out = delta = scratch.table(first.select("id", F.lit(0).alias("round"), F.lit(None).cast("long").alias("cause")))
    moved = None  # (id, change): what ids touched so far have lost or gained
    passed = lambda n: (n < F.col("need")) if sign < 0 else (n >= F.col("need"))
    for k in count(1):
        touched = leaning.join(delta.select(F.col("id").alias("rests_on")), "rests_on").groupBy("id").agg(F.count("*").alias("now"), F.min("rests_on").alias("cause"))
        before = F.lit(0).cast("long")
        if moved is not None:
            sums = moved.join(touched.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("change").alias("before"))
            touched, before = touched.join(sums, "id", "left"), F.coalesce("before", F.lit(0))
        n = F.col("n") + sign * before
        step = base.join(touched, "id").select("id", "now", "cause", (~passed(n) & passed(n + sign * F.col("now"))).alias("changed"))
        step = scratch.table(step)  # the only rows that the round makes: those touched
        seen = step.agg(F.count("*").alias("touched"), F.count_if("changed").alias("changed")).first()
        trace.append({"round": k, "touched": seen["touched"], "changed": seen["changed"]})
        if not seen["changed"]:
            return out
        delta = step.where("changed").select("id", F.lit(k).alias("round"), "cause")
        change = step.select("id", F.col("now").alias("change"))
        moved = change if moved is None else moved.union(change)
        out = out.union(delta)
        if not k % _COMPACT:
            moved, out = scratch.table(moved.groupBy("id").agg(F.sum("change").alias("change"))), scratch.table(out)


def reconsider(decisions: DataFrame, cards: DataFrame, grounds: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[dict]]:
    """(id, outcome, round, cause) for each decision and card, and a list of what each round touched and changed.

    ``decisions`` (id, order, need) were taken by the rule, ``cards`` (id, need) are undecided, ``grounds`` (id, rests_on) say what each rests on;
    one that rests on nothing (null) is the owner's and always stands. A decision is examined on the ground that stood before it: grounds that
    rest on a later decision, on one of the same order or on no decision do not count. It is withdrawn when fewer than ``need`` stand, and what rests on it with it.
    Then every card, a withdrawn decision among them, is taken when enough of its grounds stand by now, later decisions and cards taken included, and a card
    taken can open another.

    outcome: kept, withdrawn, retaken, taken or left. round: the round of the last change, null for kept and left. cause: the smallest of the
    grounds whose change in that round decided it, null where it changed at once. Ids are unique and a null need is 1; repeated grounds count each.
    """
    need = F.coalesce("need", F.lit(1)).alias("need")
    d = scratch.table(decisions.select("id", "order", need).where("id IS NOT NULL"))
    c = cards.select("id", need).where("id IS NOT NULL")
    earlier = grounds.join(d, "id").join(d.select(F.col("id").alias("rests_on"), F.col("order").alias("was")), "rests_on", "left")
    valid = scratch.table(earlier.where("rests_on IS NULL OR was < order").select("id", "rests_on"))
    held = valid.groupBy("id").agg(F.count("*").alias("n"))
    base = scratch.table(d.join(held, "id", "left").select("id", "need", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    trace: list[dict] = []
    fallen = scratch.table(_rounds(base, valid.where("rests_on IS NOT NULL"), base.where("n < need"), -1, scratch, trace))
    for r in trace:
        r["pass"] = "withdraw"

    stands = d.select("id").join(fallen.select("id"), "id", "left_anti")
    open_ = scratch.table(c.union(d.select("id", "need").join(fallen.select("id"), "id", "left_semi")))
    theirs = scratch.table(grounds.select("id", "rests_on").join(open_.select("id"), "id", "left_semi"))
    on_stand = theirs.join(stands.withColumnRenamed("id", "rests_on"), "rests_on", "left_semi").select("id")
    ready = theirs.where("rests_on IS NULL").select("id").union(on_stand).groupBy("id").agg(F.count("*").alias("n"))
    base = scratch.table(open_.join(ready, "id", "left").select("id", "need", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    again: list[dict] = []
    taken = scratch.table(_rounds(base, theirs.where("rests_on IS NOT NULL"), base.where("n >= need"), 1, scratch, again))
    for r in again:
        r["pass"] = "take"
    out = d.select("id", F.lit(True).alias("was")).union(c.select("id", F.lit(False)))
    side = lambda df, p: df.select("id", F.col("round").alias(f"{p}_round"), F.col("cause").alias(f"{p}_cause"))
    out = out.join(side(fallen, "f"), "id", "left").join(side(taken, "t"), "id", "left")
    fell, took = F.col("f_round").isNotNull(), F.col("t_round").isNotNull()
    outcome = F.when(F.col("was") & ~fell, "kept").when(F.col("was") & took, "retaken").when(F.col("was"), "withdrawn").when(took, "taken").otherwise("left")
    out = out.select("id", outcome.alias("outcome"), F.coalesce("t_round", "f_round").alias("round"), F.when(took, F.col("t_cause")).otherwise(F.col("f_cause")).alias("cause"))
    return out, trace + again
