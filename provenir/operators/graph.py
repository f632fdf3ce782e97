"""Graph operators over edge DataFrames; every walk is a driver loop of joins with a table written each round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, label) for each end of ``edges`` (a, b); label is the smallest id reachable.

    Minimum labels spread over the edges and then jump to the label's own label, so a path of n nodes takes about log n
    rounds. Edges with a null end and loops link nothing; an empty edge table gives an empty result.
    """
    ends = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    both = scratch.table(ends.union(ends.select("dst", "src")).distinct())
    lab = scratch.table(both.groupBy(F.col("src").alias("id")).agg(F.min(F.least("src", "dst")).alias("label")))
    for _ in range(max_rounds):
        near = (
            both.join(lab.select(F.col("id").alias("dst"), F.col("label").alias("m")), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("m").alias("m"))
        )
        step = lab.join(near, "id").select("id", "label", F.least("label", "m").alias("l1"))
        jump = lab.select(F.col("id").alias("l1"), F.col("label").alias("l2"))
        new = scratch.table(
            step.join(jump, "l1").select("id", F.least("l1", "l2").alias("label"), (F.least("l1", "l2") < F.col("label")).alias("moved"))
        )
        scratch.drop(lab)
        lab = new
        if new.where("moved").isEmpty():
            scratch.drop(both)
            return new.select("id", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def ancestors(nodes: DataFrame, scratch: Scratch, max_depth: int = 30) -> DataFrame:
    """Closure (id, ancestor, depth) of ``nodes`` (id, parent); depth 0 is the node itself."""
    up = nodes.where("parent IS NOT NULL").select(F.col("id").alias("ancestor"), "parent")
    out = level = scratch.table(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    for d in range(1, max_depth + 1):
        level = scratch.table(level.join(up, "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise RuntimeError("deeper than max_depth, or a cycle")


def most_specific(sets: DataFrame, closure: DataFrame) -> DataFrame:
    """(group_id, id): for each group of nodes that lie on one root-leaf chain, the deepest; other groups have null.

    A group lies on a chain if all its nodes are among the deepest one's ancestors. A node that the closure does not know is on none.
    """
    up = closure.groupBy("id").agg(F.collect_set("ancestor").alias("up"))
    s = sets.select("group_id", "id").distinct().join(up, "id", "left")
    g = s.groupBy("group_id").agg(F.collect_set("id").alias("ids"), F.max(F.struct(F.size("up").alias("n"), "id", "up")).alias("deep"))
    return g.select("group_id", F.when(F.forall("ids", lambda x: F.array_contains("deep.up", x)), F.col("deep.id")).alias("id"))


def _grown(seen: DataFrame, frontier: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Both; written anew every 16 rounds, so that the plans of long walks stay small."""
    out = seen.union(frontier)
    return out if k % 16 else scratch.table(out)


def distances(edges: DataFrame, seeds: DataFrame, scratch: Scratch, max_depth: int | None = None) -> DataFrame:
    """(id, depth, origin) of nodes reached from the seeds (id, pos), within max_depth if given; equal depths go to the earliest seed."""
    e = edges.select(F.col("a").alias("id"), F.col("b").alias("next"))
    e = e.union(e.select(F.col("next"), F.col("id"))).distinct()
    seen = frontier = scratch.table(seeds.groupBy("id").agg(F.min("pos").alias("pos")).select("id", F.lit(0).alias("depth"), "pos"))
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(e, "id").groupBy(F.col("next").alias("id")).agg(F.min("pos").alias("pos"))
        frontier = scratch.table(step.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"), "pos"))
        if frontier.isEmpty():
            break
        seen = _grown(seen, frontier, d, scratch)
    return seen.select("id", "depth", F.col("pos").alias("origin"))


def generations(edges: DataFrame, home: DataFrame, scratch: Scratch, cap: int = 12) -> DataFrame:
    """(id, generation) over edges (a, b, step): a reaches b with step +1 (parent), -1 (child) or 0 (spouse); nearest to 0 wins.

    States are (id, generation), so the walk ends, however long the chains are; equal distance goes to the state found first, then to the older generation.
    """
    seen = frontier = scratch.table(home.select("id", F.lit(0).alias("generation"), F.lit(0).alias("round")))
    for k in count(1):
        step = frontier.join(edges.select(F.col("a").alias("id"), "b", "step"), "id")
        step = step.select(F.col("b").alias("id"), (F.col("generation") + F.col("step")).alias("generation")).where(F.abs("generation") <= cap).distinct()
        frontier = scratch.table(step.join(seen, ["id", "generation"], "left_anti").select("id", "generation", F.lit(k).alias("round")))
        if frontier.isEmpty():
            break
        seen = _grown(seen, frontier, k, scratch)
    best = F.min_by("generation", F.struct(F.abs("generation"), "round", -F.col("generation")))
    return seen.groupBy("id").agg(best.alias("generation"))


def simple_paths(edges: DataFrame, pairs: DataFrame, scratch: Scratch, slack: int = 2) -> DataFrame:
    """(start, goal, path) of all simple paths for each of ``pairs`` (start, goal) within ``slack`` links of its shortest.

    Distances to the goals come first, so a step that cannot reach its goal within the budget is never made; they are walked
    until every start of a goal is reached and ``slack`` rounds more, or nothing new is found. Pairs with no chain give none,
    as do null ends; a pair of equal ends has the path of that node alone.
    """
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("next")).where("id <> next")
    e = scratch.table(ends.union(ends.select("next", "id")).distinct())
    p = scratch.table(pairs.select("start", "goal").where("start IS NOT NULL AND goal IS NOT NULL").distinct())
    far = frontier = scratch.table(p.select("goal", F.col("goal").alias("id"), F.lit(0).alias("depth")).distinct())
    for d in count(1):
        # A goal is open while a start is not reached, and until depths reach slack beyond its farthest start.
        need = F.coalesce(F.col("depth") + slack, F.lit(d))
        live = p.withColumnRenamed("start", "id").join(far, ["goal", "id"], "left").groupBy("goal").agg(F.max(need).alias("need")).where(F.col("need") >= d)
        step = frontier.join(live, "goal", "left_semi").join(e, "id").select("goal", F.col("next").alias("id")).distinct()
        frontier = scratch.table(step.join(far, ["goal", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        far = _grown(far, frontier, d, scratch)
    budget = p.join(far.withColumnRenamed("id", "start"), ["goal", "start"]).select("start", "goal", (F.col("depth") + slack).alias("budget"))
    walk = scratch.table(budget.select("start", "goal", "budget", F.col("start").alias("id"), F.array("start").alias("path")))
    done = walk.where("id = goal")
    after = far.select("goal", F.col("id").alias("next"), "depth")
    while not walk.where("id <> goal").isEmpty():  # a path is within its budget
        step = walk.where("id <> goal").join(e, "id").where("NOT array_contains(path, next)").join(after, ["goal", "next"])
        step = step.where(F.size("path") + F.col("depth") <= F.col("budget"))
        walk = scratch.table(step.select("start", "goal", "budget", F.col("next").alias("id"), F.array_append("path", F.col("next")).alias("path")))
        done = done.union(walk.where("id = goal"))
    return done.select("start", "goal", "path")


def path_standing(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(start, goal, path, n_links, weakest, owed, place) for ``paths`` by the rank of their ``links`` (a, b, rank), 0 strongest.

    weakest: the greatest rank among links that have one, null where none has; owed: links without a rank. place: fewest links,
    then the strongest weakest link, then the path. Of a link named more than once, either way round, the strongest rank counts.
    """
    both = links.select("a", "b", "rank").union(links.select("b", "a", "rank")).groupBy("a", "b").agg(F.min("rank").alias("rank"))
    n = F.size("path") - 1
    step = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.get("path", k - 1).alias("a"), F.get("path", k).alias("b")))
    steps = paths.select("start", "goal", "path", F.explode_outer(F.when(n > 0, step)).alias("s")).select("start", "goal", "path", "s.a", "s.b")
    stood = steps.join(both, ["a", "b"], "left").groupBy("start", "goal", "path").agg(
        F.max("rank").alias("weakest"), F.count_if(F.col("a").isNotNull() & F.col("rank").isNull()).alias("owed")
    )
    order = Window.partitionBy("start", "goal").orderBy("n_links", F.col("weakest").asc_nulls_last(), "path")
    return stood.withColumn("n_links", n).withColumn("place", F.row_number().over(order)).select("start", "goal", "path", "n_links", "weakest", "owed", "place")


def chain_ends(rows: DataFrame, key: str, after: str, scratch: Scratch) -> DataFrame:
    """(key, latest, steps): the end of the chain that starts at each row; ``after`` names the row that takes its place, or null.

    Pointers double each round, so a chain of n takes about log n rounds. A name that is no row ends the chain there; a circle raises.
    """
    at = scratch.table(rows.select(F.col(key), F.coalesce(after, key).alias("latest"), F.col(after).isNotNull().cast("int").alias("steps")))
    for _ in range(at.count().bit_length() + 2):  # more than any chain of so many rows takes
        step = at.select(F.col(key).alias("latest"), F.col("latest").alias("l2"), F.col("steps").alias("s2"))
        new = at.join(step, "latest", "left").select(key, F.coalesce("l2", "latest").alias("latest"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), (F.coalesce("s2", F.lit(0)) > 0).alias("moved"))
        new = scratch.table(new)
        scratch.drop(at)
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at
    raise RuntimeError("a circle of rows that take one another's place")


def ancestors_of(nodes: DataFrame, start: DataFrame, scratch: Scratch, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth) for the nodes of ``start`` (id) alone, generation by generation, to the last parent or max_depth."""
    up = nodes.where("parent IS NOT NULL").select(F.col("id").alias("ancestor"), "parent")
    out = level = scratch.table(start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        step = level.join(up, "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).distinct()
        level = scratch.table(step.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        if level.isEmpty():
            break
        out = _grown(out, level, d, scratch)
    return out
