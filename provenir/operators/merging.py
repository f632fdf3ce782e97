"""Duplicates merged into the persons that they duplicate, over every table that names a person.

A merge is an id remap, chains of merges followed to their end first, and for each table a rule for rows that fall together. Partner sets depend on
persons alone, so once persons are remapped, one pass folds every family of a kept person into the earliest of those with the same
partners, and merging again changes nothing. Each table is one join on its id and one window or aggregation on the remapped key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import folds, graph


@dataclass
class Tree:
    """The tables of one tree. Ids are unique within a table, but for ``links``, ``members`` and ``participants``, whose rows are named by their columns.

    persons (id, merged_into), links (person, persona, status, proposal, decided_at), members (family, person, role), aliases (id, person,
    value), questions (id, person, key, status), steps (id, person, step_key), runs (id, step), proposals (id, kind, persons: map of payload
    keys to person ids), events (columns of ``folds.fold_events``, with owner_kind person or family and owner), statements (id, subject_kind, subject, family,
    role, fact, vouch): subject is a person, an event, or with family and role a membership.
    """

    persons: DataFrame
    links: DataFrame
    members: DataFrame
    aliases: DataFrame
    questions: DataFrame
    steps: DataFrame
    runs: DataFrame
    proposals: DataFrame
    events: DataFrame
    statements: DataFrame


def remap(persons: DataFrame, merges: DataFrame, scratch: Scratch) -> DataFrame:
    """(old, new, hops) of every merged person: ``merges`` (dup, kept) and those made before, each chain followed to its end.

    A person merged twice goes where the first of the two, by kept id, says; into itself or into nobody is no merge; a circle raises.
    """
    said = merges.where("dup <> kept").select(F.col("dup").alias("id"), F.col("kept").alias("into"), F.lit(1).alias("n"))
    before = persons.where("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("into"), F.lit(0).alias("n"))
    one = said.union(before).groupBy("id").agg(F.min(F.struct("n", "into"))["into"].alias("into"))
    rows = persons.select("id").join(one, "id", "left")
    ends = graph.chain_ends(rows, "id", "into", scratch)
    return ends.where("id <> latest").select(F.col("id").alias("old"), F.col("latest").alias("new"), F.col("steps").alias("hops"))


def moved(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` remapped by ``ids`` (old, new), and ``own__``: the row was the kept one's before."""
    m = ids.select(F.col("old").alias(column), F.col("new").alias("new__"))
    return df.join(m, column, "left").withColumn("own__", F.col("new__").isNull()).withColumn(column, F.coalesce("new__", column)).drop("new__")


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("place__", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def merge_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a person and persona: the kept person's own, or the first that moved. An undecided row takes the first decision among the others."""
    decided = (F.coalesce("status", F.lit("undecided")) != "undecided").alias("decided__")
    # The person as it was, remapped beside it: the order of rows that meet.
    rows = moved(links.select("*", F.col("person").alias("was__"), decided), ids, "person")
    return _first(rows, ["person", "persona"], [F.desc("decided__"), F.desc("own__"), "was__", "decided_at", "proposal"]).where("place__ = 1").select(*links.columns)


def folded_families(members: DataFrame, ids: DataFrame) -> DataFrame:
    """(old, new): families of a kept person whose partners are exactly those of an earlier family, after the remap."""
    partners = moved(members.where("role = 'partner'"), ids, "person").groupBy("family").agg(F.array_sort(F.collect_set("person")).alias("partners"))
    kept = ids.select(F.col("new").alias("person")).distinct().withColumn("kept", F.lit(True))
    of = partners.select("family", "partners", F.explode("partners").alias("person")).join(kept, "person", "left_semi").select("family", "partners").distinct()
    first = of.groupBy("partners").agg(F.min("family").alias("new"))
    return of.join(first, "partners").where("family <> new").select(F.col("family").alias("old"), "new")


def merge_members(members: DataFrame, ids: DataFrame, families: DataFrame) -> DataFrame:
    """Memberships with persons and families remapped, one row each; the partner rows of a folded family are those of the family that it is folded into."""
    return moved(moved(members, ids, "person").drop("own__"), families, "family").select(*members.columns).distinct()


def merge_aliases(aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """A person holds a name as written once: the kept person's own row stands, else the smallest id."""
    return _first(moved(aliases, ids, "person"), ["person", "value"], [F.desc("own__"), "id"]).where("place__ = 1").select(*aliases.columns)


def merge_questions(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Questions of the kept person. One whose key it holds already stays with the duplicate, closed as answered if it was open, as does the
    question whether the two are one (kind duplicate_person, its key naming the other)."""
    rows = moved(questions.withColumn("was__", F.col("person")), ids, "person")
    other = F.split_part("key", F.lit(":"), F.lit(2)).cast("long")
    m = ids.select(F.col("old").alias("other__"), F.col("new").alias("into__"))
    rows = rows.withColumn("other__", F.when(F.startswith("key", F.lit("duplicate_person:")), other)).join(m, "other__", "left")
    answered = F.coalesce(F.coalesce("into__", "other__") == F.col("person"), F.lit(False))
    rows = _first(rows.withColumn("answered__", answered), ["person", "key"], [F.desc("own__"), "id"])
    stays = F.col("answered__") | (~F.col("own__") & (F.col("place__") > 1))
    status = F.when(stays & (F.col("status") == "open"), "answered").otherwise(F.col("status"))
    return rows.select(*[F.when(stays, F.col("was__")).otherwise(F.col("person")).alias("person") if c == "person" else status.alias("status") if c == "status" else F.col(c) for c in questions.columns])


def merge_steps(steps: DataFrame, runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and runs: of the steps of one key the kept person's stays unless another alone has runs; the runs of those that go are carried to it."""
    ran = runs.select(F.col("step").alias("id")).distinct().withColumn("ran__", F.lit(True))
    rows = moved(steps, ids, "person").join(ran, "id", "left").withColumn("ran__", F.coalesce("ran__", F.lit(False)))
    rows = _first(rows, ["person", "step_key"], [F.desc("ran__"), F.desc("own__"), "id"])
    kept = rows.where("place__ = 1").select(*steps.columns)
    into = rows.where("place__ > 1").select(F.col("id").alias("old"), "person", "step_key").join(kept.select("person", "step_key", F.col("id").alias("new")), ["person", "step_key"]).select("old", "new")
    return kept, moved(runs, into, "step").select(*runs.columns)


def merge_proposals(proposals: DataFrame, ids: DataFrame) -> DataFrame:
    """Every person that a payload names is the kept one; a duplicate_person proposal keeps its words."""
    named = proposals.where("kind <> 'duplicate_person'").select("id", F.explode("persons").alias("key__", "person"))
    again = moved(named, ids, "person").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key__", "person"))).alias("again__"))
    out = proposals.join(again, "id", "left")
    return out.select(*[F.coalesce("again__", "persons").alias("persons") if c == "persons" else F.col(c) for c in proposals.columns])


def merge_events(events: DataFrame, ids: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of their kept owners, and (old, new) of those that are one event with another of the owner: they stay with the owner they had."""
    is_person = F.col("owner_kind") == "person"
    p = moved(events.where(is_person).withColumn("was__", F.col("owner")), ids, "owner")
    f = moved(events.where(~is_person).withColumn("was__", F.col("owner")), families, "owner")
    rows = p.union(f)
    touched = rows.where("NOT own__").select("owner_kind", "owner").distinct()
    mine = rows.join(touched, ["owner_kind", "owner"], "left_semi")  # only owners that something moved to are gone over
    side = folds.fold_sides(mine, ["owner_kind", "owner"])
    into = side.where("id <> kept AND NOT refused").select(F.col("id").alias("old"), F.col("kept").alias("new"))
    out = rows.join(into.select(F.col("old").alias("id"), F.lit(True).alias("gone__")), "id", "left")
    owner = F.when(F.coalesce("gone__", F.lit(False)), F.col("was__")).otherwise(F.col("owner")).alias("owner")
    return out.select(*[owner if c == "owner" else F.col(c) for c in events.columns]), into


def merge_statements(statements: DataFrame, ids: DataFrame, families: DataFrame, events: DataFrame) -> DataFrame:
    """Statements follow what they are of. On an event a second statement of one fact, and a second vouch, stay on the folded event."""
    kind = F.col("subject_kind")
    of_person = moved(statements.where(kind == "person"), ids, "subject").select(*statements.columns)
    of_member = moved(moved(statements.where(kind == "member"), ids, "subject").drop("own__"), families, "family").select(*statements.columns)
    e = moved(statements.where(kind == "event").withColumn("was__", F.col("subject")), events, "subject")
    same = F.when(F.col("fact").isNotNull(), F.concat(F.lit("f"), F.col("fact").cast("string"))).when(F.coalesce("vouch", F.lit(False)), "v")
    e = e.withColumn("same__", F.coalesce(same, F.concat(F.lit("i"), F.col("id").cast("string"))))
    # What one event held twice before the merge moves or stays together: the kept event comes first, then folded ones by id.
    before = F.rank().over(Window.partitionBy("subject", "same__").orderBy(F.desc("own__"), "was__"))
    e = e.withColumn("before__", before)
    stays = F.col("before__") > 1
    of_event = e.select(*[F.when(stays, F.col("was__")).otherwise(F.col("subject")).alias("subject") if c == "subject" else F.col(c) for c in statements.columns])
    return of_person.union(of_member).union(of_event)


def merge_tree(tree: Tree, merges: DataFrame, scratch: Scratch) -> Tree:
    """The tree after ``merges`` (dup, kept). Merged persons stay, named by ``merged_into``, and hold nothing but what was folded away."""
    ids = scratch.table(remap(tree.persons, merges, scratch))
    families = scratch.table(folded_families(tree.members, ids))
    events, into = merge_events(tree.events, ids, families)
    into = scratch.table(into)
    steps, runs = merge_steps(tree.steps, tree.runs, ids)
    persons = tree.persons.drop("merged_into").join(ids.select(F.col("old").alias("id"), F.col("new").alias("merged_into")), "id", "left").select(*tree.persons.columns)
    return Tree(
        persons, merge_links(tree.links, ids), merge_members(tree.members, ids, families), merge_aliases(tree.aliases, ids), merge_questions(tree.questions, ids),
        steps, runs, merge_proposals(tree.proposals, ids), events, merge_statements(tree.statements, ids, families, into),
    )
