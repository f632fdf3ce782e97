"""Scans that are no pages: JSON responses by shape, delimited rows under a known header, rows of fixed width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEDULE = "struct<results:array<struct<scheduleId:string,highlight:string,names:array<string>>>>"
_INSIDE = "struct<ia:string,q:string,matches:array<struct<text:string,par:array<struct<page:long>>>>>"


def json_scan(scans: DataFrame, text: str) -> DataFrame:
    """``scans`` with ``scan``: struct (kind, schedule, names, segment, full_text, name) of a JSON response; kind is null where no shape claims it.

    schedule: one result with an id and names, not a search hit. page_text: an object of segments that each have a full text; the
    first is taken. profile: a list whose first entry has a profile with a name. inside: matches of a search inside one item, their
    texts without markup, one a line, of all pages or those in the column ``pages`` if there is one. Null, empty and broken texts have no kind.
    """
    t = F.col(text)
    schedule = F.from_json(t, _SCHEDULE)["results"]
    segments = F.from_json(t, "map<string,struct<full_text:string>>")
    profile = F.get(F.from_json(t, "array<struct<profile:struct<Name:string>>>"), F.lit(0))["profile"]["Name"]
    inside = F.from_json(t, _INSIDE)
    s = F.get(schedule, F.lit(0))
    bodies = F.map_values(segments)
    wanted = F.filter(inside["matches"], lambda m: F.exists(m["par"], lambda p: F.array_contains(F.col("pages"), p["page"]))) if "pages" in scans.columns else inside["matches"]
    lines = F.array_join(F.transform(wanted, lambda m: F.regexp_replace(F.coalesce(m["text"], F.lit("")), "<[^>]*>", "")), "\n")
    kind = (
        F.when((F.size(schedule) == 1) & s["scheduleId"].isNotNull() & s["names"].isNotNull() & (F.coalesce(s["highlight"], F.lit("")) == ""), "schedule")
        .when((F.size(bodies) > 0) & F.forall(bodies, lambda b: b["full_text"].isNotNull()), "page_text")
        .when(F.coalesce(profile, F.lit("")) != "", "profile")
        .when(inside["ia"].isNotNull() & inside["q"].isNotNull() & inside["matches"].isNotNull(), "inside")
    )
    of = lambda k, c: F.when(F.col("kind__") == k, c)
    scan = F.struct(
        F.col("kind__").alias("kind"), of("schedule", s["scheduleId"]).alias("schedule"), of("schedule", s["names"]).alias("names"),
        F.coalesce(of("page_text", F.get(F.map_keys(segments), F.lit(0))), of("inside", inside["ia"])).alias("segment"),
        F.coalesce(of("page_text", F.get(bodies, F.lit(0))["full_text"]), of("inside", lines)).alias("full_text"), of("profile", profile).alias("name"),
    )
    return scans.withColumn("kind__", kind).select(*[F.col(c) for c in scans.columns], scan.alias("scan"))


def _lines(text: Column) -> Column:
    """Lines that hold more than white space."""
    return F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")


def delimited_scan(scans: DataFrame, key: str, text: str, header: list[str], one: str) -> DataFrame:
    """(key, seq, row): the rows below a first line that is ``header``; a text whose rows hold several values of column ``one`` gives none.

    ``row`` is a struct of strings by header; values are compared trimmed and in lower case. A text is one searcher's derivative, so
    several values mean that it is the whole file. Records stand on one line each; missing fields are null.
    """
    lines = _lines(F.col(text))
    claimed = scans.where(F.trim(F.get(lines, F.lit(0))) == ",".join(header))
    rows = claimed.select(F.col(key), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("at", "line"))
    read = rows.select(key, (F.col("at") + 1).alias("seq"), F.from_csv("line", ", ".join(f"`{h}` string" for h in header)).alias("row"))
    return _of_one(read, key, one)


def fixed_scan(scans: DataFrame, key: str, text: str, fields: list[tuple[str, int, int]], form: str, one: str) -> DataFrame:
    """(key, seq, row): rows of fixed width, ``fields`` being (name, first column from 1, width); a text counts only if every line fits ``form``.

    ``form`` is a pattern of whole lines. Values are trimmed, blank ones null; a text with several values of ``one`` gives no rows.
    """
    lines = _lines(F.col(text))
    claimed = scans.where((F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(f"^(?:{form})$")))
    rows = claimed.select(F.col(key), F.posexplode(lines).alias("at", "line"))
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    read = rows.select(key, (F.col("at") + 1).alias("seq"), F.struct(*[F.when(cut(a, n) != "", cut(a, n)).alias(f) for f, a, n in fields]).alias("row"))
    return _of_one(read, key, one)


def _of_one(rows: DataFrame, key: str, one: str) -> DataFrame:
    value = F.lower(F.trim(F.coalesce(F.col("row")[one], F.lit(""))))
    single = rows.groupBy(key).agg((F.min(value) == F.max(value)).alias("single")).where("single").select(key)
    return rows.join(single, key, "left_semi")
