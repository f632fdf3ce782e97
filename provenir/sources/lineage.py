"""Lineage-linked files as a data source that splits a file, and the tables that an import makes of its nodes.

``spark.read.format("lineage").option("path", ...)`` gives the columns of ``gedcom.SCHEMA``. A partition is a range of bytes: it holds the
records whose first line (level 0) begins in it, so the partitions of a file hold every record once, whatever its size. A node's number is
the place of its line in the file, so numbers do not depend on the ranges. Files in UTF-16 are one partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import dates, names
from .gedcom import _LINE, CODECS, SCHEMA, decode

RANGE_BYTES = 64 << 20
_CHUNK = 1 << 20
_TOP = re.compile(rb"^\s*0\s")
_LINE_END = re.compile(rb"\r\n|\r|\n")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _lines(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) from byte ``at``, which is the start of a line or within one; ends of lines are any of the three."""
    f.seek(at)
    rest = b""
    while chunk := f.read(_CHUNK):
        rest += chunk
        last = 0
        for m in _LINE_END.finditer(rest):
            if m.end() == len(rest) and m[0] == b"\r":
                break  # its second half may come
            yield at + last, rest[last : m.start()]
            last = m.end()
        at, rest = at + last, rest[last:]
    if rest:
        yield at, rest.rstrip(b"\r")


def _range_nodes(lines: Iterator[tuple[int, bytes]], begin: int, end: int | None, codec: str) -> Iterator[list]:
    """[root, node, parent, level, xref, tag, value] of the records that begin from ``begin`` to before ``end``; one record is held at a time."""
    record: list[list] = []
    stack: list[list] = []
    started = begin == 0
    for at, raw in lines:
        top = bool(_TOP.match(raw))
        if at < begin or not (started or top):
            continue
        if top:
            if end is not None and at >= end:
                break
            yield from record
            record, stack, started = [], [], True
        elif end is not None and at >= end and not record:
            break
        m = _LINE.match(raw.decode(codec))
        if not m:
            continue
        level, tag, value = int(m[1]), m[3], m[4] or ""
        while stack and stack[-1][3] >= level:
            stack.pop()
        if tag in ("CONC", "CONT") and stack:
            stack[-1][6] += ("\n" if tag == "CONT" else "") + value
            continue
        row = [stack[0][1] if stack else at, at, stack[-1][1] if stack else None, level, m[2], tag, value]
        record.append(row)
        stack.append(row)
    yield from record


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None, codec: str | None, skip: int):
        self.path, self.begin, self.end, self.codec, self.skip = path, begin, end, codec, skip


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.bytes = max(int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))), 1)

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            fs, p = _filesystem(path)
            info = fs.get_file_info(p)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if x.type == pafs.FileType.File]
            for x in sorted((x for x in files if not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
                with fs.open_input_file(x.path) as f:
                    head = f.read(65_536)
                shown = path if info.type == pafs.FileType.File else f"{path.rstrip('/')}{x.path[len(p.rstrip('/')) :]}"
                if head[:2] in (b"\xff\xfe", b"\xfe\xff", b"0\0", b"\0" b"0"):
                    out.append(_Range(shown, 0, None, None, 0))
                    continue
                said = re.search(rb"^\s*1\s+CHAR\s+(\S+)", head.replace(b"\r", b"\n"), re.M)
                name = said[1].decode("ascii").upper() if said else "UTF-8"
                skip = 3 if head[:3] == b"\xef\xbb\xbf" else 0
                if name not in CODECS and not skip:
                    raise ValueError(f"{shown}: character set {name} is not read")
                codec = "utf-8" if skip else CODECS[name]
                out += [_Range(shown, b, min(b + self.bytes, x.size), codec, skip) for b in range(0, x.size, self.bytes)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        fs, p = _filesystem(part.path)
        with fs.open_input_file(p) as f:
            if part.codec is None:
                text = decode(f.read(), part.path)
                places = ((k, line) for k, line in _text_lines(text))
                rows = _range_nodes(places, 0, None, "utf-8")
            else:
                # One byte before the range shows whether a line begins with it.
                at = max(part.begin - 1, part.skip if part.begin == 0 else 0)
                rows = _range_nodes(_lines(f, at if part.begin else part.skip), part.begin, part.end, part.codec)
            held: list[list] = []
            for r in rows:
                held.append(r)
                if len(held) >= 10_000:
                    yield _batch(part.path, held)
                    held = []
            if held:
                yield _batch(part.path, held)


def _text_lines(text: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    for line in re.split("\r\n|\r|\n", text):
        yield at, line.encode("utf-8", "surrogatepass")
        at += len(line) + 1


def _batch(path: str, rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    cols = [pa.array([path] * len(rows), pa.string()), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
    return pa.RecordBatch.from_arrays(cols, ["path", "root", "node", "parent", "level", "xref", "tag", "value"])


class LineageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lineage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of a file, of a folder of files, or of several paths joined by commas; a file is read in ranges of about ``range_bytes``."""
    spark.dataSource.register(LineageSource)
    return spark.read.format("lineage").option("path", path).option("rangeBytes", range_bytes).load()


def _id(kind: str, *parts: Column | str) -> Column:
    """An id that follows from what it names, so that a second import of a file gives the same ids."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\u0002")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\u0001", F.lit(kind), *cols), 256), 1, 26)


#: Tags of dated or placed facts and the types of event that they are.
EVENTS = {"BIRT": "Birth", "DEAT": "Death", "BURI": "Burial", "CREM": "Cremation", "RESI": "Residence", "OCCU": "Occupation", "MARR": "Marriage", "DIV": "Divorce", "CENS": "Census", "EVEN": "Event"}


def import_tables(tree: DataFrame) -> dict[str, DataFrame]:
    """The tables of an import, from a node table (``gedcom.SCHEMA``): persons, names, families, members, events, statements, citations, media.

    Ids are digests of what a row names. Facts of one owner equal in type, date, place and value are one event, with a statement for each
    citation of each and one of the file's own (no citation) for each that cites nothing. Media are objects below a person, family or fact,
    written in place or pointing to a record of their own. A pointer to nothing gives null details; an empty node table gives empty tables.
    """
    of = lambda tag, *cols: tree.where(F.col("tag").isin(*([tag] if isinstance(tag, str) else tag))).select("path", F.col("parent").alias("of"), *cols)
    text = lambda tag, name: of(tag, F.col("node").alias("k"), "value").groupBy("path", "of").agg(F.min_by("value", "k").alias(name))
    owners = tree.where("level = 0 AND tag IN ('INDI', 'FAM') AND xref IS NOT NULL").select("path", F.col("node").alias("of"), F.col("xref").alias("owner"), F.when(F.col("tag") == "FAM", "family").otherwise("person").alias("owner_kind"))
    people = owners.where("owner_kind = 'person'")

    said = people.join(of("NAME", F.col("node").alias("n"), F.col("value").alias("written")), ["path", "of"])
    own = said.join(text("GIVN", "g").withColumnRenamed("of", "n"), ["path", "n"], "left").join(text("SURN", "s").withColumnRenamed("of", "n"), ["path", "n"], "left")
    slashed = F.nullif(F.trim(F.regexp_extract("written", "/([^/]*)/", 1)), F.lit(""))
    rest = F.nullif(F.trim(F.regexp_replace("written", "/[^/]*/.*$", "")), F.lit(""))
    whole = names.split_name(F.col("written"))
    has_slash = F.col("written").contains("/")
    named = own.select(
        "path", _id("name", "path", "owner", "n").alias("id"), _id("person", "path", "owner").alias("person"), "written", "n",
        F.coalesce("g", F.when(has_slash, rest).otherwise(whole["given"])).alias("given"), F.coalesce("s", F.when(has_slash, slashed).otherwise(whole["surname"])).alias("surname"),
    )
    first = named.groupBy("path", "person").agg(F.min("n").alias("first"))
    name_rows = named.join(first, ["path", "person"]).select("id", "person", "written", "given", "surname", (F.col("n") == F.col("first")).alias("is_primary"))
    shown = name_rows.where("is_primary").select(F.col("person").alias("id"), F.trim(F.regexp_replace("written", "/", "")).alias("display_name"))
    persons = people.join(text("SEX", "sex"), ["path", "of"], "left").select(_id("person", "path", "owner").alias("id"), "path", F.col("owner").alias("xref"), "sex").join(shown, "id", "left")

    families = owners.where("owner_kind = 'family'").select(_id("family", "path", "owner").alias("id"), "path", F.col("owner").alias("xref"))
    point = F.regexp_replace("value", "@", "")
    member = owners.where("owner_kind = 'family'").join(of(("HUSB", "WIFE", "CHIL"), "tag", "node", point.alias("xref")), ["path", "of"])
    members = member.select(_id("family", "path", "owner").alias("family"), _id("person", "path", "xref").alias("person"), F.when(F.col("tag") == "CHIL", "child").otherwise("partner").alias("role")).distinct()

    fact = owners.join(of(tuple(EVENTS), F.col("node").alias("f"), "tag", F.nullif(F.trim("value"), F.lit("")).alias("value")), ["path", "of"])
    part = lambda tag, name: text(tag, name).withColumnRenamed("of", "f")
    fact = fact.join(part("DATE", "date_text"), ["path", "f"], "left").join(part("PLAC", "place"), ["path", "f"], "left")
    kinds = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    who = F.when(F.col("owner_kind") == "family", _id("family", "path", "owner")).otherwise(_id("person", "path", "owner"))
    fact = fact.select("path", "f", "owner_kind", who.alias("owner"), kinds[F.col("tag")].alias("type"), "date_text", "place", "value")
    fact = fact.withColumn("event", _id("event", "owner", "type", "date_text", "place", "value"))
    events = fact.select(F.col("event").alias("id"), "owner_kind", "owner", "type", "date_text", "place", "value").distinct().withColumn("date", dates.parse_date(F.col("date_text")))

    titles = tree.where("level = 0 AND tag = 'SOUR'").select("path", F.col("node").alias("of"), F.col("xref").alias("source")).join(text("TITL", "title"), ["path", "of"], "left").drop("of")
    cite = of("SOUR", F.col("node").alias("c"), "level", point.alias("source")).where("level > 0").drop("level")
    detail = lambda tag, name: text(tag, name).withColumnRenamed("of", "c")
    data = of("DATA", F.col("node").alias("d")).join(text("WWW", "url").withColumnRenamed("of", "d"), ["path", "d"]).groupBy("path", F.col("of").alias("c")).agg(F.min("url").alias("url"))
    cite = cite.join(detail("PAGE", "page"), ["path", "c"], "left").join(detail("_APID", "record"), ["path", "c"], "left").join(data, ["path", "c"], "left").join(titles, ["path", "source"], "left")
    citations = cite.select(_id("citation", "path", "c").alias("id"), "path", "of", "source", "title", "page", "record", "url")
    cited = citations.select("path", F.col("of").alias("f"), F.col("id").alias("citation"), "source", "page", "record")
    st = fact.select("path", "f", "event").join(cited, ["path", "f"], "left")
    statements = st.select(_id("statement", "path", "f", "citation").alias("id"), "event", "citation", "source", "page", "record")

    objects = tree.where("level = 0 AND tag = 'OBJE'").select("path", F.col("node").alias("o"), F.col("xref").alias("ref"))
    files = lambda key: text("FILE", "file").join(text("TITL", "title"), ["path", "of"], "left").join(text("FORM", "form"), ["path", "of"], "left").withColumnRenamed("of", key)
    roots = tree.select("path", "node", F.col("root").alias("r")).join(owners.select("path", F.col("of").alias("r"), "owner", "owner_kind"), ["path", "r"])
    used = of("OBJE", F.col("node").alias("m"), "level", point.alias("ref")).where("level > 0").join(roots.select("path", F.col("node").alias("m"), "owner", "owner_kind"), ["path", "m"])
    inline = used.join(files("m"), ["path", "m"])
    pointed = used.where("ref <> ''").join(objects, ["path", "ref"], "left").join(files("o"), ["path", "o"], "left")
    media = inline.select("path", "m", "owner", "owner_kind", "file", "title", "form").union(pointed.select("path", "m", "owner", "owner_kind", "file", "title", "form"))
    media = media.select(_id("media", "path", "m").alias("id"), F.when(F.col("owner_kind") == "family", _id("family", "path", "owner")).otherwise(_id("person", "path", "owner")).alias("owner"), "file", "title", "form")
    return {"persons": persons, "names": name_rows, "families": families, "members": members, "events": events, "statements": statements, "citations": citations.drop("of"), "media": media}
