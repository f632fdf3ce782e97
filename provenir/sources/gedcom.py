"""Lineage-linked text files (level, xref, tag, value) as a node table."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = re.compile(r"^\s*(\d+)\s+(?:@([^@]+)@\s+)?(\w+)(?: (.*))?$")
SCHEMA = "path string, root long, node long, parent long, level int, xref string, tag string, value string"
#: Character sets named in a header and their codecs.
CODECS = {"UTF-8": "utf-8", "UTF8": "utf-8", "ASCII": "utf-8", "ANSI": "cp1252"}
_ENDS = re.compile("\r\n|\r|\n")


def decode(raw: bytes, path: str = "") -> str:
    """Text of a file by byte order mark, zero bytes or its CHAR line; other sets are refused."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    if raw[:2] == b"0\0":
        return raw.decode("utf-16-le")
    if raw[:2] == b"\0" b"0":
        return raw.decode("utf-16-be")
    said = re.search(rb"^\s*1\s+CHAR\s+(\S+)", raw[:65_536].replace(b"\r", b"\n"), re.M)
    name = said[1].decode("ascii").upper() if said else "UTF-8"
    if name not in CODECS:
        raise ValueError(f"{path}: character set {name} is not read")
    return raw.decode(CODECS[name])


def nodes(text: str) -> list[list]:
    """[root, node, parent, level, xref, tag, value]; CONC and CONT lines are folded into the value that they continue."""
    out: list[list] = []
    stack: list[list] = []
    for line in _ENDS.split(text):
        m = _LINE.match(line)
        if not m:
            continue
        level, tag, value = int(m[1]), m[3], m[4] or ""
        while stack and stack[-1][3] >= level:  # levels may be skipped
            stack.pop()
        if tag in ("CONC", "CONT") and stack:
            stack[-1][6] += ("\n" if tag == "CONT" else "") + value
            continue
        k = len(out)
        row = [stack[0][1] if stack else k, k, stack[-1][1] if stack else None, level, m[2], tag, value]
        out.append(row)
        stack.append(row)
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row a node; a file is read whole by one task, as levels refer to the lines before."""

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = list(zip(*nodes(decode(raw, p)), strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(c[0]), pa.string()), *(pa.array(list(x), t) for x, t in zip(c, kinds, strict=True))], ["path", "root", "node", "parent", "level", "xref", "tag", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def children(tree: DataFrame, tag: str, *columns: str) -> DataFrame:
    """(path, parent, value...) of the nodes with a tag."""
    return tree.where(F.col("tag") == tag).select("path", F.col("parent").alias("of"), F.col("node").alias(tag.lower()), F.col("value").alias(tag.lower() + "_value"), *columns)


def people(tree: DataFrame) -> DataFrame:
    """(path, person, name, sex): the individuals of a node table, their first name and sex."""
    base = tree.where("tag = 'INDI' AND level = 0").select("path", F.col("node").alias("of"), F.col("xref").alias("person"))
    first = lambda tag: children(tree, tag).groupBy("path", "of").agg(F.min_by(f"{tag.lower()}_value", tag.lower()).alias(tag.lower()))
    return base.join(first("NAME"), ["path", "of"], "left").join(first("SEX"), ["path", "of"], "left").select("path", "person", "name", "sex")


def facts(tree: DataFrame, types: tuple[str, ...] = ("BIRT", "DEAT", "BURI", "RESI", "MARR")) -> DataFrame:
    """(path, owner, fact, date, place): the dated and placed facts of individuals and families."""
    roots = tree.where("level = 0 AND tag IN ('INDI', 'FAM')").select("path", F.col("node").alias("of"), F.col("xref").alias("owner"))
    f = tree.where(F.col("tag").isin(*types)).select("path", F.col("parent").alias("of"), F.col("node").alias("fact_node"), F.col("tag").alias("fact"))
    part = lambda tag: tree.where(F.col("tag") == tag).select("path", F.col("parent").alias("fact_node"), F.col("value").alias(tag.lower()))
    return roots.join(f, ["path", "of"]).join(part("DATE"), ["path", "fact_node"], "left").join(part("PLAC"), ["path", "fact_node"], "left").select("path", "owner", "fact", F.col("date"), F.col("plac").alias("place"))


def members(tree: DataFrame) -> DataFrame:
    """(path, family, person, role): partners and children."""
    fam = tree.where("level = 0 AND tag = 'FAM'").select("path", F.col("node").alias("parent"), F.col("xref").alias("family"))
    role = F.when(F.col("tag") == "CHIL", "child").otherwise("partner")
    m = tree.where("tag IN ('HUSB', 'WIFE', 'CHIL')").select("path", "parent", F.regexp_replace("value", "@", "").alias("person"), role.alias("role"))
    return fam.join(m, ["path", "parent"]).select("path", "family", "person", "role")


def citations(tree: DataFrame) -> DataFrame:
    """(path, root, of, source, title, page, url, record): what each node cites, with the source record's title and the citation's own details."""
    titled = tree.where("tag = 'TITL' AND level = 1").select("path", F.col("parent").alias("s"), "value")
    sources = tree.where("tag = 'SOUR' AND level = 0").select("path", F.col("node").alias("s"), F.col("xref").alias("source"))
    titles = sources.join(titled, ["path", "s"]).groupBy("path", "source").agg(F.min("value").alias("title"))
    heads = tree.where("tag = 'HEAD' AND level = 0").select("path", F.col("node").alias("root"))
    cited = tree.where("tag = 'SOUR' AND level > 0").join(heads, ["path", "root"], "left_anti")
    cited = cited.select("path", "root", F.col("parent").alias("of"), F.col("node").alias("c"), F.regexp_replace("value", "@", "").alias("source"))
    own = tree.where("tag IN ('PAGE', '_APID')").groupBy("path", F.col("parent").alias("c")).pivot("tag", ["PAGE", "_APID"]).agg(F.min("value"))
    data = tree.where("tag = 'DATA'").select("path", F.col("parent").alias("c"), F.col("node").alias("data"))
    url = tree.where("tag = 'WWW'").select("path", F.col("parent").alias("data"), "value").join(data, ["path", "data"]).groupBy("path", "c").agg(F.min("value").alias("url"))
    out = cited.join(titles, ["path", "source"], "left").join(own, ["path", "c"], "left").join(url, ["path", "c"], "left")
    return out.select("path", "root", "of", "source", "title", F.col("PAGE").alias("page"), "url", F.col("_APID").alias("record"))


def cited_records(tree: DataFrame) -> DataFrame:
    """(path, source, owners): the individuals and families whose statements rest on each source, sorted."""
    owner = tree.where("level = 0 AND tag IN ('INDI', 'FAM')").select("path", F.col("node").alias("root"), F.col("xref").alias("owner"))
    return citations(tree).join(owner, ["path", "root"]).groupBy("path", "source").agg(F.array_sort(F.collect_set("owner")).alias("owners"))


def exporter(tree: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, id): the program that wrote each file, by the first registry row (id, name) whose name opens a name in the header; null if none does."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    files = tree.select("path").distinct()
    sour = tree.where("tag = 'HEAD' AND level = 0").select("path", F.col("node").alias("parent")).join(tree.where("tag = 'SOUR' AND level = 1"), ["path", "parent"])
    said = sour.select("path", key("value").alias("said")).union(sour.select("path", F.col("node").alias("parent")).join(tree.where("tag IN ('NAME', 'CORP')"), ["path", "parent"]).select("path", key("value")))
    known = registry.select("id", key("name").alias("k")).where("k <> ''")
    # Header rows are one to three a file and the registry is a short dimension: names meet on their first letter.
    hit = said.withColumn("a", F.substring("said", 1, 1)).join(known.withColumn("a", F.substring("k", 1, 1)), "a").where(F.startswith("said", F.col("k")))
    return files.join(hit.groupBy("path").agg(F.min("id").alias("id")), "path", "left")


def spouse_facts(tree: DataFrame, types: tuple[str, ...] = ("MARR", "DIV")) -> DataFrame:
    """(path, owner, fact, date, place, said_by): family facts, those written on a spouse among them, each once.

    A spouse's fact goes to their one family, or of several to the only one with a fact of that kind in that year; else it stays
    theirs. Facts of one owner, kind, date and place are one; ``said_by`` lists the spouses who state it.
    """
    f = facts(tree, types)
    roots = tree.where("level = 0 AND tag IN ('INDI', 'FAM')").select("path", F.col("node").alias("root"), F.col("xref").alias("owner"), (F.col("tag") == "FAM").alias("family"))
    f = f.join(roots.drop("root"), ["path", "owner"]).withColumn("year", F.regexp_extract(F.coalesce("date", F.lit("")), r"(\d{4})\s*$", 1))
    own, said = f.where("family"), f.where("NOT family").drop("family").withColumnRenamed("owner", "person")
    fams = tree.where("tag = 'FAMS'").select("path", "root", F.regexp_replace("value", "@", "").alias("fam")).join(roots.where("NOT family"), ["path", "root"]).select("path", F.col("owner").alias("person"), "fam").distinct()
    only = fams.groupBy("path", "person").agg(F.min("fam").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    dated = own.where("year <> ''").select("path", F.col("owner").alias("fam"), "fact", "year").distinct()
    near = fams.join(dated, ["path", "fam"]).groupBy("path", "person", "fact", "year").agg(F.min("fam").alias("near"), F.count("*").alias("n")).where("n = 1").drop("n")
    said = said.join(only, ["path", "person"], "left").join(near, ["path", "person", "fact", "year"], "left")
    said = said.select("path", F.coalesce("only", "near", "person").alias("owner"), "fact", "date", "place", F.col("person").alias("by"))
    every = own.select("path", "owner", "fact", "date", "place", F.lit(None).cast("string").alias("by")).union(said)
    return every.groupBy("path", "owner", "fact", "date", "place").agg(F.array_sort(F.collect_set("by")).alias("said_by"))
