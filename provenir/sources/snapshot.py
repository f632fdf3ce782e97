"""Snapshots of tables with a manifest of the bytes written, verified by reading the files again.

A table is written in parts by a column; a part is written anew only where its rows changed since the snapshot before, told by a digest of
the rows that is independent of their order. The manifest holds each file's sha256 and length as ``binaryFile`` reads them back from storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_ROWS = 1_000_000
_SHA = "sha256 string"


def part_digests(df: DataFrame, by: str) -> DataFrame:
    """(part, n, digest): rows of each part and a digest of them in any order; repeated rows count."""
    row = F.struct(*[F.col(c) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    part = F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return df.select(part.alias("part"), h.alias("h")).groupBy("part").agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("digest"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(file, sha256, bytes) of the data files below a snapshot, read as they are; ``file`` is the path below it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/data")
    return f.select(F.concat(F.lit("data/"), F.element_at(F.split("path", "/data/"), -1)).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_snapshot(df: DataFrame, root: str, by: str) -> DataFrame:
    """Writes ``df`` below ``root`` in parts by the column ``by`` and returns (part, n, state): new, changed, same or gone.

    Only new and changed parts are written; files of parts that are gone or replaced go. Then the manifest is made from the bytes on storage. A
    snapshot that breaks off leaves the manifest before it, against which ``verify`` shows what was begun. Null values of ``by`` are a part; one column at least is not ``by``.
    """
    spark = df.sparkSession
    now = part_digests(df, by)
    held = f"{root}/parts"
    old = spark.read.parquet(held) if _exists(spark, held) else spark.createDataFrame([], "part string, n long, digest string")
    old = spark.createDataFrame(old.collect(), old.schema)  # a row for each part: read before it is replaced
    both = now.join(old.select("part", F.col("digest").alias("was"), F.col("n").alias("n_was")), "part", "full")
    state = F.when(F.col("digest").isNull(), "gone").when(F.col("was").isNull(), "new").when((F.col("was") == F.col("digest")) & (F.col("n") == F.col("n_was")), "same").otherwise("changed")
    both = both.select("part", F.coalesce("n", F.lit(0)).alias("n"), "digest", state.alias("state"))
    plan = spark.createDataFrame(both.collect(), both.schema)
    todo = plan.where("state IN ('new', 'changed')").select("part")
    part = F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = df.withColumn("part__", part).join(todo.withColumnRenamed("part", "part__"), "part__", "left_semi")
    writer = rows.repartition("part__", F.pmod(F.xxhash64(*df.columns), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("part__").parquet(f"{root}/data")
    for r in plan.where("state = 'gone'").collect():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/data/part__={r['part']}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if _exists(spark, f"{root}/data"):
        _files(spark, root).write.mode("overwrite").parquet(f"{root}/manifest")
    plan.where("state <> 'gone'").select("part", "n", "digest").coalesce(1).write.mode("overwrite").parquet(held)
    return plan.select("part", "n", "state")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """(file, state): ok, damaged (bytes differ), missing or unlisted, for each file that the manifest or the storage has."""
    said = spark.read.parquet(f"{root}/manifest")
    have = _files(spark, root).select("file", F.col("sha256").alias("sha256_now"), F.col("bytes").alias("bytes_now"))
    both = said.join(have, "file", "full")
    state = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("sha256_now").isNull(), "missing").when((F.col("sha256") == F.col("sha256_now")) & (F.col("bytes") == F.col("bytes_now")), "ok").otherwise("damaged")
    return both.select("file", state.alias("state"))


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data").drop("part__")
