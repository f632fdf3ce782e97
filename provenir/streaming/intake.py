"""Folder intake: each file once, by content, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import latest


def archive_files(spark: SparkSession, inbox: str, archive: str, checkpoint: str) -> StreamingQuery:
    """Appends (sha256, path, bytes, content) of files not yet held to ``archive``; stops when the inbox is read.

    The checkpoint remembers files, and an anti-join on the hash drops contents that came under another name; a batch that is
    repeated after a failure writes nothing twice.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(inbox)

    def keep(batch: DataFrame, _: int) -> None:
        new = batch.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("bytes"), "content")
        first = new.groupBy("sha256").agg(F.min("path").alias("path"))  # contents stay where they are
        new = new.join(first, ["sha256", "path"], "left_semi")
        try:
            held = batch.sparkSession.read.parquet(archive).select("sha256")
        except Exception as e:  # the first batch finds no archive
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = None
        (new if held is None else new.join(held, "sha256", "left_anti")).write.mode("append").parquet(archive)

    return files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(log: DataFrame, key: str, order: str, superseded_by: str = "superseded_by") -> DataFrame:
    """The row of each key that nothing supersedes, the last by ``order`` of several; a key whose rows are all superseded has none."""
    return latest(log.where(F.col(superseded_by).isNull()), [key], [order]).select(*log.columns)
