"""Token ids as files of independent zstandard frames with a seek table.

File: frames, then the seek table as one more zstandard frame, then a footer of 16 bytes: offset of the seek table (8, little
endian), its length (4), magic ``PVTK``. A frame holds the ids of consecutive documents as little-endian unsigned
32-bit numbers. The seek table is JSON: for each frame its offset, length, crc32 of the compressed bytes and its documents as
[doc_id, number of ids]. A reader fetches the footer, the table and then only the frames of the documents asked for.

Documents are dealt to tasks by ranges of doc_id; a task sorts its range and writes files of at most about FILE_BYTES of ids, each
under a name of its own (so a repeated task never touches another's), and reports them. The reports, one row a file, are kept in
the shared folder. So a seek table stays small however much a task has.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Encoder, slices

END_ID = 1
FRAME_BYTES, FILE_BYTES = 1 << 20, 1 << 28
MAGIC = b"PVTK"
MANIFEST = "part int, file int, path string, n_docs long, n_tokens long"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_file(out, documents: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Writes documents (id, ids as bytes) to an open file, until they end or FILE_BYTES are reached; returns how many documents and ids."""
    squeeze = zstandard.ZstdCompressor(level=3, write_checksum=True)
    frames, held, size, at, docs, ids = [], [], 0, 0, 0, 0

    def flush():
        nonlocal at, size
        if held:
            z = squeeze.compress(b"".join(x for _, x in held))
            out.write(z)
            frames.append([at, len(z), zlib.crc32(z), [[i, len(x) // 4] for i, x in held]])
            at += len(z)
            held.clear()
            size = 0

    for i, x in documents:
        held.append((i, x))
        size += len(x)
        docs, ids = docs + 1, ids + len(x) // 4
        if size >= FRAME_BYTES:
            flush()
        if 4 * ids >= FILE_BYTES:
            break
    flush()
    table = squeeze.compress(json.dumps(frames, separators=(",", ":")).encode())
    out.write(table + at.to_bytes(8, "little") + len(table).to_bytes(4, "little") + MAGIC)
    return docs, ids


def seek_table(f) -> list:
    """The frames of an open file, from its last bytes."""
    end = f.seek(0, 2)
    f.seek(max(end - 16, 0))
    foot = f.read(16)
    if len(foot) != 16 or foot[12:] != MAGIC:
        raise ValueError("not a token file, or one cut short")
    f.seek(int.from_bytes(foot[:8], "little"))
    return json.loads(zstandard.ZstdDecompressor().decompress(f.read(int.from_bytes(foot[8:12], "little"))))


def read_frame(f, frame: list) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as bytes) of one frame, its checksum tested."""
    at, length, crc, docs = frame
    f.seek(at)
    z = f.read(length)
    if zlib.crc32(z) != crc:
        raise ValueError(f"frame at {at}: checksum differs")
    raw, k = zstandard.ZstdDecompressor().decompress(z), 0
    for i, n in docs:
        yield i, raw[k : k + 4 * n]
        k += 4 * n


def read_documents(path: str, wanted: set[int]) -> dict[int, bytes]:
    """Ids of the wanted documents of one file; frames without any are not read."""
    fs, p = _filesystem(path)
    with fs.open_input_file(p) as f:
        return {i: x for frame in seek_table(f) if wanted & {d[0] for d in frame[3]} for i, x in read_frame(f, frame) if i in wanted}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the token files of ``docs`` (doc_id, text); (part, file, path, n_docs, n_tokens) for each file, ascending with doc_id.

    A null text is empty and has the end id only; rows with equal or null doc_id are all written (nulls first), equal ids
    in the order of their texts. An empty table writes no document. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        part = TaskContext.get().partitionId()
        code = Encoder(tokenizer)
        fs, p = _filesystem(folder)
        fs.create_dir(p, recursive=True)
        rows = ((i, x + end) for b in batches for s in slices(b, 1) for i, x in zip(s.column(0).to_pylist(), code.batch(s.column(1)), strict=True))
        first = next(rows, None)
        for k in itertools.count():
            if first is None:
                break
            name = f"{folder}/tokens-{part:06d}-{k:06d}-{uuid.uuid4().hex[:12]}.pvtk"
            with fs.open_output_stream(_filesystem(name)[1]) as out:
                docs_, ids = write_file(out, itertools.chain([first], rows))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([name]), pa.array([docs_]), pa.array([ids])], ["part", "file", "path", "n_docs", "n_tokens"])
            first = next(rows, None)

    return dealt.mapInArrow(run, MANIFEST)


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of the files that ``write_tokens`` reported, read from them."""
    known = files.orderBy("part", "file").select("path", "n_tokens").collect()  # a row for each file
    rows, before = [], 0
    for k, r in enumerate(known):
        rows.append((k, r["path"], before))
        before += r["n_tokens"]
    # One file a task: ranges of their numbers.
    placed = spark.createDataFrame(rows, "k int, path string, before long").repartitionByRange(max(len(rows), 1), "k").select("path", "before")

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = _filesystem(path)
                with fs.open_input_file(p) as f:
                    for frame in seek_table(f):
                        out = []
                        for i, x in read_frame(f, frame):
                            out.append((i, start, len(x) // 4, zlib.crc32(x)))
                            start += len(x) // 4
                        ids, starts, ns, crcs = (list(c) for c in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(ns), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, scratch, tokenizer: str) -> DataFrame:
    """Writes and reads back: see write_tokens and read_tokens."""
    files = scratch.table(write_tokens(docs, scratch.path("tokens"), tokenizer))
    return read_tokens(docs.sparkSession, files)
