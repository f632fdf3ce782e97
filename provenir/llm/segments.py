"""Documents dealt into segments of bounded size, and numbers packed as bytes: what the positional index and the ranked search share.

A segment is a run of documents of one task with at most WORDS words (a longer document is a segment alone) and DOCS documents. A row
of an index belongs to one segment, so no list grows with the corpus and no shuffle builds the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORDS, DOCS = 4_000_000, 50_000
#: Items of a query set are searched in blocks of about so many bytes of text.
BLOCK_BYTES = 32_000_000

_KEPT = [chr(c).lower() if chr(c).isalnum() else " " for c in range(128)]
_FOLD = bytes(ord(c) for c in _KEPT) + bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def map_segments(docs: DataFrame, make: Callable[[], object], ddl: str) -> DataFrame:
    """Rows that ``make()`` gives for each segment: it has ``add(doc_id, words)`` and ``rows(segment)``, a dict of columns."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held, n_words, n_docs = make(), 0, 0
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    w = words(text)
                    if n_docs and (n_words + len(w) > WORDS or n_docs >= DOCS):
                        yield pa.RecordBatch.from_pydict(held.rows(first + made), schema=arrow)
                        held, n_words, n_docs, made = make(), 0, 0, made + 1
                    held.add(i, w)
                    n_words, n_docs = n_words + len(w), n_docs + 1
        if n_docs:
            yield pa.RecordBatch.from_pydict(held.rows(first + made), schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 0, seven bits a byte with the lowest first; the bytes, and where each number ends in them."""
    x = numbers.astype(np.int64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 9):
        size += x >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    start = ends - size
    for k in range(int(size.max()) if len(x) else 0):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = (x[at] >> 7 * k) & 127 | np.where(size[at] > k + 1, 128, 0)
    return out.tobytes(), ends


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, start)


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct (item_id, text) of ``items`` in blocks of about BLOCK_BYTES, so that no query set is held whole."""
    distinct = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    n = -(-(distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        yield [tuple(r) for r in distinct.where(block == k).collect()]  # a block
