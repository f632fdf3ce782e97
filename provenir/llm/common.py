"""What the operators share: Arrow batch mapping, hold-out columns, labels, token encoding."""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], ddl: str) -> DataFrame:
    """mapInArrow with columns as Python lists; ``make`` runs once a task and returns the function for a batch."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for k in range(0, b.num_rows, 1000):  # at most 1000 texts as Python objects
                yield pa.RecordBatch.from_pydict(fn(b.slice(k, 1000).to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Keeps the rows for whose ``column`` the batch function says True; all columns pass through without a shuffle."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                yield part.filter(pa.array(fn(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def label_rows(labels: DataFrame, column: str, worst: Callable) -> DataFrame:
    """(doc_id, y) with one row an id; repeated ids take the worse mark, null marks and ids are no labels."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(worst(F.col(column)).cast("int").alias("y"))
    )


def bounded(df: DataFrame, bound: int, seed: int) -> DataFrame:
    """All rows, or about ``bound`` of them chosen by a hash of doc_id where there are more."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def words(text: str | None) -> list[bytes]:
    r"""``[^\x20\x09-\x0D]+`` of a text as UTF-8: bytes.split() parts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, the same as encoding each text in one call.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are those of its pieces
    between white space; the ids of pieces already seen are kept (``keep`` pieces at most, then the store starts anew).
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.keep = self.whole.model, keep
        self.known: dict[str, bytes] = {}
        self.signs = {s: self._ids(s) for s in ".,;:!?"}
        # The byte-level pre-tokenizer's alphabet for bytes that are letters in Latin-1 texts.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _ids(self, piece: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(piece, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A word of letters below U+0100: one pre-token, given to the vocabulary's model at once."""
        found = self.known.get(word)
        if found is None:
            low = word.lower()
            shown = low if low.isascii() else "".join(map(self.alphabet.__getitem__, low.encode()))
            ids = [t.id for t in self.model.tokenize(shown)]
            found = self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _piece(self, piece: str) -> bytes:
        core, end = (piece[:-1], self.signs[piece[-1]]) if piece[-1:] in self.signs else (piece, b"")
        if core.isalpha() and max(core) < "Ā":
            return self._word(core) + end
        return self._ids(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, pieces = self.known, text.replace("\n", " ").split(" ")
        if len(known) > self.keep:
            known.clear()
        for p in itertools.filterfalse(known.__contains__, pieces):
            if p not in known:
                known[p] = self._piece(p)
        return b"".join(map(known.__getitem__, pieces))

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text of an Arrow array: Arrow finds the distinct pieces, and only these are encoded.

        Most are a word of LETTERS and then MARKS: two pre-tokens, whose ids follow each other. The rest goes through ``_piece``.
        """
        if len(self.known) > self.keep:
            self.known.clear()
        pieces = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        found = coded.dictionary
        plain = pc.match_substring_regex(found, f"^[{LETTERS}]+[{re.escape(MARKS)}]*$")
        low = pc.utf8_lower(found.filter(plain))
        core, marks = pc.utf8_rtrim(low, MARKS).dictionary_encode(), pc.utf8_ltrim(low, LETTERS).dictionary_encode()
        after = pa.array(map(self._ids, marks.dictionary.to_pylist()), pa.large_binary())
        words = pa.array(map(self._word, core.dictionary.to_pylist()), pa.large_binary())
        joined = pc.binary_join_element_wise(words.take(core.indices), after.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        rest = pa.array(map(self._piece, found.filter(pc.invert(plain)).to_pylist()), pa.large_binary())
        at = np.empty(len(found), np.int64)
        at[np.argsort(~np.asarray(plain), kind="stable")] = np.arange(len(found))
        ids = pa.concat_arrays([joined, rest]).take(pa.array(at)).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][np.asarray(pieces.offsets) - pieces.offsets[0].as_py()]
        raw = memoryview(ids.buffers()[2] or b"")
        return (bytes(raw[a:b]) for a, b in itertools.pairwise(ends.tolist()))


def slices(batch: pa.RecordBatch, column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of the texts in ``column``, a longer text at most more."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in itertools.pairwise(starts))
