"""Words of Arrow string batches, found and hashed with array operations.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; UTF-8 never
puts those bytes inside a longer character.  Word and n-gram hashes are
64-bit polynomial hashes read off one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = 1 << 18
#: Rows handled at once inside a task.
CHUNK_ROWS = 2000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 12), base, np.uint64)
        table[0] = 1
        table = _tables[base] = np.cumprod(table, dtype=np.uint64)
        if len(table) > 2 * CHUNK_BYTES:
            del _tables[base]
    return table[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (from 0) and UTF-8 bytes of a string array; nulls count as empty."""
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    if len(text) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1]
    off = off.astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], data


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch of at most ``size`` bytes of text each, or of one row."""
    off, _ = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + size, "right")) - 1
        to = min(max(to, at + 1), at + CHUNK_ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of a chunk in order: row, byte span and hash of each; ``first[r]:first[r + 1]`` are row r's."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    off: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(text: pa.Array, lower: bool = False) -> Words:
    """Find and hash the words of each row; ``lower`` maps A-Z to a-z first."""
    off, data = buffers(text)
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BYTE_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _powers(_inverse(_BYTE_BASE), n + 1)[start]
    return Words(
        row=np.searchsorted(off, start, "right") - 1,
        start=start,
        end=end,
        hash=mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)),
        first=np.searchsorted(start, off),
        off=off,
        data=data,
    )


class Grams:
    """Hashes of word runs of a chunk, any start and length, off one running sum."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.words = words
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * _powers(_WORD_BASE, n), out=self.total[1:])
        self.back = _powers(_inverse(_WORD_BASE), n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words ``start:end``, one for each pair."""
        h = (self.total[end] - self.total[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words inside one row, in order."""
        w = self.words
        start = np.arange(max(0, len(w.hash) - k + 1))
        start = start[start + k <= w.first[w.row[start] + 1]] if len(start) else start
        return start, self.spans(start, start + k)


def shingle_spans(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, word behind, hash) of each k-word shingle; a row of 1 to k-1 words gives its whole sequence as one."""
    g = Grams(w)
    start, h = g.runs(k)
    n = w.counts
    few = np.flatnonzero((n > 0) & (n < k))
    begin, end = w.first[few], w.first[few + 1]
    return np.concatenate([w.row[start], few]), np.concatenate([start, begin]), np.concatenate([start + k, end]), np.concatenate([h, g.spans(begin, end)])


def shingles(text: pa.Array, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle as in ``shingle_spans``."""
    row, _, _, h = shingle_spans(words_of(text, lower), k)
    return row, h


def distinct_sets(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending: values and row offsets."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[keep], h[keep]
    return h, np.searchsorted(row, np.arange(rows + 1))


def shingle_sets(text: pa.Array, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending: values and row offsets."""
    return distinct_sets(*shingles(text, k, lower), len(text))


def sets_of(texts: Iterable[str | None], k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of any number of texts, hashed a chunk at a time."""
    values, ends, held, size = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [], 0

    def flush() -> None:
        own, offsets = shingle_sets(pa.array(held, pa.string()), k, lower)
        values.append(own)
        ends.append(ends[-1][-1] + offsets[1:])

    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= CHUNK_BYTES:
            flush()
            held, size = [], 0
    if held:
        flush()
    return np.concatenate(values), np.concatenate(ends)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def packed(frame: DataFrame, name: str = "packed") -> DataFrame:
    """``frame`` with the column text replaced by ``name``: compressed for the way through a shuffle, null staying null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in chunks(batch):
                small = pa.array([None if x is None else zip_.compress(x.encode()) for x in part.column("text").to_pylist()], pa.binary())
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], small], names=[*rest, name])

    return frame.mapInArrow(work, frame.drop("text").withColumn(name, F.lit(None).cast("binary")).schema)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column in ``taken`` has that name, letter case aside."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def unpack(value: pa.Scalar) -> str | None:
    return zstandard.ZstdDecompressor().decompress(value.as_py()).decode() if value.is_valid else None


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        was = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            return root


def runs_of(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of bytes marked in ``solid`` that lie inside one row."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[off] = True
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return np.searchsorted(off, start, "right") - 1, start, end


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z turned to a-z."""
    return _LOWER[data]
