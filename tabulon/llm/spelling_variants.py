"""Grouping of spelling variants: words of a dictionary that differ by one edit.

One inserted, deleted or replaced code point leaves the first or the second
half of a word intact.  So two words at one edit meet in a block of words that
share their first half, as neighbours in the sorted dictionary, or in one of
those that share their second half, neighbours in the dictionary sorted by
reversed words.  A block is scanned and its pairs verified; a crowded block is
divided again by the halves of what its words don't share, until one code point
is left, where a block can't hold more words than the alphabet allows.

A block is named (m, i, j, first i code points, last j): it is for pairs whose
shorter word has m code points, and it owns those of them whose common prefix
ends in i ... m - j - 1 (or m, if j is 0), so each pair has one owner.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import crc
from tabulon.llm.words import buffers, chunks, lowered, runs_of
from tabulon.plans.lineage import cut

#: Words have so many code points and stand so often at least.
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Of the runs whose hash this divides, one code point is deleted.
EVERY = 97
#: A near word is a word's form if it stands so many times as often.
TIMES = 2
#: Words of a block that is scanned; larger ones are divided.
BLOCK = 256
#: Distinct words that a task adds up before it hands them on, and code points of pairs compared at once.
HELD, AT_ONCE = 1 << 18, 1 << 22

#: Bytes of words besides the second byte of U+00C0 to U+00FF, all of which begin with C3.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans, which don't overlap and are in order, as strings."""
    step = np.zeros(len(data) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(step[:-1]) > 0])])


def words_of(doc_id: list, text: pa.Array, every: int = EVERY, least_chars: int = LEAST_CHARS) -> pa.Array:
    """The runs of letters of some rows, lower-cased, of which hashes delete a code point; those that are long enough."""
    off, data = buffers(text)
    solid = _LETTER[data]
    solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    row, start, end = runs_of(solid, off)
    data = lowered(data)
    heads = np.zeros(len(doc_id), np.uint32)
    for i, x in enumerate(doc_id):
        heads[i] = zlib.crc32(f"{'' if x is None else x}:".encode())
    h = crc.extend(heads[row], data, start, end)
    pairs = np.concatenate([[0], np.cumsum(data == 0xC3)])
    length = end - start - (pairs[end] - pairs[start])
    hit = h % np.uint32(every) == 0
    whole = ~hit & (length >= least_chars)
    cuts = []
    for i in np.flatnonzero(hit & (length > least_chars)):
        word, at = data[start[i] : end[i]].tobytes().decode(), int(h[i]) % int(length[i])
        cuts.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([_strings(data, start[whole], end[whole]), pa.array(cuts, pa.string())])


def dictionary(docs: DataFrame, every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text) that are long and frequent enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            yield from table.rename_columns({"n_sum": "n"}).select(["word", "n"]).to_batches()

        for batch in batches:
            for part in chunks(batch):
                found = pc.value_counts(words_of(part.column("doc_id").to_pylist(), part.column("text"), every, least_chars))
                held.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"]))
                size += len(found)
                if size >= HELD:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    found = docs.select("doc_id", "text").mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _block(m: Column, i: Column, j: Column) -> Column:
    """A block of pairs whose shorter word has m code points: those that share the first i and the last j."""
    word = F.col("word")
    key = F.xxhash64(m, i, j, F.substring(word, F.lit(1), i), F.substring(word, F.length(word) - j + 1, j))
    return F.struct(m.alias("m"), i.alias("i"), j.alias("j"), key.alias("key"))


def _halves(rows: DataFrame) -> DataFrame:
    """The rows of (word, n, m, i, j), each in the two blocks that its block is divided into."""
    m, i, j = (F.col(c) for c in "mij")
    half = i + F.floor((m - i - j) / 2).cast("int")
    both = F.array(_block(m, half, j), _block(m, i, m - half))
    return rows.select("word", "n", F.explode(both).alias("at")).select("word", "n", "at.*")


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, of the pairs at one edit that the blocks own; rows are sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if held and (last or key[0] != held[-1].column("key")[-1].as_py()):
            yield from _scanned(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield from _scanned(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield from _scanned(pa.Table.from_batches(held))


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of each word, padded with zeros."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def _scanned(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of whole blocks; blocks of about equally long words are taken together, so that padding stays small."""
    m = table.column("m").to_numpy()
    level = np.frexp(m)[1]
    for own in np.unique(level):
        part = table.filter(pa.array(level == own))
        yield from _compared(part)


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key, m, i, j, n = (table.column(c).to_numpy() for c in ("key", "m", "i", "j", "n"))
    text = table.column("word").to_pylist()
    width = int(m.max()) + 1
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    behind = np.repeat(np.append(edge[1:], len(key)), np.diff(np.append(edge, len(key)))) - np.arange(len(key)) - 1
    if not behind.any():
        return
    length = np.fromiter(map(len, text), np.int64, len(text))
    words, backward = _codes(text, width), _codes([x[::-1] for x in text], width)
    # So many words of the table, each with all that stand behind it in its block, make one comparison.
    upto, at, most = np.cumsum(behind), 0, max(1, AT_ONCE // width)
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        own = behind[at:to]
        a = np.repeat(np.arange(at, to), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        at = to
        fits = np.minimum(length[a], length[b]) == m[a]
        a, b = a[fits], b[fits]
        if not len(a):
            continue
        prefix = (words[a] != words[b]).argmax(axis=1)
        suffix = (backward[a] != backward[b]).argmax(axis=1)
        near = prefix + suffix >= m[a] - (length[a] == length[b])
        near &= (prefix >= i[a]) & ((j[a] == 0) | (prefix < m[a] - j[a])) & (i[a] == i[b]) & (j[a] == j[b]) & (m[a] == m[b])
        a, b = a[near], b[near]
        if len(a):
            both, other = np.concatenate([a, b]), np.concatenate([b, a])
            yield pa.RecordBatch.from_arrays([pa.array(text).take(pa.array(both)), pa.array(text).take(pa.array(other)), pa.array(n[other])], names=["word", "near", "near_n"])


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of each word of (word, n), distinct words, and each word at one edit from it."""
    size = F.length("word")
    # A word is the shorter or equal one of pairs of class m = its length, and the longer one of the class below.
    classes = words.where(size >= least_chars).select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= least_chars)).alias("m"))
    waiting, scanned = _halves(classes.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))), []
    while True:
        waiting = cut(waiting)
        sizes = waiting.where("m - i - j > 1").groupBy("key").agg(F.count(F.lit(1)).alias("held"))
        crowded = cut(sizes.where(F.col("held") > block).select("key"))
        if crowded.isEmpty():
            scanned.append(waiting)
            break
        # The second part is a finished block whose key happens to equal that of a crowded one.
        scanned.append(waiting.join(crowded, "key", "left_anti").union(waiting.join(crowded, "key", "left_semi").where("m - i - j <= 1")))
        waiting = _halves(waiting.join(crowded, "key", "left_semi").where("m - i - j > 1"))
    blocks = scanned[0].select("word", "n", "m", "i", "j", "key")
    for more in scanned[1:]:
        blocks = blocks.union(more.select(*blocks.columns))
    alone = blocks.repartition("key").sortWithinPartitions("key")
    return alone.mapInArrow(_near_pairs, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of (word, form): the end of its chain; each round doubles the steps taken."""
    hop = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        after = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(hop.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hop = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hop


def group_variants(docs: DataFrame, every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs (doc_id, text).

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z
    lower-cased; where the CRC-32 of '<doc_id>:<run>' is a multiple of ``every``,
    the code point at the hash modulo the length is deleted.  ``n_near`` counts the
    words at one edit; ``form`` is the one of them that stands most often (ties:
    first in code-point order) if it stands ``times`` times as often as the word,
    and ``root`` the end of the chain of forms.  Null and empty texts have no
    words, a null id counts as an empty one in the hash, repeated rows count as
    often as they stand, an empty table gives no rows, and other columns are left out.
    """
    words = cut(dictionary(docs, every, least_chars, least_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, least_chars, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    much = -F.col("best.less") >= times * F.col("n")
    known = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")
        )
    )
    return known.join(roots(known.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
