"""Substring dedup with suffix automata.

A window is a run of ``length`` words.  Words covered by a window that also
stands elsewhere in the corpus are removed.  Every window has an anchor, its
least hash of some consecutive words, so equal windows have equal anchors.
Neighbouring windows with the same anchor occurrence form a fragment.

Reference shards hold the distinct fragments of anchors that occur more than
once, dealt by anchor, so that all places where a window could recur meet in
one shard of bounded size.  Each shard becomes a suffix automaton with weighted
occurrence counts, and its fragments are streamed through it: where the
matching statistic reaches ``length`` words that occur twice, the window goes.
Anchors with very many distinct fragments are counted window by window in a
shuffle instead, which no hot passage can overfill.

``remove_reference_spans`` is the broadcast form, against reference texts of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.words import CHUNK_BYTES, Grams, chunks, fresh, packed, unpack, words_of
from tabulon.plans.lineage import cut

LENGTH = 35
#: Words of an anchor, if the window is longer; and windows that one anchor occurrence may have, one bit each of a mask.
ANCHOR_WORDS, MASK_BITS = 12, 63
#: Words that the automaton of one shard holds, about; and distinct fragments of one anchor that go to an automaton.
SHARD_WORDS, SHARD_FRAGMENTS = 60_000, 64
#: Most words of the reference texts of the broadcast form, and words of each of its automata.
REFERENCE_WORDS, REFERENCE_SHARD = 2_000_000, 250_000


class SuffixAutomaton:
    """All substrings of some sequences of integers, each with its weighted number of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A state for the part of q that is one symbol longer than p; q if that is all of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list[int], weight: int = 1) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._split(last, symbol, q)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, symbol, self.next[p][symbol])
                last = new
            self.count[last] += weight

    def close(self) -> SuffixAutomaton:
        """Add up the occurrence counts; to be called once, after the last ``add``."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] >= 0:
                self.count[self.link[state]] += self.count[state]
        return self

    def ends(self, sequence: list[int], length: int, least: int) -> list[int]:
        """Positions where the last ``length`` symbols occur at least ``least`` times in what was added."""
        state, matched, found = 0, 0, []
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            while state and self.length[self.link[state]] >= length:
                state = self.link[state]
                matched = self.length[state]
            if matched >= length and self.count[state] >= least:
                found.append(i)
        return found


def anchor_words(length: int) -> int:
    """Words of the anchors of windows of that length."""
    if length < 1:
        raise ValueError(f"a window has one word or more, not {length}")
    return max(min(ANCHOR_WORDS, length), length - MASK_BITS + 1)


def fragments(text: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, fragment hash) of each fragment, in order."""
    w = words_of(text)
    g = Grams(w)
    own = anchor_words(length)
    span = length - own + 1
    n = len(w.hash)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    start = np.arange(n - own + 1)
    grams = g.spans(start, start + own)
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    window = np.arange(n - length + 1)
    fits = window + length <= w.first[w.row[window] + 1]
    window, anchor = window[fits], (window + least)[fits]
    if not len(window):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    head = np.ones(len(window), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (w.row[window[1:]] != w.row[window[:-1]])
    at = np.flatnonzero(head)
    many = np.diff(np.append(at, len(window)))
    first = window[at]
    row = w.row[first]
    return row, first - w.first[row], many, grams[anchor[at]], g.spans(first, first + many + length - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows that share an id stay apart."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.hash("text"))


def _unpacked(batches: Iterator[pa.RecordBatch], name: str = "packed") -> Iterator[pa.RecordBatch]:
    """Chunks of batches with the column of packed texts replaced by ``text``."""
    for batch in batches:
        at, size = 0, 0
        texts: list[str | None] = []
        rest = [i for i, c in enumerate(batch.schema.names) if c != name]
        for i, x in enumerate(batch.column(name)):
            texts.append(unpack(x))
            size += len(texts[-1] or "")
            if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(texts, pa.string())], names=[*[part.schema.names[c] for c in rest], "text"])
                at, size, texts = i + 1, 0, []


_ROW = "doc_id long, text_key int"


def fragment_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(anchor, fragment, doc_id, text_key, first, windows) of every fragment of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                row, first, many, anchor, fragment = fragments(part.column("text"), length)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(fragment.view(np.int64)), part.column("doc_id").cast(pa.int64()).take(at), part.column("text_key").take(at), pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32))],
                    names=["anchor", "fragment", "doc_id", "text_key", "first", "windows"],
                )

    return keyed.mapInArrow(work, f"anchor long, fragment long, {_ROW}, first int, windows int")


def fragment_words(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, fragment, weight, words): word hashes of each wanted fragment, read from one of its places; once for each repeated row there."""
    by_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "fragment", "weight", "first", "windows")).alias("want"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "want")
    placed = packed(keyed).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).select("want", "packed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _unpacked(batches):
            w = words_of(part.column("text"))
            cols: list[list] = [[], [], [], []]
            for r, want in enumerate(part.column("want").to_pylist()):
                for x in want:
                    s = w.first[r] + x["first"]
                    for c, v in zip(cols, (x["anchor"], x["fragment"], x["weight"], w.hash[s : s + x["windows"] + length - 1].tobytes()), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "fragment", "weight", "words"])

    return placed.mapInArrow(work, "anchor long, fragment long, weight long, words binary")


def shard_matches(sequences: DataFrame, shards: int, length: int) -> DataFrame:
    """(anchor, fragment, mask): bit i set where window i of the fragment recurs, found shard by shard with an automaton."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "fragment"])
        sequences = [np.frombuffer(x, np.uint64).tolist() for x in pdf["words"]]
        automaton = SuffixAutomaton()
        for seq, weight in zip(sequences, pdf["weight"], strict=True):
            automaton.add(seq, int(weight))
        automaton.close()
        masks = [sum(1 << (e - length + 1) for e in automaton.ends(seq, length, 2)) for seq in sequences]
        return pd.DataFrame({"anchor": pdf["anchor"], "fragment": pdf["fragment"], "mask": masks})

    dealt = sequences.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(work, "anchor long, fragment long, mask long")


def window_matches(sequences: DataFrame, length: int) -> DataFrame:
    """The same by counting window hashes in a shuffle, for anchors with too many fragments for one shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("words")]
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            many = np.array([len(h) - length + 1 for h in hashes], np.int64)
            base = np.concatenate([[0], np.cumsum([len(h) for h in hashes])[:-1]]) if hashes else np.zeros(0, np.int64)
            which = np.repeat(np.arange(len(hashes)), many)
            window = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            key = _sequence_hash(flat, base[which] + window, length)
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in ("anchor", "fragment", "weight")], pa.array(window), pa.array(key.view(np.int64))], names=["anchor", "fragment", "weight", "window", "key"]
            )

    rows = sequences.mapInArrow(work, "anchor long, fragment long, weight long, window long, key long")
    twice = rows.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("window").cast("int"))
    return rows.join(twice, "key").groupBy("anchor", "fragment").agg(F.sum(bit).alias("mask"))


def _sequence_hash(flat: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    from types import SimpleNamespace

    return Grams(SimpleNamespace(hash=flat)).spans(start, start + length)


def repeated_windows(keyed: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, first, mask) of fragments with windows that recur: bit i is the window at word first + i.

    Lists of hot anchors are cut before they are joined: with no aggregate in
    the join's stage, Spark splits the partitions that such an anchor fills.
    """
    rows = fragment_rows(keyed, length)
    shared = cut(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    places = cut(rows.join(shared, "anchor"))
    one = F.min(F.struct("doc_id", "text_key", "first", "windows")).alias("at")
    distinct = cut(places.groupBy("anchor", "fragment").agg(F.count(F.lit(1)).alias("weight"), one).select("anchor", "fragment", "weight", "at.*"))
    hot = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_FRAGMENTS).select("anchor"))
    few, many = distinct.join(hot, "anchor", "left_anti"), distinct.join(hot, "anchor", "left_semi")
    words = few.agg(F.sum(F.col("windows") + (length - 1))).first()[0] or 0
    found = shard_matches(fragment_words(keyed, few, length), max(1, round(words / SHARD_WORDS)), length)
    found = found.union(window_matches(cut(fragment_words(keyed, many, length).dropDuplicates(["anchor", "fragment"])), length))
    return places.join(found.where("mask <> 0"), ["anchor", "fragment"]).select("doc_id", "text_key", "first", "mask")


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ADDED = ("n_words", "n_removed", "spans", "kept")


def _with_added(frame: DataFrame) -> DataFrame:
    """An empty frame's schema plus the columns that the removals add."""
    kinds = ("long", "long", "array<struct<start:int,end:int>>", "string")
    return frame.select("*", *[F.lit(None).cast(k).alias(c) for c, k in zip(_ADDED, kinds, strict=True)])


def _added(part: pa.RecordBatch, columns: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), _SPANS, pa.string())
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=[*columns, *_ADDED])


def remove_repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` plus n_words, n_removed, spans and kept (columns of those names are replaced).

    Removes each word covered by a window of ``length`` words whose sequence also
    starts anywhere else, the same document included; windows are judged on the
    input.  Words are separated by ASCII blanks and not changed.  spans are the
    removed runs (word positions, end excluded); kept holds the other words joined
    by one blank.  Null and blank texts have no words.  Repeated rows repeat each
    other's windows.  An empty table gives no rows.  A length under 1 is an error.
    """
    anchor_words(length)
    own = docs.drop(*_ADDED)
    columns = own.columns
    packed_name, key = fresh("packed", columns), fresh("sd_key", columns)
    doc, text, many = (fresh(c, [*columns, packed_name, key]) for c in ("sd_doc", "sd_text", "sd_found"))
    windows = repeated_windows(_keyed(own), length).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "mask")).alias(many))
    found = windows.select(F.col("doc_id").alias(doc), F.col("text_key").alias(text), many)
    whole = packed(own.withColumn(key, F.hash(F.coalesce("text", F.lit("")))), packed_name)
    placed = whole.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text)), "left").drop(doc, text, key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(MASK_BITS)
        for part in _unpacked(batches, packed_name):
            rows = []
            for own_text, hits in zip(part.column("text").to_pylist(), part.column(many).to_pylist(), strict=True):
                words = (own_text or "").encode().split()
                gone = np.zeros(len(words), bool)
                if hits:
                    first = np.array([x["first"] for x in hits], np.int64)
                    mask = np.array([x["mask"] for x in hits], np.int64)
                    gone = _covered(len(words), (first[:, None] + bits)[(mask[:, None] >> bits) & 1 == 1], length)
                rows.append((len(words), int(gone.sum()), _spans(gone), b" ".join(compress(words, ~gone) if hits else words).decode()))
            yield _added(part, columns, rows)

    return placed.mapInArrow(work, _with_added(own).schema)


def remove_reference_spans(docs: DataFrame, reference: DataFrame, length: int = LENGTH, most_words: int = REFERENCE_WORDS) -> DataFrame:
    """``remove_repeated_spans`` against the texts of ``reference``: words in runs of ``length`` that stand there go.

    The reference must hold at most ``most_words`` words (checked); its automata are broadcast.
    """
    texts = reference.select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.size(F.split(F.trim("text"), "[ \\t-\\r]+")))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the reference has {size} words; the bound is {most_words}")
    shards, held = [SuffixAutomaton()], 0
    for r in texts.toLocalIterator():
        hashes = words_of(pa.array([r["text"]])).hash.tolist()
        if held + len(hashes) > REFERENCE_SHARD and held:
            shards.append(SuffixAutomaton())
            held = 0
        shards[-1].add(hashes)
        held += len(hashes)
    shared = docs.sparkSession.sparkContext.broadcast([s.close() for s in shards])

    own = docs.drop(*_ADDED)
    columns = own.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words_of(part.column("text"))
                rows = []
                for r, text in enumerate(part.column("text").to_pylist()):
                    words = (text or "").encode().split()
                    hashes = w.hash[w.first[r] : w.first[r + 1]].tolist()
                    ends = [e for s in shared.value for e in s.ends(hashes, length, 1)]
                    gone = _covered(len(words), np.array(ends, np.int64) - length + 1, length)
                    rows.append((len(words), int(gone.sum()), _spans(gone), b" ".join(compress(words, ~gone)).decode()))
                yield _added(part, columns, rows)

    return own.mapInArrow(work, _with_added(own).schema)
