"""Document fingerprints: one-permutation MinHash of five-word shingles.

Each shingle is hashed once.  The top bits choose a bin and the rest compete
for its minimum.  Empty bins borrow from a filled bin chosen by a hash of
(bin, attempt), the same for every document: optimal densification.  The low
bits of each bin are packed into a hex string.  Likeness counts equal bins and
takes out the share that equals by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.words import CHUNK_BYTES, CHUNK_ROWS, chunks, mix, shingles

SHINGLE_WORDS = 5
BIN_BITS = 9
LOW_BITS = 4
BINS = 1 << BIN_BITS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_TEXT = "fp_text"


def _bins(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Densified minima, one line of bins for each row, and which rows have any shingle."""
    row, h = shingles(text, SHINGLE_WORDS, lower=True)
    least = np.full(len(text) * BINS, _EMPTY)
    value = mix(h & np.uint64((1 << (64 - BIN_BITS)) - 1)) >> np.uint64(1)
    np.minimum.at(least, row * BINS + (h >> np.uint64(64 - BIN_BITS)).astype(np.int64), value)
    least = least.reshape(len(text), BINS)
    full = least != _EMPTY
    some = full.any(axis=1)
    lack_row, lack_bin = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(lack_row):
        seed = lack_bin.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((attempt + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        donor = (mix(seed) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        found = full[lack_row, donor]
        # Mixed with the borrowing bin's number, so that the low bits of bins with one donor are independent;
        # two documents that borrow from equal bins stay equal.
        least[lack_row[found], lack_bin[found]] = mix(least[lack_row[found], donor[found]] + lack_bin[found].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        lack_row, lack_bin = lack_row[~found], lack_bin[~found]
        attempt += 1
    return least, some


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of each bin as small integers, and which rows have a signature at all."""
    least, some = _bins(text)
    return (least & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Hex strings of the packed low bits; '' for rows without words."""
    two = (low[:, 0::2] << 4) | low[:, 1::2]
    return [r.tobytes().hex() if ok else "" for r, ok in zip(two, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, corrected for chance equality, in 0..1.

    Two rows without words are alike (1.0); one without and one with aren't (0.0).
    """
    chance = 2.0**-LOW_BITS
    est = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(some_a & some_b, np.clip(est, 0.0, 1.0), np.where(some_a | some_b, 0.0, 1.0))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``fingerprint`` (hex string; '' for null, empty and blank texts).

    Equal texts have equal fingerprints.  All columns pass through; one named
    fingerprint is replaced.
    """
    kept = docs.drop("fingerprint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                low, some = signatures(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed(low, some), pa.string())], names=[*part.schema.names, "fingerprint"])

    schema = kept.withColumn("fingerprint", F.lit("")).schema
    return kept.mapInArrow(work, schema)


def _heads(docs: DataFrame, buckets: int) -> list[int]:
    """Descending ids that start each of about ``buckets`` ranges of equal size; each occurs in the table.

    The list is as long as the number of buckets, whatever the table's size.
    """
    shares = [i / buckets for i in range(1, buckets)]
    row = docs.agg(F.max("fp_key").alias("top"), F.percentile_approx("fp_key", shares, 10000).alias("cuts")).first()
    return [] if row["top"] is None else sorted({row["top"], *row["cuts"]}, reverse=True)


def pair_with_next(docs: DataFrame, work, schema: str) -> DataFrame:
    """Apply ``work`` to streams of (doc_id, fp_text, fp_last) in descending doc_id.

    Ids are cut into ranges; each range's rows come in order, followed by one
    or more rows with ``fp_last`` set: the first rows of the next range (after
    the last range: of the first).  So every row that isn't ``fp_last`` has its
    follower right behind it, and the text is shuffled once.  Ids that repeat
    follow each other by text; null ids come last.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias(_TEXT)).withColumn("fp_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = _heads(keyed, 4 * parts)
    n, rising = len(heads), np.array(heads[::-1], np.int64)

    @F.pandas_udf("array<int>")
    def ranges(key: pd.Series) -> pd.Series:
        at = n - 1 - (np.searchsorted(rising, key.to_numpy(np.int64), "left"))
        head = rising[n - 1 - at] == key.to_numpy(np.int64)
        return pd.Series([[k, (k - 1) % n] if h else [k] for k, h in zip(at, head, strict=True)])

    placed = keyed.withColumn("fp_ranges", ranges("fp_key"))
    dealt = placed.select("doc_id", _TEXT, "fp_key", F.posexplode("fp_ranges").alias("fp_pos", "fp_range")).withColumn("fp_last", F.col("fp_pos") == 1)
    lined = dealt.repartition(parts, "fp_range").sortWithinPartitions("fp_range", "fp_last", F.desc("fp_key"), _TEXT)
    return lined.select("doc_id", _TEXT, "fp_last").mapInArrow(work, schema)


def _flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of consecutive rows; each but the first begins with the row that ended the one before."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        for part in chunks(batch, _TEXT):
            held.append(part)
            rows, size = rows + part.num_rows, size + part.column(_TEXT).nbytes
            if rows > 1 and (size >= CHUNK_BYTES or rows >= CHUNK_ROWS):
                table = pa.Table.from_batches(held)
                yield table
                last = table.slice(rows - 1).combine_chunks().to_batches()
                held, rows, size = last, 1, 0
    if rows > 1:
        yield pa.Table.from_batches(held)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and the same document with its second half replaced.

    The last floor(n/2) code points give way to as many of the first code
    points of the next document in descending doc_id (all of it if shorter;
    after the last document comes the first).  Null texts are empty.  A table
    of one row follows itself; an empty table gives no rows.  Only doc_id and
    text are read, so other columns may have any name.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _flow(batches):
            text = table.column(_TEXT).combine_chunks()
            own = text.to_pylist()
            halves = [len(x) // 2 for x in own[:-1]]
            edited = [x[: len(x) - h] + y[:h] for x, y, h in zip(own, own[1:], halves, strict=False)]
            low, some = signatures(text)
            low_e, some_e = signatures(pa.array(edited, pa.string()))
            out = pa.table(
                {
                    "doc_id": table.column("doc_id").slice(0, len(edited)).cast(pa.int64()),
                    "n_chars": pa.array([len(x) for x in own[:-1]], pa.int64()),
                    "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                    "fingerprint": packed(low[:-1], some[:-1]),
                    "edited_fingerprint": packed(low_e, some_e),
                    "near_edited": likeness(low[:-1], low_e, some[:-1], some_e),
                    "near_next": likeness(low[:-1], low[1:], some[:-1], some[1:]),
                }
            )
            keep = pa.array(~np.asarray(table.column("fp_last").slice(0, len(edited)).combine_chunks().to_numpy(zero_copy_only=False), bool))
            yield from out.filter(keep).combine_chunks().to_batches()

    return pair_with_next(docs, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
