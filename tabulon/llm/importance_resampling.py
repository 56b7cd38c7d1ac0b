"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams.  Each bucket has a gain, the floored
log-ratio of its smoothed frequencies in the target and in the corpus; a
document's weight is the floored mean of the gains of its n-grams, and its
score the weight plus a floored Gumbel draw seeded by its id, so the highest
scores are a sample without replacement in proportion to the weights.

Bucket counts are bounded arrays, summed a task at a time, and gains are one
array that every task holds.  Scores are whole numbers of a narrow range, so
their histogram is bounded too: summed from the top it gives the rank at which
each score begins and the score at which the draw ends.  Only documents that
reach it are ordered, each score by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import crc
from tabulon.llm.words import buffers, chunks, lowered, runs_of
from tabulon.plans.lineage import cut

#: Buckets of the hashed n-grams, longest n-gram, parts of the natural logarithm's unit that gains and draws are floored to.
BUCKETS, LONGEST, UNIT = 10_000, 2, 1000
#: Share of the documents drawn, words that a document must have to be drawn, seed of the draw.
PERCENT, LEAST_WORDS, SEED = 25, 20, 7

#: Bytes of words: digits, a-z and all of code points beyond ASCII; A-Z is lower-cased before.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(text: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``longest`` words, repeats included, and the number of words of each row."""
    off, data = buffers(text)
    data = lowered(data)
    row, start, end = runs_of(_SOLID[data], off)
    hashed = crc.extend(np.zeros(len(start), np.uint32), data, start, end)
    rows, found = [row], [hashed]
    for n in range(2, longest + 1):
        # A run of n words is the run of n - 1 from the same word on, a blank and the next word, all in one row.
        own = np.arange(max(0, len(row) - n + 1))
        own = own[row[own] == row[own + n - 1]]
        longer = np.zeros(len(row), np.uint32)
        longer[own] = crc.extend(crc.extend_byte(hashed[own], 0x20), data, start[own + n - 1], end[own + n - 1])
        hashed = longer
        rows.append(row[own])
        found.append(hashed[own])
    return np.concatenate(rows), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.bincount(row, minlength=len(text))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket stands in all of ``texts`` (text): one array a task, summed by Spark; ``buckets`` numbers reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch):
                total += np.bincount(features(part.column("text"), buckets, longest)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """Floored log-ratio of each bucket's smoothed share of the target and of the source."""
    s, t, many = source.astype(float), target.astype(float), float(len(source))
    return np.floor(unit * np.log((t + 1) * (s.sum() + many) / ((s + 1) * (t.sum() + many)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of (doc_id, text); the weight is 0 where there are no n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in chunks(batch):
                row, bucket, n_words = features(part.column("text"), len(own), longest)
                n = np.bincount(row, minlength=part.num_rows)
                total = np.bincount(row, own[bucket], minlength=part.num_rows).astype(np.int64)
                columns = [n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def gumbel(doc_id: str, seed: int = SEED, unit: int = UNIT) -> Column:
    """Floored Gumbel draw of a document, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(unit)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw_highest(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, n_features, weight, score, eligible) without eligible, and with the rank of each drawn row.

    Of N eligible rows the ``percent`` * N // 100 of highest score are drawn, ties
    to smaller doc_id.  A score's rows are ordered in one window, in which equal
    rows are one with a count.
    """
    rows = ["doc_id", "n_features", "weight", "score"]
    histogram = scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Scores are whole numbers within some ten units of gain and draw: so many rows at most, whatever the corpus.
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = cut(histogram.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0))))
    drawn = (histogram.agg(F.sum("n")).first()[0] or 0) * percent // 100
    reached = histogram.where(F.col("above") < drawn).select("score", "above")
    lowest = reached.agg(F.min("score")).first()[0]
    inside = F.lit(False) if lowest is None else F.col("eligible") & (F.col("score") >= lowest)
    upto = Window.partitionBy("score").orderBy(*rows[:3]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        scored.where(inside)
        .groupBy(*rows)
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(F.broadcast(reached), "score")
        .withColumn("rank", F.col("above") + F.coalesce(F.sum("copies").over(upto), F.lit(0)))
        .select(*rows, F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + F.col("copies"))).alias("rank"))
        .withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    )
    return ranked.union(scored.where(~inside).select(*rows, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs (doc_id, text), drawn towards target (text).

    A-Z is lower-cased; words are runs of digits, letters a-z and code points
    beyond ASCII.  Null and empty texts have no words and weight 0.  Documents of
    fewer than ``least_words`` words are scored but not drawn; rows without id
    have no score and take no part in the draw.  Repeated rows are drawn each by
    itself, with ranks of their own.  An empty target leaves every gain to the
    corpus alone; an empty corpus gives no rows.  Other columns are left out.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    weighed = weigh(docs, gain, longest).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    eligible = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    scored = cut(weighed.select("doc_id", "n_features", "weight", "score", eligible.alias("eligible")))
    return draw_highest(scored, percent)
