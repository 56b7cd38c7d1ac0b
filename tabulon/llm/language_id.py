"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter holds all languages: each slot is a word whose bit l belongs to
language l.  An n-gram sets its language's bit in a few slots; a look-up ANDs
those slots and returns at once every language that has the n-gram.  A text's
score for a language is the share of its n-grams found there, corrected for
the share that a filter so full returns by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.words import chunks, mix
from tabulon.plans.lineage import cut

#: n-gram lengths in code points, and the seed of each.
SIZES = (2, 3, 4)
#: Slots that each n-gram sets, and the share of slots that a language may fill, about: the filter's size follows from the counts.
PROBES, FILL = 3, 0.1
#: An n-gram goes in if it makes up at least this share of its language's n-grams of that length, so at most 1 / share of them do.
LEAST_SHARE = 1 / 40_000
#: Languages that a model may have, and bytes of its filter, both checked before anything of their number reaches the driver.
MOST_LANGUAGES, MOST_BYTES = 4096, 1 << 28
#: Code points whose n-grams are taken at once.
BLOCK = 1 << 16
#: Languages are fitted on at most so many of their labelled documents each, chosen by a hash of the id.
SAMPLE_DOCS = 5_000
UNKNOWN = "und"


_CLASS = None


def _fold_table() -> np.ndarray:
    """Code point -> folded code point, 32 for what isn't a letter; built once in a worker."""
    global _CLASS
    if _CLASS is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _CLASS = table
    return _CLASS


def folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of folded characters; a run of non-letters is one blank, and one blank stands at both ends of each row with letters.

    So what a row gives doesn't hang on its neighbours.
    """
    table = _fold_table()
    own = [x if x is not None else "" for x in text.to_pylist()]
    # Each row is its characters between two separators, which fold to blanks.
    raw = np.frombuffer("".join(f"\n{x}\n" for x in own).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, own), np.int64, len(own)) + 2
    code = table[raw]
    blank = code == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[np.cumsum(size) - size] = True
    return np.repeat(np.arange(len(own), dtype=np.int32), size)[keep], code[keep]


def ngrams(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size index, rows, hashes) of the n-grams of a chunk, BLOCK starts at a time.

    N-grams lie inside one row and hold a letter.
    """
    row, code = folded(text)
    for i, n in enumerate(SIZES):
        last = len(code) - n + 1
        for at in range(0, last, BLOCK):
            m = min(BLOCK, last - at)
            h, letter = np.zeros(m, np.uint64), np.zeros(m, bool)
            for j in range(at, at + n):
                own = code[j : j + m]
                h *= np.uint64(0x100000001B3)
                h += own
                letter |= own != 32
            # Two blanks never touch, so an inner blank of a longer n-gram is a word border.
            ok = letter & (row[at : at + m] == row[at + n - 1 : at + n - 1 + m])
            yield i, row[at : at + m][ok], mix(h[ok] + np.uint64(n << 56))


def _slots(h: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """PROBES slots of each hash among a power of two of them."""
    step, mask = (h >> np.uint64(32)) | np.uint64(1), np.uint64(slots - 1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & mask).astype(np.int64)


@dataclass
class LanguageModel:
    """Filter words by plane (64 languages each), languages in order, chance share of each language."""

    languages: list[str]
    planes: np.ndarray
    chance: np.ndarray

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each row; score = corrected share of n-grams that the language has."""
        n, k = len(text), len(self.languages)
        hits, total = np.zeros((n, max(k, 1))), np.zeros(n, np.int64)
        for _, row, h in ngrams(text):
            if not len(row):
                continue
            low, high = int(row[0]), int(row[-1]) + 1
            row = row - low
            total[low:high] += np.bincount(row, minlength=high - low)
            slots = list(_slots(h, self.planes.shape[1]))
            for p, plane in enumerate(self.planes):
                found = plane[slots[0]]
                for s in slots[1:]:
                    found &= plane[s]
                for bit in range(min(64, k - 64 * p)):
                    hits[low:high, 64 * p + bit] += np.bincount(row, (found >> np.uint64(bit)) & np.uint64(1), minlength=high - low)
        share = hits / np.maximum(total, 1)[:, None]
        score = np.clip((share - self.chance) / (1 - self.chance), 0, 1) if k else hits
        best = score.argmax(axis=1)
        some = (total > 0) & (k > 0)
        lang = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
        return lang, np.where(some, score[np.arange(n), best], 0.0)


def _ngram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, size, gram, n): how often each n-gram stands in the language's documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                names, code = np.unique(part.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                found = list(ngrams(part.column("text")))
                for i in range(len(SIZES)):
                    row, h = (np.concatenate([x[c] for x in found if x[0] == i] or [np.zeros(0, t)]) for c, t in ((1, np.int32), (2, np.uint64)))
                    for own, name in enumerate(names):
                        gram, n = np.unique(h[code[row] == own], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([str(name)] * len(gram), pa.string()), pa.array(np.full(len(gram), i, np.int8)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                            names=["lang", "size", "gram", "n"],
                        )

    return labelled.mapInArrow(work, "lang string, size byte, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, least_share: float = LEAST_SHARE) -> LanguageModel:
    """Model of the non-null ``lang`` values of ``labelled`` (doc_id, text, lang).

    The fit sees at most about ``sample_docs`` documents a language, taken by a
    hash of the id at a rate set from exact counts; the result's size depends
    on languages and ``least_share`` only.  Null texts teach nothing.
    """
    known = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = cut(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = {r["lang"]: r["n"] for r in sizes.collect()}
    if not counts:
        return LanguageModel([], np.zeros((1, 1), np.uint64), np.zeros(1))
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.where(draw < rate[F.col("lang")]).select("text", "lang")
    grams = cut(_ngram_counts(sample))
    least = grams.groupBy("lang", "size").agg((F.sum("n") * least_share).alias("least"))
    chosen = cut(grams.join(F.broadcast(least), ["lang", "size"]).where("n >= least").select("lang", "size", "gram"))
    languages = sorted(counts)
    most = chosen.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << max(10, math.ceil(math.log2(most * PROBES / FILL)))
    shape = ((len(languages) + 63) // 64, slots)
    if 8 * shape[0] * shape[1] > MOST_BYTES:
        raise ValueError(f"a filter of {shape} words has more than {MOST_BYTES} bytes: raise least_share")
    planes = np.zeros(shape, np.uint64)
    for r in chosen.groupBy("lang", "size").agg(F.collect_list("gram").alias("grams")).toLocalIterator():
        plane, bit = divmod(languages.index(r["lang"]), 64)
        for s in _slots(np.array(r["grams"], np.int64).view(np.uint64), slots):
            planes[plane][s] |= np.uint64(1 << bit)
    fill = np.array([((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageModel(languages, planes, fill**PROBES)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` plus lang_pred and score (columns of those names are replaced).

    ``und`` with score 0 where the text is null or has no letter, or no language
    was learnt.  Only the text is read.  Equal scores go to the first language in
    alphabetical order.
    """
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                lang, score = shared.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(work, kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may teach: non-null lang, and crc32 of the id as text leaves a remainder other than 1 by 3."""
    return docs.where(F.col("lang").isNotNull() & ~held_out())


def held_out():
    """True for documents of the test third; null ids count as training rows."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
