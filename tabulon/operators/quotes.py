"""Quotes checked against what was said: exact, near or not there; and quotes sought in whole corpora and on pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tabulon.functions.exprs import normalize_page, normalize_text
from tabulon.plans.lineage import cut

#: Least length of a fragment, least tokens, share of known tokens and of tokens in order of a near match.
FRAGMENT_LEAST, NEAR_TOKENS, NEAR_FILTER, NEAR_SHARE = 8, 4, 0.6, 0.85
#: Bytes of an anchor (no quote sought is shorter), bits of the bitmap of anchors, and turns looked at together.
GRAM, SLOTS, TURNS_AT_ONCE = 8, 1 << 23, 500


def quote_fragments(quote: Column) -> Column:
    """Normalised fragments between ellipses, quotation marks at their ends taken off, eight characters or more."""
    parts = F.transform(F.split(quote, r"\.{3}|…"), lambda f: F.trim(F.regexp_replace(normalize_text(f), r"^[\"']+|[\"']+$", "")))
    return F.filter(parts, lambda f: F.length(f) >= FRAGMENT_LEAST)


def in_order(fragments: Column, text: Column) -> Column:
    """Whether the fragments stand in the text one behind the other."""

    def step(at: Column, f: Column) -> Column:
        found = F.call_function("locate", f, text, at)
        return F.when((at > 0) & (found > 0), found + F.length(f)).otherwise(F.lit(0))

    return F.aggregate(fragments, F.lit(1), step) > 0


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two token lists: one bit a token of ``a``, one step a token of ``b``."""
    bits: dict[str, int] = {}
    for i, x in enumerate(a):
        bits[x] = bits.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & bits.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def common_in_order(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def quote_tokens(text: Column) -> Column:
    words = F.split(F.regexp_replace(normalize_text(text), r"[^\p{L}\p{N}'\s]", " "), r"\s+")
    return F.filter(words, lambda w: w != "")


def match_quotes(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """(quote_id, doc, match, idx, speaker, role, score, spans_turns) of quotes (quote_id, doc, quote) in their document's segments.

    ``exact``: the fragments stand in order in one segment, a participant's
    before a moderator's.  ``near``: they stand in the document's segments
    taken together (spans_turns), or the best segment has 85 % of the words in
    order.  Else ``none``, with the best score.  Pairs are a quote and the
    segments of its own document only.
    """
    # Words are cut before the join, once for each quote and segment: behind it a filter would cut them for every word it looks at.
    asked = quotes.select("quote_id", "doc", quote_fragments(F.col("quote")).alias("f")).withColumn("q", quote_tokens(F.array_join("f", " ")))
    said = segments.select("doc", "idx", "speaker", "role", normalize_text(F.col("text")).alias("t"), quote_tokens(F.col("text")).alias("w"))
    pairs = asked.where(F.size("f") > 0).join(said, "doc")
    first = F.struct((F.col("role") == "moderator").alias("m"), "idx", "speaker", "role")
    exact = pairs.where(in_order(F.col("f"), F.col("t"))).groupBy("quote_id", "doc").agg(F.min(first).alias("e"))
    whole = said.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), " ").alias("whole"))
    spans = asked.where(F.size("f") > 0).join(whole, "doc").where(F.forall("f", lambda f: F.contains(F.col("whole"), f))).select("quote_id", "doc", F.lit(True).alias("spans"))
    words = pairs.select("quote_id", "doc", "idx", "speaker", "role", "q", "w")
    known = F.size(F.filter("w", lambda w: F.array_contains("q", w)))
    close = words.where((F.size("q") >= NEAR_TOKENS) & (known >= NEAR_FILTER * F.size("q"))).withColumn("score", common_in_order("q", "w") / F.size("q"))
    best = close.groupBy("quote_id", "doc").agg(F.min(F.struct((-F.col("score")).alias("s"), (F.col("role") == "moderator").alias("m"), "idx", "speaker", "role")).alias("b"))
    all_ = quotes.select("quote_id", "doc").join(exact, ["quote_id", "doc"], "left").join(spans, ["quote_id", "doc"], "left").join(best, ["quote_id", "doc"], "left")
    is_exact, is_span = F.col("e").isNotNull(), F.col("e").isNull() & F.col("spans").isNotNull()
    is_near = ~is_exact & ~is_span & F.coalesce(-F.col("b.s") >= NEAR_SHARE, F.lit(False))

    def of(name: str) -> Column:
        return F.when(is_exact, F.col(f"e.{name}")).when(is_near, F.col(f"b.{name}")).alias(name)

    score = F.when(is_exact | is_span, 1.0).otherwise(F.coalesce(F.floor(-F.col("b.s") * 1000 + 0.5) / 1000, F.lit(0.0)))
    return all_.select("quote_id", "doc", F.when(is_exact, "exact").when(is_span | is_near, "near").otherwise("none").alias("match"), of("idx"), of("speaker"), of("role"), score.alias("score"), is_span.alias("spans_turns"))


def quote_tally(matches: DataFrame) -> DataFrame:
    """(exact, near, none, moderator): exact matches in a moderator's words count as moderator."""
    asked = (F.col("match") == "exact") & F.coalesce(F.col("role") == "moderator", F.lit(False))
    return matches.agg(*[F.count_if((F.col("match") == m) & ~asked).alias(m) for m in ("exact", "near", "none")], F.count_if(asked).alias("moderator"))


def kept_themes(themes: DataFrame, matches: DataFrame) -> DataFrame:
    """Themes (quote_id, ...) with ``kept`` and, where a quote isn't a participant's own words, ``reason``; fixed values: the reasons."""
    both = themes.join(matches.select("quote_id", "match", "role"), "quote_id")
    moderator = F.coalesce(F.col("role") == "moderator", F.lit(False))
    reason = F.when((F.col("match") == "exact") & moderator, "quote came from the moderator").when(F.col("match") == "near", "quote was close but not word for word").when(F.col("match") == "none", "quote was not found in the transcript")
    return both.withColumn("kept", (F.col("match") == "exact") & ~moderator).withColumn("reason", reason).drop("match", "role")


def _grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, order) of every run of eight bytes inside a text: the bytes themselves as a number, and a hash of them that orders them."""
    data = [(x or "").encode() for x in text.to_pylist()]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    whole = np.frombuffer(b"".join(data), np.uint8)
    if len(whole) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, GRAM)).view(np.uint64)[:, 0]
    row = np.searchsorted(ends, np.arange(len(key)), "right")
    inside = np.arange(len(key)) + GRAM <= ends[row]
    row, key = row[inside], key[inside]
    order = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return row, key, order ^ (order >> np.uint64(32))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes (quote_id, q) with their anchor, the eight bytes of least hash, and its slot among ``SLOTS``."""
    for batch in batches:
        row, key, order = _grams(batch.column("q"))
        line = np.lexsort((order, row))
        first = line[np.unique(row[line], return_index=True)[1]]
        part = batch.take(pa.array(row[first]))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key[first].view(np.int64)), pa.array((order[first] % np.uint64(SLOTS)).astype(np.int64))], names=["quote_id", "q", "anchor", "slot"])


def quotes_in_corpus(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """(quote_id, doc, idx): first turn of all that holds the normalised quote, a participant's before a moderator's.

    A quote is known by its anchor, eight bytes of it.  One pass over the turns
    keeps those that hold bytes which may be an anchor, by a bitmap of fixed size;
    they meet the quotes in a join and are verified whole.  Shorter quotes aren't sought.
    """
    own = quotes.select(F.col("quote_id").cast("long").alias("quote_id"), normalize_text(F.col("quote")).alias("q")).where(F.length("q") >= FRAGMENT_LEAST)
    anchored = cut(own.mapInArrow(_anchored, "quote_id long, q string, anchor long, slot long"))
    # SLOTS bits, whatever the number of quotes.
    words = anchored.select(F.floor(F.col("slot") / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(SLOTS // 64, np.uint64)
    for r in words.toLocalIterator():
        bitmap[r["w"]] = np.int64(r["bits"]).view(np.uint64)
    shared = quotes.sparkSession.sparkContext.broadcast(bitmap)

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TURNS_AT_ONCE):
                part = batch.slice(at, TURNS_AT_ONCE)
                row, key, order = _grams(part.column("t"))
                slot = order % np.uint64(SLOTS)
                some = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                met = np.unique(np.stack([row[some], key[some].view(np.int64)], axis=1), axis=0)
                rows = part.take(pa.array(met[:, 0]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(met[:, 1])], names=["doc", "idx", "moderator", "t", "anchor"])

    t = turns.select(F.col("doc").cast("long").alias("doc"), F.col("idx").cast("long").alias("idx"), (F.col("role") == "moderator").alias("moderator"), normalize_text(F.col("text")).alias("t"))
    near = t.mapInArrow(meets, "doc long, idx long, moderator boolean, t string, anchor long")
    found = near.join(anchored.select("quote_id", "q", "anchor"), "anchor").where(F.contains("t", "q"))
    first = found.groupBy("quote_id").agg(F.min(F.struct("moderator", "doc", "idx")).alias("f"))
    return first.select("quote_id", "f.doc", F.col("f.idx").cast("int").alias("idx"))


def quotes_on_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Quotes (quote_id, doc, page, quote) with ``verified``: on the page named, on its neighbours taken together, or, without a page, in the document."""
    q = quotes.select("quote_id", "doc", "page", normalize_page(F.col("quote")).alias("q"))
    p = pages.select("doc", F.col("page").alias("at"), "text")
    near = q.join(p, "doc").where(F.col("page").isNull() | (F.abs(F.col("at") - F.col("page")) <= 1))

    def joined(which: Column) -> Column:
        lines = F.sort_array(F.collect_list(F.when(which, F.struct("at", "text"))))
        return normalize_page(F.array_join(F.transform(lines, lambda x: x["text"]), " "))

    own = F.col("page").isNull() | (F.col("at") == F.col("page"))
    seen = near.groupBy("quote_id", "q").agg(joined(own).alias("own"), joined(~own).alias("beside"))
    hit = (F.length("q") > 0) & (F.contains("own", "q") | F.contains("beside", "q"))
    return quotes.join(seen.select("quote_id", hit.alias("verified")), "quote_id", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
