"""Token counts by section: each document is encoded once, and token spans are joined to section spans.

A byte-level vocabulary gives each token a byte length, so a running sum of
lengths is the span of every token.  Sections are spans too: those of a column,
those of fields that are put together to one text, or else the lines of the
text, each with its closing newline.  A token that crosses a boundary is
allotted by an explicit rule:

``start``     to the section that holds its first byte,
``majority``  to the section that holds most of its bytes, the first of equals,
``split``     to every section it touches, in proportion to bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.words import buffers, chunks

#: Vocabulary file of ranks, one "base64 rank" a line, and the pattern that pre-splits text for it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "majority", "split")


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, pattern: str):
    """Encoder and byte length of each token id."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte offsets that begin a line, then the end; an empty text has one empty section."""
    starts = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], starts[starts < len(data)], [len(data)]])


def span_sections(data: np.ndarray, spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds and section numbers of code-point spans (start, end), given in order; what lies between them is section -1.

    Spans that overlap, run backwards or leave the text are an error.
    """
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    bounds, number, upto = [0], [], 0
    for i, s in enumerate(spans or []):
        if not upto <= s["start"] <= s["end"] < len(at):
            raise ValueError(f"span {i} ({s['start']} to {s['end']}) overlaps another or leaves its text of {len(at) - 1} characters")
        if s["start"] > upto:
            bounds.append(int(at[s["start"]]))
            number.append(-1)
        bounds.append(int(at[s["end"]]))
        number.append(i)
        upto = s["end"]
    if bounds[-1] < len(data) or not number:
        bounds.append(len(data))
        number.append(-1)
    return np.array(bounds), np.array(number)


def joined_fields(fields: list[str]) -> tuple[Column, Column]:
    """Text of the fields joined by newlines, nulls being empty, and the span of each with the newline behind it."""
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for i, p in enumerate(parts):
        end = at + F.char_length(p) + F.lit(int(i < len(parts) - 1))
        spans.append(F.struct(at.alias("start"), end.alias("end")))
        at = end
    return F.concat_ws("\n", *parts), F.array(*spans)


def allot(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, from token end offsets and section bounds.

    Tokens and sections both cover the text without gaps, so the interval join
    is a binary search of token edges among bounds.  A crossing token is counted
    as crossing in the section that holds its first byte.
    """
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    head = np.searchsorted(bounds, starts, "right") - 1
    tail = np.searchsorted(bounds, ends, "left") - 1
    crossing = np.bincount(head[tail > head], minlength=n)
    if rule == "start":
        return np.bincount(head, minlength=n).astype(float), crossing
    whole = np.bincount(head[tail == head], minlength=n).astype(float)
    for t in np.flatnonzero(tail > head):
        s = np.arange(head[t], tail[t] + 1)
        share = np.minimum(bounds[s + 1], ends[t]) - np.maximum(bounds[s], starts[t])
        if rule == "majority":
            whole[s[np.argmax(share)]] += 1
        else:
            whole[s] += share / share.sum()
    return whole, crossing


def token_counts(docs: DataFrame, rule: str = "start", vocabulary: str = VOCABULARY, pattern: str = PATTERN, spans: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """One row for each section of each document (doc_id, text).

    Sections are the spans of the column ``spans`` (array of structs start, end
    in code points, in order and disjoint; gaps between them are rows of section
    -1), or the ``fields``, columns that make up the text in place of ``text``
    (section i is the i-th; the newline between two belongs to the first), or
    else lines.  Columns: doc_id, section (0-based), start_char, end_char (code
    points), n_tokens (double; fractions only under ``split``), n_crossing,
    doc_tokens.  The n_tokens of a document's rows add up to doc_tokens.  Null
    and empty texts have one empty line and no tokens, null spans are none;
    repeated rows are counted each by itself, an empty table gives no rows, and
    other columns aren't read.  Special-token strings are ordinary text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if spans and fields:
        raise ValueError("give spans or fields, not both")
    if fields:
        text, given = joined_fields(fields)
        docs = docs.select("doc_id", text.alias("text"), given.alias("spans"))
    else:
        docs = docs.select("doc_id", "text", *([F.col(spans).alias("spans")] if spans else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(vocabulary, pattern)
        for batch in batches:
            for part in chunks(batch):
                off, data = buffers(part.column("text"))
                rows, cols = [], [[], [], [], [], []]
                given = part.column("spans").to_pylist() if "spans" in part.schema.names else None
                for r, text in enumerate(part.column("text").to_pylist()):
                    own = data[off[r] : off[r + 1]]
                    ids = np.array(encoder.encode_ordinary(text or ""), np.int64)
                    bounds, number = span_sections(own, given[r]) if given is not None else (line_sections(own), None)
                    number = np.arange(len(bounds) - 1) if number is None else number
                    tokens, crossing = allot(np.cumsum(lengths[ids]), bounds, rule)
                    chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[bounds]
                    rows.append(len(tokens))
                    for c, x in zip(cols, (number, chars[:-1], chars[1:], tokens, crossing), strict=True):
                        c.append(x)
                n = np.array(rows)
                flat = [np.concatenate(c) for c in cols]
                which = np.repeat(np.arange(len(n)), n)
                total = np.rint(np.bincount(which, flat[3], minlength=len(n))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()).take(pa.array(which)),
                        *[pa.array(x.astype(np.int64)) for x in flat[:3]],
                        pa.array(flat[3]),
                        pa.array(flat[4].astype(np.int64)),
                        pa.array(total[which]),
                    ],
                    names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
                )

    schema = "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"
    return docs.mapInArrow(work, schema)
