"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

Blanks become marks, and the text falls into marked words that no piece
crosses.  The distinct words of a chunk are sorted, which lays them out as a
trie in depth-first order: each word keeps the forward states of the prefix it
shares with the word before and extends them.

Forward states, one for each prefix:

* ``unigram`` models: the best sum of scores, and the last piece of the path
  that has it (ordinary Viterbi).
* ``bpe`` models: the last piece of the only admissible path.  A piece may
  follow another where merging their joined text gives back the two; chains of
  such pairs are exactly what merging the whole word gives, and each prefix has
  one.  The transition score is 0 or minus infinity.

Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.words import chunks, list_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text handled with one trie, and distinct words whose pieces a task keeps between tries.
TRIE_BYTES, KEPT_WORDS = 1 << 20, 150_000
#: Ids decoded at once, or those of one text.
DECODED_IDS = 1 << 17
#: Pairs of neighbouring pieces whose admissibility a task remembers.
KEPT_PAIRS = 400_000
_LOST = -1e18


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


class Codec:
    """Pieces and scores of a model file, and the search over them."""

    def __init__(self, model: str, algorithm: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        sample = " a  \ufb01 \uff21 e\u0301\t\n"
        if sp.decode(sp.encode(sample)) != sample:
            raise ValueError("the model normalises texts; ids over plain texts would differ from its own")
        self.algorithm = algorithm
        self.unknown = sp.unk_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[int, float] = {}
        self.bytes: list[int] = [self.unknown] * 256
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"" if sp.is_control(i) else b" \xe2\x81\x87 ")
            else:
                self.ids[piece] = i
                self.scores[i] = sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        self.floor = min(self.scores.values()) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a blank; marked words can't be told apart")
        lines = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{lines}]*|[^{MARK}{lines}]+" + (r"|\n+" if lines else ""))
        self.lone: dict[str, int] = {}
        self.fits: dict[int, bool] = {}

    def number(self, char: str) -> int:
        """A number of its own for a character without a piece, beyond all ids."""
        i = self.lone[char] = len(self.raw) + ord(char)
        return i

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by plain merging: best score first, leftmost of equals."""
        part = list(text)
        while len(part) > 1:
            best = None
            for i in range(len(part) - 1):
                p = self.ids.get(part[i] + part[i + 1])
                if p is not None and (best is None or self.scores[p] > best[0]):
                    best = (self.scores[p], i)
            if best is None:
                break
            i = best[1]
            part[i : i + 2] = [part[i] + part[i + 1]]
        return part

    def follows(self, left: str, right: str) -> bool:
        """Whether merging left + right gives back the two."""
        return self.merged(left + right) == [x for x in (left, right) if x]

    def piece_ids(self, piece: str) -> list[int]:
        """Id of a piece, or the byte pieces of a character without one."""
        i = self.ids.get(piece)
        return [self.bytes[b] for b in piece.encode()] if i is None else [i]

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the ascending distinct words, forward states shared along common prefixes."""
        return self._merge_paths(words) if self.algorithm == "bpe" else self._best_paths(words)

    def _merge_paths(self, words: list[str]) -> list[list[int]]:
        get, lone, fits, longest, size = self.ids.get, self.lone, self.fits, self.longest, len(self.raw)
        last: list[int] = [0]  # last piece of the path over the first i characters, and where it begins
        back: list[int] = [0]
        out, before = [], ""
        for word in words:
            shared, n = _shared(before, word), len(word)
            del last[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, n + 1):
                # Only one start is admissible, so the short pieces, which win most often, are tried first.
                for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                    i = get(word[start:end])
                    if i is None:
                        if start < end - 1:
                            continue
                        i = lone.get(word[start]) or self.number(word[start])
                    key = last[start] << 21 | i if start else -1 - i
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) > KEPT_PAIRS:
                            fits.clear()
                        ok = fits[key] = self.follows(word[back[start] : start], word[start:end])
                    if ok:
                        last.append(i)
                        back.append(start)
                        break
            own, end = [], n
            while end:
                i = last[end]
                if i < size:
                    own.append(i)
                else:
                    own.extend(self.bytes[b] for b in reversed(word[end - 1].encode()))
                end = back[end]
            own.reverse()
            out.append(own)
            before = word
        return out

    def _best_paths(self, words: list[str]) -> list[list[int]]:
        ids, scores, longest = self.ids, self.scores, self.longest
        score: list[float] = [0.0]
        back: list[int] = [0]
        out, before = [], ""
        for word in words:
            shared = _shared(before, word)
            del score[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, at = _LOST, end - 1
                for start in range(max(0, end - longest), end):
                    i = ids.get(word[start:end])
                    s = score[start] + (scores[i] if i is not None else self.floor if end - start == 1 else _LOST)
                    if s > best:
                        best, at = s, start
                score.append(best)
                back.append(at)
            own, end = [], len(word)
            while end:
                own.append(word[back[end] : end])
                end = back[end]
            out.append([i for p in reversed(own) for i in self.piece_ids(p)])
            before = word
        return out

    def split(self, text: str) -> list[str]:
        """Marked words of a text with its leading mark, given without their first mark; empty for an empty text.

        Where blanks stand alone, plain splitting at them gives just these; a run of blanks is one mark each but the last,
        which the pattern tells apart.
        """
        if "  " in text or text[:1] in (" ", "") or text[-1] == " ":
            return [w[1:] if w[0] == MARK else MARK_FREE + w for w in self.words.findall((MARK + text).replace(" ", MARK))] if text else []
        return text.split(" ")

    def decode(self, ids) -> str:
        """Text of piece ids; the leading mark's blank is taken off, broken byte runs read as U+FFFD."""
        return _unmarked(b"".join(map(self.raw.__getitem__, ids)))


#: Stands before words that have no mark (they follow a line break), so that they differ from marked ones; half a surrogate pair, which no UTF-8 text can hold.
MARK_FREE = "\ud800"


def _unmarked(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(model: str, algorithm: str) -> Codec:
    return Codec(model, algorithm)


def encode_texts(tool: Codec, texts: list[str | None], table: dict[str, bytes]) -> list[bytes]:
    """32-bit ids of each text; ``table`` keeps the pieces of words seen before, of these texts' alone when it is full."""
    split = [tool.split(x or "") for x in texts]
    words = set(chain.from_iterable(split))
    new = words.difference(table)
    if len(table) + len(new) > KEPT_WORDS:
        kept = {w: table[w] for w in words.difference(new)}
        table.clear()
        table.update(kept)
    lined = sorted(w[1:] if w[:1] == MARK_FREE else MARK + w for w in new)
    for word, ids in zip(lined, tool.encode_sorted(lined), strict=True):
        table[word[1:] if word[:1] == MARK else MARK_FREE + word] = array("i", ids).tobytes()
    return [b"".join(map(table.__getitem__, words)) for words in split]


def encode_documents(docs: DataFrame, model: str = MODEL, algorithm: str = "bpe") -> DataFrame:
    """``docs`` plus piece_ids (array<int>) and n_pieces (columns of those names are replaced).

    Null and empty texts have no pieces.  Blanks are kept as they are, so
    decoding gives back the text; only the mark itself, U+2581, reads as a
    blank, as in the library.  Control strings in a text are ordinary text.
    A model that normalises texts is refused.
    """
    if algorithm not in ("bpe", "unigram"):
        raise ValueError("algorithm must be bpe or unigram")
    kept = docs.drop("piece_ids", "n_pieces")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, table = codec(model, algorithm), {}
        for batch in batches:
            for part in chunks(batch, size=TRIE_BYTES):
                ids = encode_texts(tool, part.column("text").to_pylist(), table)
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = list_array(flat, np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(n)], names=[*part.schema.names, "piece_ids", "n_pieces"])

    return kept.mapInArrow(work, kept.withColumn("piece_ids", F.lit(None).cast("array<int>")).withColumn("n_pieces", F.lit(0).cast("long")).schema)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` plus ``decoded``, the text of piece_ids; null ids decode to an empty text."""
    kept = encoded.drop("decoded")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(codec(model, "bpe").raw, pa.binary())
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column("piece_ids")), 0).to_numpy().astype(np.int64)
            upto, at = np.concatenate([[0], np.cumsum(n)]), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + DECODED_IDS, "right")) - 1)
                part = batch.slice(at, to - at)
                ids = part.column("piece_ids")
                joined = pieces.take(ids.flatten())  # its bytes stand one after the other
                _, offsets, data = joined.buffers()
                ends = np.frombuffer(offsets, np.int32)[upto[at : to + 1] - upto[at]]
                at = to
                raw = data.to_pybytes() if data is not None else b""
                text = [_unmarked(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(work, kept.withColumn("decoded", F.lit("")).schema)
