"""Chat formatting with typed content parts.

A message holds an ordered list of parts.  A visitor with one method for each
kind (text, image, audio, document) flattens them into the formatted text:
text is escaped, anything else becomes placeholders, one for each token it
expands to, and leaves a reference with its place and token count.  Control
strings inside texts gain a backslash behind their first character, which
``unescape`` takes off again, so that the output reads back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of this template, and control strings of other common ones that are defused as well.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (TURN, BODY, END, *PLACEHOLDERS.values(), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

PART_TYPE = "array<struct<kind:string,text:string,ref:string,n_tokens:int>>"
_BY_FIRST = "|".join(re.escape(c[0]) + r"(?P<n%d>\\*)" % i + re.escape(c[1:]) for i, c in enumerate(CONTROL))
_ANY = re.compile(re.sub(r"\(\?P<n\d+>", "(?:", _BY_FIRST))
_TURNS = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(BODY) + r"(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """Put one more backslash behind the first character of each control string, escaped ones included."""
    return _ANY.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Take one backslash off each escaped control string."""
    return _ANY.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class Flatten:
    """Visits the parts of one message in order."""

    def __init__(self, at: int):
        self.at, self.pieces, self.refs = at, [], []

    def visit(self, part) -> None:
        kind = part["kind"] or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def visit_text(self, part) -> None:
        self._put(escape(part["text"] or ""))

    def _attach(self, part) -> None:
        n = max(1, int(part["n_tokens"] or 1))
        self.refs.append({"kind": part["kind"], "ref": part["ref"], "at": self.at, "n_tokens": n})
        self._put(PLACEHOLDERS[part["kind"]] * n)

    visit_image = visit_audio = visit_document = _attach

    def visit_unknown(self, part) -> None:
        raise ValueError(f"no such kind of part: {part['kind']}")


def format_messages(roles: list[str], messages: list[list]) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """Formatted text, spans under the loss mask (assistant bodies, escaped), attachment references."""
    out, at, spans, refs = [], 0, [], []
    for role, parts in zip(roles, messages, strict=True):
        head = TURN + escape(role) + BODY
        flat = Flatten(at + len(head))
        for part in parts:
            flat.visit(part)
        if role == "assistant":
            spans.append((at + len(head), flat.at))
        out += [head, *flat.pieces, END]
        refs += flat.refs
        at = flat.at + len(END)
    return "".join(out), spans, refs


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted text."""
    return [(unescape(a), unescape(b)) for a, b in _TURNS.findall(formatted)]


def text_parts(text: Column) -> Column:
    """A list of one text part; null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,at:long,n_tokens:int>>"


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row a conversation from (conv_id, turn, role, parts).

    Columns: conv_id, n_turns, formatted, loss_spans (code points), attachments.
    Turns are put in order by turn, then role and parts, so repeated rows and
    equal turns stay in a fixed order; null turns come first, null roles are
    empty.  Null parts are no parts.  Null conv_ids form one conversation.
    Ids travel as texts, so that no null turns them into floats.  Only the four
    columns are read; an empty table gives no rows.
    Rows are sorted inside partitions and read as a stream, one conversation in
    memory at a time; its formatted text is one value of the result.
    """
    ordered = messages.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(PART_TYPE), F.array().cast(PART_TYPE)).alias("parts"))
    lined = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(key, roles, parts) -> dict:
            text, spans, refs = format_messages(roles, parts)
            return {"conv_id": key, "n_turns": len(roles), "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans], "attachments": refs}

        key, roles, parts, any_row = None, [], [], False
        for frame in frames:
            out = []
            for k, role, own in zip(frame["conv_id"], frame["role"], frame["parts"], strict=True):
                if any_row and k != key:
                    out.append(done(key, roles, parts))
                    roles, parts = [], []
                key, any_row = k, True
                roles.append(role)
                parts.append(own)
            if out:
                yield pd.DataFrame(out)
        if any_row:
            yield pd.DataFrame([done(key, roles, parts)])

    made = lined.mapInPandas(work, FORMATTED.replace("conv_id long", "conv_id string"))
    return made.withColumn("conv_id", F.col("conv_id").cast(messages.schema["conv_id"].dataType))


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, all read back from the formatted text and its spans."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, text, spans in zip(f["conv_id"], f["formatted"], f["loss_spans"], strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[int(s["start"]) : int(s["end"])]) for s in spans)
                rows.append((key, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    made = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss_spans").mapInPandas(work, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return made.withColumn("conv_id", F.col("conv_id").cast(formatted.schema["conv_id"].dataType))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
