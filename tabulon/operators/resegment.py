"""Reading a transcript again and editing its codebook, with what hangs on the old turns and codes carried over.

Two segmentations of one text are aligned by the places of their turns in it:
an interval join over buckets of characters.  What is tied to an old turn goes
to the new turn that shares most characters with it.  An edited codebook is a
new version; codes that keep their name keep their counts and their turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import code_key
from tabulon.operators.changes import carry_flags, insert_codebooks
from tabulon.operators.views import codebooks_in_force
from tabulon.plans.lineage import cut

#: Characters of a bucket of the interval join; turns are mostly shorter.
BUCKET = 1024
#: Most codes of an edited codebook, and the wording of what is wrong with edits.
MOST_EDITED = 28
NO_CODES = "A codebook needs at least one code with a name and a definition."
TOO_MANY = f"A codebook can have at most {MOST_EDITED} codes."
#: Ids of a codebook's codes begin at its own id times this.
ID_STEP = 100

#: Characters at both ends of a turn by which it is found where a label stands inside it.
ENDS = (40, 20, 10, 4)

_BLANKS = re.compile(r"[ \t\n\r\f\v]+")


def find_turn(body: str, own: str, at: int) -> tuple[int, int] | None:
    """Start and stop of a turn in a text from ``at`` on: as it is, or from its first characters to its last, as a merged turn has its parts' labels in the text."""
    start = body.find(own, at)
    if start >= 0:
        return start, start + len(own)
    for size in ENDS:
        start = body.find(own[:size], at) if len(own) > size else -1
        stop = body.find(own[-size:], start + len(own) - size) if start >= 0 else -1
        if stop >= 0:
            return start, stop + size
    return None


def turn_spans(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc, idx, start, stop): places of turns (doc, idx, text) in their document's text (doc, text), blanks not counted.

    Turns are sought in order, each behind the one before.  Those that aren't
    there, blank ones and those without a text have no row.  A group is one
    document's text, which is one row already, and its turns.
    """

    def place(text: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
        body = _BLANKS.sub("", max((t for t in text["text"] if t is not None), default=""))
        at, out = 0, []
        for doc, idx, turn in turns.sort_values(["idx", "text"], na_position="first")[["doc", "idx", "text"]].itertuples(index=False):
            own = _BLANKS.sub("", turn or "")
            found = find_turn(body, own, at) if own else None
            if found:
                at = found[1]
                out.append((doc, idx, *found))
        return pd.DataFrame(out, columns=["doc", "idx", "start", "stop"])

    left = docs.select(F.col("doc").cast("long").alias("doc"), "text").groupBy("doc")
    right = segments.select(F.col("doc").cast("long").alias("doc"), F.col("idx").cast("long").alias("idx"), "text").groupBy("doc")
    return left.cogroup(right).applyInPandas(place, "doc long, idx long, start long, stop long")


def align_turns(old: DataFrame, new: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc, old_idx, new_idx, overlap) of turns whose spans (doc, idx, start, stop) overlap.

    Spans meet in each bucket of the document they reach into; a pair counts in
    the first one they share, so long turns cost rows but give no pair twice.
    """

    def dealt(spans: DataFrame, name: str) -> DataFrame:
        reach = F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))
        own = [F.col(c).alias(f"{name}_{c}") for c in ("idx", "start", "stop")]
        return spans.where("stop > start").select("doc", *own, F.explode(reach).alias("bucket"))

    both = dealt(old, "old").join(dealt(new, "new"), ["doc", "bucket"])
    start, stop = F.greatest("old_start", "new_start"), F.least("old_stop", "new_stop")
    met = both.where((stop > start) & (F.col("bucket") == F.floor(start / bucket)))
    return met.select("doc", "old_idx", "new_idx", (stop - start).alias("overlap"))


def best_turns(aligned: DataFrame) -> DataFrame:
    """(doc, idx, new_idx, overlap): the new turn that shares most with each old one, the first of equals."""
    best = F.max_by(F.struct("new_idx", "overlap"), F.struct(F.col("overlap"), -F.col("new_idx")))
    return aligned.groupBy("doc", F.col("old_idx").alias("idx")).agg(best.alias("b")).select("doc", "idx", "b.new_idx", "b.overlap")


def carry(rows: DataFrame, best: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``rows`` (doc, idx, ...) on their new turns; of several that meet under the same ``keys`` the one that shares most stays, the earliest of equals.

    Rows whose turn has no place go; equal rows become one.
    """
    own = [c for c in rows.columns if c not in ("doc", "idx")]
    moved = rows.join(best, ["doc", "idx"])
    first = F.max_by(F.struct(*own), F.struct(F.col("overlap"), -F.col("idx"), *[F.col(c) for c in own if c not in keys])) if own else None
    if first is None:
        return moved.select("doc", F.col("new_idx").alias("idx")).distinct()
    return moved.groupBy("doc", F.col("new_idx").alias("idx"), *keys).agg(first.alias("kept")).select("doc", "idx", *[F.col(f"kept.{c}").alias(c) for c in own])


@dataclass
class Resegmented:
    """What hung on the old turns, on the new ones, and how much had no place: (doc, kind, lost)."""

    aligned: DataFrame
    assignments: DataFrame
    overrides: DataFrame
    notes: DataFrame
    lost: DataFrame


def resegment(docs: DataFrame, old: DataFrame, new: DataFrame, assignments: DataFrame, overrides: DataFrame, notes: DataFrame) -> Resegmented:
    """Codes (doc, idx, code), overrides (doc, idx, name, action) and notes (doc, idx, note) carried from old turns to new ones.

    A merged turn has the codes of all its parts, and of a split turn the larger
    part has them.  Overrides that meet on one turn and name, and notes that meet
    on one turn, give way to the one that shares most.
    """
    aligned = cut(align_turns(turn_spans(docs, old), turn_spans(docs, new)))
    best = cut(best_turns(aligned))
    named = overrides.withColumn("resegment_key", code_key(F.col("name")))
    kinds = {"assignments": assignments.select("doc", "idx"), "overrides": overrides.select("doc", "idx"), "notes": notes.select("doc", "idx")}
    lost = None
    for kind, rows in kinds.items():
        own = rows.join(best, ["doc", "idx"], "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("lost")).select("doc", F.lit(kind).alias("kind"), "lost")
        lost = own if lost is None else lost.union(own)
    return Resegmented(aligned, carry(assignments, best, ["code"]), carry(named, best, ["resegment_key"]).drop("resegment_key"), carry(notes, best), lost)


def check_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, problems): edits (doc, place, code_id, name, definition, ...) trimmed, blank ones left out; documents whose edits can't be a codebook, with the reason."""
    text = [c for c in ("name", "definition", "inclusion", "exclusion") if c in edits.columns]
    own = edits.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in text}).withColumn("edit_key", F.lower("name"))
    filled = own.where("name <> '' AND definition <> ''")
    same = Window.partitionBy("doc", "edit_key").orderBy("place")
    sizes = filled.withColumn("twice", F.row_number().over(same)).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.when(F.col("twice") > 1, F.col("name")), F.when(F.col("twice") > 1, F.col("place"))).alias("twice"))
    asked = own.select("doc").distinct().join(sizes, "doc", "left")
    reason = F.when(F.col("n").isNull(), NO_CODES).when(F.col("n") > MOST_EDITED, TOO_MANY).when(F.col("twice").isNotNull(), F.concat(F.lit('Two codes are both called "'), "twice", F.lit('".')))
    problems = asked.select("doc", reason.alias("reason")).where("reason IS NOT NULL")
    return filled.drop("edit_key").join(problems.select("doc"), "doc", "left_anti"), problems


@dataclass
class Reapplied:
    """codebooks, codes and assignments with the new versions; codes left to apply (doc, code_id); problems (doc, reason)."""

    codebooks: DataFrame
    codes: DataFrame
    assignments: DataFrame
    open: DataFrame
    problems: DataFrame


def _same(a: str, b: str) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def reapply_codebook(codebooks: DataFrame, codes: DataFrame, assignments: DataFrame, edits: DataFrame, new: DataFrame) -> Reapplied:
    """Edited codebooks as new versions: ``edits`` (doc, place, code_id, name, definition) and ``new`` (doc, codebook_id, run_id) of the books to make.

    A code that was edited from one in force and kept its name, case and blanks
    aside, keeps its reproduction counts and its turns; renamed and new codes
    have neither and are left to apply.  Marks of researchers' codes are carried
    by name.  Documents with problems stay as they are.
    """
    fine, problems = check_edits(edits)
    made = new.join(fine.select("doc").distinct(), "doc", "left_semi").withColumn("source", F.lit("edited"))
    books = cut(insert_codebooks(codebooks, made))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("place")) - 1
    force = codebooks_in_force(codebooks).select("codebook_id", "doc")
    before = codes.join(force, "codebook_id").select("doc", F.col("code_id").alias("old_id"), F.col("name").alias("old_name"), F.col("reproduced_runs").alias("old_runs"), F.col("total_runs").alias("old_total"))
    placed = fine.withColumn("position", place.cast("int")).join(made.select("doc", "codebook_id"), "doc")
    both = placed.withColumnRenamed("code_id", "old_id").join(before, ["doc", "old_id"], "left").withColumn("keeps", F.coalesce(_same("name", "old_name"), F.lit(False)))
    rows = cut(both.select("doc", "codebook_id", (F.col("codebook_id") * ID_STEP + F.col("position")).alias("code_id"), "position", "name", "definition", "keeps", F.when(F.col("keeps"), F.col("old_id")).alias("old_id"), F.when(F.col("keeps"), F.col("old_runs")).alias("reproduced_runs"), F.when(F.col("keeps"), F.col("old_total")).alias("total_runs")))
    own = rows.withColumn("added_by_researcher", F.lit(False)).select(*[c for c in codes.columns if c in (*rows.columns, "added_by_researcher")])
    carried = carry_flags(codes.unionByName(own, allowMissingColumns=True), books)
    kept = assignments.join(rows.where("keeps").select(F.col("old_id").alias("code_id"), F.col("code_id").alias("new_id")), "code_id").select("segment_id", F.col("new_id").alias("code_id"))
    return Reapplied(books, carried, assignments.unionByName(kept), rows.where("NOT keeps").select("doc", "code_id"), problems)
