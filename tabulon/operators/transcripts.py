"""Transcripts: speaker turns from text, by windows over lines, and pages, batches and summaries of turns.

A transcript is exploded into lines.  Windows over a document's lines count
its labels and headings, choose how it is read, and number the turns; lines
are then gathered by turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tabulon.functions.exprs import normalize_text

#: Line patterns of transcripts, by what they mark.
LABEL_LINE = r"^\s*(?:[\[(]?\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?[\])]?\s*)?([A-Za-z][A-Za-z0-9 .'_-]{0,39}?)\s*:\s+(\S.*)$"
MODERATOR = r"(?i)^(moderator|interviewer|facilitator|researcher|host|mod|int|m|q)\b"
RESPONDENT_LABEL = r"(?i)^(r|resp|respondent|interviewee)$"
RESPONDENT_HEADING = r"(?i)^(Interview(?:ee)?|Respondent|Participant|Case)\s*#?(\d{1,3})\b(?:\s+(?:transcript|notes?|summary))?\s*$"
PROFILE_HEADING = r"(?i)^(demographics|respondent profile|participant profile|profile|background)$"
PROFILE_FIELD = r"^[-•*–]?\s*([A-Za-z][A-Za-z0-9 /&'()-]{0,40}?)\s*:\s*(\S.{0,120})$"
SESSION_KEYWORD = r"(?i)^(focus group|group|session|interview)\s*#?(\d{1,3})\s*(?:[:.–-]\s*(\S.*))?$"
SESSION_ID = r"^([A-Z]{1,3}\d{1,3})\s*:\s*(\S.*)$"
NOT_SPEAKER = r"(?i)^(format|setting|setting assumed|note|notes|source|date|title|duration|location|venue|topic|agenda|summary|context|common discussion route|synthetic transcript|synthetic data)$"
TIME_BLOCK = r"^\[\d{1,2}:\d{2}(?::\d{2})?\s*[–-]\s*\d{1,2}:\d{2}(?::\d{2})?\]"
#: Longest turn, limits of a coding batch, characters of the question that goes with a turn, cost of an item.
TURN_MOST, BATCH_CHARS, BATCH_ITEMS, CONTEXT_CHARS, ITEM_COST = 1200, 14000, 60, 240, 20
#: How a transcript can be read, and the share of words above which one respondent dominates.
MODES = ("auto", "labels", "headings", "sessions", "paragraphs", "none")
DOMINANT = 0.7


@dataclass
class Reading:
    """segments (doc, idx, speaker, role, text), modes (doc, mode, notes), profiles (doc, speaker, field, value)."""

    segments: DataFrame
    modes: DataFrame
    profiles: DataFrame


def split_long(text: str, most: int = TURN_MOST) -> list[str]:
    """Pieces of at most ``most`` characters: sentences packed in order, a longer one cut at a blank in its second half or hard."""
    if len(text) <= most:
        return [text]
    packed: list[str] = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if packed and packed[-1] and len(packed[-1]) + 1 + len(sentence) <= most:
            packed[-1] += " " + sentence
        else:
            packed.append(sentence)
    out = []
    for part in packed:
        while len(part) > most:
            blank = part.rfind(" ", 0, most + 1)
            at = blank if blank > most / 2 else most
            out.append(part[:at].strip())
            part = part[at:].strip()
        out.append(part)
    return [p for p in out if p]


@F.pandas_udf(ArrayType(StringType()))
def _pieces(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [p.strip() for p in split_long(t or "") if p.strip()])


def _part(x: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank, with the label, heading and session marks of each and what its document holds of them."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    lines = docs.select("doc", F.posexplode(F.split(plain, "\n", -1)).alias("pos", "line")).withColumn("t", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("t <> ''")
    label = F.trim(_part(F.col("line"), LABEL_LINE, 1))
    own = lines.select("*", label.alias("label"), F.trim(_part(F.col("line"), LABEL_LINE, 2)).alias("rest")).withColumn("key", F.lower("label"))
    whole, same = Window.partitionBy("doc"), Window.partitionBy("doc", "key")
    counted = own.withColumn("n_label", F.when(F.col("key").isNotNull(), F.count("key").over(same)))
    keyword = F.col("t").rlike(SESSION_KEYWORD)
    word = F.lower(_part(F.col("t"), SESSION_KEYWORD, 1))
    # An id opens a session only where it labels one line of the whole document.
    once = _part(F.col("t"), SESSION_ID, 1)
    opens = once.isNotNull() & F.coalesce((F.col("n_label") == 1) & (F.col("key") == F.lower(once)), F.lit(False))
    session = F.when(keyword, F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 40), F.lit(" "), _part(F.col("t"), SESSION_KEYWORD, 2).cast("int").cast("string"))).when(opens, once)
    title = F.when(keyword, F.trim(_part(F.col("t"), SESSION_KEYWORD, 3))).when(opens, F.trim(_part(F.col("t"), SESSION_ID, 2)))
    marked = counted.select(
        "*",
        F.when(F.col("t").rlike(RESPONDENT_HEADING), F.concat(_part(F.col("t"), RESPONDENT_HEADING, 1), F.lit(" "), _part(F.col("t"), RESPONDENT_HEADING, 2))).alias("heading"),
        session.alias("session_head"),
        title.alias("session_title"),
        (F.col("t").rlike(TIME_BLOCK) | F.coalesce(F.col("label").isNotNull() & (F.col("label").rlike(NOT_SPEAKER) | keyword), F.lit(False))).alias("header_like"),
    )
    return marked.select(
        "*",
        F.count("heading").over(whole).alias("headings"),
        F.count("session_head").over(whole).alias("sessions"),
        F.count("label").over(whole).alias("labels"),
        F.count_if(F.col("n_label") >= 2).over(whole).alias("labelled"),
        (F.coalesce(F.max(F.col("key") == "i").over(whole), F.lit(False)) & F.coalesce(F.max(F.col("key").rlike(RESPONDENT_LABEL)).over(whole), F.lit(False))).alias("i_asks"),
    )


#: Notes on a layout that was asked for and isn't there.
NOT_FOUND = {
    "headings": 'No headings such as "Interview 1" were found, so the file was read as plain paragraphs.',
    "sessions": 'No session headings such as "FOCUS GROUP 1: ..." or "U01: ..." were found, so the file was read as plain paragraphs.',
    "labels": 'No "Name:" speaker labels were found, so the file was read as plain paragraphs.',
}


def _mode(requested: str) -> Column:
    if requested == "auto":
        labels = F.col("labelled") >= 3
        return F.when(F.col("headings") >= 2, "headings").when((F.col("sessions") >= 2) & labels, "sessions").when(labels, "labels").otherwise("none")
    if requested in NOT_FOUND:
        return F.when(F.col(requested) == 0, "none").otherwise(requested)
    return F.lit(requested)


def _moderates(label: Column, moderators: list[str]) -> Column:
    key = F.lower(F.trim(label))
    return F.coalesce(key.isin([m.strip().lower() for m in moderators if m.strip()] or ["\n"]) | F.trim(label).rlike(MODERATOR) | (F.col("i_asks") & (key == "i")), F.lit(False))


def _name_like() -> Column:
    """Three words at most, each beginning with a capital or a digit."""
    words = F.split("label", r"\s+")
    return (F.size(words) <= 3) & F.forall(words, lambda w: w.rlike("^[A-Z0-9]"))


def _gathered(lines: DataFrame, keys: list[str], piece: Column) -> DataFrame:
    """Text of each turn, its pieces joined by blanks in line order."""
    rows = lines.groupBy(*keys).agg(F.min("pos").alias("at"), F.sort_array(F.collect_list(F.struct("pos", piece.alias("p")))).alias("l"))
    return rows.withColumn("text", F.trim(F.array_join(F.filter(F.transform("l", lambda x: x["p"]), lambda p: p != ""), " "))).drop("l")


def read_transcripts(docs: DataFrame, mode: str = "auto", moderators: list[str] = ()) -> Reading:
    """Turns, layout and profiles of transcripts (doc, text).

    Layouts: ``headings`` (a respondent under each heading), ``sessions``
    (labels repeat in each session, so participants are keyed by it), ``labels``
    ("Name: ..." lines), ``paragraphs`` (each a respondent) and ``none``
    (paragraphs without speakers).  ``auto`` takes the first that fits.  Long
    turns are split.  Null and empty texts have no turns.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    moderators = list(moderators)
    lines = _lines(docs).withColumn("mode", _mode(mode))
    by_doc = Window.partitionBy("doc").orderBy("pos")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = F.coalesce(F.col("n_label") >= 2, F.lit(False))
    named = F.col("label").isNotNull() & (_name_like() if mode == "labels" else (valid | _name_like()))

    # headings: lines below a heading, profile fields lifted out
    under = lines.where("mode = 'headings'").withColumn("speaker", F.last("heading", ignorenulls=True).over(so_far)).withColumn("turn", F.count("heading").over(so_far)).where("turn > 0 AND heading IS NULL")
    opens = F.regexp_replace("t", r"^[-•*–]\s*", "").rlike(PROFILE_HEADING)
    in_turn = Window.partitionBy("doc", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = under.withColumn("opens", opens).withColumn("block", F.count_if("opens").over(in_turn))
    in_block = Window.partitionBy("doc", "turn", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_field = F.col("t").rlike(PROFILE_FIELD)
    read = block.withColumn("field", (F.col("block") > 0) & ~F.col("opens") & (F.count_if(~F.col("opens") & ~is_field).over(in_block) == 0))
    spoken = _gathered(read.where("NOT opens AND NOT field"), ["doc", "turn", "speaker"], F.col("t")).select("doc", "at", "speaker", F.lit("participant").alias("role"), "text")
    profile = read.where("field").select("doc", "speaker", F.trim(_part(F.col("t"), PROFILE_FIELD, 1)).alias("field"), F.struct("pos", F.trim(_part(F.col("t"), PROFILE_FIELD, 2)).alias("v")).alias("value"))

    # sessions: the labels of each session
    inside = lines.where("mode = 'sessions'").withColumn("session", F.last("session_head", ignorenulls=True).over(so_far)).withColumn("instance", F.count("session_head").over(so_far))
    inside = inside.where("session IS NOT NULL").withColumn("starts", named & ~F.col("header_like") & F.col("session_head").isNull())
    resets = F.col("session_head").isNotNull() | (F.col("header_like") & F.col("session_head").isNull())
    inside = inside.withColumn("event", F.count_if(F.col("starts") | resets).over(so_far)).withColumn("moderates", _moderates(F.col("label"), moderators))
    head = Window.partitionBy("doc", "event")
    turned = inside.withColumn("opened", F.max("starts").over(head)).where("opened").withColumn("raw", F.max(F.when(F.col("starts"), F.col("label"))).over(head)).withColumn("asks", F.max(F.when(F.col("starts"), F.col("moderates"))).over(head))
    talks = _gathered(turned, ["doc", "session", "event", "raw", "asks"], F.when(F.col("starts"), F.col("rest")).otherwise(F.col("t")))
    people = talks.where("NOT asks").groupBy("doc", "session").agg(F.count_distinct("raw").alias("people"))
    keyed = talks.join(people, ["doc", "session"], "left").withColumn("speaker", F.when(F.col("asks"), F.col("raw")).when(F.col("people") == 1, F.col("session")).otherwise(F.concat("raw", F.lit(" ("), "session", F.lit(")"))))
    in_sessions = keyed.select("doc", "at", "speaker", F.when(F.col("asks"), "moderator").otherwise("participant").alias("role"), "text")
    titles = inside.where("session_title IS NOT NULL").groupBy("doc", "session").agg(F.max_by("session_title", "pos").alias("title"))
    bars = inside.withColumn("opened", F.max("starts").over(head)).where(~F.col("opened") & ~resets & F.contains("t", F.lit(" | ")))
    bars = bars.groupBy("doc", "session", "instance").agg(F.min(F.struct("pos", "t")).alias("b")).groupBy("doc", "session").agg(F.max("b").alias("b")).select("doc", "session", "b.t")
    first = keyed.where("NOT asks").groupBy("doc", "speaker").agg(F.min_by("session", "at").alias("session"), F.min_by("people", "at").alias("people")).join(titles, ["doc", "session"], "left").join(bars, ["doc", "session"], "left")
    about = F.array(*[F.struct(F.lit(n).alias("field"), F.struct(F.lit(0).alias("pos"), v.alias("v")).alias("value")) for n, v in (("Session", F.col("session")), ("Session title", F.col("title")), ("Profile", F.when(F.col("people") == 1, F.col("t"))))])
    profile = profile.unionByName(first.select("doc", "speaker", F.explode(about).alias("a")).select("doc", "speaker", "a.*").where("value.v IS NOT NULL"))

    # labels: a turn for each label, and one without a speaker for what follows a header line
    flat = lines.where("mode = 'labels'").withColumn("starts", named & ~F.col("header_like"))
    flat = flat.withColumn("event", F.count_if(F.col("starts") | F.col("header_like")).over(so_far)).withColumn("before", F.count_if("starts").over(so_far)).where("before > 0 AND NOT header_like")
    flat = flat.withColumn("raw", F.max(F.when(F.col("starts"), F.col("label"))).over(head)).withColumn("asks", _moderates(F.col("raw"), moderators))
    under_labels = _gathered(flat, ["doc", "event", "raw", "asks"], F.when(F.col("starts"), F.col("rest")).otherwise(F.col("t")))
    under_labels = under_labels.select("doc", "at", F.col("raw").alias("speaker"), F.when(F.col("raw").isNull(), "unknown").when(F.col("asks"), "moderator").otherwise("participant").alias("role"), "text")

    # paragraphs, with or without numbered respondents
    chosen = docs.select("doc", "text").join(lines.select("doc", "mode").distinct(), "doc", "left").where(F.coalesce("mode", F.lit("none")).isin("none", "paragraphs"))
    cut = F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), r"\n\s*\n", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    blocks = chosen.select("doc", "mode", F.posexplode(F.filter(cut, lambda p: p != "")).alias("at", "text"))
    numbered = F.when(F.col("mode") == "paragraphs", F.concat(F.lit("Respondent "), (F.col("at") + 1).cast("string")))
    plain = blocks.select("doc", "at", numbered.alias("speaker"), F.when(F.col("mode") == "paragraphs", "participant").otherwise("unknown").alias("role"), "text")

    turns = spoken.unionByName(in_sessions).unionByName(under_labels).unionByName(plain)
    pieces = turns.select("doc", "at", "speaker", "role", F.posexplode(_pieces("text")).alias("piece", "text"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("at", "piece")) - 1
    segments = pieces.select("doc", place.alias("idx"), "speaker", "role", "text")

    first_start = F.min(F.when((F.col("mode") == "labels") & named & ~F.col("header_like"), F.col("pos")).when((F.col("mode") == "sessions") & F.col("session_head").isNotNull(), F.col("pos"))).over(Window.partitionBy("doc"))
    lead = lines.withColumn("first_start", first_start).groupBy("doc", "mode").agg(F.count_if((F.col("pos") < F.col("first_start")) & ~(F.col("header_like") & (F.col("mode") == "labels"))).alias("lead"))
    many = F.concat(F.col("lead").cast("string"), F.lit(" line"), F.when(F.col("lead") == 1, "").otherwise("s"))
    notes = F.array(
        F.when(F.lit(mode in NOT_FOUND) & (F.col("mode") == "none"), F.lit(NOT_FOUND.get(mode))),
        F.when((F.col("lead") > 0) & (F.col("mode") == "sessions"), F.concat(many, F.lit(" before the first session heading (an index, guide or introduction) were not coded.")))
        .when((F.col("lead") > 0) & (F.col("mode") == "labels"), F.concat(many, F.lit(" before the first speaker label (a title or introduction) were not coded."))),
    )
    known = lead.select("doc", "mode", F.filter(notes, lambda n: n.isNotNull()).alias("notes"))
    modes = docs.select("doc").join(known, "doc", "left").select("doc", F.coalesce("mode", F.lit("none")).alias("mode"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))
    return Reading(segments, modes, profile.groupBy("doc", "speaker", "field").agg(F.max_by("value.v", "value.pos").alias("value")))


def summarize_reading(reading: Reading) -> DataFrame:
    """(doc, mode, respondents, participant_turns, moderator_turns, unlabelled_turns, warnings); respondents is null without speakers."""
    s = reading.segments
    chars = s.where("role <> 'moderator' AND speaker IS NOT NULL").groupBy("doc", "speaker").agg(F.sum(F.length("text")).alias("chars"))
    chars = chars.groupBy("doc").agg(F.count(F.lit(1)).alias("respondents"), F.max("chars").alias("top"), F.sum("chars").alias("chars"))
    turns = s.groupBy("doc").agg(F.count_if(F.col("role") != "moderator").alias("participant_turns"), F.count_if(F.col("role") == "moderator").alias("moderator_turns"), F.count_if((F.col("role") != "moderator") & F.col("speaker").isNull()).alias("unlabelled_turns"))
    all_ = reading.modes.join(turns, "doc", "left").join(chars, "doc", "left").na.fill(0, ["participant_turns", "moderator_turns", "unlabelled_turns"])
    n = F.col("unlabelled_turns")
    #: The warnings' wording.
    warnings = F.array(
        F.when(F.col("respondents").isNull(), "No speakers were detected, so respondents cannot be counted and every theme will show as coming from an unknown speaker.")
        .when(n > 0, F.concat(n.cast("string"), F.lit(" participant turn"), F.when(n == 1, " has").otherwise("s have"), F.lit(" no speaker, usually text before the first label."))),
        F.when((F.col("moderator_turns") == 0) & F.col("mode").isin("labels", "none"), "No moderator or interviewer turns were found. If the file contains interviewer questions, they are being coded as participant speech."),
        F.when(F.col("respondents") == 1, "Only one respondent was found. Counts across people will not mean much."),
        F.when((F.col("respondents") >= 3) & (F.col("top") > DOMINANT * F.col("chars")), "One respondent supplies more than 70% of the participant text, so themes may mostly reflect that person."),
    )
    return all_.select("doc", "mode", "respondents", "participant_turns", "moderator_turns", "unlabelled_turns", F.concat("notes", F.filter(warnings, lambda w: w.isNotNull())).alias("warnings"))


def session_of_speaker(speaker: Column) -> Column:
    """The session in brackets behind a speaker's label, else null."""
    return F.trim(_part(speaker, r"\(([^()]+)\)\s*$", 1))


def suggest_setup(docs: DataFrame) -> DataFrame:
    """(doc, session_type, mode, reason) from file name and text of (doc, filename, text); documents that tell nothing give no row."""
    name = F.lower(F.coalesce("filename", F.lit("")))
    by_name = F.when(name.rlike(r"focus[\s_-]*group"), "focus_group").when(name.contains("interview"), "individual")
    long = docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 50)
    reading = read_transcripts(long.select("doc", "text"))
    people = reading.segments.where("role <> 'moderator'").groupBy("doc").agg((F.count_distinct("speaker") + F.max(F.col("speaker").isNull().cast("int"))).alias("n"))
    seen = reading.modes.join(people, "doc", "left").select("doc", "mode", F.coalesce("n", F.lit(0)).alias("n"))
    both = docs.select("doc", by_name.alias("by_name"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?im)^\s*focus group\s*#?\d+")).alias("groups")).join(seen, "doc", "left")
    groups = F.col("groups")
    kind = F.when(F.col("mode").isNotNull() & ((groups > 0) | (F.col("by_name") == "focus_group")), "focus_group").otherwise(F.coalesce("by_name", F.lit("individual")))
    #: The reasons' wording.
    read = F.concat(F.col("n").cast("string"), F.lit(" speaker"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" found"), F.when(groups > 0, F.concat(F.lit(", "), groups.cast("string"), F.lit(" focus group heading"), F.when(groups == 1, "").otherwise("s"))).otherwise(""), F.lit(', layout read as "'), "mode", F.lit('"'))
    named = F.concat(F.lit("the file name mentions "), F.when(F.col("by_name") == "focus_group", "a focus group").otherwise("interviews"))
    told = both.where("mode IS NOT NULL OR by_name IS NOT NULL")
    return told.select("doc", kind.alias("session_type"), F.coalesce("mode", F.lit("auto")).alias("mode"), F.when(F.col("mode").isNotNull(), read).otherwise(named).alias("reason"))


def with_context(turns: DataFrame) -> DataFrame:
    """Participants' turns with ``context``, the first characters of the moderator's turn right before, used once."""
    w = Window.partitionBy("doc").orderBy("idx")
    asked = F.when(F.lag("role").over(w) == "moderator", F.left(F.lag("text").over(w), F.lit(CONTEXT_CHARS)))
    return turns.withColumn("context", asked).where("role <> 'moderator'")


def coding_batches(turns: DataFrame, chars: int = BATCH_CHARS, items: int = BATCH_ITEMS) -> DataFrame:
    """(doc, idx, batch) of participants' turns: packed in order by the cost of text and question and by number.

    Each task folds over its sorted rows, one at a time, so no document is held whole.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, batch, used, n = None, 0, 0, 0
        for f in frames:
            out = []
            for d, i, cost in zip(f["doc"], f["idx"], f["cost"], strict=True):
                if d != doc:
                    doc, batch, used, n = d, 0, 0, 0
                elif used + cost > chars or n >= items:
                    batch, used, n = batch + 1, 0, 0
                used, n = used + cost, n + 1
                out.append((d, i, batch))
            yield pd.DataFrame(out, columns=["doc", "idx", "batch"])

    cost = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("context"), F.lit(0)) + ITEM_COST
    lined = with_context(turns).select("doc", "idx", cost.alias("cost")).repartition("doc").sortWithinPartitions("doc", "idx")
    return lined.mapInPandas(work, "doc long, idx long, batch int")


def open_excerpt(turns: DataFrame, most: int = 60_000) -> DataFrame:
    """(doc, turns, chars, truncated): whole turns from the start, "speaker: text" each, while they fit; fixed value: 60,000 characters."""
    line = F.length("text") + F.coalesce(F.length("speaker") + 2, F.lit(0)) + 1
    upto = turns.select("doc", F.sum(line).over(Window.partitionBy("doc").orderBy("idx")).alias("upto"))
    fits = F.col("upto") <= most
    return upto.groupBy("doc").agg(F.count_if(fits).alias("turns"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("chars"), F.max(~fits).alias("truncated"))


def page_of_turn(turns: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, idx, page): first page of the document that holds the turn's first sixty normalised characters (twelve at least)."""
    head = turns.select("doc", "idx", F.left(normalize_text(F.col("text")), F.lit(60)).alias("head")).where(F.length("head") >= 12)
    text = pages.select("doc", "page", normalize_text(F.col("text")).alias("body"))
    return head.join(text, "doc").where(F.expr("instr(body, head) > 0")).groupBy("doc", "idx").agg(F.min("page").alias("page"))
