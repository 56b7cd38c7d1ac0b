"""The analysis of coded transcripts in one piece: a row of nested results for each document.

Turns and their codes are laid in one table and dealt by document once.  Each
turn becomes a row for itself, one for each of its codes and themes and one for
each keyword it holds; windows over a unit mark episodes and echoes, one sum by
unit and speaker follows, and two grouping sets of it (units, people) give all
measures.  So every table is read once, and nothing but sums leaves a document's
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import count_sentences, count_words, echo_words, keyword_count, split_keywords
from tabulon.operators.coding import ECHO_LIKENESS, ECHO_REACH, ECHO_WORDS, EPISODE_GAP

#: Fixed value: the name of a transcript without speakers.
WHOLE = "Whole transcript"


def _units(turns: DataFrame, assigned: DataFrame, book: DataFrame) -> DataFrame:
    """(doc, kind, unit, idx, speaker, role, n, ...) of turns, and of participants' codes, themes and keywords."""
    said = turns.select("doc", "idx", F.struct("speaker", "role", F.coalesce("text", F.lit("")).alias("text")).alias("turn"), F.lit(None).cast("string").alias("code"))
    laid = said.unionByName(assigned.select("doc", "idx", F.lit(None).cast(said.schema["turn"].dataType).alias("turn"), F.col("code").cast("string").alias("code")))
    base = laid.repartition("doc").groupBy("doc", "idx").agg(F.max("turn").alias("turn"), F.collect_set("code").alias("held")).where("turn IS NOT NULL")
    known = book.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("code", F.coalesce("theme", F.lit("")).alias("theme")))).alias("themes"), F.array_distinct(F.flatten(F.collect_list(split_keywords(F.coalesce("keywords", F.lit("")))))).alias("terms"))
    both = base.join(known, "doc").select("doc", "idx", "turn.*", F.filter("held", lambda c: F.map_contains_key("themes", c)).alias("held"), "themes", "terms")
    unit = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("unit"), n.cast("long").alias("n"))
    own = F.array_distinct(F.filter(F.transform("held", lambda c: F.element_at("themes", c)), lambda t: t != ""))
    coded = F.concat(
        F.transform("held", lambda c: unit("code", c, F.lit(1))),
        F.transform(own, lambda t: unit("theme", t, F.lit(1))),
        F.filter(F.transform("terms", lambda t: unit("keyword", t, keyword_count(F.col("text"), t))), lambda u: u["n"] > 0),
    )
    every = F.array(unit("turn", F.lit(""), F.lit(1)))
    units = F.when(F.col("role") == "moderator", every).otherwise(F.concat(every, coded))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    measured = both.select("doc", "idx", "speaker", "role", count_words(F.col("text")).alias("words"), count_sentences(F.col("text")).alias("sentences"), F.size(words).alias("parts"), echo_words(F.col("text")).alias("bag"), units.alias("units"))
    return measured.select("*", F.explode("units").alias("u")).select("doc", "idx", "speaker", "role", "words", "sentences", "parts", "bag", "u.*")


def _marked(units: DataFrame) -> DataFrame:
    """The units with ``new`` (begins an episode) and ``echo`` (follows another speaker's alike or comes short behind it)."""
    w = Window.partitionBy("doc", "kind", "unit").orderBy("idx")
    before = F.collect_list(F.when((F.col("kind") != "turn") & F.col("speaker").isNotNull(), F.struct("speaker", "bag"))).over(w.rangeBetween(-ECHO_REACH, -1))
    alike = lambda bag: (F.size(bag) > 0) & (F.size("bag") > 0) & (F.size(F.array_intersect(bag, F.col("bag"))) >= ECHO_LIKENESS * F.size(F.array_union(bag, F.col("bag"))))
    echo = F.exists("before", lambda x: (x["speaker"] != F.col("speaker")) & ((F.col("parts") <= ECHO_WORDS) | alike(x["bag"])))
    new = F.coalesce(F.col("idx") - F.lag("idx").over(w) > EPISODE_GAP, F.lit(True))
    return units.withColumn("before", before).withColumn("new", new).withColumn("echo", F.coalesce(F.col("speaker").isNotNull() & echo, F.lit(False)))


def _gathered(summed: DataFrame) -> DataFrame:
    """Measures of each document's units and people, from sums by (doc, kind, unit, speaker, role)."""
    copied = summed.select("*", F.col("kind").alias("of_kind"), F.col("unit").alias("of_unit"), F.col("speaker").alias("of_speaker"))
    turn, code = F.col("of_kind") == "turn", F.col("of_kind") == "code"
    each = copied.groupingSets([["doc", "kind", "unit"], ["doc", "speaker", "role"]], "doc", "kind", "unit", "speaker", "role").agg(
        F.grouping("kind").alias("person"),
        F.sum("turns").alias("turns"),
        F.sum("mentions").alias("mentions"),
        F.count("of_speaker").alias("speakers"),
        F.sum("episodes").alias("episodes"),
        F.sum("echo_turns").alias("echo_turns"),
        F.count_if(F.col("of_speaker").isNotNull() & (F.col("free") > 0)).alias("independent"),
        F.collect_list(F.when(code & F.col("of_speaker").isNotNull(), F.col("of_speaker"))).alias("voices"),
        F.sum(F.when(turn, F.col("turns"))).alias("said"),
        F.sum(F.when(turn, F.col("words"))).alias("words"),
        F.sum(F.when(turn, F.col("sentences"))).alias("sentences"),
        F.min(F.when(turn, F.col("first"))).alias("first"),
        F.sort_array(F.collect_list(F.when(code, F.struct(F.col("of_unit").alias("code"), "turns")))).alias("code_turns"),
    )
    unit = lambda kind: F.col("kind") == kind
    measures = F.struct("turns", "mentions", "speakers", "episodes", "echo_turns", "independent", "voices")
    table = lambda kind: F.map_from_entries(F.collect_list(F.when(unit(kind), F.struct("unit", measures)))).alias(kind)
    person, asks = F.col("person") == 1, F.col("role") == "moderator"
    one = F.struct("first", "speaker", F.col("said").alias("turns"), "words", "sentences", "code_turns")
    return each.groupBy("doc").agg(
        table("code"), table("theme"), table("keyword"),
        F.coalesce(F.sum(F.when(person & ~asks, F.col("said"))), F.lit(0)).alias("participant_turns"),
        F.coalesce(F.sum(F.when(person & asks, F.col("said"))), F.lit(0)).alias("moderator_turns"),
        F.coalesce(F.sum(F.when(person & ~asks & F.col("speaker").isNull(), F.col("said"))), F.lit(0)).alias("unlabelled_turns"),
        F.sort_array(F.collect_list(F.when(person & ~asks, one))).alias("people"),
        F.sort_array(F.collect_list(F.when(person & F.col("speaker").isNotNull(), F.struct("first", "speaker", F.col("said").alias("turns"), asks.alias("moderator"))))).alias("speakers"),
    )


def _measure(table: str, key: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(table, key)[name], F.lit(0).cast("long"))


def analysis_view(turns: DataFrame, assigned: DataFrame, book: DataFrame, focus: DataFrame) -> DataFrame:
    """One row for each document of ``book`` (doc, code, number, theme, keywords), the codebook in force.

    turns are (doc, idx, speaker, role, text), assigned (doc, idx, code), focus
    (doc) the focus groups.  Columns: doc, focus, participant_turns,
    moderator_turns, unlabelled_turns, speakers_total (null without speakers);
    codes (number, code, theme, turns, speakers_with, episodes, echo_turns,
    independent, keywords (term, mentions, turns, speakers)), in order of number,
    also those on no turn; themes (theme, codes, turns, speakers_with, episodes,
    echo_turns, independent), in order of their first code, a turn counting once;
    respondents (label, turns, words, sentences, code_turns), in order of first
    speech; speakers (label, turns, moderator); and curve, the codes first met with each respondent.
    Echoes and independent speakers count in focus groups only; independent is null elsewhere.
    Null texts are empty turns; codes outside the book and codes of moderators'
    turns don't count; documents without turns have zeros.
    """
    summed = _marked(_units(turns, assigned, book)).groupBy("doc", "kind", "unit", "speaker", "role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("n").alias("mentions"), F.count_if("new").alias("episodes"), F.count_if("echo").alias("echo_turns"), F.count_if(~F.col("echo")).alias("free"),
        F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), F.min("idx").alias("first"),
    )
    listed = book.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("number", "code", F.nullif("theme", F.lit("")).alias("theme"), split_keywords(F.coalesce("keywords", F.lit(""))).alias("terms")))).alias("book"))
    groups = focus.select("doc").distinct().withColumn("focus", F.lit(True))
    all_ = listed.join(_gathered(summed), "doc", "left").join(groups, "doc", "left").withColumn("focus", F.coalesce("focus", F.lit(False)))
    none = F.array().cast("array<struct<first:bigint,speaker:string,turns:bigint,words:bigint,sentences:bigint,code_turns:array<struct<code:string,turns:bigint>>>>")
    people = F.filter(F.coalesce("people", none), lambda p: p["turns"].isNotNull())
    named = F.filter(people, lambda p: p["speaker"].isNotNull())
    has = F.size("named") > 0
    ready = all_.withColumn("everyone", people).withColumn("named", named)

    def stats(table: str, key: Column) -> list[Column]:
        m = lambda name: _measure(table, key, name)
        return [
            m("turns").alias("turns"), F.when(has, m("speakers")).alias("speakers_with"), m("episodes").alias("episodes"),
            F.when(F.col("focus"), m("echo_turns")).otherwise(0).alias("echo_turns"), F.when(has & F.col("focus"), m("independent")).alias("independent"),
        ]

    def keyword(term: Column) -> Column:
        return F.struct(term.alias("term"), _measure("keyword", term, "mentions").alias("mentions"), _measure("keyword", term, "turns").alias("turns"), F.when(has, _measure("keyword", term, "speakers")).alias("speakers"))

    codes = F.transform("book", lambda c: F.struct(c["number"].alias("number"), c["code"].alias("code"), c["theme"].alias("theme"), *stats("code", c["code"]), F.transform(c["terms"], keyword).alias("keywords")))
    names = F.array_distinct(F.filter(F.transform("book", lambda c: c["theme"]), lambda t: t.isNotNull()))
    members = lambda t: F.transform(F.filter("book", lambda c: c["theme"] == t), lambda c: c["code"])
    themes = F.transform(names, lambda t: F.struct(t.alias("theme"), members(t).alias("codes"), *stats("theme", t)))
    shown = F.when(has, F.col("named")).otherwise(F.col("everyone"))
    respondents = F.transform(shown, lambda p: F.struct(F.coalesce(p["speaker"], F.lit(WHOLE)).alias("label"), p["turns"].alias("turns"), p["words"].alias("words"), p["sentences"].alias("sentences"), p["code_turns"].alias("code_turns")))
    order = F.transform("named", lambda p: p["speaker"])
    met = F.transform(F.map_values(F.coalesce("code", F.create_map().cast("map<string,struct<turns:bigint,mentions:bigint,speakers:bigint,episodes:bigint,echo_turns:bigint,independent:bigint,voices:array<string>>>"))), lambda m: F.array_min(F.transform(m["voices"], lambda v: F.array_position(order, v))))
    curve = F.transform("named", lambda p, i: F.size(F.filter("met", lambda x: x == i + 1)))
    out = ready.withColumn("met", met)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    lines = F.transform(F.coalesce("speakers", F.array().cast("array<struct<first:bigint,speaker:string,turns:bigint,moderator:boolean>>")), lambda s: F.struct(s["speaker"].alias("label"), s["turns"].alias("turns"), s["moderator"].alias("moderator")))
    return out.select(
        "doc", "focus", count("participant_turns"), count("moderator_turns"), count("unlabelled_turns"), F.when(has, F.size("named")).alias("speakers_total"),
        codes.alias("codes"), themes.alias("themes"), respondents.alias("respondents"), lines.alias("speakers"), curve.alias("curve"),
    )
