"""How complete a coded transcript is: saturation in order and shuffled, the quality of its data, early against late, and survey answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import as_number, count_sentences, count_words, fnv1a, is_missing, jround
from tabulon.operators.coding import duplicate_turns, participants, spread

#: Respondents of the simple rule's base and run and its threshold, shuffles and their seed, thin respondents and themes.
BASE, RUN, THRESHOLD, SHUFFLES, SEED, THIN_WORDS, THIN_PEOPLE = 4, 2, 0.05, 200, 20260101, 50, 3
#: Turns of a calibration sample, of each code, and the seed's name.
SAMPLE, PER_CODE, SAMPLE_SEED = 24, 2, "calibration"
#: Share of numbers and least values of a numeric survey column; respondents and early turns of a meaning check.
NUMERIC_SHARE, NUMERIC_LEAST, CHECK_PEOPLE, CHECK_EARLY = 0.9, 3, 6, 3


def speaker_order(turns: DataFrame) -> DataFrame:
    """(doc, speaker, position, people): participants by first speech, from 1."""
    first = participants(turns).where("speaker IS NOT NULL").groupBy("doc", "speaker").agg(F.min("idx").alias("first"))
    return first.select("doc", "speaker", F.row_number().over(Window.partitionBy("doc").orderBy("first")).alias("position"), F.count(F.lit(1)).over(Window.partitionBy("doc")).alias("people"))


def voiced(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, speaker, code) of participants, once each."""
    return codes.select("doc", "idx", "code").join(participants(turns).where("speaker IS NOT NULL"), ["doc", "idx"]).select("doc", "speaker", "code").distinct()


def saturation_curve(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, position, new_codes, cumulative): codes first met with each respondent, in order of first speech."""
    order = speaker_order(turns)
    first = voiced(turns, codes).join(order, ["doc", "speaker"]).groupBy("doc", "code").agg(F.min("position").alias("position"))
    new = first.groupBy("doc", "position").agg(F.count(F.lit(1)).alias("new_codes"))
    curve = order.join(new, ["doc", "position"], "left").na.fill(0, ["new_codes"])
    return curve.select("doc", "position", "new_codes", F.sum("new_codes").over(Window.partitionBy("doc").orderBy("position")).alias("cumulative"))


def simple_saturation(curve: DataFrame) -> DataFrame:
    """(doc, base_codes, new_in_run, ratio, saturated): new codes of the two respondents behind the first four; documents with fewer than six don't appear."""
    at = {n: F.max(F.when(F.col("position") == n, F.col("cumulative"))) for n in (BASE, BASE + RUN)}
    g = curve.groupBy("doc").agg(F.count(F.lit(1)).alias("people"), at[BASE].alias("base_codes"), at[BASE + RUN].alias("upto")).where(F.col("people") >= BASE + RUN)
    new = F.col("upto") - F.col("base_codes")
    ratio = F.when(F.col("base_codes") > 0, new / F.col("base_codes"))
    return g.select("doc", "base_codes", new.alias("new_in_run"), jround(ratio, 4).alias("ratio"), F.coalesce(ratio <= THRESHOLD, F.lit(False)).alias("saturated"))


def theme_saturation(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, code, participants, first_seen_at, in_first_half, added_in_last_third) of codes that someone voiced."""
    met = voiced(turns, codes).join(speaker_order(turns), ["doc", "speaker"])
    half, third = F.ceil(F.col("people") / 2), F.floor(F.col("people") * 2 / 3)
    return met.groupBy("doc", "code").agg(F.count(F.lit(1)).alias("participants"), F.min("position").alias("first_seen_at"), F.count_if(F.col("position") <= half).alias("in_first_half"), F.count_if(F.col("position") > third).alias("added_in_last_third"))


def uniform_stream(seed: int) -> Iterator[float]:
    """The 32-bit generator mulberry32, whose numbers must equal others' for the same seed."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ state >> 15) * (state | 1)) & mask
        t ^= (t + ((t ^ t >> 7) * (t | 61) & mask)) & mask
        yield ((t ^ t >> 14) & mask) / 2**32


def shuffled_saturation(turns: DataFrame, codes: DataFrame, shuffles: int = SHUFFLES, seed: int = SEED) -> DataFrame:
    """(doc, position, low, median, high): 10th, 50th and 90th percentile of the codes met, over seeded shuffles of the respondents.

    One respondent list with its code sets is a row; shuffles run inside the
    task that has it.  Documents with fewer than three respondents or without
    codes don't appear.
    """
    sets = voiced(turns, codes).groupBy("doc", "speaker").agg(F.collect_list("code").alias("codes"))
    lined = speaker_order(turns).join(sets, ["doc", "speaker"], "left").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("codes", F.array().cast("array<string>")).alias("codes")))).alias("people"))
    fit = lined.where((F.size("people") >= 3) & F.exists("people", lambda p: F.size(p["codes"]) > 0)).select("doc", F.transform("people", lambda p: p["codes"]).alias("sets"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, sets in zip(f["doc"], f["sets"], strict=True):
                people, draws, curves = [frozenset(s) for s in sets], uniform_stream(seed), []
                for _ in range(shuffles):
                    order = list(range(len(people)))
                    for i in range(len(order) - 1, 0, -1):
                        j = int(next(draws) * (i + 1))
                        order[i], order[j] = order[j], order[i]
                    seen: set[str] = set()
                    curves.append([len(seen := seen | people[k]) for k in order])
                q = pd.DataFrame(curves).quantile([0.1, 0.5, 0.9])
                rows += [(doc, i + 1, *map(float, q[i])) for i in range(len(people))]
            yield pd.DataFrame(rows, columns=["doc", "position", "low", "median", "high"])

    return fit.mapInPandas(work, "doc long, position int, low double, median double, high double")


def data_quality(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """One row a document: volume, shares, spreads, duplicates, coded share and the notes that they give rise to.

    Spreads are structs (n, min, q1, median, q3, max); shares are null where
    they have no base.  Fixed values: the notes' wording and bounds.
    """
    t = turns.withColumn("words", count_words(F.col("text"))).withColumn("spoken", F.col("role") != "moderator")
    marked = t.join(codes.select("doc", "idx").distinct().withColumn("coded", F.lit(True)), ["doc", "idx"], "left")
    g = marked.groupBy("doc").agg(
        F.count_if("spoken").alias("participant_turns"), F.count_if(~F.col("spoken")).alias("moderator_turns"), F.count_if(F.col("spoken") & F.col("speaker").isNull()).alias("unlabelled_turns"),
        F.sum("words").alias("total_words"), F.coalesce(F.sum(F.when(F.col("spoken"), F.col("words"))), F.lit(0)).alias("participant_words"),
        F.sum(F.when(F.col("spoken"), count_sentences(F.col("text")))).alias("sentences"), F.count_if(F.col("spoken") & F.col("coded")).alias("coded_turns"),
    )
    people = t.where("spoken AND speaker IS NOT NULL").groupBy("doc", "speaker").agg(F.sum("words").alias("words"))
    ranked = people.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("words"))))
    shares = ranked.groupBy("doc").agg(F.count(F.lit(1)).alias("respondents"), F.sum("words").alias("all"), F.sum(F.when(F.col("k") == 1, F.col("words"))).alias("one"), F.sum(F.when(F.col("k") <= 3, F.col("words"))).alias("three"), F.count_if(F.col("words") < THIN_WORDS).alias("thin_respondents"))
    parts = ("n", "min", "q1", "median", "q3", "max")
    by_person = spread(people, "words", ["doc"]).select("doc", F.struct(*parts).alias("words_per_respondent"))
    by_turn = spread(t.where("spoken"), "words", ["doc"]).select("doc", F.struct(*parts).alias("words_per_turn"))
    twice = duplicate_turns(turns).groupBy("doc").agg(F.count(F.lit(1)).alias("duplicate_turns"))
    thin = voiced(turns, codes).groupBy("doc", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.count_if(F.col("n") < THIN_PEOPLE).alias("thin_themes"))
    out = g
    for other in (shares, by_person, by_turn, twice, thin):
        out = out.join(other, "doc", "left")
    out = out.na.fill(0, ["respondents", "thin_respondents", "duplicate_turns", "thin_themes"])
    moderator = F.when(F.col("moderator_turns") > 0, F.try_divide(F.col("total_words") - F.col("participant_words"), F.col("total_words")))
    top = F.try_divide(F.col("one"), F.col("all"))
    n = F.col("respondents")
    notes = F.array(
        F.when(n < 3, "Fewer than 3 labelled respondents, so no saturation curve.").when(n < 8, F.concat(F.lit("Only "), n.cast("string"), F.lit(" respondents, so the saturation curve is coarse and should be read with care."))),
        F.when(moderator > 0.4, "Moderator talk is over 40% of the words. Check for leading questions, or that moderator turns were separated correctly."),
        F.when((n >= 4) & (top > 0.3), "One speaker supplies over 30% of the participant words, so counts of turns may overstate how widely a theme is held."),
    )
    share = lambda a, b: jround(F.try_divide(F.col(a), F.col(b)), 4)
    return out.select(
        "doc", "respondents", "participant_turns", "moderator_turns", "unlabelled_turns", "total_words", "participant_words", jround(moderator, 4).alias("moderator_word_share"), "words_per_respondent", "words_per_turn",
        share("sentences", "participant_turns").alias("sentences_per_turn"), jround(top, 4).alias("top_speaker_share"), share("three", "all").alias("top_three_share"), "thin_respondents", "duplicate_turns",
        share("coded_turns", "participant_turns").alias("coded_share"), "thin_themes", F.filter(notes, lambda x: x.isNotNull()).alias("notes"),
    )


def meaning_split(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, code, early_turns, late_turns, verdict): coded turns of respondents before and in the last third.

    Needs six respondents; ``too_few_turns`` where fewer than three turns are
    early or none is late, else ``ready`` for a judgement.
    """
    order = speaker_order(turns).where(F.col("people") >= CHECK_PEOPLE)
    late = order.where(F.col("position") > F.floor(F.col("people") * 2 / 3)).select("doc", "speaker", F.lit(True).alias("late"))
    coded = codes.select("doc", "idx", "code").distinct().join(participants(turns), ["doc", "idx"]).join(order.select("doc").distinct(), "doc", "left_semi").join(late, ["doc", "speaker"], "left")
    g = coded.groupBy("doc", "code").agg(F.count_if(F.col("late").isNull()).alias("early_turns"), F.count("late").alias("late_turns"))
    return g.withColumn("verdict", F.when((F.col("early_turns") < CHECK_EARLY) | (F.col("late_turns") == 0), "too_few_turns").otherwise("ready"))


def calibration_sample(turns: DataFrame, codes: DataFrame, size: int = SAMPLE, seed: str = SAMPLE_SEED, per_code: int = PER_CODE) -> DataFrame:
    """(doc, idx) of the turns that a researcher is asked to code blind, chosen in each document from participants' turns (doc, id, idx, role).

    Turns are ranked by a seeded hash of the id.  Codes in order take two turns
    each that aren't taken yet, then turns without a code fill a third, then the
    rest up to ``size``.  A code's choice hangs on those before it, so each
    document's candidates, the first few of every code and of the rest, go
    through one short fold.
    """
    pool = participants(turns).select("doc", "id", "idx", fnv1a(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("rank"))
    mine = pool.join(codes.select("doc", "idx", "code").distinct(), ["doc", "idx"], "left")
    place = F.row_number().over(Window.partitionBy("doc", "code").orderBy("rank", "idx"))
    spare = F.row_number().over(Window.partitionBy("doc").orderBy("rank", "idx"))
    # No choice looks further than size ranks into its list: fewer than size turns are taken before it.
    listed = mine.withColumn("k", place).where(F.col("k") <= size).select("doc", "idx", "rank", "code", F.lit(False).alias("any"))
    listed = listed.union(pool.withColumn("k", spare).where(F.col("k") <= size).select("doc", "idx", "rank", F.lit(None).cast("string"), F.lit(True)))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "idx"])
        taken: dict[int, None] = {}

        def take(rows: pd.DataFrame, most: int) -> None:
            for i in rows["idx"]:
                if most <= 0 or len(taken) >= size:
                    return
                if i not in taken:
                    taken[i] = None
                    most -= 1

        coded = frame[~frame["any"]]
        for _, own in coded[coded["code"].notna()].groupby("code", sort=True):
            take(own, per_code)
        take(coded[coded["code"].isna()], max(2, size // 3))
        take(frame[frame["any"]], size)
        return pd.DataFrame({"doc": frame["doc"].iloc[0], "idx": sorted(taken)})

    return listed.groupBy("doc").applyInPandas(work, "doc long, idx long")


def numeric_variables(cells: DataFrame) -> DataFrame:
    """(variable, median, values) of long survey cells (row, variable, value) that are numbers in nine of ten cases, three at least."""
    present = cells.where(~is_missing(F.col("value"))).withColumn("number", as_number(F.col("value"), percent=True))
    g = present.groupBy("variable").agg(F.count(F.lit(1)).alias("present"), F.count("number").alias("values"))
    fit = g.where((F.col("values") >= NUMERIC_SHARE * F.col("present")) & (F.col("values") >= NUMERIC_LEAST)).select("variable", "values")
    return fit.join(spread(present, "number", ["variable"]).select("variable", "median"), "variable").select("variable", "median", "values")


def case_rows(keys: DataFrame, survey: DataFrame) -> DataFrame:
    """(doc, speaker, row, matches): first survey row (row, key) with a respondent's case key, case and blanks aside; blank keys meet none."""
    own = keys.withColumn("k", F.lower(F.trim("case_key"))).where("k <> ''")
    rows = survey.select("row", F.lower(F.trim(F.coalesce(F.col("key").cast("string"), F.lit("")))).alias("k")).groupBy("k").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("matches"))
    return keys.select("doc", "speaker").join(own.join(rows, "k").select("doc", "speaker", "row", "matches"), ["doc", "speaker"], "left").na.fill(0, ["matches"])


def dissonance(voices: DataFrame, keys: DataFrame, cells: DataFrame, case_column: str, links: DataFrame) -> DataFrame:
    """Voices (doc, speaker, code) against linked survey answers: one row each with value, median, state.

    ``links`` holds code, variable and direction (higher or lower); variables
    that aren't numeric are left out.  State: ``dissonant`` on the wrong side of
    the median, ``unmatched`` without a row or number, else ``consistent``.
    """
    survey = cells.where(F.col("variable") == case_column).select("row", F.col("value").alias("key"))
    found = case_rows(keys, survey).select("doc", "speaker", "row")
    usable = links.join(numeric_variables(cells).select("variable", "median"), "variable")
    asked = voices.join(F.broadcast(usable), "code").join(found, ["doc", "speaker"], "left")
    answers = cells.select("row", "variable", F.when(~is_missing(F.col("value")), as_number(F.col("value"), percent=True)).alias("answer")).groupBy("row", "variable").agg(F.first("answer").alias("answer"))
    both = asked.join(answers, ["row", "variable"], "left")
    wrong = ((F.col("direction") == "higher") & (F.col("answer") < F.col("median"))) | ((F.col("direction") == "lower") & (F.col("answer") > F.col("median")))
    state = F.when(F.col("answer").isNull(), "unmatched").when(wrong, "dissonant").otherwise("consistent")
    return both.select("doc", "speaker", "code", "variable", "direction", F.col("answer").alias("value"), "median", state.alias("state"))

