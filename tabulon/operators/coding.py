"""Qualitative coding: codes on turns, respondents, episodes, echoes, agreement, cross-tabs and saturation.

Turns are (doc, idx, speaker, role, text); assignments are (doc, idx, code).
Windows run inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import count_sentences, count_words, echo_words, jround, keyword_count

#: Gap that ends an episode, reach and size of an echo, base under which a share is flagged, exemplar lengths, turns of a finding.
EPISODE_GAP, ECHO_REACH, ECHO_WORDS, ECHO_LIKENESS, SMALL_BASE, EXEMPLAR, EXEMPLAR_MOST, FINDING_TURNS = 3, 4, 15, 0.5, 5, 220, 500, 2
#: Bands of kappa by upper bound, and turns and positives below which it is unstable.
KAPPA_BANDS = ((0.2, "Slight"), (0.4, "Fair"), (0.6, "Moderate"), (0.8, "Substantial"))
KAPPA_TURNS, KAPPA_POSITIVES = 20, 3


def participants(turns: DataFrame) -> DataFrame:
    return turns.where("role <> 'moderator'")


def assign_by_keyword(turns: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """(doc, idx, code) of participants' turns that hold the code's keyword as a whole word."""
    hits = F.array(*[F.when(keyword_count(F.col("text"), F.lit(k)) > 0, F.lit(c)) for c, k in keywords.items()])
    return participants(turns).select("doc", "idx", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("code"))


def keyword_counts(turns: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, mentions, turns, speakers) over participants' turns; speakers is null where no turn has a speaker."""
    each = participants(turns).select("doc", "speaker", "text", F.explode(F.array(*map(F.lit, keywords))).alias("keyword")).withColumn("n", keyword_count(F.col("text"), F.col("keyword")))
    who = F.count_distinct(F.when((F.col("n") > 0) & F.col("speaker").isNotNull(), F.struct("doc", "speaker")))
    return each.groupBy("keyword").agg(F.sum("n").cast("long").alias("mentions"), F.count_if(F.col("n") > 0).alias("turns"), F.when(F.count("speaker") > 0, who).alias("speakers"))


def _coded(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """Participants' turns with each of their codes."""
    return codes.select("doc", "idx", "code").distinct().join(participants(turns), ["doc", "idx"])


def episodes(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, code, episodes): runs of coded turns whose positions are at most three apart."""
    w = Window.partitionBy("doc", "code").orderBy("idx")
    new = F.coalesce(F.col("idx") - F.lag("idx").over(w) > EPISODE_GAP, F.lit(True))
    return _coded(turns, codes).withColumn("new", new).groupBy("doc", "code").agg(F.count_if("new").alias("episodes"))


def echoes(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, idx, code): coded turns that follow, within four positions, another speaker's turn of the code and are short or alike."""
    split = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    coded = _coded(turns, codes).where("speaker IS NOT NULL").withColumn("words", echo_words(F.col("text"))).withColumn("n_words", F.size(split))
    w = Window.partitionBy("doc", "code").orderBy("idx").rangeBetween(-ECHO_REACH, -1)
    before = coded.withColumn("before", F.collect_list(F.struct("speaker", "words")).over(w))
    alike = lambda a, b: F.size(F.array_intersect(a, b)) >= ECHO_LIKENESS * F.size(F.array_union(a, b))
    hit = F.exists("before", lambda x: (x["speaker"] != F.col("speaker")) & ((F.col("n_words") <= ECHO_WORDS) | ((F.size(x["words"]) > 0) & (F.size("words") > 0) & alike(x["words"], F.col("words")))))
    return before.where(hit).select("doc", "idx", "code")


def code_stats(turns: DataFrame, codes: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, code, turns, participant_turns, speakers_with, speakers_total, episodes, echo_turns, independent_speakers) of participants' coded turns.

    ``groups`` holds the doc of each focus group: only there echoes count, and
    independent_speakers are those with a turn that isn't one.  Speaker counts
    are null in documents without labelled participants.
    """
    coded = _coded(turns, codes)
    talk = participants(turns).groupBy("doc").agg(F.count(F.lit(1)).alias("participant_turns"), F.count_distinct("speaker").alias("labelled"))
    echo = echoes(turns, codes).join(groups.select("doc").distinct(), "doc", "left_semi").withColumn("echo", F.lit(1))
    flagged = coded.join(echo, ["doc", "idx", "code"], "left")
    base = flagged.groupBy("doc", "code").agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct("speaker").alias("with"), F.count("echo").alias("echo_turns"), F.count_distinct(F.when(F.col("echo").isNull(), F.col("speaker"))).alias("independent")
    )
    focus = groups.select("doc").distinct().withColumn("focus", F.lit(True))
    out = base.join(talk, "doc").join(episodes(turns, codes), ["doc", "code"]).join(focus, "doc", "left")
    has = F.col("labelled") > 0
    return out.select("doc", "code", "turns", "participant_turns", F.when(has, F.col("with")).alias("speakers_with"), F.when(has, F.col("labelled")).alias("speakers_total"), "episodes", "echo_turns", F.when(has & F.col("focus"), F.col("independent")).alias("independent_speakers"))


def group_coverage(turns: DataFrame, codes: DataFrame, groups: DataFrame) -> DataFrame:
    """(code, groups_with, groups_total): focus groups in which a participant's turn has the code."""
    focus = groups.select("doc").distinct()
    total = focus.agg(F.count(F.lit(1)).alias("groups_total"))
    return _coded(turns, codes).join(focus, "doc", "left_semi").groupBy("code").agg(F.count_distinct("doc").alias("groups_with")).join(F.broadcast(total))


def respondents(turns: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(doc, speaker, label, turns, words, sentences[, code_turns]) of participants.

    A transcript without speakers is one respondent, "Whole transcript"; in
    others, turns without a speaker count for nobody.  ``code_turns`` maps codes
    to turns.
    """
    own = participants(turns).withColumn("labelled", F.max(F.col("speaker").isNotNull()).over(Window.partitionBy("doc"))).where("speaker IS NOT NULL OR NOT labelled")
    own = own.withColumn("speaker", F.coalesce("speaker", F.lit("")))
    label = F.when(F.col("speaker") == "", "Whole transcript").otherwise(F.col("speaker")).alias("label")
    g = own.groupBy("doc", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.sum(count_words(F.col("text"))).alias("words"), F.sum(count_sentences(F.col("text"))).alias("sentences")).select("doc", "speaker", label, "turns", "words", "sentences")
    if codes is None:
        return g
    each = codes.select("doc", "idx", "code").distinct().join(own, ["doc", "idx"]).groupBy("doc", "speaker", "code").agg(F.count(F.lit(1)).alias("n"))
    maps = each.groupBy("doc", "speaker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("code_turns"))
    return g.join(maps, ["doc", "speaker"], "left").withColumn("code_turns", F.coalesce("code_turns", F.create_map().cast("map<string,bigint>")))


def spread(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(n, min, q1, median, q3, max) with linear interpolation, for each group of ``by``.

    Values are counted first and quantiles read off the running counts of the
    distinct ones, so that no buffer holds a group's values.
    """
    keys = list(by or [])
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    counts = v.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    if keys:
        line = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = counts.withColumn("upto", F.sum("c").over(line)).join(whole.select(*keys, "n"), keys)
    else:
        from tabulon.operators.tables import running_sum

        upto = running_sum(counts, "v", {"c": "upto"}).join(F.broadcast(whole.select("n")))
    spots = F.array(*[F.struct(F.lit(q).alias("q"), ((F.col("n") - 1) * q).alias("at")) for q in (0.25, 0.5, 0.75)])
    # A distinct value holds the ranks from upto - c to upto - 1; a quantile lies between two ranks.
    each = upto.select(*keys, "v", "c", "upto", F.explode(spots).alias("s")).select(*keys, "v", "c", "upto", "s.q", F.floor("s.at").alias("lo"), F.ceil("s.at").alias("hi"), (F.col("s.at") - F.floor("s.at")).alias("part"))
    holds = lambda rank: (F.col("upto") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    hit = each.where(holds("lo") | holds("hi")).groupBy(*keys, "q").agg(F.max(F.when(holds("lo"), F.col("v"))).alias("a"), F.max(F.when(holds("hi"), F.col("v"))).alias("b"), F.first("part").alias("part"))
    named = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    both = whole.join(named, keys) if keys else whole.join(F.broadcast(named))
    return both.select(*keys, "n", "min", "q1", "median", "q3", "max")


def duplicate_turns(turns: DataFrame) -> DataFrame:
    """(doc, idx) of participants' turns whose speaker said the same before, case aside; blank turns don't count."""
    w = Window.partitionBy("doc", "speaker", F.lower(F.trim("text"))).orderBy("idx")
    return participants(turns).where(F.trim("text") != "").withColumn("k", F.row_number().over(w)).where("k > 1").select("doc", "idx")


def themes_by_attribute(codes: DataFrame, turns: DataFrame, attributes: DataFrame) -> DataFrame:
    """(code, value, with_code, base, share, turns, small_base, unknown) of respondents by an attribute (doc, speaker, value).

    Blank values are unknown: such respondents count in ``unknown`` and in no
    group.  Every code meets every value; values are few (checked by the sort
    of attributes that ``usable_attributes`` lets through).
    """
    who = participants(turns).where("speaker IS NOT NULL").select("doc", "speaker").distinct()
    known = who.join(attributes.withColumn("value", F.nullif(F.trim("value"), F.lit(""))), ["doc", "speaker"], "left")
    base = known.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("base"))
    unknown = known.agg(F.count_if(F.col("value").isNull()).alias("unknown"))
    said = codes.select("doc", "idx", "code").distinct().join(participants(turns), ["doc", "idx"]).where("speaker IS NOT NULL").groupBy("code", "doc", "speaker").agg(F.count(F.lit(1)).alias("n"))
    seen = said.join(known.where("value IS NOT NULL"), ["doc", "speaker"]).groupBy("code", "value").agg(F.count(F.lit(1)).alias("with_code"), F.sum("n").alias("turns"))
    grid = said.select("code").distinct().select("code", F.lit(1).alias("one")).join(F.broadcast(base.withColumn("one", F.lit(1))), "one").drop("one")
    out = grid.join(seen, ["code", "value"], "left").na.fill(0, ["with_code", "turns"]).join(F.broadcast(unknown))
    return out.select("code", "value", "with_code", "base", jround(F.col("with_code") * 100.0 / F.col("base"), 1).alias("share"), "turns", (F.col("base") < SMALL_BASE).alias("small_base"), "unknown")


def cooccurrence(codes: DataFrame, turns: DataFrame) -> DataFrame:
    """(code_a, code_b, turns, respondents): pairs of codes on one turn or voiced by one respondent, the diagonal holding each code's own count.

    Codes of a unit are a small set; pairs come from exploding it twice.
    """
    said = codes.select("doc", "idx", "code").distinct().join(participants(turns), ["doc", "idx"])

    def pairs(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        sets = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("code")).alias("s"))
        each = sets.select("s", F.explode("s").alias("code_a")).select("code_a", F.explode("s").alias("code_b")).where("code_a <= code_b")
        return each.groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias(name))

    by_turn, by_person = pairs(said, ["doc", "idx"], "turns"), pairs(said.where("speaker IS NOT NULL"), ["doc", "speaker"], "respondents")
    return by_turn.join(by_person, ["code_a", "code_b"], "full").na.fill(0, ["turns", "respondents"])


def usable_attributes(attributes: DataFrame) -> DataFrame:
    """(attribute, covered, distinct_values) with at least two values and fewer values than respondents."""
    g = attributes.groupBy("attribute").agg(F.count(F.lit(1)).alias("covered"), F.count_distinct("value").alias("distinct_values"))
    return g.where("distinct_values >= 2 AND distinct_values < covered")


def theme_rollup(codes: DataFrame, themes: dict[str, str]) -> DataFrame:
    """Assignments with themes in place of codes, one for each turn and theme."""
    named = F.create_map(*[F.lit(x) for kv in themes.items() for x in kv])
    return codes.select("doc", "idx", F.try_element_at(named, F.col("code")).alias("code")).where("code IS NOT NULL").distinct()


def across_documents(stats: DataFrame) -> DataFrame:
    """(code, documents_with, documents_total, turns, speakers_with, speakers_total) of ``code_stats``; speaker sums are null if any document lacks speakers."""
    total = stats.agg(F.count_distinct("doc").alias("documents_total"))

    def summed(c: str) -> Column:
        return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)

    g = stats.groupBy("code").agg(F.count_if(F.col("turns") > 0).alias("documents_with"), F.sum("turns").alias("turns"), summed("speakers_with"), summed("speakers_total"))
    return g.join(F.broadcast(total)).select("code", "documents_with", "documents_total", "turns", "speakers_with", "speakers_total")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, both_yes, model_only, researcher_only, both_no, agreement, kappa, band, caveat) of two 0/1 columns.

    Kappa is null where chance agreement is total or nothing was judged; it is
    banded before it is rounded to four decimals.
    """
    x, y = F.col(a) == 1, F.col(b) == 1
    g = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both_yes"), F.count_if(x & ~y).alias("model_only"), F.count_if(~x & y).alias("researcher_only"), F.count_if(~x & ~y).alias("both_no")
    )
    n = F.col("n").cast("double")
    observed = F.try_divide(F.col("both_yes") + F.col("both_no"), n)
    model, researcher = (F.try_divide(F.col("both_yes") + F.col(c), n) for c in ("model_only", "researcher_only"))
    expected = model * researcher + (1 - model) * (1 - researcher)
    g = g.withColumn("k", F.when(expected < 1, (observed - expected) / F.nullif(1 - expected, F.lit(0.0))))
    return g.select("n", "both_yes", "model_only", "researcher_only", "both_no", jround(observed, 4).alias("agreement"), jround(F.col("k"), 4).alias("kappa"), kappa_band(F.col("k")).alias("band"), kappa_caveat().alias("caveat"))


def kappa_band(k: Column) -> Column:
    out = F.when(k.isNull(), "Not defined").when(k < 0, "Worse than chance")
    for high, name in KAPPA_BANDS:
        out = out.when(k <= high, name)
    return out.otherwise("Almost perfect")


def kappa_caveat() -> Column:
    """The wording, from the columns of ``kappa``."""
    few = F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(" turn"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(f" judged; kappa is unstable below {KAPPA_TURNS}."))
    rare = (F.col("both_yes") + F.col("model_only") < KAPPA_POSITIVES) | (F.col("both_yes") + F.col("researcher_only") < KAPPA_POSITIVES)
    return F.when(F.col("n") < KAPPA_TURNS, few).when(rare, "The code applies to very few of the judged turns, so kappa is unstable.")


def exemplars(turns: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, code, idx, quote): the participant's turn closest to 220 characters (200 more against those under 40), first of equals.

    Over 500 characters it is cut behind the last sentence that ends in the
    second two thirds, else at the last blank.
    """
    score = F.abs(F.length("text") - EXEMPLAR) + F.when(F.length("text") < 40, 200).otherwise(0)
    best = _coded(turns, codes).groupBy("doc", "code").agg(F.min_by(F.struct("idx", F.trim("text").alias("text")), F.struct(score.alias("s"), F.col("idx"))).alias("b"))
    head = F.left("b.text", F.lit(EXEMPLAR_MOST))
    behind = lambda mark: EXEMPLAR_MOST - F.coalesce(F.nullif(F.call_function("locate", F.lit(mark[::-1]), F.reverse(head)), F.lit(0)), F.lit(EXEMPLAR_MOST + 1)) - len(mark) + 1
    sentence = F.greatest(*[behind(m) for m in (". ", "? ", "! ")])
    cut = F.when(sentence > EXEMPLAR_MOST / 3, F.left(head, sentence + 1)).otherwise(F.trim(F.left(head, behind(" "))))
    return best.select("doc", "code", "b.idx", F.when(F.length("b.text") > EXEMPLAR_MOST, cut).otherwise(F.col("b.text")).alias("quote"))


def coded_findings(turns: DataFrame, codes: DataFrame, book: DataFrame) -> DataFrame:
    """Findings of codes on two turns or more: (doc, code, turns, speakers, idx, quote, reproduced_runs, total_runs, theme) with the codebook's (doc, code, ...) columns.

    ``book`` holds doc, code, reproduced_runs, total_runs and theme; a finding
    stands under its code's theme, or its name where there is none.
    """
    n = _coded(turns, codes).groupBy("doc", "code").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("speaker").alias("speakers")).where(F.col("turns") >= FINDING_TURNS)
    theme = F.coalesce(F.nullif(F.col("theme"), F.lit("")), F.col("code"))
    return n.join(exemplars(turns, codes), ["doc", "code"]).join(book, ["doc", "code"]).select("doc", "code", "turns", "speakers", "idx", "quote", "reproduced_runs", "total_runs", theme.alias("theme"))


def apply_overrides(model: DataFrame, overrides: DataFrame, book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, dormant): a researcher's changes (doc, idx, name, action) laid over the model's (doc, idx, code).

    Changes meet the codebook (doc, code, name) by the key of the name; those
    that meet none are kept and counted, (doc, dormant).  Removed assignments go,
    added ones come with source researcher, which also marks those that were there.
    """
    from tabulon.functions.exprs import code_key

    named = overrides.withColumn("key", code_key(F.col("name"))).join(book.select("doc", "code", code_key(F.col("name")).alias("key")), ["doc", "key"], "left")
    dormant = named.groupBy("doc").agg(F.count_if(F.col("code").isNull()).alias("dormant"))
    key = ["doc", "idx", "code"]
    met = named.where("code IS NOT NULL")
    added = met.where("action = 'add'").select(*key).distinct().withColumn("own", F.lit(True))
    left = model.select(*key).distinct().join(met.where("action = 'remove'").select(*key), key, "left_anti")
    laid = left.join(added, key, "full")
    return laid.select(*key, F.when(F.col("own"), "researcher").otherwise("model").alias("source")), dormant
