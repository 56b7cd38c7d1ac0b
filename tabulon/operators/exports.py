"""Exports as tables: what each sheet or file holds, in its order and with its labels, and RFC 4180 files of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import views as V


def _title(x):
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 100))


def findings_sheet(findings: DataFrame, files: DataFrame, accepted_only: bool = False) -> DataFrame:
    """Findings with readable labels, by theme and time; fixed values: the labels."""
    own = findings.where("status = 'accepted'") if accepted_only else findings
    rows = V.placed(V.with_source(own, files), F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("finding_id"))
    kind = F.when(F.col("finding_kind").isNotNull(), V.labelled(F.col("finding_kind"), V.KIND_LABELS, F.col("finding_kind"))).when(F.col("pattern_type").isNotNull(), V.labelled(F.col("pattern_type"), V.PATTERN_LABELS, F.col("pattern_type"))).otherwise("")
    return rows.select(
        "run_id", "pos", F.coalesce("theme", F.lit("No theme")).alias("theme"), V.labelled(F.col("origin"), V.ORIGIN_LABELS).alias("origin"), _title(F.coalesce("data_type", F.lit(""))).alias("data_type"), kind.alias("kind"), F.col("finding_text").alias("finding"),
        _title(F.col("status")).alias("status"), F.coalesce("source_filename", F.lit("")).alias("source"), F.when(F.col("duplicate_group_id").isNotNull(), "Yes").otherwise("No").alias("possible_duplicate"),
    )


def history_sheet(history: DataFrame, insight_history: DataFrame) -> DataFrame:
    """Archived findings, latest first, whole: finding, status, the insight it fed, why it went."""
    rows = V.history_listing(history, insight_history, most=None)
    fed = F.coalesce(F.concat("headline", F.coalesce(F.concat(F.lit(" ("), "quality_tier", F.lit(")")), F.lit(""))), F.lit(""))
    return rows.select("run_id", "pos", F.col("finding_text").alias("finding"), _title(F.col("status")).alias("status"), fed.alias("insight"), V.labelled(F.col("archived_reason"), V.REASON_LABELS, F.col("archived_reason")).alias("removed_by"))


def insights_sheet(insights: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    listing = V.insights_listing(insights, findings, verdicts).select("run_id", "pos", "insight_id", "theme", "verdict_tier")
    text = insights.select("insight_id", "headline", "observation", "finding_id").join(findings.select("finding_id", "finding_text"), "finding_id").drop("finding_id")
    both = listing.join(text, "insight_id")
    return both.select("run_id", "pos", F.coalesce("theme", F.lit("No theme")).alias("theme"), V.labelled(F.col("verdict_tier"), V.TIER_LABELS, F.col("verdict_tier")).alias("robustness"), "headline", "observation", F.col("finding_text").alias("from_finding"))


def recommendations_sheet(recs: DataFrame, insights: DataFrame, findings: DataFrame, accepted_only: bool = False) -> DataFrame:
    own = recs.where("status = 'accepted'") if accepted_only else recs
    both = own.join(insights.select("insight_id", "finding_id", "headline"), "insight_id").join(findings.select("finding_id", "theme"), "finding_id")
    rows = V.placed(both, F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("rec_id"))
    return rows.select("run_id", "pos", F.coalesce("theme", F.lit("No theme")).alias("theme"), _title(F.col("priority")).alias("priority"), F.col("action_text").alias("action"), _title(F.col("status")).alias("status"), F.col("headline").alias("from_insight"))


def synths_sheet(synths: DataFrame, sources: DataFrame, insights: DataFrame, findings: DataFrame) -> DataFrame:
    both = synths.join(V.synth_members(synths, sources, insights, findings).select("synth_id", "headlines"), "synth_id")
    rows = V.placed(both, F.desc_nulls_last("quality_score"), F.col("created_at"), F.col("synth_id"))
    quality = F.when(F.col("quality_tier").isNull(), "Not yet scored").otherwise(F.concat(_title(F.col("quality_tier")), F.lit(" ("), F.col("quality_score").cast("string"), F.lit("/25)")))
    return rows.select("run_id", "pos", _title(F.col("confidence_tier")).alias("confidence"), quality.alias("quality"), F.when(F.col("review_status") == "accepted", "Accepted").otherwise("Rejected").alias("status"), F.when(F.col("action_plan_status") == "has_action", "Has action").otherwise("Retained, no action yet").alias("action_plan"), F.col("headlines").alias("chain_of_evidence"))


def deck_pages(sheet: DataFrame, cards: int) -> DataFrame:
    """Rows of a sheet with the page of their theme that they stand on, from 0."""
    from pyspark.sql import Window

    return sheet.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("run_id", "theme").orderBy("pos")) - 1) / cards))


def verbatim_rows(segments: DataFrame, codes: DataFrame, themes: DataFrame) -> DataFrame:
    """(doc, code, theme, speaker, turn, also): a row for each code of a turn, with its other codes; ``themes`` holds code and theme."""
    rows = segments.where("role <> 'moderator'").join(codes.groupBy("doc", "idx").agg(F.sort_array(F.collect_set("code")).alias("codes")), ["doc", "idx"])
    each = rows.select("doc", "speaker", (F.col("idx") + 1).alias("turn"), "codes", F.explode("codes").alias("code"))
    also = F.nullif(F.array_join(F.array_remove("codes", F.col("code")), "; "), F.lit(""))
    return each.join(F.broadcast(themes), "code", "left").select("doc", "code", "theme", "speaker", "turn", also.alias("also"))


def themed_extract(segments: DataFrame, codes: DataFrame, themes: DataFrame) -> DataFrame:
    """Verbatims in the order of a themed extract: (doc, place) by theme, code and turn; fixed value: the speaker's stand-in."""
    from pyspark.sql import Window

    rows = verbatim_rows(segments, codes, themes)
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("theme").asc_nulls_last(), "code", "turn"))
    return rows.select("doc", place.alias("place"), "theme", "code", F.concat(F.coalesce("speaker", F.lit("Unlabelled")), F.lit(" (turn "), F.col("turn").cast("string"), F.lit(")")).alias("who"))


def respondent_matrix(respondents: DataFrame, codes: list[str], books: DataFrame) -> DataFrame:
    """(doc, label, turns, one column a code): turns of each respondent, null where the document's codebook (doc, codes) lacks the code."""
    both = respondents.join(books, "doc")
    cell = lambda c: F.when(F.array_contains("codes", c), F.coalesce(F.try_element_at("code_turns", F.lit(c)), F.lit(0))).alias(c)
    return both.select("doc", "label", "turns", *[cell(c) for c in codes])


def write_csv(sheet: DataFrame, folder: str) -> None:
    """Files of RFC 4180: a header, commas, quotes doubled inside quoted fields."""
    sheet.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(folder)
