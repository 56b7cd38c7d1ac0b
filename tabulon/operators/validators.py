"""Checks of model answers, which arrive as JSON lists: what survives is decided by these rules, never by the model.

Answers are rows (key, answer).  Lists are exploded with their place, so that
"the first one counts" is a window over places.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Allowed scores, codes of a codebook, links and negative cases kept, evidence tiers, insights of a pillar.
SCORES, MOST_CODES, MOST_LINKS, MOST_NEGATIVES, MOST_PROOFS = (1, 3, 5), 12, 15, 3, 3
CHAIN_TIERS = {"supported": "robust", "overreach": "use_with_caution", "contradicted": "not_supported", "unsupported": "insufficient_information"}
CONFIDENCE_RANK = {"strong": 0, "moderate": 1, "exploratory": 2}
#: Fixed value: the theme that takes codes left alone.
HOLDING_THEME = "Other (not yet themed)"
#: Keys under which a list may hide.
LIST_KEYS = ("themes", "merges", "placements", "groups", "theme_groups", "groupings")


def find_list(value, depth: int = 0) -> list | None:
    """The list in a parsed answer: itself, in a JSON text, under a known key, the values of an object, or a map of names to codes."""
    if isinstance(value, list):
        return value
    if isinstance(value, str) and depth < 2:
        try:
            return find_list(json.loads(value), depth + 1)
        except ValueError:
            loose = re.findall(r'"theme"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,\s*"codes"\s*:\s*\[([^\]]*)\]', value)
            return [{"theme": t.replace('\\"', '"'), "codes": [int(n) for n in re.findall(r"\d+", c)]} for t, c in loose] or None
    if isinstance(value, dict) and value:
        for key in LIST_KEYS:
            if key in value and (found := find_list(value[key], depth + 1)):
                return found
        if all(isinstance(v, dict) for v in value.values()):
            return list(value.values())
        if all(isinstance(v, list) for v in value.values()):
            return [{"theme": k, "codes": v} for k, v in value.items()]
    return None


@F.pandas_udf(StringType())
def tolerant_list(answer: pd.Series) -> pd.Series:
    """The list in an answer as JSON, null if there is none."""
    return answer.map(lambda a: None if a is None or (found := find_list(a, -1)) is None else json.dumps(found))


def items(answers: DataFrame, schema: str, *beside: str) -> DataFrame:
    """(key, place, ...) of the objects in the lists of (key, answer), columns of the answer beside them; what can't be read gives no rows."""
    parsed = F.from_json(tolerant_list(F.col("answer")), f"array<struct<{schema}>>")
    return answers.select("key", *beside, F.posexplode(parsed).alias("place", "item")).where("item IS NOT NULL").select("key", *beside, "place", "item.*")


def _beside(answers: DataFrame, rows: DataFrame, name: str, *columns: str, how: str = "inner") -> DataFrame:
    """Answers with the key's rows in a list ``name``.

    A key has one answer, and its rows are what that answer could name, so both
    sides are one row a key.  Rows made by exploding look small to the planner,
    which would broadcast them whole; a merge join keeps them on the executors.
    """
    return answers.join(rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias(name)).hint("merge"), "key", how)


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row by place of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("key", *keys).orderBy("place"))).where("_k = 1").drop("_k")


def _said(text: str) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def valid_scores(answers: DataFrame, dimensions: list[str], counts: DataFrame) -> DataFrame:
    """(key, index, scores, total): scores of 1, 3 or 5 on each dimension, an index below the count of (key, n), a reason; the first of each index."""
    rows = items(answers, ", ".join(["index: int", "rationale: string", *[f"{d}_score: int" for d in dimensions]]))
    allowed = F.lit(True)
    for d in dimensions:
        allowed = allowed & F.coalesce(F.col(f"{d}_score").isin(*SCORES), F.lit(False))
    fine = rows.join(counts, "key").where(allowed & (F.col("index") >= 0) & (F.col("index") < F.col("n")) & _said("rationale"))
    total = sum((F.col(f"{d}_score") for d in dimensions[1:]), F.col(f"{dimensions[0]}_score"))
    return _first(fine, "index").select("key", "index", *[f"{d}_score" for d in dimensions], total.alias("total"), F.trim("rationale").alias("rationale"))


def scores_current(items_now: DataFrame, stored: DataFrame) -> DataFrame:
    """(run_id, current): whether stored (run_id, item_order, item_text) still describe the items, one for one."""
    both = items_now.select("run_id", "item_order", F.col("item_text").alias("now")).join(stored.select("run_id", "item_order", F.col("item_text").alias("was")), ["run_id", "item_order"], "full")
    return both.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("now") == F.col("was"), F.lit(False))).alias("current"))


def consolidated_codes(answers: DataFrame, themes_per_run: DataFrame, most: int = MOST_CODES) -> DataFrame:
    """(key, rank, name, definition, reproduced_runs) of merged codes.

    Members are (run, theme) numbers from 1; those outside ``themes_per_run``
    (key, run, themes) don't count, and codes without one go.  Of equal names
    the first stays; at most twelve by number of runs.
    """
    known = _beside(answers, themes_per_run, "known", "run", "themes")
    rows = items(known, "name: string, definition: string, members: array<struct<run: int, theme: int>>", "known").where(_said("name") & _said("definition"))
    inside = F.filter("members", lambda m: (m["theme"] >= 1) & F.exists("known", lambda k: (k["run"] == m["run"]) & (m["theme"] <= k["themes"])))
    reproduced = F.size(F.array_distinct(F.transform(inside, lambda m: m["run"]))).cast("long")
    runs = rows.select("key", "place", F.trim("name").alias("name"), F.trim("definition").alias("definition"), reproduced.alias("reproduced_runs")).where("reproduced_runs > 0")
    one = _first(runs.withColumn("low", F.lower("name")), "low")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("reproduced_runs"), "place"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("key", "rank", "name", "definition", "reproduced_runs")


def valid_assignments(answers: DataFrame, asked: DataFrame, codes: DataFrame) -> DataFrame:
    """(key, index, code): codes from 1 to the count of (key, n) on turns that were asked (key, index), once each; of answers for one turn the last with a code counts."""
    rows = items(answers, "index: int, codes: array<string>").select("key", "place", "index", F.posexplode("codes").alias("at", "raw"))
    fine = rows.withColumn("code", F.when(F.col("raw").rlike(r"^\d+$"), F.col("raw").cast("int"))).join(codes, "key").where("code >= 1 AND code <= n").join(asked, ["key", "index"], "left_semi")
    last = fine.withColumn("final", F.max("place").over(Window.partitionBy("key", "index"))).where("place = final")
    return last.select("key", "index", "code").distinct()


def valid_links(answers: DataFrame, codes: DataFrame, variables: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(key, code, variable, direction, rationale): links to variables of (key, variable) by their name, case aside, with a direction and a reason; fifteen at most."""
    rows = items(answers, "code: int, variable: string, direction: string, rationale: string").withColumn("low", F.lower(F.trim("variable")))
    known = variables.select("key", F.lower(F.trim("variable")).alias("low"), F.col("variable").alias("own"))
    fine = rows.join(codes, "key").join(known, ["key", "low"]).where((F.col("code") >= 1) & (F.col("code") <= F.col("n")) & F.col("direction").isin("higher", "lower") & _said("rationale"))
    one = _first(fine, "code", "own").withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where(F.col("k") <= most)
    return one.select("key", "code", F.col("own").alias("variable"), "direction", F.left(F.trim("rationale"), F.lit(400)).alias("rationale"))


def valid_negatives(answers: DataFrame, asked: DataFrame, codes: DataFrame, most: int = MOST_NEGATIVES) -> DataFrame:
    """(key, code, index, reason): turns said to contradict a code, three a code at most, once each."""
    rows = items(answers, "code: int, index: int, reason: string")
    fine = rows.join(codes, "key").where((F.col("code") >= 1) & (F.col("code") <= F.col("n")) & _said("reason")).join(asked, ["key", "index"], "left_semi")
    one = _first(fine, "code", "index").withColumn("k", F.row_number().over(Window.partitionBy("key", "code").orderBy("place"))).where(F.col("k") <= most)
    return one.select("key", "code", "index", F.left(F.trim("reason"), F.lit(300)).alias("reason"))


def _numbers(column: str) -> Column:
    """Whole numbers of a list of texts, in order, each once."""
    return F.array_distinct(F.transform(F.filter(F.col(column), lambda x: F.trim(x).rlike(r"^\d+$")), lambda x: F.trim(x).cast("int")))


def theme_groups(answers: DataFrame, codes: DataFrame) -> DataFrame:
    """(key, theme, codes): themes of two codes or more; a code belongs to the first theme that has it, of equal names the first counts.

    A theme that is left with one code gives it back, so themes are folded in order, a few to a codebook.
    """
    rows = items(answers.join(codes.hint("merge"), "key"), "theme: string, codes: array<string>", "n").where(_said("theme")).select("key", "n", "place", F.left(F.trim("theme"), F.lit(120)).alias("theme"), _numbers("codes").alias("codes"))
    inside = rows.withColumn("codes", F.filter("codes", lambda c: (c >= 1) & (c <= F.col("n"))))
    lined = inside.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "theme", "codes"))).alias("l"))
    empty = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<theme:string,codes:array<int>>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        left = F.array_except(x["codes"], state["used"])
        known = F.exists(state["out"], lambda o: F.lower(o["theme"]) == F.lower(x["theme"]))
        takes = (F.size(left) >= 2) & ~known
        one = F.array(F.struct(x["theme"].alias("theme"), left.alias("codes")))
        return F.struct(F.when(takes, F.concat(state["used"], left)).otherwise(state["used"]).alias("used"), F.when(takes, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    folded = lined.select("key", F.explode(F.aggregate("l", empty, step, lambda s: s["out"])).alias("o"))
    return folded.select("key", "o.theme", "o.codes")


def place_leftovers(answers: DataFrame, groups: DataFrame, leftover: DataFrame) -> DataFrame:
    """(key, theme, code) of codes left over (key, code): in the theme of a number (key, number, theme), in a new theme of two, or in the holding theme."""
    asked = _beside(_beside(answers, leftover, "left", "code"), groups, "groups", "number", "theme", how="left")
    told = items(asked, "code: int, theme: int, new_theme: string", "left", "groups").where(F.exists("left", lambda x: x["code"] == F.col("code")) & (F.col("theme").isNotNull() | (F.trim("new_theme") != "")))
    named = F.transform(F.filter("groups", lambda g: g["number"] == F.col("theme")), lambda g: g["theme"])
    known = _first(told, "code").select("key", "place", "code", "new_theme", F.explode_outer(named).alias("name"))
    # A known theme has no part in new names; new ones need a name.
    fresh = F.when(F.col("name").isNull(), F.lower(F.trim("new_theme")))
    own = Window.partitionBy("key", "fresh")
    lined = known.where(F.col("name").isNotNull() | _said("new_theme")).withColumn("fresh", fresh)
    label = F.first(F.left(F.trim("new_theme"), F.lit(120))).over(own.orderBy("place"))
    new = F.when(F.col("n") >= 2, F.col("label")).otherwise(HOLDING_THEME)
    return lined.withColumns({"n": F.count(F.lit(1)).over(own), "label": label}).select("key", F.coalesce("name", new).alias("theme"), "code")


def chain_tier(outcome: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tier in CHAIN_TIERS.items():
        out = F.when(outcome == name, tier).otherwise(out)
    return out


def chain_verdicts(answers: DataFrame, pool: DataFrame) -> DataFrame:
    """(key, tier, level, relied, contradicting) of claims judged against numbered evidence (key, index, finding_id).

    Indices outside the evidence don't count; contradicting ones only where the
    outcome is contradicted.  An unknown outcome or no reason gives no row.
    """
    parsed = answers.select("key", F.from_json("answer", "outcome string, rationale string, relied_indices array<int>, contradicting_indices array<int>").alias("a")).select("key", "a.*")
    fine = parsed.withColumn("tier", chain_tier(F.col("outcome"))).where(F.col("tier").isNotNull() & _said("rationale"))
    numbered = pool.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("index", "finding_id"))).alias("ids"))
    both = fine.join(numbered, "key", "left")
    ids = lambda c: F.filter(F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<int>"))), lambda i: F.try_element_at("ids", i)), lambda x: x.isNotNull())
    relied, against = ids("relied_indices"), F.when(F.col("outcome") == "contradicted", ids("contradicting_indices")).otherwise(F.array().cast("array<bigint>"))
    level = F.when(F.col("tier") == "not_supported", "contradicted").when(F.size(relied) > 1, "cross_source_corroborated").otherwise("single_source")
    return both.select("key", "tier", level.alias("level"), F.array_join(relied, ",").alias("relied"), F.array_join(against, ",").alias("contradicting"))


def pillars(answers: DataFrame, insights: DataFrame, most: int = MOST_PROOFS) -> DataFrame:
    """(key, pillar, theme, headline, insight_ids, overflow): groups of numbered insights (key, index, synth_id, confidence_tier, quality_score, headline).

    A pillar needs a headline and a known index; its three strongest insights
    stay, by tier and then score.  Where none survives, each insight is a pillar.
    """
    rank = F.lit(3)
    for tier, r in CONFIDENCE_RANK.items():
        rank = F.when(F.col("confidence_tier") == tier, r).otherwise(rank)
    ranked = insights.withColumns({"rank": rank, "worse": -F.coalesce("quality_score", F.lit(0))})
    # Insights without an answer stay: each of them is a pillar.
    both = _beside(answers, ranked, "insights", "index", "synth_id", "rank", "worse", "confidence_tier", "headline", how="right")
    parsed = F.from_json(tolerant_list(F.col("answer")), "array<struct<theme: string, headline: string, insight_indices: array<int>>>")

    def proofs(indices: Column) -> Column:
        """The insights of those numbers, the strongest first."""
        each = F.transform(F.array_distinct(indices), lambda x, at: F.transform(F.filter("insights", lambda i: i["index"] == x), lambda i: F.struct(i["rank"], i["worse"], at.alias("at"), i["synth_id"].alias("synth_id"))))
        return F.sort_array(F.flatten(each))

    placed = F.transform(F.coalesce("said", F.array().cast("array<struct<theme: string, headline: string, insight_indices: array<int>>>")), lambda x, place: F.struct(place.alias("pillar"), F.trim(x["theme"]).alias("theme"), F.trim(x["headline"]).alias("headline"), proofs(x["insight_indices"]).alias("l")))
    fine = F.filter(placed, lambda p: (p["headline"] != "") & (F.size(p["l"]) > 0))
    made = F.transform(fine, lambda p: F.struct(p["pillar"].alias("pillar"), F.coalesce(F.nullif(p["theme"], F.lit("")), F.lit("Key finding")).alias("theme"), p["headline"].alias("headline"), F.array_join(F.transform(F.slice(p["l"], 1, most), lambda x: x["synth_id"].cast("string")), ",").alias("insight_ids"), F.greatest(F.lit(0), F.size(p["l"]) - most).cast("long").alias("overflow")))
    bare = F.transform("insights", lambda i: F.struct(i["index"].alias("pillar"), F.coalesce(i["confidence_tier"], F.lit("Key finding")).alias("theme"), i["headline"].alias("headline"), i["synth_id"].cast("string").alias("insight_ids"), F.lit(0).cast("long").alias("overflow")))
    found = both.select("key", "insights", parsed.alias("said")).select("key", "insights", made.alias("made"))
    return found.select("key", F.explode(F.when(F.size("made") > 0, F.col("made")).otherwise(bare)).alias("p")).select("key", "p.*")


#: Findings of a request and of a pass, insights of a request and of a pass, insights and claims of a contradiction check, characters of a brief.
VERDICTS_EACH, VERDICTS_MOST, ACTIONS_EACH, ACTIONS_MOST, CHECKS_MOST, CLAIMS_MOST, BRIEF_CHARS = 20, 100, 10, 60, 30, 80, 40_000
#: Verdict tiers, priorities, and the texts that every recommendation has.
TIERS, PRIORITIES = ("robust", "use_with_caution", "not_supported", "insufficient_information"), ("high", "medium", "low")
ACTION_TEXTS = ("action_text", "owner_role", "owner_feasibility_note", "timeline", "metric", "assumptions_and_risks", "alternatives_considered")
#: The wording of a finding without a judgement, of a conflict without a reason, and of a theme that is missing.
NOT_JUDGED = "The verification pass did not return a judgment for this finding; try re-running it."
CONFLICT = "The insight's conclusion conflicts with this claim."
NO_THEME = "Uncategorized"


def _entries(answers: DataFrame, name: str, schema: str) -> DataFrame:
    """(key, place, ...) of the objects in the list ``name`` of each answer; fields of another kind are null."""
    listed = F.try_variant_get(F.try_parse_json("answer"), f"$.{name}", "array<variant>")
    fields = [x.strip().split(" ") for x in schema.split(",")]
    rows = answers.select("key", F.posexplode(listed).alias("place", "item"))
    return rows.select("key", "place", *[_typed(F.col("item"), f"$.{n}", kind).alias(n) for n, kind in fields])


def _typed(value: Column, path: str, kind: str) -> Column:
    """A field of a variant if it is a whole number, or a text, as ``kind`` (int or string) asks; null if it is something else."""
    inner = F.try_variant_get(value, path, "variant")
    is_text = F.schema_of_variant(inner) == "STRING"
    if kind == "string":
        return F.when(is_text, F.try_variant_get(value, path, "string"))
    number = F.when(F.schema_of_variant(inner).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, path, "double"))
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e9), number.cast("int"))


def judged_findings(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, index, tier, rationale) of verdicts with an index inside the request (key, n), a known tier and a rationale; the first of each index."""
    rows = _entries(answers, "verdicts", "index int, verdict_tier string, rationale string").join(requests.select("key", "n"), "key")
    fine = rows.where((F.col("index") >= 0) & (F.col("index") < F.col("n")) & F.col("verdict_tier").isin(*TIERS) & (F.length("rationale") > 0))
    return _first(fine, "index").select("key", "index", F.col("verdict_tier").alias("tier"), "rationale")


def pass_verdicts(judged: DataFrame, requests: DataFrame, failed: DataFrame) -> DataFrame:
    """(run_id, item_id, tier, rationale) of a pass over requests (key, run_id, items): findings that an answer skipped lack information.

    Runs with a request that failed (run_id) get nothing, so the pass is tried again as a whole.
    """
    asked = requests.join(failed.select("run_id"), "run_id", "left_anti").select("key", "run_id", F.posexplode("items").alias("index", "item_id"))
    both = asked.join(judged, ["key", "index"], "left")
    return both.select("run_id", "item_id", F.coalesce("tier", F.lit("insufficient_information")).alias("tier"), F.coalesce("rationale", F.lit(NOT_JUDGED)).alias("rationale"))


def contradiction_answers(answers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checked, found): keys whose answer is an object, and (key, claim_id, detail) of the claims in requests (key, claims) that it says are contradicted, each once.

    Only whole numbers inside the list of claims count; other answers leave the insight unchecked.
    """
    parsed = answers.withColumn("v", F.try_parse_json("answer")).where(F.schema_of_variant("v").startswith("OBJECT"))
    listed = F.coalesce(F.try_variant_get("v", "$.contradicted_indices", "array<variant>"), F.array().cast("array<variant>"))
    number = F.transform(listed, lambda x: F.when(F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(x, "$", "double")))
    whole = F.array_distinct(F.filter(number, lambda x: x.isNotNull() & (x == F.floor(x)) & (x >= 0)))
    detail = F.coalesce(F.nullif(F.trim(_typed(F.col("v"), "$.detail", "string")), F.lit("")), F.lit(CONFLICT))
    each = parsed.select("key", detail.alias("detail"), F.explode(whole).alias("index")).join(requests.select("key", "claims"), "key")
    found = each.where(F.col("index") < F.size("claims")).select("key", F.get("claims", F.col("index").cast("int")).alias("claim_id"), "detail")
    return parsed.select("key").distinct(), found


def recommendation_answers(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, place, index, priority, action_text, ...) of recommendations with an index inside the request (key, n), a known priority and every text, trimmed."""
    rows = _entries(answers, "recommendations", ", ".join(["index int", "priority string", *[f"{t} string" for t in ACTION_TEXTS]])).join(requests.select("key", "n"), "key")
    told = rows.withColumns({t: F.trim(t) for t in ACTION_TEXTS})
    fine = told.where((F.col("index") >= 0) & (F.col("index") < F.col("n")) & F.col("priority").isin(*PRIORITIES))
    for t in ACTION_TEXTS:
        fine = fine.where(_said(t))
    return fine.select("key", "place", "index", "priority", *ACTION_TEXTS)


def framing_answers(answers: DataFrame) -> DataFrame:
    """(key, business_problem, research_objective), trimmed; null where an answer has no such text."""
    v = F.try_parse_json("answer")
    return answers.select("key", *[F.nullif(F.trim(_typed(v, f"$.{c}", "string")), F.lit("")).alias(c) for c in ("business_problem", "research_objective")])


def framing_prompt(brief: Column, proposal: Column) -> Column:
    """The documents of a run under their headings, each cut at 40,000 characters; null where there is neither."""
    part = lambda name, x: F.when(F.length(x) > 0, F.concat(F.lit(f"=== {name} ===\n"), F.left(x, F.lit(BRIEF_CHARS))))
    return F.nullif(F.concat_ws("\n\n", part("BRIEF", brief), part("PROPOSAL", proposal)), F.lit(""))
