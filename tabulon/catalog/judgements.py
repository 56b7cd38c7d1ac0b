"""Queries of requests to a provider and of what survives of its answers, over the fixture tables, and their SQL.

The provider of these queries is a rule on the prompt, so that SQL can say what it answers.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tabulon.catalog.fixtures import oracle, tables
from tabulon.operators import judge as J
from tabulon.operators import validators as W

_SPECS: dict[str, tuple] = {}


def _spec(name: str, function, names: str, sql: str) -> None:
    _SPECS[name] = (function, names.split(), sql)


def _verdicts(prompts: list[str]) -> list[str | None]:
    """Every fifth finding has no known tier and every fifth no verdict; the last one is judged twice; some prompts get no list, some no answer."""
    out = []
    for p in prompts:
        n, first = p.count("\n") + 1, hashlib.sha256(p.encode()).hexdigest()[0]
        entries = [{"index": i, "verdict_tier": ("robust", "use_with_caution", "bogus", None, "not_supported")[i % 5], "rationale": f"because {i}"} for i in range(n) if i % 5 != 3]
        entries += [{"index": n - 1, "verdict_tier": "robust", "rationale": "again"}, {"index": n, "verdict_tier": "robust", "rationale": "beyond"}, {"index": "0", "verdict_tier": "robust", "rationale": "text"}, {"index": 3, "verdict_tier": "robust", "rationale": ""}]
        out.append(None if first == "0" else "no list" if first == "1" else json.dumps({"verdicts": entries}))
    return out


def _none(spark):
    return spark.createDataFrame([], J.ANSWERS)


def _judged(findings):
    theme = F.concat(F.lit("["), F.coalesce("theme", F.lit(W.NO_THEME)), F.coalesce(F.concat(F.lit(" · "), "finding_kind"), F.lit("")), F.lit("] "), "finding_text")
    items = findings.where("origin <> 'generated' AND status <> 'rejected' AND grounded_by_finding_id IS NULL").withColumn("item_id", F.col("finding_id"))
    requests = J.numbered_requests(items, "verify_findings", ["created_at", "finding_id"], theme, W.VERDICTS_EACH, W.VERDICTS_MOST)
    return requests, J.judge_pending(requests, _none(findings.sparkSession), _verdicts, W.judged_findings)


def _requests(findings):
    requests, answers = _judged(findings)
    used = answers.groupBy("request_id").agg(F.max("attempt").alias("attempts"), F.bool_or("accepted").alias("accepted"))
    return requests.join(used, "request_id").select("run_id", "chunk", "n", F.concat_ws(",", F.transform("items", lambda i: i.cast("string"))).alias("items"), "request_id", "attempts", "accepted")


def _pass(findings):
    requests, answers = _judged(findings)
    done, failed = J.accepted_answers(requests, answers)
    done = done.withColumnRenamed("request_id", "key")
    return W.pass_verdicts(W.judged_findings(done.select("key", "answer"), done), done, failed).select("run_id", F.col("item_id").alias("finding_id"), "tier", "rationale")


_ASKED = """asked AS (SELECT run_id, finding_id, (k - 1) // 20 AS chunk, (k - 1) % 20 AS index, '[' || coalesce(theme, 'Uncategorized') || coalesce(' · ' || finding_kind, '') || '] ' || finding_text AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, finding_id) AS k FROM findings WHERE origin <> 'generated' AND status <> 'rejected' AND grounded_by_finding_id IS NULL) x WHERE k <= 100),
requests AS (SELECT run_id, chunk::INTEGER AS chunk, count(*)::INTEGER AS n, string_agg(finding_id::VARCHAR, ',' ORDER BY index) AS items, string_agg(index || '. ' || line, chr(10) ORDER BY index) AS prompt FROM asked GROUP BY 1, 2),
named AS (SELECT *, sha256('verify_findings' || chr(10) || prompt) AS request_id, left(sha256(prompt), 1) IN ('0', '1') AS fails FROM requests)"""
_spec("judge_requests", _requests, "findings", f"WITH {_ASKED} SELECT run_id, chunk, n, items, request_id, CASE WHEN fails THEN 2 ELSE 1 END AS attempts, NOT fails AS accepted FROM named")
_spec("judged_verdicts", _pass, "findings", f"""WITH {_ASKED} SELECT run_id, finding_id, CASE index % 5 WHEN 0 THEN 'robust' WHEN 1 THEN 'use_with_caution' WHEN 4 THEN 'not_supported' ELSE CASE WHEN index = n - 1 THEN 'robust' ELSE 'insufficient_information' END END AS tier,
  CASE WHEN index % 5 IN (0, 1, 4) THEN 'because ' || index WHEN index = n - 1 THEN 'again' ELSE '{W.NOT_JUDGED}' END AS rationale FROM asked JOIN named USING (run_id, chunk) WHERE run_id NOT IN (SELECT run_id FROM named WHERE fails)""")


def _conflicts(prompts: list[str]) -> list[str | None]:
    """Insights contradict the claims at half and at the end of the list, and places that aren't in it; every other one without a reason."""
    out = []
    for p in prompts:
        n, even = p.count("\n"), int(hashlib.sha256(p.encode()).hexdigest(), 16) % 2 == 0
        out.append(json.dumps({"contradicted_indices": [n // 2, n - 1, n // 2, n, -1, 0.5, "0"], "detail": "  " if even else " it can't be "}))
    return out


def _contradictions(synths, findings):
    claims = findings.where("origin IN ('stated', 'coded') AND status <> 'rejected' AND coalesce(finding_kind, '') <> 'external_citation'").withColumn("item_id", F.col("finding_id"))
    line = F.concat(F.lit("["), F.coalesce("theme", F.lit(W.NO_THEME)), F.lit("] "), "finding_text")
    block = J.numbered_requests(claims, "claims", ["created_at", "finding_id"], line, W.CLAIMS_MOST, W.CLAIMS_MOST).select("run_id", F.col("items").alias("claims"), F.col("prompt").alias("block"))
    place = F.row_number().over(J.Window.partitionBy("run_id").orderBy("created_at", "synth_id"))
    due = synths.where("review_status <> 'rejected' AND contradiction_checked_at IS NULL").withColumn("place", place).where(F.col("place") <= W.CHECKS_MOST).join(block, "run_id")
    requests = J.with_request_ids(due.select(F.lit("contradiction_check").alias("agent"), F.concat_ws("\n", F.concat_ws(" ", "headline", "implication"), "block").alias("prompt"), "run_id", "synth_id", "claims"))
    answers = J.judge_pending(requests, _none(synths.sparkSession), _conflicts, lambda a, r: W.contradiction_answers(a, r)[0])
    done = J.accepted_answers(requests, answers)[0].withColumnRenamed("request_id", "key")
    found = W.contradiction_answers(done.select("key", "answer"), done)[1]
    return found.join(done.select("key", "run_id", "synth_id"), "key").select("run_id", "synth_id", F.col("claim_id").alias("finding_id"), "detail")


_spec("contradiction_checks", _contradictions, "synths findings", f"""WITH claims AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, finding_id) - 1 AS k FROM findings WHERE origin IN ('stated', 'coded') AND status <> 'rejected' AND coalesce(finding_kind, '') <> 'external_citation') x WHERE k < 80),
block AS (SELECT run_id, count(*) AS n, string_agg(k || '. [' || coalesce(theme, 'Uncategorized') || '] ' || finding_text, chr(10) ORDER BY k) AS t FROM claims GROUP BY 1),
due AS (SELECT * FROM synths WHERE review_status <> 'rejected' AND contradiction_checked_at IS NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, synth_id) <= 30),
asked AS (SELECT run_id, synth_id, n, right(sha256(headline || ' ' || implication || chr(10) || t), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS even FROM due JOIN block USING (run_id)),
spots AS (SELECT DISTINCT run_id, synth_id, even, k FROM (SELECT *, unnest([n // 2, n - 1]) AS k FROM asked) x)
SELECT run_id, synth_id, finding_id, CASE WHEN even THEN '{W.CONFLICT.replace("'", "''")}' ELSE 'it can''t be' END AS detail FROM spots JOIN claims USING (run_id, k)""")


def _actions(prompts: list[str]) -> list[str | None]:
    """Every third recommendation has an unknown priority, every fourth a blank metric."""
    texts = {t: f" {t} " for t in W.ACTION_TEXTS}
    return [json.dumps({"recommendations": [{"index": i, "priority": ("high", "low", "soon")[i % 3], **texts, "metric": " " if i % 4 == 3 else "m"} for i in range(p.count("\n") + 2)]}) for p in prompts]


def _recommended(insights):
    items = insights.where("quality_tier = 'qualified'").withColumn("item_id", F.col("insight_id"))
    requests = J.numbered_requests(items, "recommendation_agent", ["created_at", "insight_id"], F.concat_ws(" ", "headline", "observation"), W.ACTIONS_EACH, W.ACTIONS_MOST)
    answers = J.judge_pending(requests, _none(insights.sparkSession), _actions, W.recommendation_answers)
    done = J.accepted_answers(requests, answers)[0].withColumnRenamed("request_id", "key")
    made = W.recommendation_answers(done.select("key", "answer"), done).join(done.select("key", "run_id", "items"), "key")
    return made.select("run_id", F.get("items", F.col("index")).alias("insight_id"), "priority", "action_text", "metric")


_spec("recommended_actions", _recommended, "insights", """WITH asked AS (SELECT run_id, insight_id, (k - 1) % 10 AS i FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, insight_id) AS k FROM insights WHERE quality_tier = 'qualified') x WHERE k <= 60)
SELECT run_id, insight_id, CASE i % 3 WHEN 0 THEN 'high' ELSE 'low' END AS priority, 'action_text' AS action_text, 'm' AS metric FROM asked WHERE i % 3 < 2 AND i % 4 <> 3""")


def _framings(prompts: list[str]) -> list[str | None]:
    return [json.dumps({"business_problem": f" {len(p)} characters " if "BRIEF" in p else None, "research_objective": "1. aim" if "PROPOSAL" in p else " "}) for p in prompts]


def _framed(runs):
    prompt = W.framing_prompt(F.repeat(F.col("decision_statement"), 4000), F.when(F.col("run_id") % 2 == 0, F.col("project_name")).otherwise(""))
    requests = J.with_request_ids(runs.select(F.lit("brief_intake").alias("agent"), prompt.alias("prompt"), "run_id").where("prompt IS NOT NULL"))
    answers = J.judge_pending(requests, _none(runs.sparkSession), _framings, lambda a, r: W.framing_answers(a))
    done = J.accepted_answers(requests, answers)[0].withColumnRenamed("request_id", "key")
    told = W.framing_answers(done.select("key", "answer")).join(done.select("key", "run_id"), "key").drop("key")
    return runs.select("run_id").join(told, "run_id", "left")


_spec("framing_fields", _framed, "runs", """SELECT run_id, CASE WHEN decision_statement IS NOT NULL THEN (14 + least(40000, 4000 * length(decision_statement)) + CASE WHEN run_id % 2 = 0 THEN 19 + length(project_name) ELSE 0 END) || ' characters' END AS business_problem,
  CASE WHEN run_id % 2 = 0 THEN '1. aim' END AS research_objective FROM runs""")


def _query(name: str):
    function, names, _ = _SPECS[name]
    return lambda spark, sf_dir: function(*tables(spark, sf_dir, *names))


QUERIES = {name: _query(name) for name in _SPECS}
ORACLE_SQL = {name: oracle(sql, *names) for name, (_, names, sql) in _SPECS.items()}
