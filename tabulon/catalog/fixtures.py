"""Tables of the evidence store, made from the test tables by SQL that Spark and DuckDB read alike.

Queries take them as DataFrames, their checks as common table expressions, so
both sides see the same rows.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

_SCORE = "CASE WHEN {k} % 14 = 0 THEN NULL ELSE 1 + 2 * (({k} + {i}) % 3) END AS {name}"


def _scores(key: str, names: tuple[str, ...]) -> str:
    return ", ".join(_SCORE.format(k=key, i=i, name=n) for i, n in enumerate(names))


INSIGHT_SCORES = ("why_score", "actionability_score", "novelty_score", "synthesis_score", "evidentiary_score")
FIXTURES = {
    "programs": "SELECT r_regionkey AS program_id, r_name AS name, 9 - r_regionkey AS created_at FROM {region}",
    "runs": """SELECT n_nationkey AS run_id, n_name AS project_name, CASE WHEN n_nationkey % 4 <> 3 THEN n_regionkey END AS program_id, CASE n_nationkey % 3 WHEN 0 THEN 'wave 1' WHEN 1 THEN 'wave 2' ELSE 'wave 3' END AS wave_label,
  CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS decision_statement, (n_nationkey * 7) % 25 AS created_at FROM {nation}""",
    "files": """SELECT p_partkey AS document_id, p_partkey % 23 AS run_id, CASE p_partkey % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'table' WHEN 2 THEN 'transcript' ELSE 'evidence' END AS kind,
  CASE WHEN p_partkey % 4 = 1 THEN CASE WHEN p_size > 25 THEN 'raw' ELSE 'aggregated' END END AS ingestion_type, p_name || '.pdf' AS source_filename, p_size AS uploaded_at, CASE WHEN p_partkey % 6 < 4 THEN p_type || ' ' || p_name || ' ' || p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_name || ' ' || p_brand END AS extracted_text FROM {part}""",
    "file_tables": """SELECT p_partkey * 10 + i AS table_id, p_partkey AS document_id, p_partkey % 23 AS run_id, i AS table_index, '["' || p_brand || '","' || p_type || '",""]' AS headers, CASE WHEN p_size > 25 THEN 'raw' ELSE 'aggregated' END AS ingestion_type
  FROM {part} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i) twice WHERE p_partkey % 4 = 1 AND p_partkey % 23 < 20""",
    "findings": """SELECT o_orderkey AS finding_id, o_custkey % 25 AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'generated' ELSE 'coded' END AS origin,
  'finding ' || CAST(o_orderkey % 40 AS STRING) || ' about ' || lower(o_orderpriority) || ' orders of year ' || CAST(year(o_orderdate) AS STRING) || ' in state ' || o_orderstatus || ' price' || CAST(o_custkey % 60 AS STRING) AS finding_text,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'stated_insight' WHEN 1 THEN 'fact' WHEN 2 THEN 'external_citation' END END AS finding_kind, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS theme,
  CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey % 200 END AS source_document_id, CASE WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 50) * 4 + 1 END AS source_table_id,
  CAST(o_orderkey % 7 AS STRING) AS source_cells, CASE WHEN o_orderkey % 6 IN (0, 2, 3) THEN o_orderkey - o_orderkey % 6 END AS duplicate_group_id, CASE WHEN o_orderkey % 9 = 3 THEN o_orderkey - 2 END AS grounded_by_finding_id,
  o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0 AS has_stats, CASE WHEN o_orderkey % 8 <> 1 THEN o_orderkey % 90 END AS n1, o_orderkey % 70 + 20 AS n2, CASE WHEN o_orderkey % 4 = 1 THEN 'not_significant' ELSE 'sampling_assumed_random' END AS caveat,
  CASE WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderpriority < '3' THEN 'banner_comparison' ELSE 'outlier' END END AS pattern_type, CASE WHEN o_orderkey % 2 = 0 THEN 'quantitative' ELSE 'qualitative' END AS data_type, o_orderdate AS created_at FROM {orders}""",
    "verdicts": """SELECT l_orderkey * 10 + l_linenumber AS verdict_id, l_orderkey AS finding_id, CASE min(l_returnflag) WHEN 'A' THEN 'robust' WHEN 'N' THEN 'use_with_caution' ELSE CASE WHEN l_linenumber = 2 THEN 'insufficient_information' ELSE 'not_supported' END END AS verdict_tier,
  CASE WHEN min(l_linestatus) = 'F' THEN 'data_backed' ELSE 'report_only' END AS verification_basis, 'line ' || CAST(l_linenumber AS STRING) AS rationale, CASE WHEN max(l_quantity) > 40 THEN '["not_significant"]' END AS caveats,
  '{{"cited_finding_ids":[' || CAST(l_orderkey + 1 AS STRING) || ',' || CAST(l_orderkey + 7 AS STRING) || '],"relied_finding_ids":[' || CAST(l_orderkey - 2 AS STRING) || ']}}' AS due_care, max(l_shipdate) AS created_at FROM {lineitem} WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber""",
    "insights": "SELECT o_orderkey * 3 AS insight_id, o_orderkey AS finding_id, o_custkey % 25 AS run_id, 'headline ' || CAST(o_orderkey AS STRING) AS headline, 'sees ' || lower(o_orderpriority) AS observation, " + _scores("o_orderkey", INSIGHT_SCORES) + ", CASE WHEN o_orderkey % 14 <> 0 THEN o_orderkey % 21 + 5 END AS quality_score, CASE WHEN o_orderkey % 14 <> 0 THEN CASE WHEN o_orderkey % 21 >= 10 THEN 'qualified' ELSE 'partial' END END AS quality_tier, o_orderdate AS created_at FROM {orders} WHERE o_orderkey % 2 = 0",
    "synths": """SELECT c_custkey AS synth_id, c_custkey % 25 AS run_id, c_name AS headline, 'so ' || lower(c_mktsegment) AS implication, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'rejected' ELSE 'accepted' END AS review_status, CASE c_custkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'exploratory' END AS confidence_tier,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 21 + 5 END AS quality_score, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 21 >= 10 THEN 'qualified' WHEN c_custkey % 21 >= 7 THEN 'partial' ELSE 'finding' END END AS quality_tier, c_custkey % 5 + 1 AS triangulation_count,
  CASE WHEN c_custkey % 4 = 0 THEN 'retained_no_action' ELSE 'has_action' END AS action_plan_status, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS contradiction_checked_at, (c_custkey * 37) % 1501 AS created_at FROM {customer}""",
    "synth_sources": "SELECT o_custkey AS synth_id, o_orderkey * 3 AS insight_id FROM {orders} WHERE o_orderkey % 4 = 0",
    "recs": """SELECT o_orderkey AS rec_id, o_custkey % 25 AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 3 END AS insight_id, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey END AS synth_id, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 10 < 8 THEN 'ai_suggested' ELSE 'researcher_authored' END AS source, o_orderkey % 13 = 0 AS edited, 'act ' || CAST(o_orderkey AS STRING) AS action_text,
  """ + _scores("o_orderkey", ("rec_actionability_score", "rec_feasibility_score", "rec_evidence_score")) + ", CASE WHEN o_orderkey % 14 <> 0 THEN o_orderkey % 13 + 3 END AS rec_quality_score, o_orderdate AS created_at FROM {orders} WHERE o_orderkey % 4 < 2",
    "contradictions": """SELECT o_orderkey AS contradiction_id, o_custkey % 25 AS run_id, o_orderkey - o_orderkey % 3 AS original_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - o_orderkey % 3 + 1 END AS contradicting_finding_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS contradicting_synth_id,
  'because ' || o_orderpriority AS rationale, o_orderdate AS created_at FROM {orders} WHERE o_orderkey % 17 = 5""",
    "trace": """SELECT event_id, user_id % 25 AS run_id, CASE event_type WHEN 'signup' THEN 'process_run_batch' WHEN 'error' THEN 'process_run_errors' ELSE 'api_usage' END AS event, CASE event_type WHEN 'signup' THEN '{{"mode":"full"}}' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '{{"message":"m' || CAST(event_id AS STRING) || '","errors":["e' || CAST(event_id AS STRING) || '"]}}' ELSE '{{"errors":[]}}' END
  ELSE '{{"agent":"' || event_type || '","input_tokens":' || CAST(event_id % 1000 AS STRING) || ',"output_tokens":' || CAST(event_id % 77 AS STRING) || '}}' END AS detail, ts AS occurred_at FROM {events}""",
    "finding_history": "SELECT o_orderkey AS history_id, o_orderkey AS original_finding_id, o_custkey % 25 AS run_id, 'old ' || CAST(o_orderkey AS STRING) AS finding_text, o_orderpriority AS theme, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'full_reprocess' ELSE 'manual_reextract' END AS archived_reason, o_orderdate AS archived_at FROM {orders} WHERE o_orderkey % 5 = 2",
    "insight_history": "SELECT o_orderkey AS original_finding_id, 'was ' || CAST(o_orderkey AS STRING) AS headline, CASE WHEN o_orderkey % 4 = 0 THEN 'qualified' END AS quality_tier FROM {orders} WHERE o_orderkey % 10 = 2",
    "candidates": """SELECT s_suppkey AS candidate_id, s_nationkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'decision' ELSE 'objective' END AS kind, s_name AS candidate_text, CASE WHEN s_suppkey % 3 = 0 THEN 'researcher_authored' ELSE 'ai_suggested' END AS source,
  CASE s_suppkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'accepted' END AS status, s_suppkey % 7 = 0 AS edited, s_suppkey AS created_at FROM {supplier}""",
    "validations": """SELECT n_nationkey AS run_id, CASE WHEN i < 2 THEN 'objective' ELSE 'decision' END AS item_kind, i AS item_order, n_name || ' ' || CAST(i AS STRING) AS item_text, CASE i WHEN 0 THEN 'resolved' WHEN 1 THEN 'partial' ELSE 'gap' END AS status, '[' || CAST(n_nationkey + 25 * i AS STRING) || ',' || CAST(n_nationkey + 25 * (i + 1) AS STRING) || ']' AS synth_ids
  FROM {nation} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i UNION ALL SELECT 2 AS i) three""",
    "objective_scores": """SELECT n_nationkey AS run_id, i AS item_order, CASE WHEN n_nationkey % 6 = 0 AND i = 1 THEN 'changed' ELSE n_name || ' ' || CAST(i AS STRING) END AS item_text, 4 + (n_nationkey * 3 + i * 5) % 17 AS quality_score FROM {nation} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i UNION ALL SELECT 2 AS i) three WHERE n_nationkey % 8 <> 1 OR i < 2""",
    "segments": "SELECT conv_id * 1000 + turn AS segment_id, conv_id AS doc, turn AS idx, CASE WHEN role <> 'system' THEN role END AS speaker, CASE WHEN role = 'system' THEN 'moderator' ELSE 'participant' END AS role, text FROM {conversations}",
    "codebooks": "SELECT conv_id * 10 + v AS codebook_id, conv_id AS doc, conv_id % 25 AS run_id, v AS version, CASE v WHEN 1 THEN 'induced' ELSE 'edited' END AS source FROM (SELECT DISTINCT conv_id FROM {conversations}) d CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v UNION ALL SELECT 3 AS v) three WHERE v <= 1 + conv_id % 3",
    "codes": """SELECT codebook_id * 10 + p AS code_id, codebook_id, p AS position, CASE p WHEN 0 THEN 'Price' WHEN 1 THEN 'Taste  notes' WHEN 2 THEN 'Trust' ELSE 'Time' END AS name, 'meaning ' || CAST(p AS STRING) AS definition, (codebook_id + p) % 4 AS reproduced_runs, 3 AS total_runs, p = 3 AND version = 1 AS added_by_researcher
  FROM {codebooks} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 AS p UNION ALL SELECT 2 AS p UNION ALL SELECT 3 AS p) four WHERE p < 3 OR version <> 2""",
    "assignments": "SELECT segment_id, code_id FROM {segments} JOIN {codebooks} ON segments.doc = codebooks.doc JOIN {codes} ON codebooks.codebook_id = codes.codebook_id WHERE (idx + position) % 3 = 0 AND role <> 'moderator'",
    "code_meta": "SELECT DISTINCT conv_id AS doc, 'price' AS code_key, CASE WHEN conv_id % 2 = 0 THEN 'Money' ELSE '' END AS theme, 'note ' || CAST(conv_id AS STRING) AS note, 'cost, fees' AS keywords FROM {conversations} UNION ALL SELECT DISTINCT conv_id, 'taste notes', 'Senses', '', '' FROM {conversations} WHERE conv_id % 3 = 0",
    "overrides": "SELECT doc, idx, CASE WHEN idx % 3 = 0 THEN 'price' WHEN idx % 3 = 1 THEN ' TRUST ' ELSE 'Gone code' END AS name, CASE WHEN idx % 2 = 0 THEN 'remove' ELSE 'add' END AS action FROM {segments} WHERE role <> 'moderator' AND idx < 6 AND doc % 2 = 0",
    "settings": "SELECT p_partkey AS document_id, CASE WHEN p_size % 2 = 0 THEN 'focus_group' ELSE 'individual' END AS session_type, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS setup_confirmed_at FROM {part} WHERE p_partkey % 4 = 2 AND p_partkey % 3 <> 0",
    "narratives": "SELECT n_nationkey AS run_id, 'old story of ' || n_name AS governing_thought, n_nationkey AS generated_at FROM {nation} WHERE n_nationkey % 3 <> 0",
}


def _names(sql: str) -> list[str]:
    return [n for _, n, _, _ in string.Formatter().parse(sql) if n]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables as DataFrames."""
    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            if name in BASE:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            else:
                # Spark fills the braces in with the DataFrames themselves.
                sql = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"{\1} AS \1", FIXTURES[name])
                made[name] = spark.sql(sql, **{n: get(n) for n in _names(FIXTURES[name])})
        return made[name]

    return [get(n) for n in names]


def oracle(body: str, *names: str) -> str:
    """SQL of ``body`` with the named tables, and those they are made from, in front."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes or name in BASE:
            return
        for n in _names(FIXTURES[name]):
            add(n)
        ctes[name] = FIXTURES[name].format(**{n: n for n in _names(FIXTURES[name])})

    for n in names:
        add(n)
    if not ctes:
        return body
    front = ", ".join(f"{n} AS ({s})" for n, s in ctes.items())
    for start, word in (("WITH RECURSIVE ", "WITH RECURSIVE "), ("WITH ", "WITH ")):
        if body.startswith(start):
            return f"{word}{front}, {body[len(start):]}"
    return f"WITH {front} {body}"
