"""Queries of the read models, exports and interface tallies over the fixture tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog.fixtures import oracle, tables
from tabulon.operators import evidence as E
from tabulon.operators import exports as X
from tabulon.operators import patterns as P
from tabulon.operators import views as V

#: Query -> (function, tables it takes, SQL over those tables).
_SPECS: dict[str, tuple] = {}


def _spec(name: str, function, names: str, sql: str) -> None:
    _SPECS[name] = (function, names.split(), sql)


def _pos(order: str) -> str:
    return f"(row_number() OVER (PARTITION BY run_id ORDER BY {order}))::INTEGER AS pos"


_LATEST = "lv AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, verdict_id DESC) = 1)"
_PASSED = "('robust', 'use_with_caution')"
_THEME = "theme ASC NULLS LAST, created_at"
_CORROBORATES = "EXISTS (SELECT 1 FROM findings g WHERE g.grounded_by_finding_id = f.finding_id)"
_CHAIN = f"""chain AS (SELECT s.synth_id, string_agg(i.headline, ' | ' ORDER BY i.created_at, i.insight_id) AS headlines, count(*) FILTER (f.origin IN ('stated', 'coded') OR {_CORROBORATES}) AS ok, count(*) AS n
  FROM synth_sources s JOIN insights i USING (insight_id) JOIN findings f USING (finding_id) GROUP BY 1)"""
_CLAIM = "n::VARCHAR || ' claim' || CASE WHEN n = 1 THEN '' ELSE 's' END"

_spec("view_findings", V.findings_listing, "findings files contradictions", f"""SELECT run_id, {_pos("created_at, finding_id")}, finding_id, coalesce(a.source_filename, b.source_filename) AS source_filename, {_CORROBORATES} AS corroborates,
  EXISTS (SELECT 1 FROM contradictions c WHERE c.original_id = f.finding_id) AS contradicted, EXISTS (SELECT 1 FROM contradictions c WHERE c.contradicting_finding_id = f.finding_id) AS contradicts
FROM findings f LEFT JOIN (SELECT document_id, source_filename FROM files) a ON a.document_id = source_document_id LEFT JOIN (SELECT document_id, source_filename FROM files) b ON b.document_id = source_table_id""")
_spec("view_insights", V.insights_listing, "insights findings verdicts", f"""WITH {_LATEST}, j AS (SELECT i.run_id, i.insight_id, f.theme, i.created_at, lv.verdict_tier, lv.verification_basis, f.origin IN ('stated', 'coded') OR {_CORROBORATES} AS from_report, coalesce(lv.caveats, '[]') AS caveats FROM insights i JOIN findings f USING (finding_id) JOIN lv USING (finding_id))
SELECT run_id, {_pos(_THEME + ", insight_id")}, insight_id, theme, verdict_tier, verification_basis, from_report, caveats FROM j""")
_spec("view_synthesized_insights", V.synths_listing, "synths synth_sources insights findings contradictions", f"""WITH {_CHAIN}, g AS (SELECT run_id, contradicting_synth_id AS synth_id, count(*) AS contradicts FROM contradictions JOIN (SELECT finding_id FROM findings) o ON o.finding_id = original_id WHERE contradicting_synth_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT s.*, headlines, ok, n, n - ok AS new FROM synths s JOIN chain USING (synth_id))
SELECT run_id, {_pos("CASE review_status WHEN 'rejected' THEN 1 ELSE 0 END, quality_score DESC NULLS LAST, CASE confidence_tier WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, triangulation_count DESC, created_at, synth_id")}, synth_id, headlines,
  CASE WHEN new = 0 THEN 'New: combines ' || ok || ' claim' || CASE WHEN ok = 1 THEN '' ELSE 's' END || ' the report itself made into something none of them said alone.'
    WHEN ok = 0 THEN 'New: built entirely from ' || new || ' net-new finding' || CASE WHEN new = 1 THEN '' ELSE 's' END || ' the report did not contain.'
    ELSE 'New: combines ' || ok || ' claim' || CASE WHEN ok = 1 THEN '' ELSE 's' END || ' from the report with ' || new || ' net-new finding' || CASE WHEN new = 1 THEN '' ELSE 's' END || ' into something the report did not say.' END AS caption, coalesce(contradicts, 0) AS contradicts
FROM j LEFT JOIN g USING (run_id, synth_id)""")
_spec("view_verdict_summary", V.verdict_summary, "verdicts findings", f"SELECT run_id, count(*) AS verdicts, count(*) FILTER (verdict_tier IN {_PASSED}) AS passed FROM verdicts JOIN findings USING (finding_id) GROUP BY 1")
_spec("view_failed_verdicts", V.failed_sample, "verdicts findings", f"SELECT run_id, {_pos('verdict_id')}, verdict_id, finding_text, verdict_tier FROM verdicts JOIN (SELECT finding_id, run_id, finding_text FROM findings) f USING (finding_id) WHERE verdict_tier IN ('not_supported', 'insufficient_information') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY verdict_id) <= 3")
_spec("view_stated_insights", V.stated_validations, "findings verdicts insights contradictions synths", f"""WITH {_LATEST}, c AS (SELECT f.finding_id, f.run_id, f.created_at, lv.verdict_tier, lv.due_care, i.insight_id FROM findings f LEFT JOIN lv USING (finding_id) LEFT JOIN (SELECT finding_id, insight_id FROM insights) i USING (finding_id) WHERE f.finding_kind = 'stated_insight' AND f.status <> 'rejected'),
cited AS (SELECT k.finding_id, string_agg(o.finding_text, ' | ' ORDER BY o.created_at, o.finding_id) AS t FROM (SELECT DISTINCT finding_id, unnest(from_json(json_extract(due_care, '$.cited_finding_ids'), '["BIGINT"]')) AS other FROM c) k JOIN findings o ON o.finding_id = k.other GROUP BY 1),
relied AS (SELECT k.finding_id, string_agg(o.finding_text, ' | ' ORDER BY o.created_at, o.finding_id) AS t FROM (SELECT DISTINCT finding_id, unnest(from_json(json_extract(due_care, '$.relied_finding_ids'), '["BIGINT"]')) AS other FROM c) k JOIN findings o ON o.finding_id = k.other GROUP BY 1),
by_ AS (SELECT x.run_id, original_id AS finding_id, string_agg(CASE WHEN o.finding_text IS NULL THEN 'net_new_insight' WHEN o.origin = 'generated' THEN 'net_new_finding' ELSE 'report_claim' END, ',' ORDER BY x.created_at, contradiction_id) AS t FROM contradictions x LEFT JOIN findings o ON o.finding_id = contradicting_finding_id GROUP BY 1, 2)
SELECT run_id, {_pos("created_at, finding_id")}, finding_id, verdict_tier, insight_id AS elevated_insight_id, coalesce(cited.t, '') AS cited, coalesce(relied.t, '') AS relied, coalesce(by_.t, '') AS contradicted_by FROM c LEFT JOIN cited USING (finding_id) LEFT JOIN relied USING (finding_id) LEFT JOIN by_ USING (run_id, finding_id)""")
_spec("view_recommendations", V.recommendations_listing, "recs insights findings", f"""WITH j AS (SELECT r.run_id, r.rec_id, i.headline, f.theme, i.quality_score, r.created_at FROM recs r JOIN insights i USING (insight_id) JOIN findings f USING (finding_id))
SELECT run_id, {_pos("quality_score DESC NULLS LAST, " + _THEME + ", rec_id")}, rec_id, headline, theme, quality_score FROM j""")
_spec("view_synth_recommendations", V.synth_recommendations, "recs synths", f"""WITH j AS (SELECT r.run_id, r.rec_id, s.headline, s.confidence_tier, s.quality_score, r.created_at FROM recs r JOIN synths s USING (synth_id)) SELECT run_id, {_pos("quality_score DESC NULLS LAST, created_at, rec_id")}, rec_id, headline, confidence_tier, quality_score FROM j""")
_spec("view_recommendation_scores", lambda recs: recs.where("synth_id IS NOT NULL").select("run_id", "rec_id", "rec_actionability_score", "rec_feasibility_score", "rec_evidence_score", E.rating(F.col("rec_actionability_score") + F.col("rec_feasibility_score") + F.col("rec_evidence_score"), 12, 9).alias("tier")), "recs", """WITH t AS (SELECT *, rec_actionability_score + rec_feasibility_score + rec_evidence_score AS total FROM recs WHERE synth_id IS NOT NULL)
SELECT run_id, rec_id, rec_actionability_score, rec_feasibility_score, rec_evidence_score, CASE WHEN total >= 12 THEN 'strong' WHEN total >= 9 THEN 'workable' WHEN total IS NOT NULL THEN 'weak' END AS tier FROM t""")
_spec("view_objective_scores", lambda o: V.placed(o, F.col("item_order")).select("run_id", "pos", "item_text", "quality_score", E.rating(F.col("quality_score"), 16, 12).alias("tier")), "objective_scores", f"SELECT run_id, {_pos('item_order')}, item_text, quality_score, CASE WHEN quality_score >= 16 THEN 'strong' WHEN quality_score >= 12 THEN 'workable' ELSE 'weak' END AS tier FROM objective_scores")
_spec("insight_tiers", lambda i: i.select("insight_id", E.insight_tier(*[F.col(c) for c in ("why_score", "actionability_score", "novelty_score", "synthesis_score", "evidentiary_score")]).alias("tier")), "insights", "WITH t AS (SELECT insight_id, why_score + actionability_score + novelty_score + synthesis_score + evidentiary_score AS n FROM insights) SELECT insight_id, CASE WHEN n >= 15 THEN 'qualified' WHEN n >= 12 THEN 'partial' WHEN n IS NOT NULL THEN 'finding' END AS tier FROM t")
_spec("view_parked_insights", V.parked_insights, "synths recs", f"SELECT run_id, {_pos('created_at, synth_id')}, synth_id, action_plan_status FROM synths s WHERE review_status = 'accepted' AND NOT EXISTS (SELECT 1 FROM recs r WHERE r.synth_id = s.synth_id AND r.status = 'accepted')")
_spec("view_usage_by_agent", V.usage_by_agent, "trace", f"""WITH g AS (SELECT run_id, json_extract_string(detail, '$.agent') AS agent, count(*) AS calls, sum(json_extract_string(detail, '$.input_tokens')::BIGINT)::BIGINT AS input_tokens, sum(json_extract_string(detail, '$.output_tokens')::BIGINT)::BIGINT AS output_tokens FROM trace WHERE event = 'api_usage' GROUP BY 1, 2)
SELECT run_id, {_pos("input_tokens + output_tokens DESC, agent")}, agent, calls, input_tokens, output_tokens, floor((input_tokens / 1e6 * 2 + output_tokens / 1e6 * 10) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS cost_usd FROM g""")
_spec("view_history", lambda h, i: V.history_listing(h, i).select("run_id", "pos", "history_id", "archived_reason", "headline", "quality_tier"), "finding_history insight_history", f"SELECT run_id, {_pos('archived_at DESC, history_id DESC')}, history_id, archived_reason, headline, quality_tier FROM finding_history LEFT JOIN insight_history USING (original_finding_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY archived_at DESC, history_id DESC) <= 200")
_BOOKS = "books AS (SELECT * FROM codebooks QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1)"
_KEY = "lower(regexp_replace(trim(name), '\\s+', ' ', 'g'))"
_spec("view_codebooks", V.codebook_view, "codebooks codes assignments segments code_meta", f"""WITH {_BOOKS}, own AS (SELECT c.*, b.doc, b.version FROM codes c JOIN books b USING (codebook_id)),
n AS (SELECT code_id, count(DISTINCT segment_id) AS turns, count(DISTINCT speaker) AS speakers FROM assignments JOIN own USING (code_id) JOIN (SELECT segment_id, speaker FROM segments) s USING (segment_id) GROUP BY 1),
t AS (SELECT doc, count(*) FILTER (role <> 'moderator') AS participant_turns, count(*) FILTER (segment_id IN (SELECT segment_id FROM assignments JOIN own USING (code_id))) AS coded_turns FROM segments GROUP BY 1)
SELECT doc, version, (SELECT count(*) FROM codebooks x WHERE x.doc = own.doc) AS versions, code_id, position, name, coalesce(turns, 0) AS turns, coalesce(speakers, 0) AS speakers, coalesce(m.theme, '') AS theme, participant_turns, coded_turns
FROM own LEFT JOIN n USING (code_id) JOIN t USING (doc) LEFT JOIN code_meta m ON m.doc = own.doc AND m.code_key = {_KEY}""")
_spec("view_table_previews", V.table_previews, "file_tables", f"SELECT run_id, {_pos('document_id, table_index')}, table_id, document_id, table_index, ingestion_type FROM file_tables")
_spec("view_runs", V.run_list, "runs findings", "SELECT r.run_id, project_name, count(f.finding_id) AS findings_total, count(*) FILTER (f.status = 'rejected') AS findings_rejected FROM runs r LEFT JOIN findings f ON f.run_id = r.run_id GROUP BY 1, 2")
_spec("view_programs", V.programs_with_waves, "programs runs", "SELECT p.program_id, p.name, coalesce(string_agg(r.project_name, ' | ' ORDER BY r.created_at, r.run_id), '') AS waves FROM programs p LEFT JOIN runs r USING (program_id) GROUP BY 1, 2")
_spec("view_sibling_waves", V.sibling_waves, "runs", "SELECT a.run_id, (row_number() OVER (PARTITION BY a.run_id ORDER BY b.created_at, b.run_id))::INTEGER AS pos, b.run_id AS sibling_id FROM runs a JOIN runs b USING (program_id) WHERE a.run_id <> b.run_id")
_spec("view_unconfirmed_transcripts", V.unconfirmed_transcripts, "files settings", f"SELECT run_id, {_pos('uploaded_at, document_id')}, document_id, source_filename FROM files LEFT JOIN settings USING (document_id) WHERE kind = 'transcript' AND setup_confirmed_at IS NULL")
_spec("view_latest_message", lambda t: V.latest_message(t, ["process_run_errors", "process_run_batch"]), "trace", "SELECT run_id, json_extract_string(detail, '$.message') AS message FROM trace WHERE event IN ('process_run_errors', 'process_run_batch') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, event_id DESC) = 1")
_spec("view_process_errors", V.process_errors, "trace", """WITH b AS (SELECT run_id, max(occurred_at) AS since FROM trace WHERE event = 'process_run_batch' GROUP BY 1), e AS (SELECT t.* FROM trace t LEFT JOIN b USING (run_id) WHERE event = 'process_run_errors' AND (since IS NULL OR occurred_at >= since) QUALIFY row_number() OVER (PARTITION BY t.run_id ORDER BY occurred_at DESC, event_id DESC) = 1)
SELECT run_id, event_id, array_to_string(from_json(json_extract(detail, '$.errors'), '["VARCHAR"]'), ',') AS errors FROM e WHERE json_array_length(detail, '$.errors') > 0""")
_spec("pool_insight_eligibility", V.insight_eligibility, "findings verdicts insights", f"""WITH {_LATEST} SELECT run_id, {_pos("theme ASC NULLS LAST, f.created_at, finding_id")}, finding_id, verdict_tier FROM findings f JOIN (SELECT finding_id, verdict_tier FROM lv) v USING (finding_id) WHERE status <> 'rejected' AND verdict_tier IN {_PASSED} AND NOT EXISTS (SELECT 1 FROM insights i WHERE i.finding_id = f.finding_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY theme ASC NULLS LAST, f.created_at, finding_id) <= 60""")
_spec("pool_synthesis", V.synthesis_pool, "insights findings synth_sources", f"""WITH j AS (SELECT i.run_id, insight_id, theme, i.created_at FROM insights i JOIN findings f USING (finding_id) WHERE NOT EXISTS (SELECT 1 FROM synth_sources s WHERE s.insight_id = i.insight_id))
SELECT run_id, {_pos(_THEME + ", insight_id")}, insight_id, count(*) OVER (PARTITION BY run_id) AS total FROM j QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {_THEME}, insight_id) <= 60""")
_spec("pool_recommendation", V.recommendation_pool, "insights findings recs runs", f"""WITH j AS (SELECT i.run_id, insight_id, theme, i.created_at FROM insights i JOIN findings f USING (finding_id) WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.insight_id = i.insight_id) AND i.run_id IN (SELECT run_id FROM runs WHERE decision_statement IS NOT NULL))
SELECT run_id, {_pos(_THEME + ", insight_id")}, insight_id FROM j QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {_THEME}, insight_id) <= 60""")
_spec("pool_synth_recommendation", V.synth_recommendation_pool, "synths synth_sources insights findings recs", f"""WITH {_CHAIN} SELECT run_id, {_pos("created_at, synth_id")}, synth_id, headlines FROM synths s JOIN chain USING (synth_id) WHERE review_status = 'accepted' AND action_plan_status = 'has_action' AND NOT EXISTS (SELECT 1 FROM recs r WHERE r.synth_id = s.synth_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, synth_id) <= 60""")
_spec("pool_claims", V.claims_to_compare, "findings", f"SELECT run_id, {_pos('created_at, finding_id')}, finding_id, count(*) OVER (PARTITION BY run_id) > 80 AS truncated FROM findings WHERE origin IN ('stated', 'coded') AND status <> 'rejected' AND coalesce(finding_kind, '') <> 'external_citation' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, finding_id) <= 80")
_spec("pool_contradiction_checks", V.insights_to_check, "synths", f"SELECT run_id, {_pos('created_at, synth_id')}, synth_id FROM synths WHERE review_status <> 'rejected' AND contradiction_checked_at IS NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, synth_id) <= 30")
_spec("pool_scoring", V.scoring_pool, "insights synths synth_sources recs", """SELECT * FROM (SELECT run_id, 'insight' AS what, (row_number() OVER (PARTITION BY run_id ORDER BY created_at, insight_id))::INTEGER AS pos, insight_id AS id FROM insights WHERE quality_score IS NULL
UNION ALL SELECT run_id, 'synth', (row_number() OVER (PARTITION BY run_id ORDER BY created_at, synth_id))::INTEGER, synth_id FROM synths s WHERE quality_score IS NULL AND EXISTS (SELECT 1 FROM synth_sources x JOIN insights USING (insight_id) WHERE x.synth_id = s.synth_id)
UNION ALL SELECT run_id, 'recommendation', (row_number() OVER (PARTITION BY run_id ORDER BY created_at, rec_id))::INTEGER, rec_id FROM recs r WHERE status <> 'rejected' AND rec_quality_score IS NULL AND r.synth_id IN (SELECT synth_id FROM synths)) u WHERE pos <= 60""")
_spec("view_evidence_inventory", V.evidence_inventory, "files findings file_tables", """WITH h AS (SELECT run_id, table_id, unnest(from_json(headers, '["VARCHAR"]')) AS name, generate_subscripts(from_json(headers, '["VARCHAR"]'), 1) AS spot FROM file_tables), f AS (SELECT run_id, name, min((table_id, spot)) AS first FROM h WHERE trim(name) <> '' GROUP BY 1, 2)
SELECT run_id, 'document' AS what, kind AS name, count(*) AS n FROM files GROUP BY 1, 2, 3 UNION ALL SELECT run_id, 'finding', origin || ' ' || data_type, count(*) FROM findings WHERE status <> 'rejected' GROUP BY 1, 2, 3
UNION ALL SELECT * FROM (SELECT run_id, 'variable', name, row_number() OVER (PARTITION BY run_id ORDER BY first) AS n FROM f) v WHERE n <= 60""")
_spec("view_narrative_recommendations", V.narrative_recommendations, "recs synths", f"""SELECT run_id, {_pos("CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_at, rec_id")}, rec_id, priority FROM recs WHERE status = 'accepted' AND synth_id IN (SELECT synth_id FROM synths)""")
_spec("view_unmapped_insights", V.unmapped_insights, "synths validations", """SELECT run_id, synth_id, headline FROM synths s WHERE review_status = 'accepted' AND NOT EXISTS (SELECT 1 FROM validations v WHERE v.run_id = s.run_id AND list_contains(from_json(v.synth_ids, '["BIGINT"]'), s.synth_id))""")
_spec("view_accepted_findings", lambda f, v: V.accepted_findings(f, v).select("run_id", "pos", "finding_id", "verdict_tier"), "findings verdicts", f"WITH {_LATEST} SELECT run_id, {_pos('theme ASC NULLS LAST, f.created_at, finding_id')}, finding_id, verdict_tier FROM findings f JOIN (SELECT finding_id, verdict_tier FROM lv) v USING (finding_id) WHERE status = 'accepted' AND verdict_tier IN {_PASSED}")
_spec("view_assistant_context", V.assistant_context, "findings verdicts synths recs", f"""WITH {_LATEST} SELECT run_id, what, pos, id FROM (SELECT run_id, 'finding' AS what, (row_number() OVER (PARTITION BY run_id ORDER BY theme ASC NULLS LAST, f.created_at, finding_id))::INTEGER AS pos, finding_id AS id, 80 AS most FROM findings f JOIN (SELECT finding_id, verdict_tier FROM lv) v USING (finding_id) WHERE status = 'accepted' AND verdict_tier IN {_PASSED}
UNION ALL SELECT run_id, 'insight', (row_number() OVER (PARTITION BY run_id ORDER BY created_at, synth_id))::INTEGER, synth_id, 60 FROM synths WHERE review_status = 'accepted'
UNION ALL SELECT run_id, 'recommendation', (row_number() OVER (PARTITION BY run_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_at, rec_id))::INTEGER, rec_id, 40 FROM recs WHERE status = 'accepted') u WHERE pos <= most""")
_spec("view_methodology_files", V.methodology_files, "files", f"SELECT run_id, {_pos('kind, uploaded_at, document_id')}, document_id, kind FROM files WHERE kind IN ('evidence', 'report') AND length(extracted_text) > 50 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY kind, uploaded_at, document_id) <= 6")
_spec("pool_framing", V.framing_evidence, "insights findings", f"WITH j AS (SELECT i.run_id, insight_id, theme, i.created_at FROM insights i JOIN findings f USING (finding_id)) SELECT run_id, {_pos(_THEME + ', insight_id')}, insight_id, theme FROM j QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {_THEME}, insight_id) <= 120")
_spec("view_code_meta", lambda m: V.meta_maps(m).select("doc", F.array_join(F.transform(F.map_entries("themes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("themes")), "code_meta", "SELECT doc, string_agg(code_key || '=' || theme, ';' ORDER BY code_key) AS themes FROM code_meta GROUP BY 1")
_spec("view_contradictions", lambda c, f, s: V.contradiction_listing(c, f, s).drop("created_at"), "contradictions findings synths", f"""WITH j AS (SELECT c.*, coalesce(f.finding_text, s.headline, 'a synthesized insight') AS by_text, CASE WHEN f.finding_text IS NULL THEN 'net_new_insight' WHEN f.origin = 'generated' THEN 'net_new_finding' ELSE 'report_claim' END AS by_kind FROM contradictions c LEFT JOIN findings f ON f.finding_id = contradicting_finding_id LEFT JOIN synths s ON s.synth_id = contradicting_synth_id)
SELECT run_id, {_pos("created_at, contradiction_id")}, contradiction_id, original_id, by_text, by_kind, rationale FROM j""")
_spec("pool_evidence", lambda f, v: V.evidence_pool(f.where("finding_kind = 'stated_insight' AND finding_id % 60 = 0").select(F.col("finding_id").alias("claim_id"), "run_id", "theme", F.array(F.col("finding_id") + 25, F.col("finding_id") + 50).alias("cited")), f, v), "findings verdicts", """WITH c AS (SELECT finding_id AS claim_id, run_id, theme FROM findings WHERE finding_kind = 'stated_insight' AND finding_id % 60 = 0),
j AS (SELECT claim_id, (row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN finding_id IN (claim_id + 25, claim_id + 50) THEN 0 ELSE 1 END, CASE WHEN f.theme IS NOT DISTINCT FROM c.theme THEN 0 ELSE 1 END, created_at, finding_id) - 1)::INTEGER AS index, finding_id FROM c JOIN findings f USING (run_id) WHERE finding_kind <> 'stated_insight' AND status <> 'rejected' AND finding_id IN (SELECT finding_id FROM verdicts))
SELECT claim_id, index, finding_id FROM j WHERE index < 40""")
_spec("discovery_report", V.discovery_report, "synths synth_sources insights findings verdicts", f"""WITH {_LATEST}, {_CHAIN}, n AS (SELECT run_id, finding_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE verdict_tier WHEN 'robust' THEN 0 ELSE 1 END, theme ASC NULLS LAST, f.created_at, finding_id) AS pos, count(*) OVER (PARTITION BY run_id) AS total FROM findings f JOIN (SELECT finding_id, verdict_tier FROM lv) v USING (finding_id) WHERE origin = 'generated' AND status = 'accepted' AND verdict_tier IN {_PASSED} AND NOT {_CORROBORATES})
SELECT run_id, 'insight' AS what, (row_number() OVER (PARTITION BY run_id ORDER BY quality_score DESC NULLS LAST, created_at, synth_id))::INTEGER AS pos, synth_id AS id, 0::BIGINT AS omitted FROM synths JOIN chain USING (synth_id) WHERE review_status = 'accepted'
UNION ALL SELECT run_id, 'finding', pos::INTEGER, finding_id, greatest(0, total - 12)::BIGINT FROM n WHERE pos <= 12""")
_spec("input_completeness", E.input_completeness, "runs files file_tables", """WITH j AS (SELECT run_id, EXISTS (SELECT 1 FROM files f WHERE f.run_id = r.run_id AND kind IN ('report', 'transcript')) AS rep, EXISTS (SELECT 1 FROM file_tables t WHERE t.run_id = r.run_id) AS dat FROM runs r)
SELECT run_id, CASE WHEN rep AND dat THEN 'report_and_data' WHEN rep THEN 'report_only' WHEN dat THEN 'data_only' ELSE 'none' END AS state, CASE WHEN dat THEN 'raw_data_mining,synthesis' WHEN rep THEN 'synthesis' ELSE '' END AS sources FROM j""")
_spec("grounding_digest", P.grounding_digest, "findings", "SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY created_at, finding_id))::INTEGER AS index, finding_id, finding_text AS text FROM findings WHERE origin = 'generated' AND status <> 'rejected' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, finding_id) <= 20")
_spec("grounded_findings", lambda f: P.grounded(f.where("origin = 'stated'").select("finding_id", "run_id", (F.col("finding_id") % 25).cast("int").alias("grounded_pattern_index")), P.grounding_digest(f)).select("finding_id", "grounded_by_finding_id"), "findings", """WITH d AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY created_at, finding_id) AS k, finding_id AS g FROM findings WHERE origin = 'generated' AND status <> 'rejected')
SELECT f.finding_id, g AS grounded_by_finding_id FROM findings f LEFT JOIN d ON d.run_id = f.run_id AND d.k = f.finding_id % 25 AND d.k <= 20 WHERE origin = 'stated'""")
_spec("chart_eligibility", lambda f: P.chart_eligibility(f.where("(finding_id % 3 = 1 AND has_stats) OR theme < '2'").select("run_id", "theme", "origin", "pattern_type", F.when(F.col("has_stats"), "{}").alias("stated_stats"), F.lit("b").alias("banner_column"), F.lit("s").alias("stub_column"), F.when(F.col("finding_id") % 2 == 0, "x").alias("stub_category"))), "findings", """WITH g AS (SELECT run_id, theme, count(*) FILTER (origin <> 'generated' OR NOT has_stats) AS others, count(DISTINCT pattern_type) AS kinds, min(pattern_type) AS kind, count(*) FILTER (pattern_type IS NULL) AS untyped, count(*) FILTER (finding_id % 2 = 0) AS shares FROM findings WHERE (finding_id % 3 = 1 AND has_stats) OR theme < '2' GROUP BY 1, 2)
SELECT run_id, theme, CASE kind WHEN 'outlier' THEN 'outlier_strip' ELSE CASE WHEN shares > 0 THEN 'categorical_crosstab' ELSE 'group_means' END END AS chart FROM g WHERE others = 0 AND kinds = 1 AND untyped = 0""")
_spec("theme_groups", V.theme_groups, "findings", f"""WITH g AS (SELECT run_id, coalesce(theme, 'No theme') AS theme, count(*) AS findings FROM findings WHERE duplicate_group_id IS NULL GROUP BY 1, 2) SELECT run_id, {_pos("CASE WHEN theme <> 'No theme' AND findings > 1 THEN 0 ELSE 1 END, theme = 'No theme', theme")}, theme, findings FROM g""")
_spec("pill_counts", lambda f: V.pill_counts(V.filtered_findings(f, status="accepted", data_type="qualitative")), "findings", "SELECT run_id, coalesce(theme, 'No theme') AS theme, count(*) FILTER (duplicate_group_id IS NULL) AS findings, count(duplicate_group_id) AS duplicates FROM findings WHERE status = 'accepted' AND data_type = 'qualitative' GROUP BY 1, 2")
_spec("quality_tallies", V.quality_tallies, "synths", "SELECT run_id, " + ", ".join(f"count(*) FILTER ({c} = '{v}') AS {v}" for c, v in (("confidence_tier", "strong"), ("confidence_tier", "moderate"), ("confidence_tier", "exploratory"), ("quality_tier", "qualified"), ("quality_tier", "partial"), ("quality_tier", "finding"), ("review_status", "accepted"))) + ", count(*) FILTER (review_status <> 'accepted') AS rejected FROM synths GROUP BY 1")
_spec("priority_tallies", V.priority_tallies, "recs", "SELECT run_id, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'low') AS low FROM recs WHERE status <> 'rejected' GROUP BY 1")
_spec("insight_theme_counts", V.insight_theme_counts, "insights findings", f"WITH g AS (SELECT i.run_id, coalesce(theme, 'Uncategorized') AS theme, count(*) AS n FROM insights i JOIN findings f USING (finding_id) GROUP BY 1, 2) SELECT run_id, {_pos('n DESC, theme')}, theme, n FROM g")
_spec("findings_by_reach", lambda f: V.by_reach(f, f.select("finding_id", (F.col("finding_id") % 5).alias("speakers_with"), (F.col("finding_id") % 3 * 4).alias("speakers_total"))), "findings", f"""WITH r AS (SELECT *, CASE WHEN origin = 'coded' AND finding_id % 3 > 0 THEN (finding_id % 5)::DOUBLE / (finding_id % 3 * 4) END AS reach FROM findings) SELECT run_id, {_pos("reach DESC NULLS LAST, created_at, finding_id")}, finding_id FROM r""")
_spec("export_findings", lambda f, d: X.findings_sheet(f, d, accepted_only=True), "findings files", f"""SELECT run_id, {_pos("theme ASC NULLS LAST, created_at, finding_id")}, coalesce(theme, 'No theme') AS theme, CASE origin WHEN 'generated' THEN 'Generated (from data)' WHEN 'coded' THEN 'Coded (from transcript)' ELSE 'Stated (from report)' END AS origin, CASE data_type WHEN 'qualitative' THEN 'Qualitative' ELSE 'Quantitative' END AS data_type,
  CASE WHEN finding_kind IS NOT NULL THEN CASE finding_kind WHEN 'fact' THEN 'Fact' WHEN 'external_citation' THEN 'External citation' ELSE 'Stated insight' END WHEN pattern_type = 'outlier' THEN 'Outlier' ELSE coalesce(pattern_type, '') END AS kind, finding_text AS finding, 'Accepted' AS status, coalesce(a.source_filename, b.source_filename, '') AS source, CASE WHEN duplicate_group_id IS NULL THEN 'No' ELSE 'Yes' END AS possible_duplicate
FROM findings f LEFT JOIN (SELECT document_id, source_filename FROM files) a ON a.document_id = source_document_id LEFT JOIN (SELECT document_id, source_filename FROM files) b ON b.document_id = source_table_id WHERE status = 'accepted'""")
_spec("export_history", X.history_sheet, "finding_history insight_history", f"""SELECT run_id, {_pos("archived_at DESC, history_id DESC")}, finding_text AS finding, upper(left(status, 1)) || substr(status, 2) AS status, CASE WHEN headline IS NULL THEN '' ELSE headline || coalesce(' (' || quality_tier || ')', '') END AS insight, CASE archived_reason WHEN 'full_reprocess' THEN 'Reprocess all documents' ELSE 'Manual re-extract' END AS removed_by FROM finding_history LEFT JOIN insight_history USING (original_finding_id)""")
_spec("export_insights", X.insights_sheet, "insights findings verdicts", f"""WITH {_LATEST}, j AS (SELECT i.run_id, i.insight_id, f.theme, i.created_at, lv.verdict_tier, i.headline, i.observation, f.finding_text FROM insights i JOIN findings f USING (finding_id) JOIN lv USING (finding_id))
SELECT run_id, {_pos(_THEME + ", insight_id")}, coalesce(theme, 'No theme') AS theme, CASE verdict_tier WHEN 'robust' THEN 'Robust' WHEN 'use_with_caution' THEN 'Use with caution' ELSE verdict_tier END AS robustness, headline, observation, finding_text AS from_finding FROM j""")
_spec("export_recommendations", X.recommendations_sheet, "recs insights findings", f"""WITH j AS (SELECT r.*, i.headline, f.theme FROM recs r JOIN insights i USING (insight_id) JOIN findings f USING (finding_id)) SELECT run_id, {_pos(_THEME + ", rec_id")}, coalesce(theme, 'No theme') AS theme, upper(left(priority, 1)) || substr(priority, 2) AS priority, action_text AS action, upper(left(status, 1)) || substr(status, 2) AS status, headline AS from_insight FROM j""")
_spec("export_synthesized_insights", X.synths_sheet, "synths synth_sources insights findings", f"""WITH {_CHAIN} SELECT run_id, {_pos("quality_score DESC NULLS LAST, created_at, synth_id")}, upper(left(confidence_tier, 1)) || substr(confidence_tier, 2) AS confidence, CASE WHEN quality_tier IS NULL THEN 'Not yet scored' ELSE upper(left(quality_tier, 1)) || substr(quality_tier, 2) || ' (' || quality_score || '/25)' END AS quality,
  CASE review_status WHEN 'accepted' THEN 'Accepted' ELSE 'Rejected' END AS status, CASE action_plan_status WHEN 'has_action' THEN 'Has action' ELSE 'Retained, no action yet' END AS action_plan, headlines AS chain_of_evidence FROM synths JOIN chain USING (synth_id)""")
_spec("export_deck_pages", lambda r, i, f: X.deck_pages(X.recommendations_sheet(r, i, f), 4).select("run_id", "theme", "pos", "page"), "recs insights findings", f"""WITH j AS (SELECT r.*, f.theme FROM recs r JOIN insights i USING (insight_id) JOIN findings f USING (finding_id)), p AS (SELECT run_id, coalesce(theme, 'No theme') AS theme, {_pos(_THEME + ", rec_id")} FROM j) SELECT run_id, theme, pos, ((row_number() OVER (PARTITION BY run_id, theme ORDER BY pos) - 1) // 4)::BIGINT AS page FROM p""")


def _query(name: str):
    function, names, _ = _SPECS[name]
    return lambda spark, sf_dir: function(*tables(spark, sf_dir, *names))


QUERIES = {name: _query(name) for name in _SPECS}
ORACLE_SQL = {name: oracle(sql, *names) for name, (_, names, sql) in _SPECS.items()}
