"""Read models of the evidence store: each is a view of all runs at once, keyed by run_id.

``pos`` is a row's place in its run, from 1, in the order in which the view is
read; limits are on it.  Where a finding has several verdicts the latest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import code_key, jround
from tabulon.operators.evidence import cost_usd, discovery_class, latest_per_key, provenance_caption
from tabulon.plans.lineage import cut

#: Rows that each view shows or hands to a prompt.
HISTORY, FAILED, TO_INSIGHT, TO_SYNTHESIS, TO_RECOMMEND, CLAIMS, CHECKS, TO_SCORE, VARIABLES, METHOD_FILES, FRAMING = 200, 3, 60, 60, 60, 80, 30, 60, 60, 6, 120
CONTEXT = {"findings": 80, "insights": 60, "recommendations": 40}
NET_NEW, EVIDENCE = 12, 40
PASSED = ("robust", "use_with_caution")
#: Labels of exports.
ORIGIN_LABELS = {"generated": "Generated (from data)", "coded": "Coded (from transcript)", "stated": "Stated (from report)"}
KIND_LABELS = {"fact": "Fact", "own_finding": "Own finding", "external_citation": "External citation", "hypothesis": "Hypothesis", "methodology": "Methodology", "recommendation": "Recommendation", "stated_insight": "Stated insight"}
PATTERN_LABELS = {"segment_difference": "Segment difference", "trend": "Trend", "outlier": "Outlier", "relationship": "Relationship"}
REASON_LABELS = {"regenerate_unreviewed": "Regenerate unreviewed", "full_reprocess": "Reprocess all documents", "manual_reextract": "Manual re-extract"}
TIER_LABELS = {"robust": "Robust", "use_with_caution": "Use with caution"}


def placed(df: DataFrame, *order: Column, most: int | None = None) -> DataFrame:
    """``df`` with ``pos`` in its run; the first ``most`` of each run."""
    out = df.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    return out if most is None else out.where(F.col("pos") <= most)


def labelled(x: Column, names: dict[str, str], other: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if other is None else other
    for key, name in names.items():
        out = F.when(x == key, name).otherwise(out)
    return out


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    return latest_per_key(verdicts, ["finding_id"], F.desc("created_at"), F.desc("verdict_id")).drop("created_at", "verdict_id")


def flagged(df: DataFrame, key: str, other: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` plus whether its key stands in a column of another table."""
    keys = other.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.col(name).isNotNull())


def with_source(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the file they come from: that of the document, else of the table."""
    one, two = (files.select(F.col("document_id").alias(k), F.col("source_filename").alias(n)) for k, n in (("source_document_id", "f1"), ("source_table_id", "f2")))
    return findings.join(one, "source_document_id", "left").join(two, "source_table_id", "left").withColumn("source_filename", F.coalesce("f1", "f2")).drop("f1", "f2")


def findings_listing(findings: DataFrame, files: DataFrame, contradictions: DataFrame) -> DataFrame:
    out = with_source(findings, files)
    out = flagged(out, "finding_id", findings, "grounded_by_finding_id", "corroborates")
    out = flagged(out, "finding_id", contradictions, "original_id", "contradicted")
    out = flagged(out, "finding_id", contradictions, "contradicting_finding_id", "contradicts")
    return placed(out, F.col("created_at"), F.col("finding_id")).select("run_id", "pos", "finding_id", "source_filename", "corroborates", "contradicted", "contradicts")


def insights_listing(insights: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    own = flagged(findings, "finding_id", findings, "grounded_by_finding_id", "corroborates")
    both = insights.join(own.select("finding_id", "theme", "origin", "corroborates"), "finding_id").join(latest_verdicts(verdicts), "finding_id")
    report = F.col("origin").isin("stated", "coded") | F.col("corroborates")
    return placed(both, F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("insight_id")).select("run_id", "pos", "insight_id", "theme", "verdict_tier", "verification_basis", report.alias("from_report"), F.coalesce("caveats", F.lit("[]")).alias("caveats"))


def synth_members(synths: DataFrame, sources: DataFrame, insights: DataFrame, findings: DataFrame) -> DataFrame:
    """(synth_id, headlines, validated, net_new, themes, members) of synthesized insights with sources."""
    own = flagged(findings, "finding_id", findings, "grounded_by_finding_id", "corroborates").select("finding_id", "theme", discovery_class(F.col("origin"), F.col("corroborates")).alias("kind"))
    chain = sources.join(insights.select("insight_id", "finding_id", "headline", "created_at"), "insight_id").join(own, "finding_id").join(synths.select("synth_id"), "synth_id", "left_semi")
    lines = F.sort_array(F.collect_list(F.struct("created_at", "insight_id", "headline")))
    g = chain.groupBy("synth_id").agg(lines.alias("l"), F.count_if(F.col("kind") == "validated").alias("validated"), F.count_if(F.col("kind") == "net_new").alias("net_new"), F.count_distinct("theme").alias("themes"), F.count(F.lit(1)).alias("members"))
    return g.withColumn("headlines", F.array_join(F.transform("l", lambda x: x["headline"]), " | ")).drop("l")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "strong", 0).when(tier == "moderate", 1).otherwise(2)


def synths_listing(synths: DataFrame, sources: DataFrame, insights: DataFrame, findings: DataFrame, contradictions: DataFrame) -> DataFrame:
    against = contradictions.where("contradicting_synth_id IS NOT NULL").join(findings.select(F.col("finding_id").alias("original_id"), "finding_text"), "original_id")
    against = against.groupBy("run_id", F.col("contradicting_synth_id").alias("synth_id")).agg(F.count(F.lit(1)).alias("contradicts"))
    both = synths.join(synth_members(synths, sources, insights, findings), "synth_id").join(against, ["run_id", "synth_id"], "left").na.fill(0, ["contradicts"])
    order = [F.when(F.col("review_status") == "rejected", 1).otherwise(0), F.desc_nulls_last("quality_score"), tier_rank(F.col("confidence_tier")), F.desc("triangulation_count"), F.col("created_at"), F.col("synth_id")]
    return placed(both, *order).select("run_id", "pos", "synth_id", "headlines", provenance_caption(F.col("validated"), F.col("net_new")).alias("caption"), "contradicts")


def verdict_summary(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    both = verdicts.join(findings.select("finding_id", "run_id"), "finding_id")
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("verdicts"), F.count_if(F.col("verdict_tier").isin(*PASSED)).alias("passed"))


def failed_sample(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    both = verdicts.where(F.col("verdict_tier").isin("not_supported", "insufficient_information")).join(findings.select("finding_id", "run_id", "finding_text"), "finding_id")
    return placed(both, F.col("verdict_id"), most=FAILED).select("run_id", "pos", "verdict_id", "finding_text", "verdict_tier")


def named_findings(claims: DataFrame, findings: DataFrame, field: str, name: str) -> DataFrame:
    """(finding_id, texts) of the findings whose ids a JSON list in ``due_care`` holds, by time."""
    ids = F.from_json(F.get_json_object("due_care", f"$.{field}"), "array<bigint>")
    each = claims.select("finding_id", F.explode(ids).alias("other")).distinct().join(findings.select(F.col("finding_id").alias("other"), "finding_text", "created_at"), "other")
    g = each.groupBy("finding_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "other", "finding_text"))).alias("l"))
    return g.select("finding_id", F.array_join(F.transform("l", lambda x: x["finding_text"]), " | ").alias(name))


def contradictor_kind() -> Column:
    """What contradicts, from the columns ``by_text`` and ``by_origin``."""
    return F.when(F.col("by_text").isNull(), "net_new_insight").when(F.col("by_origin") == "generated", "net_new_finding").otherwise("report_claim")


def contradiction_listing(contradictions: DataFrame, findings: DataFrame, synths: DataFrame) -> DataFrame:
    """Contradictions with the contradictor's text and kind."""
    by = findings.select(F.col("finding_id").alias("contradicting_finding_id"), F.col("finding_text").alias("by_text"), F.col("origin").alias("by_origin"))
    both = contradictions.join(by, "contradicting_finding_id", "left").join(synths.select(F.col("synth_id").alias("contradicting_synth_id"), F.col("headline").alias("by_headline")), "contradicting_synth_id", "left")
    text = F.coalesce("by_text", "by_headline", F.lit("a synthesized insight"))
    return placed(both, F.col("created_at"), F.col("contradiction_id")).select("run_id", "pos", "contradiction_id", "original_id", text.alias("by_text"), contradictor_kind().alias("by_kind"), "rationale", "created_at")


def stated_validations(findings: DataFrame, verdicts: DataFrame, insights: DataFrame, contradictions: DataFrame, synths: DataFrame) -> DataFrame:
    claims = findings.where("finding_kind = 'stated_insight' AND status <> 'rejected'").join(latest_verdicts(verdicts), "finding_id", "left").join(insights.select("finding_id", "insight_id"), "finding_id", "left")
    out = claims.join(named_findings(claims, findings, "cited_finding_ids", "cited"), "finding_id", "left").join(named_findings(claims, findings, "relied_finding_ids", "relied"), "finding_id", "left")
    by = contradiction_listing(contradictions, findings, synths).groupBy("run_id", F.col("original_id").alias("finding_id")).agg(F.sort_array(F.collect_list(F.struct("created_at", "contradiction_id", "by_kind"))).alias("l"))
    out = out.join(by.select("run_id", "finding_id", F.array_join(F.transform("l", lambda x: x["by_kind"]), ",").alias("contradicted_by")), ["run_id", "finding_id"], "left").na.fill("", ["cited", "relied", "contradicted_by"])
    return placed(out, F.col("created_at"), F.col("finding_id")).select("run_id", "pos", "finding_id", "verdict_tier", F.col("insight_id").alias("elevated_insight_id"), "cited", "relied", "contradicted_by")


def recommendations_listing(recs: DataFrame, insights: DataFrame, findings: DataFrame) -> DataFrame:
    both = recs.join(insights.select("insight_id", "finding_id", "headline", "quality_score"), "insight_id").join(findings.select("finding_id", "theme"), "finding_id")
    return placed(both, F.desc_nulls_last("quality_score"), F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("rec_id")).select("run_id", "pos", "rec_id", "headline", "theme", "quality_score")


def synth_recommendations(recs: DataFrame, synths: DataFrame) -> DataFrame:
    both = recs.join(synths.select("synth_id", "headline", "confidence_tier", "quality_score"), "synth_id")
    return placed(both, F.desc_nulls_last("quality_score"), F.col("created_at"), F.col("rec_id")).select("run_id", "pos", "rec_id", "headline", "confidence_tier", "quality_score")


def parked_insights(synths: DataFrame, recs: DataFrame) -> DataFrame:
    done = recs.where("status = 'accepted' AND synth_id IS NOT NULL").select("synth_id")
    return placed(synths.where("review_status = 'accepted'").join(done, "synth_id", "left_anti"), F.col("created_at"), F.col("synth_id")).select("run_id", "pos", "synth_id", "action_plan_status")


def usage_by_agent(trace: DataFrame) -> DataFrame:
    tokens = {n: F.get_json_object("detail", f"$.{n}").try_cast("bigint") for n in ("input_tokens", "output_tokens")}
    g = trace.where("event = 'api_usage'").groupBy("run_id", F.get_json_object("detail", "$.agent").alias("agent")).agg(F.count(F.lit(1)).alias("calls"), *[F.coalesce(F.sum(t), F.lit(0)).alias(n) for n, t in tokens.items()])
    return placed(g, F.desc(F.col("input_tokens") + F.col("output_tokens")), F.col("agent")).select("run_id", "pos", "agent", "calls", "input_tokens", "output_tokens", jround(cost_usd(F.col("input_tokens"), F.col("output_tokens")), 6).alias("cost_usd"))


def history_listing(history: DataFrame, insight_history: DataFrame, most: int | None = HISTORY) -> DataFrame:
    both = history.join(insight_history, "original_finding_id", "left")
    return placed(both, F.desc("archived_at"), F.desc("history_id"), most=most)


def codebooks_in_force(codebooks: DataFrame) -> DataFrame:
    """The latest codebook of each document."""
    return latest_per_key(codebooks, ["doc"], F.desc("version"))


def codebook_view(codebooks: DataFrame, codes: DataFrame, assignments: DataFrame, segments: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc, version, versions, code_id, position, name, turns, speakers, theme, participant_turns, coded_turns) of the codes in force."""
    books = codebooks_in_force(codebooks)
    versions = codebooks.groupBy("doc").agg(F.count(F.lit(1)).alias("versions"))
    own = codes.join(books.select("codebook_id", "doc", "version"), "codebook_id")
    said = assignments.join(own.select("code_id"), "code_id", "left_semi").join(segments.select("segment_id", "speaker", "role"), "segment_id")
    counts = said.groupBy("code_id").agg(F.count_distinct("segment_id").alias("turns"), F.count_distinct("speaker").alias("speakers"))
    coded = assignments.join(own.select("code_id"), "code_id", "left_semi").select("segment_id").distinct().withColumn("coded", F.lit(True))
    turns = segments.join(coded, "segment_id", "left").groupBy("doc").agg(F.count_if(F.col("role") != "moderator").alias("participant_turns"), F.count("coded").alias("coded_turns"))
    named = own.withColumn("code_key", code_key(F.col("name"))).join(meta.select("doc", "code_key", "theme"), ["doc", "code_key"], "left")
    out = named.join(counts, "code_id", "left").join(versions, "doc").join(turns, "doc").na.fill(0, ["turns", "speakers"]).na.fill("", ["theme"])
    return out.select("doc", "version", "versions", "code_id", "position", "name", "turns", "speakers", "theme", "participant_turns", "coded_turns")


def open_coding_passes(manifest: DataFrame, codebooks: DataFrame) -> DataFrame:
    """(doc, passes, returned, kept, exact, near, none, truncated) of open coding for each document's latest induced codebook."""
    book = latest_per_key(codebooks.where("source = 'induced'"), ["doc"], F.desc("version")).select("codebook_id")
    rows = manifest.where("stage = 'open_coding'").join(book, "codebook_id", "left_semi")
    num = lambda path: F.coalesce(F.sum(F.get_json_object("detail", path).try_cast("bigint")), F.lit(0))
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("passes"), num("$.themes_returned").alias("returned"), num("$.themes_kept").alias("kept"), *[num(f"$.quotes.{m}").alias(m) for m in ("exact", "near", "none")], F.coalesce(F.max(F.get_json_object("detail", "$.input_truncated") == "true"), F.lit(False)).alias("truncated"))


def table_previews(file_tables: DataFrame) -> DataFrame:
    return placed(file_tables, F.col("document_id"), F.col("table_index")).select("run_id", "pos", "table_id", "document_id", "table_index", "ingestion_type")


def run_list(runs: DataFrame, findings: DataFrame) -> DataFrame:
    g = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings_total"), F.count_if(F.col("status") == "rejected").alias("findings_rejected"))
    both = runs.join(g, "run_id", "left").na.fill(0, ["findings_total", "findings_rejected"])
    return both.select("run_id", "project_name", "findings_total", "findings_rejected")


def programs_with_waves(programs: DataFrame, runs: DataFrame) -> DataFrame:
    waves = runs.where("program_id IS NOT NULL").groupBy("program_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "run_id", "project_name"))).alias("l"))
    named = waves.select("program_id", F.array_join(F.transform("l", lambda x: x["project_name"]), " | ").alias("waves"))
    return programs.join(named, "program_id", "left").select("program_id", "name", F.coalesce("waves", F.lit("")).alias("waves"))


def sibling_waves(runs: DataFrame) -> DataFrame:
    """(run_id, sibling_id, pos): the other runs of a run's program, by time."""
    others = runs.where("program_id IS NOT NULL").select("program_id", F.col("run_id").alias("sibling_id"), F.col("created_at").alias("at"))
    both = runs.select("run_id", "program_id").join(others, "program_id").where("run_id <> sibling_id")
    return placed(both, F.col("at"), F.col("sibling_id")).select("run_id", "pos", "sibling_id")


def unconfirmed_transcripts(files: DataFrame, settings: DataFrame) -> DataFrame:
    """Transcripts without settings or whose settings nobody confirmed."""
    both = files.where("kind = 'transcript'").join(settings.select("document_id", "setup_confirmed_at"), "document_id", "left").where("setup_confirmed_at IS NULL")
    return placed(both, F.col("uploaded_at"), F.col("document_id")).select("run_id", "pos", "document_id", "source_filename")


def latest_message(trace: DataFrame, events: list[str]) -> DataFrame:
    """(run_id, message) of the latest of some events; null if its detail has none."""
    last = latest_per_key(trace.where(F.col("event").isin(events)), ["run_id"], F.desc("occurred_at"), F.desc("event_id"))
    return last.select("run_id", F.get_json_object("detail", "$.message").alias("message"))


def process_errors(trace: DataFrame) -> DataFrame:
    """(run_id, event_id, errors) of the latest errors at or after a run's latest batch; none where the list is empty."""
    batch = trace.where("event = 'process_run_batch'").groupBy("run_id").agg(F.max("occurred_at").alias("since"))
    due = trace.where("event = 'process_run_errors'").join(batch, "run_id", "left").where("since IS NULL OR occurred_at >= since")
    last = latest_per_key(due, ["run_id"], F.desc("occurred_at"), F.desc("event_id"))
    errors = F.from_json(F.get_json_object("detail", "$.errors"), "array<string>")
    return last.where(F.size(errors) > 0).select("run_id", "event_id", F.array_join(errors, ",").alias("errors"))


def insight_eligibility(findings: DataFrame, verdicts: DataFrame, insights: DataFrame, most: int = TO_INSIGHT) -> DataFrame:
    passed = latest_verdicts(verdicts).where(F.col("verdict_tier").isin(*PASSED)).select("finding_id", "verdict_tier")
    open_ = findings.where("status <> 'rejected'").join(passed, "finding_id").join(insights.select("finding_id"), "finding_id", "left_anti")
    return placed(open_, F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("finding_id"), most=most).select("run_id", "pos", "finding_id", "verdict_tier")


def synthesis_pool(insights: DataFrame, findings: DataFrame, sources: DataFrame, most: int = TO_SYNTHESIS) -> DataFrame:
    """Insights that no synthesis uses yet, and how many there are in the run beyond the limit."""
    free = insights.join(sources.select("insight_id"), "insight_id", "left_anti").join(findings.select("finding_id", "theme"), "finding_id")
    counted = free.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("run_id")))
    return placed(counted, F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("insight_id"), most=most).select("run_id", "pos", "insight_id", "total")


def recommendation_pool(insights: DataFrame, findings: DataFrame, recs: DataFrame, runs: DataFrame, most: int = TO_RECOMMEND) -> DataFrame:
    """Insights without a recommendation, in runs with a decision."""
    decided = runs.where("decision_statement IS NOT NULL").select(F.col("run_id").cast("long").alias("run_id"))
    free = insights.join(recs.select("insight_id"), "insight_id", "left_anti").join(findings.select("finding_id", "theme"), "finding_id").join(decided, "run_id", "left_semi")
    return placed(free, F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("insight_id"), most=most).select("run_id", "pos", "insight_id")


def synth_recommendation_pool(synths: DataFrame, sources: DataFrame, insights: DataFrame, findings: DataFrame, recs: DataFrame, most: int = TO_RECOMMEND) -> DataFrame:
    free = synths.where("review_status = 'accepted' AND action_plan_status = 'has_action'").join(recs.select("synth_id"), "synth_id", "left_anti")
    both = free.join(synth_members(synths, sources, insights, findings).select("synth_id", "headlines"), "synth_id")
    return placed(both, F.col("created_at"), F.col("synth_id"), most=most).select("run_id", "pos", "synth_id", "headlines")


def claims_to_compare(findings: DataFrame, most: int = CLAIMS) -> DataFrame:
    """Report claims that insights are held against; ``truncated`` where the run has more than the limit."""
    claims = findings.where("origin IN ('stated', 'coded') AND status <> 'rejected' AND coalesce(finding_kind, '') <> 'external_citation'")
    counted = claims.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy("run_id")) > most)
    return placed(counted, F.col("created_at"), F.col("finding_id"), most=most).select("run_id", "pos", "finding_id", "truncated")


def insights_to_check(synths: DataFrame, most: int = CHECKS) -> DataFrame:
    due = synths.where("review_status <> 'rejected' AND contradiction_checked_at IS NULL")
    return placed(due, F.col("created_at"), F.col("synth_id"), most=most).select("run_id", "pos", "synth_id")


def scoring_pool(insights: DataFrame, synths: DataFrame, sources: DataFrame, recs: DataFrame, most: int = TO_SCORE) -> DataFrame:
    """(run_id, what, pos, id) of insights, synthesized insights with sources and recommendations on them that have no score."""
    one = placed(insights.where("quality_score IS NULL"), F.col("created_at"), F.col("insight_id"), most=most).select("run_id", F.lit("insight").alias("what"), "pos", F.col("insight_id").alias("id"))
    used = sources.join(insights.select("insight_id"), "insight_id", "left_semi").select("synth_id")
    two = placed(synths.where("quality_score IS NULL").join(used, "synth_id", "left_semi"), F.col("created_at"), F.col("synth_id"), most=most).select("run_id", F.lit("synth"), "pos", "synth_id")
    three = placed(recs.where("status <> 'rejected' AND rec_quality_score IS NULL").join(synths.select("synth_id"), "synth_id", "left_semi"), F.col("created_at"), F.col("rec_id"), most=most).select("run_id", F.lit("recommendation"), "pos", "rec_id")
    return one.union(two).union(three)


def evidence_inventory(files: DataFrame, findings: DataFrame, file_tables: DataFrame, most: int = VARIABLES) -> DataFrame:
    """(run_id, what, name, n): files by kind, findings by origin and type, and the first sixty variable names of tables."""
    docs = files.groupBy("run_id", F.lit("document").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    found = findings.where("status <> 'rejected'").groupBy("run_id", F.lit("finding").alias("what"), F.concat_ws(" ", "origin", "data_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    heads = file_tables.select("run_id", "table_id", F.posexplode(F.from_json("headers", "array<string>")).alias("at", "name")).where("trim(name) <> ''")
    first = heads.groupBy("run_id", "name").agg(F.min(F.struct("table_id", "at")).alias("first"))
    variables = placed(first, F.col("first"), most=most).select("run_id", F.lit("variable").alias("what"), "name", F.col("pos").cast("long").alias("n"))
    return docs.union(found).union(variables)


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def narrative_recommendations(recs: DataFrame, synths: DataFrame) -> DataFrame:
    both = recs.where("status = 'accepted'").join(synths.select("synth_id"), "synth_id", "left_semi")
    return placed(both, priority_rank(F.col("priority")), F.col("created_at"), F.col("rec_id")).select("run_id", "pos", "rec_id", "priority")


def unmapped_insights(synths: DataFrame, validations: DataFrame) -> DataFrame:
    """Accepted synthesized insights that no objective item of their run names."""
    named = validations.select(F.col("run_id").cast("long").alias("run_id"), F.explode(F.from_json("synth_ids", "array<bigint>")).alias("synth_id"))
    return synths.where("review_status = 'accepted'").join(named, ["run_id", "synth_id"], "left_anti").select("run_id", "synth_id", "headline")


def accepted_findings(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accepted findings whose verdict passed, by theme and time."""
    passed = latest_verdicts(verdicts).where(F.col("verdict_tier").isin(*PASSED)).select("finding_id", "verdict_tier")
    return placed(findings.where("status = 'accepted'").join(passed, "finding_id"), F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("finding_id"))


def assistant_context(findings: DataFrame, verdicts: DataFrame, synths: DataFrame, recs: DataFrame) -> DataFrame:
    """(run_id, what, pos, id): what a chat is told of a run, within the limits."""
    one = accepted_findings(findings, verdicts).where(F.col("pos") <= CONTEXT["findings"]).select("run_id", F.lit("finding").alias("what"), "pos", F.col("finding_id").alias("id"))
    two = placed(synths.where("review_status = 'accepted'"), F.col("created_at"), F.col("synth_id"), most=CONTEXT["insights"]).select("run_id", F.lit("insight"), "pos", "synth_id")
    three = placed(recs.where("status = 'accepted'"), priority_rank(F.col("priority")), F.col("created_at"), F.col("rec_id"), most=CONTEXT["recommendations"]).select("run_id", F.lit("recommendation"), "pos", "rec_id")
    return one.union(two).union(three)


def methodology_files(files: DataFrame, most: int = METHOD_FILES) -> DataFrame:
    fit = files.where("kind IN ('evidence', 'report') AND length(extracted_text) > 50")
    return placed(fit, F.col("kind"), F.col("uploaded_at"), F.col("document_id"), most=most).select("run_id", "pos", "document_id", "kind")


def framing_evidence(insights: DataFrame, findings: DataFrame, most: int = FRAMING) -> DataFrame:
    both = insights.join(findings.select("finding_id", "theme"), "finding_id")
    return placed(both, F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("insight_id"), most=most).select("run_id", "pos", "insight_id", "theme")


def meta_maps(meta: DataFrame) -> DataFrame:
    """(doc, themes): each document's codes and their themes as one map."""
    return meta.groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code_key", "theme")))).alias("themes"))


def evidence_pool(claims: DataFrame, findings: DataFrame, verdicts: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(claim_id, index, finding_id): what a claim (claim_id, run_id, theme, cited array) is judged against: cited first, then its theme, then by time.

    A claim doesn't meet all findings of its run: what isn't cited is among the
    run's first ``most`` by time, or among its theme's first ``most`` there, so
    a claim sorts those two lists and what it cites.
    """
    live = findings.where("finding_kind <> 'stated_insight' AND status <> 'rejected'").join(verdicts.select("finding_id").distinct(), "finding_id", "left_semi")
    stored = cut(live.select("run_id", "finding_id", F.col("theme").alias("own_theme"), "created_at"))
    row = F.struct("created_at", "finding_id", "own_theme")

    def first(*keys: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "finding_id"))
        return stored.withColumn("k", k).where(F.col("k") <= most).groupBy(*keys).agg(F.collect_list(row).alias("l"))

    run = first("run_id").select("run_id", F.col("l").alias("of_run"))
    theme = first("run_id", "own_theme").select(F.col("run_id").alias("r"), "own_theme", F.col("l").alias("of_theme"))
    named = claims.select("claim_id", "run_id", F.explode(F.array_distinct("cited")).alias("finding_id")).join(stored, ["run_id", "finding_id"])
    cited = named.groupBy("claim_id").agg(F.collect_list(row).alias("of_claim"))
    both = claims.join(run, "run_id").join(theme, (F.col("run_id") == F.col("r")) & F.col("theme").eqNullSafe(F.col("own_theme")), "left").join(cited, "claim_id", "left")
    none = F.array().cast(run.schema["of_run"].dataType)
    known = F.array_distinct(F.concat(F.coalesce("of_claim", none), F.coalesce("of_theme", none), "of_run"))
    order = lambda x: F.struct(F.when(F.array_contains("cited", x["finding_id"]), 0).otherwise(1), F.when(x["own_theme"].eqNullSafe(F.col("theme")), 0).otherwise(1), x["created_at"], x["finding_id"].alias("finding_id"))
    return both.select("claim_id", F.posexplode(F.slice(F.sort_array(F.transform(known, order)), 1, most)).alias("index", "x")).select("claim_id", "index", "x.finding_id")


def discovery_report(synths: DataFrame, sources: DataFrame, insights: DataFrame, findings: DataFrame, verdicts: DataFrame, most: int = NET_NEW) -> DataFrame:
    """(run_id, what, pos, id, omitted): accepted synthesized insights and computed findings that no claim rests on, twelve listed and the rest counted."""
    kept = synths.where("review_status = 'accepted'").join(synth_members(synths, sources, insights, findings).select("synth_id"), "synth_id")
    one = placed(kept, F.desc_nulls_last("quality_score"), F.col("created_at"), F.col("synth_id")).select("run_id", F.lit("insight").alias("what"), "pos", F.col("synth_id").alias("id"), F.lit(0).cast("long").alias("omitted"))
    new = flagged(findings.where("origin = 'generated' AND status = 'accepted'"), "finding_id", findings, "grounded_by_finding_id", "used").where("NOT used")
    passed = latest_verdicts(verdicts).where(F.col("verdict_tier").isin(*PASSED)).select("finding_id", "verdict_tier")
    both = new.join(passed, "finding_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run_id")))
    two = placed(both, F.when(F.col("verdict_tier") == "robust", 0).otherwise(1), F.col("theme").asc_nulls_last(), F.col("created_at"), F.col("finding_id"), most=most).select("run_id", F.lit("finding"), "pos", "finding_id", F.greatest(F.lit(0), F.col("n") - most).cast("long"))
    return one.union(two)


def filtered_findings(findings: DataFrame, **equal: str) -> DataFrame:
    """Findings whose columns have the given values; those not named are free."""
    out = findings
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out


def theme_groups(findings: DataFrame) -> DataFrame:
    """(run_id, pos, theme, findings): themes of several findings first, by name, then single ones and those without a theme; duplicates stand elsewhere."""
    name = F.coalesce("theme", F.lit("No theme"))
    g = findings.where("duplicate_group_id IS NULL").groupBy("run_id", name.alias("theme")).agg(F.count(F.lit(1)).alias("findings"))
    none = F.col("theme") == "No theme"
    return placed(g, F.when(~none & (F.col("findings") > 1), 0).otherwise(1), none, F.col("theme")).select("run_id", "pos", "theme", "findings")


def pill_counts(findings: DataFrame) -> DataFrame:
    """(run_id, theme, findings, duplicates): counts behind the theme filter, which ignore that filter."""
    name = F.coalesce("theme", F.lit("No theme"))
    return findings.groupBy("run_id", name.alias("theme")).agg(F.count_if(F.col("duplicate_group_id").isNull()).alias("findings"), F.count("duplicate_group_id").alias("duplicates"))


def quality_tallies(synths: DataFrame) -> DataFrame:
    count = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    return synths.groupBy("run_id").agg(*[count("confidence_tier", v) for v in ("strong", "moderate", "exploratory")], *[count("quality_tier", v) for v in ("qualified", "partial", "finding")], count("review_status", "accepted"), F.count_if(F.col("review_status") != "accepted").alias("rejected"))


def priority_tallies(recs: DataFrame) -> DataFrame:
    return recs.where("status <> 'rejected'").groupBy("run_id").agg(*[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium", "low")])


def insight_theme_counts(insights: DataFrame, findings: DataFrame) -> DataFrame:
    g = insights.join(findings.select("finding_id", "theme"), "finding_id").groupBy("run_id", F.coalesce("theme", F.lit("Uncategorized")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    return placed(g, F.desc("n"), F.col("theme")).select("run_id", "pos", "theme", "n")


def by_reach(findings: DataFrame, reach: DataFrame) -> DataFrame:
    """(run_id, pos, finding_id): the share of speakers (finding_id, speakers_with, speakers_total) first, findings without one last in their order."""
    both = findings.join(reach, "finding_id", "left")
    share = F.when((F.col("origin") == "coded") & (F.col("speakers_total") > 0), F.col("speakers_with") / F.col("speakers_total"))
    return placed(both, F.desc_nulls_last(share), F.col("created_at"), F.col("finding_id")).select("run_id", "pos", "finding_id")


def verbatims(segments: DataFrame, codes: DataFrame) -> DataFrame:
    """Participants' turns with the sorted list of their codes (doc, idx, code)."""
    own = codes.groupBy("doc", "idx").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return segments.where("role <> 'moderator'").join(own, ["doc", "idx"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def search_verbatims(rows: DataFrame, text: str = "", code: str | None = None, uncoded: bool = False) -> DataFrame:
    """Verbatims with a code, with none, or all, whose text or speaker holds the words, case aside."""
    out = rows.where(F.size("codes") == 0) if uncoded else rows if code is None else rows.where(F.array_contains("codes", code))
    q = F.lit(text.strip().lower())
    return out.where(F.contains(F.lower("text"), q) | F.contains(F.lower(F.coalesce("speaker", F.lit(""))), q))


def finding_counts(findings: DataFrame, stats: DataFrame, groups: DataFrame, rollup: DataFrame) -> DataFrame:
    """Code counts behind coded findings (finding_id, doc, code): those of the code, its focus groups and its theme."""
    return findings.join(stats, ["doc", "code"]).join(groups, "code", "left").join(rollup, ["doc", "code"], "left")
