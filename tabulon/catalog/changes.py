"""Queries of the state changes and evidence rules over the fixture tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog.fixtures import oracle, tables
from tabulon.operators import changes as C
from tabulon.operators import coding as Q
from tabulon.operators import evidence as E
from tabulon.operators import views as V

_SPECS: dict[str, tuple] = {}


def _spec(name: str, function, names: str, sql: str) -> None:
    _SPECS[name] = (function, names.split(), sql)


_LATEST = "lv AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, verdict_id DESC) = 1)"
_KEY = "lower(regexp_replace(trim(name), '\\s+', ' ', 'g'))"
_CUTTAG = "CASE WHEN {n} < 30 THEN 2 WHEN {n} < 50 THEN 1 ELSE 0 END"
_BOOKS = "books AS (SELECT * FROM codebooks QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1)"
_LINKED = "EXISTS (SELECT 1 FROM findings g WHERE g.grounded_by_finding_id = f.finding_id)"


def _caveats(findings):
    return findings.withColumn("caveats", F.array("caveat"))


_CAUTION = f"CASE WHEN n1 IS NULL OR n2 IS NULL THEN 'base_size_unknown' WHEN greatest({_CUTTAG.format(n='n1')}, {_CUTTAG.format(n='n2')}) = 2 THEN 'base_size_small' WHEN greatest({_CUTTAG.format(n='n1')}, {_CUTTAG.format(n='n2')}) = 1 THEN 'base_size_borderline' END"
_spec("computed_verdicts", lambda f: E.computed_verdicts(_caveats(f)), "findings", f"""WITH c AS (SELECT *, {_CAUTION} AS caution FROM findings WHERE status <> 'rejected')
SELECT finding_id, CASE WHEN caveat = 'not_significant' THEN 'not_supported' WHEN caution IS NOT NULL THEN 'use_with_caution' ELSE 'robust' END AS tier, finding_id AS basis_id FROM c WHERE origin = 'generated' AND has_stats
UNION ALL SELECT a.finding_id, CASE WHEN b.caution IS NOT NULL THEN 'use_with_caution' ELSE 'robust' END, b.finding_id FROM c a JOIN c b ON b.finding_id = a.grounded_by_finding_id AND b.has_stats WHERE NOT (a.origin = 'generated' AND a.has_stats) AND coalesce(a.finding_kind, '') <> 'stated_insight'""")
_spec("corroboration", E.corroboration, "findings", """WITH c AS (SELECT *, coalesce(source_document_id::VARCHAR, 't' || source_table_id, 'f' || finding_id) AS src FROM findings WHERE status <> 'rejected'), g AS (SELECT duplicate_group_id, count(DISTINCT src) AS n FROM c WHERE duplicate_group_id IS NOT NULL GROUP BY 1)
SELECT finding_id, CASE WHEN g.n > 1 OR grounded_by_finding_id IN (SELECT finding_id FROM c) THEN 'cross_source_corroborated' ELSE 'single_source' END AS level FROM c LEFT JOIN g USING (duplicate_group_id)""")
_spec("discovery_class", lambda f: V.flagged(f, "finding_id", f, "grounded_by_finding_id", "used").select("finding_id", E.discovery_class(F.col("origin"), F.col("used")).alias("kind"), E.verification_basis(F.col("origin"), F.col("grounded_by_finding_id").isNotNull(), F.col("finding_id") % 12 == 0).alias("basis")), "findings", f"""SELECT finding_id, CASE WHEN origin IN ('stated', 'coded') OR {_LINKED} THEN 'validated' ELSE 'net_new' END AS kind, CASE WHEN origin = 'generated' OR grounded_by_finding_id IS NOT NULL OR finding_id % 12 = 0 THEN 'data_backed' ELSE 'report_only' END AS basis FROM findings f""")
_spec("contradiction_downgrade", lambda v, c: E.downgrade_contradicted(v.withColumnRenamed("verdict_tier", "tier"), c.select("original_id", F.col("contradiction_id").alias("contradicting_id"), "created_at")).select("finding_id", "verdict_id", "tier", "previous_tier", "contradicting_id"), "verdicts contradictions", f"""WITH {_LATEST}, c AS (SELECT original_id, contradiction_id FROM contradictions QUALIFY row_number() OVER (PARTITION BY original_id ORDER BY created_at, contradiction_id) = 1)
SELECT finding_id, verdict_id, CASE WHEN c.original_id IS NULL THEN verdict_tier ELSE 'not_supported' END AS tier, CASE WHEN c.original_id IS NOT NULL THEN verdict_tier END AS previous_tier, contradiction_id AS contradicting_id FROM lv LEFT JOIN c ON original_id = finding_id""")
_spec("record_contradictions", lambda c: E.record_contradictions(c.where("contradiction_id % 2 = 0"), c).select("contradiction_id"), "contradictions", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY original_id, contradicting_finding_id, contradicting_synth_id ORDER BY contradiction_id) AS k FROM contradictions)
SELECT contradiction_id FROM contradictions WHERE contradiction_id % 2 = 0 UNION ALL SELECT contradiction_id FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM contradictions o WHERE o.contradiction_id % 2 = 0 AND o.original_id = n.original_id AND o.contradicting_finding_id IS NOT DISTINCT FROM n.contradicting_finding_id AND o.contradicting_synth_id IS NOT DISTINCT FROM n.contradicting_synth_id)""")
_spec("refreshed_duplicates", E.refreshed_duplicates, "findings", "")
_spec("candidate_review", lambda c: C.review_candidates(c, c.select("candidate_id", F.when(F.col("candidate_id") % 6 == 0, "accept").when(F.col("candidate_id") % 6 == 1, "reject").when(F.col("candidate_id") % 6 == 2, "restore").when(F.col("candidate_id") % 6 == 3, "delete").alias("action"), F.when(F.col("candidate_id") % 12 == 0, " new text ").otherwise("").alias("text")).where("action IS NOT NULL")).select("candidate_id", "candidate_text", "status", "edited"), "candidates", """SELECT candidate_id, CASE WHEN candidate_id % 12 = 0 THEN 'new text' ELSE candidate_text END AS candidate_text, CASE WHEN candidate_id % 6 IN (0, 2) THEN 'accepted' WHEN candidate_id % 6 = 1 THEN 'rejected' ELSE status END AS status, CASE WHEN candidate_id % 6 = 0 THEN candidate_id % 12 = 0 ELSE edited END AS edited FROM candidates WHERE candidate_id % 6 <> 3""")
_spec("candidate_regenerate", lambda c, r: C.regenerate_candidates(c, r.where("run_id % 2 = 0"), r.where("run_id % 2 = 0").select((F.col("run_id") + 100_000).cast("long").alias("candidate_id"), "run_id", F.lit("decision").alias("kind"), F.lit("fresh").alias("candidate_text"), F.lit(0).cast("long").alias("created_at"))).select("candidate_id", "run_id", "status", "candidate_text"), "candidates runs", """SELECT candidate_id, run_id, status, candidate_text FROM candidates WHERE NOT (run_id % 2 = 0 AND source = 'ai_suggested' AND status <> 'rejected' AND NOT edited) UNION ALL SELECT run_id + 100000, run_id, 'accepted', 'fresh' FROM runs WHERE run_id % 2 = 0""")
_spec("candidate_add", lambda c: C.add_candidates(c, c.select((F.col("candidate_id") + 500_000).alias("candidate_id"), "run_id", "kind", F.when(F.col("candidate_id") % 2 == 0, " own ").otherwise(" ").alias("candidate_text"), "created_at")).select("candidate_id", "candidate_text", "source", "status"), "candidates", "SELECT candidate_id, candidate_text, source, status FROM candidates UNION ALL SELECT candidate_id + 500000, 'own', 'researcher_authored', 'accepted' FROM candidates WHERE candidate_id % 2 = 0")
_spec("derived_statements", C.derived_statements, "candidates runs", """WITH a AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY run_id, kind) AS n FROM candidates WHERE status = 'accepted' WINDOW w AS (PARTITION BY run_id, kind ORDER BY created_at, candidate_id)),
s AS (SELECT run_id, kind, string_agg(CASE WHEN n = 1 THEN candidate_text ELSE k || '. ' || candidate_text END, chr(10) ORDER BY k) AS statement FROM a GROUP BY 1, 2) SELECT r.run_id, k.kind, statement FROM runs r CROSS JOIN (VALUES ('decision'), ('objective')) k(kind) LEFT JOIN s ON s.run_id = r.run_id AND s.kind = k.kind""")
_spec("recommendation_review", lambda r: C.review_recommendations(r, r.select("rec_id", F.when(F.col("rec_id") % 5 == 0, "edit").when(F.col("rec_id") % 5 == 1, "reject").otherwise("accept").alias("action"), F.lit("edited").alias("text")), ["rec_actionability_score", "rec_feasibility_score", "rec_evidence_score", "rec_quality_score"]).select("rec_id", "status", "edited", "action_text", "rec_quality_score"), "recs", "SELECT rec_id, CASE WHEN rec_id % 5 = 1 THEN 'rejected' ELSE 'accepted' END AS status, edited OR rec_id % 5 = 0 AS edited, CASE WHEN rec_id % 5 = 0 THEN 'edited' ELSE action_text END AS action_text, CASE WHEN rec_id % 5 <> 0 THEN rec_quality_score END AS rec_quality_score FROM recs")
_spec("recommendation_add", lambda r, s: C.add_recommendations(r, s.select((F.col("synth_id") + 700_000).alias("rec_id"), "run_id", F.lit(None).cast("long").alias("insight_id"), F.when(F.col("synth_id") % 2 == 0, F.col("synth_id")).alias("synth_id"), F.lit("high").alias("priority"), F.lit("do").alias("action_text"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "accepted").alias("accepted")), "recs synths", "SELECT source, count(*) AS n, count(*) FILTER (status = 'accepted') AS accepted FROM (SELECT source, status FROM recs UNION ALL SELECT 'researcher_authored', 'accepted' FROM synths WHERE synth_id % 2 = 0) u GROUP BY 1")


def _synth_review(synths, sources, insights):
    empty = synths.limit(0).select("synth_id", "run_id", "headline", "review_status", F.lit("").alias("source_headlines"), F.lit("").alias("archived_reason"))
    change = synths.select("synth_id", F.when(F.col("synth_id") % 4 == 0, "delete").when(F.col("synth_id") % 4 == 1, "accept").otherwise("reject").alias("action")).where("synth_id % 5 <> 0")
    kept, history = C.review_synths(synths, change, empty, sources, insights)
    return kept.select("synth_id", "review_status", F.lit(None).cast("string").alias("source_headlines")).union(history.select("synth_id", F.lit("archived"), "source_headlines"))


_spec("synth_review", _synth_review, "synths synth_sources insights", """WITH h AS (SELECT synth_id, string_agg(headline, ' | ' ORDER BY created_at, insight_id) AS t FROM synth_sources JOIN (SELECT insight_id, headline, created_at FROM insights) i USING (insight_id) GROUP BY 1)
SELECT synth_id, CASE WHEN synth_id % 5 = 0 THEN review_status WHEN synth_id % 4 = 1 THEN 'accepted' ELSE 'rejected' END AS review_status, NULL AS source_headlines FROM synths WHERE synth_id % 5 = 0 OR synth_id % 4 <> 0 UNION ALL SELECT synth_id, 'archived', coalesce(t, '') FROM synths LEFT JOIN h USING (synth_id) WHERE synth_id % 5 <> 0 AND synth_id % 4 = 0""")


def _edits(findings):
    each = [(3, "status", "rejected", 1), (4, "theme", "New", 1), (4, "theme", "Newer", 2), (6, "finding_kind", "fact", 1), (6, "note", "  ", 1), (9, "note", " look ", 1)]
    rows = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(a).alias("at")) for m, f, v, a in each])
    changes = findings.select("finding_id", F.explode(rows).alias("e")).select("finding_id", "e.*").where("finding_id % m = 0")
    return C.edit_findings(findings.withColumn("note", F.lit("n")), changes).select("finding_id", "status", "theme", "finding_kind", "note")


_spec("finding_edits", _edits, "findings", "SELECT finding_id, CASE WHEN finding_id % 3 = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN finding_id % 4 = 0 THEN 'Newer' ELSE theme END AS theme, CASE WHEN finding_id % 6 = 0 THEN 'fact' ELSE finding_kind END AS finding_kind, CASE WHEN finding_id % 18 = 0 THEN 'look' WHEN finding_id % 6 = 0 THEN NULL WHEN finding_id % 9 = 0 THEN 'look' ELSE 'n' END AS note FROM findings WHERE finding_id % 18 <> 0 UNION ALL SELECT finding_id, 'rejected', CASE WHEN finding_id % 4 = 0 THEN 'Newer' ELSE theme END, 'fact', 'look' FROM findings WHERE finding_id % 18 = 0")
_spec("finding_bulk_status", lambda f: C.set_statuses(f, f.where("origin = 'coded'"), "accepted").groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n")), "findings", "SELECT run_id, CASE WHEN origin = 'coded' THEN 'accepted' ELSE status END AS status, count(*) AS n FROM findings GROUP BY 1, 2")
_spec("reverify", lambda v, f, r: C.reverify(v, f, r.where("run_id < 5"), E.computed_verdicts(_caveats(f)).select("finding_id", "tier")).groupBy("verdict_tier").agg(F.count(F.lit(1)).alias("n")), "verdicts findings runs", f"""WITH c AS (SELECT *, {_CAUTION} AS caution FROM findings WHERE status <> 'rejected'), fresh AS (SELECT finding_id, CASE WHEN caveat = 'not_significant' THEN 'not_supported' WHEN caution IS NOT NULL THEN 'use_with_caution' ELSE 'robust' END AS tier FROM c WHERE origin = 'generated' AND has_stats
UNION ALL SELECT a.finding_id, CASE WHEN b.caution IS NOT NULL THEN 'use_with_caution' ELSE 'robust' END FROM c a JOIN c b ON b.finding_id = a.grounded_by_finding_id AND b.has_stats WHERE NOT (a.origin = 'generated' AND a.has_stats) AND coalesce(a.finding_kind, '') <> 'stated_insight')
SELECT tier AS verdict_tier, count(*) AS n FROM (SELECT verdict_tier AS tier FROM verdicts WHERE finding_id NOT IN (SELECT finding_id FROM findings WHERE run_id < 5) UNION ALL SELECT tier FROM fresh WHERE finding_id IN (SELECT finding_id FROM findings WHERE run_id < 5)) u GROUP BY 1""")
_spec("codebook_insert", lambda b: C.insert_codebooks(b, b.where("version = 1").select((F.col("codebook_id") + 5).alias("codebook_id"), "doc", "run_id", F.lit("imported").alias("source"))).select("codebook_id", "doc", F.col("version").cast("int").alias("version"), "source"), "codebooks", "SELECT codebook_id, doc, version, source FROM codebooks UNION ALL SELECT codebook_id + 5, doc, (SELECT max(version) + 1 FROM codebooks x WHERE x.doc = b.doc), 'imported' FROM codebooks b WHERE version = 1")


def _restore(codebooks, codes, assignments):
    books, own, placed = C.restore_codebooks(codebooks, codes, assignments, codebooks.where("version = 1").select("codebook_id", F.lit(1_000_000).alias("restored")))
    n = placed.groupBy("code_id").agg(F.count(F.lit(1)).alias("turns"))
    return own.join(books.select("codebook_id", "version"), "codebook_id").join(n, "code_id", "left").select("codebook_id", F.col("version").cast("int").alias("version"), "code_id", "name", F.coalesce("turns", F.lit(0)).alias("turns"))


_spec("codebook_restore", _restore, "codebooks codes assignments", """WITH m AS (SELECT doc, max(version) AS v FROM codebooks GROUP BY 1), n AS (SELECT code_id, count(*) AS turns FROM assignments GROUP BY 1), o AS (SELECT c.codebook_id, version, code_id, name, coalesce(turns, 0) AS turns, doc FROM codes c JOIN codebooks USING (codebook_id) LEFT JOIN n USING (code_id))
SELECT codebook_id, version, code_id, name, turns FROM o UNION ALL SELECT codebook_id + 1000000, v + 1, code_id + 10000000, name, turns FROM o JOIN m USING (doc) WHERE version = 1 AND v > 1""")
_spec("segments_replace", lambda s: C.replace_partition(s, s.where("doc % 3 = 0 AND idx = 0").withColumn("text", F.lit("new")), "doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("last")).select("doc", "n", F.when(F.col("last") == "new", True).otherwise(False).alias("replaced")), "segments", "SELECT doc, CASE WHEN doc % 3 = 0 AND count(*) FILTER (idx = 0) > 0 THEN count(*) FILTER (idx = 0) ELSE count(*) END AS n, CASE WHEN doc % 3 = 0 AND count(*) FILTER (idx = 0) > 0 THEN true ELSE max(text) = 'new' END AS replaced FROM segments GROUP BY doc")


def _add_codes(codes, codebooks):
    new = codebooks.select((F.col("codebook_id") * 10 + 9).alias("code_id"), "codebook_id", F.when(F.col("doc") % 2 == 0, " TASTE notes ").otherwise("Care").alias("name"), F.lit("d").alias("definition"))
    return C.add_codes(codes, codebooks, new).select("code_id", "codebook_id", F.col("position").cast("int").alias("position"), "name", "added_by_researcher")


_spec("code_add", _add_codes, "codes codebooks", f"""WITH {_BOOKS} SELECT code_id, codebook_id, position, name, added_by_researcher FROM codes UNION ALL SELECT codebook_id * 10 + 9, codebook_id, (SELECT max(position) + 1 FROM codes c WHERE c.codebook_id = b.codebook_id), 'Care', true FROM books b WHERE doc % 2 <> 0""")


def _turn_changes(segments):
    own = segments.where("role <> 'moderator'").select("doc", "idx", F.lit("c").alias("code"))
    held = own.where("idx % 3 < 2").withColumn("source", F.when(F.col("idx") % 3 == 0, "model").otherwise("researcher"))
    noted = own.where("idx % 3 = 1").withColumn("action", F.lit("add")).union(own.where("idx % 6 = 2").withColumn("action", F.lit("remove")))
    asked = own.where("doc % 2 = 0").withColumn("action", F.lit("add")).union(own.where("doc % 2 = 1").withColumn("action", F.lit("remove")))
    held, noted = C.change_codes(held, noted, asked)
    return held.join(noted, ["doc", "idx", "code"], "full").select("doc", "idx", "source", "action")


_spec("turn_code_changes", _turn_changes, "segments", """WITH s AS (SELECT doc, idx, idx % 3 AS m, CASE WHEN idx % 3 = 0 THEN 'model' WHEN idx % 3 = 1 THEN 'researcher' END AS src, CASE WHEN idx % 3 = 1 THEN 'add' WHEN idx % 6 = 2 THEN 'remove' END AS prior FROM segments WHERE role <> 'moderator'),
r AS (SELECT doc, idx, CASE WHEN doc % 2 = 0 THEN CASE WHEN src IS NOT NULL THEN src WHEN prior = 'remove' THEN 'model' ELSE 'researcher' END END AS source, CASE WHEN doc % 2 = 0 THEN CASE WHEN src IS NOT NULL THEN prior WHEN prior = 'remove' THEN NULL ELSE 'add' END ELSE CASE WHEN src IS NULL THEN prior WHEN src = 'researcher' THEN NULL ELSE 'remove' END END AS action FROM s)
SELECT doc, idx, source, action FROM r WHERE source IS NOT NULL OR action IS NOT NULL""")
_spec("carry_flags", lambda c, b: C.carry_flags(c, b).select("code_id", "added_by_researcher"), "codes codebooks", f"""WITH {_BOOKS} SELECT code_id, added_by_researcher OR (codebook_id IN (SELECT codebook_id FROM books) AND EXISTS (SELECT 1 FROM codes o JOIN codebooks ob USING (codebook_id) WHERE ob.doc = b.doc AND o.added_by_researcher AND lower(trim(o.name)) = lower(trim(c.name)))) AS added_by_researcher FROM codes c JOIN codebooks b USING (codebook_id)""")
_spec("code_meta_save", lambda m: C.save_code_meta(m, m.select("doc", F.lit(" Price ").alias("name"), F.lit(None).cast("string").alias("theme"), F.lit(" seen ").alias("note"), F.lit(None).cast("string").alias("keywords")).union(m.select("doc", F.lit("New"), F.lit("T"), F.lit(None).cast("string"), F.lit("k")))), "code_meta", "SELECT doc, code_key, theme, CASE WHEN code_key = 'price' THEN 'seen' ELSE note END AS note, keywords FROM code_meta UNION ALL SELECT DISTINCT doc, 'new', 'T', '', 'k' FROM code_meta")
_spec("note_save", lambda s: C.save_notes(s.where("idx = 0").select("doc", "idx", F.lit("old").alias("note")), s.where("idx < 2").select("doc", "idx", F.when(F.col("doc") % 2 == 0, " ").otherwise(" new ").alias("note")), ["doc", "idx"], "note"), "segments", "SELECT doc, idx, 'new' AS note FROM segments WHERE idx < 2 AND doc % 2 <> 0")
_spec("setup_save", lambda s, f: C.save_setup(s, f.where("kind = 'transcript'").select("document_id", F.lit("individual").alias("session_type"), F.lit(99).alias("setup_confirmed_at"))), "settings files", "SELECT document_id, 'individual' AS session_type, coalesce(setup_confirmed_at, 99) AS setup_confirmed_at FROM files LEFT JOIN settings USING (document_id) WHERE kind = 'transcript'")


def _links(codes):
    base = codes.select(F.col("codebook_id").alias("doc"), F.col("name").alias("code"), F.lit("fee").alias("variable")).distinct()
    old = base.where("code <> 'Time'").withColumns({"direction": F.lit("lower"), "status": F.lit("proposed"), "source": F.lit("model")})
    return C.add_links(old, base.where("code IN ('Time', 'Trust')").withColumn("direction", F.lit("higher")))


_spec("link_add", _links, "codes", "SELECT DISTINCT codebook_id AS doc, name AS code, 'fee' AS variable, CASE WHEN name IN ('Time', 'Trust') THEN 'higher' ELSE 'lower' END AS direction, CASE WHEN name IN ('Time', 'Trust') THEN 'accepted' ELSE 'proposed' END AS status, CASE WHEN name = 'Time' THEN 'researcher' ELSE 'model' END AS source FROM codes")


def _negatives(segments):
    s = segments.select("doc", F.lit("c").alias("code"), "idx", F.lit("r").alias("reason"))
    cases = s.withColumn("status", F.when(F.col("idx") % 3 == 0, "confirmed").when(F.col("idx") % 3 == 1, "dismissed").otherwise("pending"))
    return C.refresh_negatives(cases, s.where("idx % 4 < 2"))


_spec("negative_refresh", _negatives, "segments", "SELECT doc, 'c' AS code, idx, 'r' AS reason, CASE WHEN idx % 3 = 0 THEN 'confirmed' WHEN idx % 3 = 1 THEN 'dismissed' ELSE 'pending' END AS status FROM segments WHERE idx % 3 < 2 OR idx % 4 < 2")
_spec("calibration_labels", lambda s, c, b: C.calibration_labels(s.limit(0).select("doc", "idx", F.lit("").alias("code"), F.lit(True).alias("applies")), c.join(b.where("version = 1"), "codebook_id").select("doc", F.col("name").alias("code")), s.where("idx < 3").select("doc", "idx"), s.where("idx < 5").select("doc", "idx", F.array(F.lit("Price"), F.when(F.col("idx") == 1, "Trust").otherwise("x")).alias("codes"))), "segments codes codebooks", "SELECT s.doc, idx, name AS code, name = 'Price' OR (name = 'Trust' AND idx = 1) AS applies FROM segments s JOIN codebooks b ON b.doc = s.doc AND version = 1 JOIN codes USING (codebook_id) WHERE idx < 3")
_spec("theme_sync", lambda c, b, m: C.sync_themes(c.join(b, "codebook_id").select((F.col("code_id") * 2).alias("finding_id"), "doc", "code_id", F.when(F.col("code_id") % 2 == 0, F.col("name")).alias("theme")), c, b, m), "codes codebooks code_meta", f"""WITH {_BOOKS}, w AS (SELECT code_id, coalesce(nullif(m.theme, ''), c.name) AS wanted, CASE WHEN code_id % 2 = 0 THEN c.name END AS theme FROM codes c JOIN books b USING (codebook_id) LEFT JOIN code_meta m ON m.doc = b.doc AND m.code_key = {_KEY.replace("name", "c.name")}) SELECT code_id * 2 AS finding_id, wanted AS theme FROM w WHERE theme IS DISTINCT FROM wanted""")
_spec("cascade_delete", lambda r, f, s: C.cascade_delete(r.where("run_id % 4 = 0").select(F.col("run_id").cast("long").alias("run_id")), "run_id", f)[0].agg(F.count(F.lit(1)).alias("findings")).join(C.cascade_delete(r.where("run_id % 4 = 0").select(F.col("run_id").cast("long").alias("run_id")), "run_id", s)[0].agg(F.count(F.lit(1)).alias("synths"))), "runs findings synths", "SELECT (SELECT count(*) FROM findings WHERE run_id % 4 <> 0) AS findings, (SELECT count(*) FROM synths WHERE run_id % 4 <> 0) AS synths")


def _archive(findings, files, history):
    kept, gone = C.archive_findings(findings, files.where("document_id < 60"), history.select("original_finding_id", "run_id", "finding_text", "theme", "status", "archived_reason"), "manual_reextract", only_rejected=True)
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(gone.agg(F.count(F.lit(1)).alias("history"), F.count_distinct("original_finding_id").alias("ids")))


_spec("archive_rejected", _archive, "findings files finding_history", """WITH d AS (SELECT finding_id FROM findings WHERE status = 'rejected' AND source_document_id IN (SELECT document_id FROM files WHERE document_id < 60)), h AS (SELECT original_finding_id AS i FROM finding_history UNION SELECT finding_id FROM d)
SELECT (SELECT count(*) FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM d)) AS kept, (SELECT count(*) FROM h) AS history, (SELECT count(DISTINCT i) FROM h) AS ids""")
_spec("picked_insights", lambda i: C.picked_insights(i.union(i.withColumn("insight_id", F.col("insight_id") + 1))).select("insight_id", "finding_id"), "insights", "SELECT insight_id, finding_id FROM insights")
_spec("override_overlay", lambda a, c, b, s, o: Q.apply_overrides(*_overlay(a, c, b, s, o))[0].select("doc", "idx", "code", "source"), "assignments codes codebooks segments overrides", f"""WITH {_BOOKS}, bk AS (SELECT doc, code_id AS code, {_KEY} AS key FROM codes JOIN books USING (codebook_id)), m AS (SELECT DISTINCT s.doc, idx, code_id AS code FROM assignments JOIN segments s USING (segment_id) JOIN bk ON bk.code = code_id),
o AS (SELECT x.doc, idx, action, bk.code FROM overrides x JOIN bk ON bk.doc = x.doc AND bk.key = lower(regexp_replace(trim(x.name), '\\s+', ' ', 'g'))), l AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE action = 'remove' AND o.doc = m.doc AND o.idx = m.idx AND o.code = m.code))
SELECT coalesce(l.doc, a.doc) AS doc, coalesce(l.idx, a.idx) AS idx, coalesce(l.code, a.code) AS code, CASE WHEN a.doc IS NOT NULL THEN 'researcher' ELSE 'model' END AS source FROM l FULL JOIN (SELECT DISTINCT doc, idx, code FROM o WHERE action = 'add') a ON a.doc = l.doc AND a.idx = l.idx AND a.code = l.code""")
_spec("override_dormant", lambda a, c, b, s, o: Q.apply_overrides(*_overlay(a, c, b, s, o))[1], "assignments codes codebooks segments overrides", f"""WITH {_BOOKS}, bk AS (SELECT doc, {_KEY} AS key FROM codes JOIN books USING (codebook_id)) SELECT o.doc, count(*) FILTER (NOT EXISTS (SELECT 1 FROM bk WHERE bk.doc = o.doc AND bk.key = lower(regexp_replace(trim(o.name), '\\s+', ' ', 'g')))) AS dormant FROM overrides o GROUP BY 1""")


def _overlay(assignments, codes, codebooks, segments, overrides):
    book = codes.join(V.codebooks_in_force(codebooks).select("codebook_id", "doc"), "codebook_id").select("doc", F.col("code_id").alias("code"), "name")
    model = assignments.join(segments.select("segment_id", "doc", "idx"), "segment_id").join(book.select(F.col("code").alias("code_id")), "code_id", "left_semi").select("doc", "idx", F.col("code_id").alias("code"))
    return model, overrides, book


_spec("support_links", lambda f: C.support_links(f.where("origin = 'stated'").select(F.col("run_id").alias("chunk"), F.col("finding_id").alias("raw_index"), "finding_id", "finding_kind", F.array(F.col("finding_id") + 75, F.col("finding_id"), F.col("finding_id") - 75).alias("supporting"))), "findings", """WITH s AS (SELECT * FROM findings WHERE origin = 'stated'), e AS (SELECT a.finding_id, b.finding_id AS to_, CASE WHEN b.finding_id > a.finding_id THEN 0 ELSE 2 END AS spot FROM s a JOIN s b ON b.run_id = a.run_id AND b.finding_id IN (a.finding_id + 75, a.finding_id - 75) WHERE a.finding_kind = 'stated_insight')
SELECT finding_id, '[' || string_agg(to_::VARCHAR, ',' ORDER BY spot) || ']' AS supports FROM e GROUP BY 1""")
_spec("narrative_upsert", lambda n, r: C.upsert(n, r.where("run_id % 2 = 0").select("run_id", F.lit("new story").alias("governing_thought"), F.lit(100).alias("generated_at")), ["run_id"]), "narratives runs", "SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'new story' ELSE governing_thought END AS governing_thought, CASE WHEN run_id % 2 = 0 THEN 100 ELSE generated_at END AS generated_at FROM runs LEFT JOIN narratives USING (run_id) WHERE run_id % 2 = 0 OR governing_thought IS NOT NULL")
_spec("validation_replace", lambda v: C.replace_partition(v, v.where("run_id % 2 = 0 AND item_order = 0").withColumn("status", F.lit("gap")), "run_id").select("run_id", "item_order", "status"), "validations", "SELECT run_id, item_order, CASE WHEN run_id % 2 = 0 THEN 'gap' ELSE status END AS status FROM validations WHERE run_id % 2 <> 0 OR item_order = 0")
_spec("run_updates", lambda r: C.set_columns(r, r.where("run_id < 10").select("run_id", (F.col("run_id") % 3).alias("program_id"), F.lit("w").alias("wave_label")), ["run_id"], ["program_id", "wave_label"]).select("run_id", "program_id", "wave_label"), "runs", "SELECT run_id, CASE WHEN run_id < 10 THEN run_id % 3 ELSE program_id END AS program_id, CASE WHEN run_id < 10 THEN 'w' ELSE wave_label END AS wave_label FROM runs")


def _stability(insights, synths, sources):
    members = sources.join(insights.select("insight_id"), "insight_id", "left_semi").join(synths.where("review_status = 'accepted'").select("synth_id", "run_id"), "synth_id").select("synth_id", "run_id", "insight_id")
    pool = insights.select("run_id", "insight_id")
    clusters = pool.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("resample"), (F.col("insight_id") % 7).alias("cluster"), "insight_id")
    return E.stability(pool, members, clusters)


_spec("synth_stability", _stability, "insights synths synth_sources", """WITH m AS (SELECT synth_id, s.run_id, insight_id FROM synth_sources JOIN (SELECT insight_id FROM insights) i USING (insight_id) JOIN (SELECT synth_id, run_id FROM synths WHERE review_status = 'accepted') s USING (synth_id)),
d AS (SELECT run_id, insight_id, resample, row_number() OVER (PARTITION BY run_id, resample ORDER BY md5('stability|' || resample || '|' || insight_id), insight_id) AS k, count(*) OVER (PARTITION BY run_id, resample) AS n FROM insights CROSS JOIN range(5) r(resample)),
a AS (SELECT synth_id, resample, insight_id % 7 AS cluster FROM m JOIN d USING (run_id, insight_id) WHERE k > floor(n * 0.25) AND k <= floor(n * 0.25) + 60),
t AS (SELECT synth_id, resample, count(*) AS alive FROM a GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT synth_id, resample, max(c) AS best FROM (SELECT synth_id, resample, cluster, count(*) AS c FROM a GROUP BY 1, 2, 3) x GROUP BY 1, 2)
SELECT m.synth_id, coalesce(count(t.synth_id), 0) AS testable, count(*) FILTER (best >= 0.5 * alive) AS reappeared FROM (SELECT DISTINCT synth_id FROM m) m LEFT JOIN t USING (synth_id) LEFT JOIN b USING (synth_id, resample) GROUP BY 1""")

_STOP = "the a an of in on for to and or is are was were has have had that this these those by with as at its it their among between than most least more less not be which who".split()
TOKENS = f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({{x}}), '[^a-z0-9%.\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in _STOP)})))"
_, _NAMES, _ = _SPECS["refreshed_duplicates"]
_SPECS["refreshed_duplicates"] = (E.refreshed_duplicates, _NAMES, f"""WITH RECURSIVE sets AS (SELECT finding_id AS id, run_id, {TOKENS.format(x="finding_text")} AS w FROM findings WHERE status <> 'rejected' AND origin <> 'generated'),
uniq AS (SELECT run_id, list_sort(w) AS w, min(id) AS id FROM sets GROUP BY 1, 2), e AS (SELECT a.id AS a, b.id AS b FROM uniq a JOIN uniq b ON a.run_id = b.run_id AND a.id <> b.id WHERE len(list_intersect(a.w, b.w)) >= 0.55 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
r(id, root) AS (SELECT id, id FROM uniq UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), c AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
p AS (SELECT s.id, c.root FROM sets s JOIN uniq u ON u.run_id = s.run_id AND u.w = list_sort(s.w) JOIN c ON c.id = u.id),
g AS (SELECT finding_id, min(finding_id) OVER w AS group_id, count(*) OVER w AS n FROM findings WHERE status <> 'rejected' AND origin = 'generated' WINDOW w AS (PARTITION BY run_id, source_table_id, source_cells, finding_text))
SELECT id AS finding_id, root AS group_id FROM p WHERE root IN (SELECT root FROM p GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT finding_id, group_id FROM g WHERE n > 1""")


def _query(name: str):
    function, names, _ = _SPECS[name]
    return lambda spark, sf_dir: function(*tables(spark, sf_dir, *names))


QUERIES = {name: _query(name) for name in _SPECS}
ORACLE_SQL = {name: oracle(sql, *names) for name, (_, names, sql) in _SPECS.items()}
