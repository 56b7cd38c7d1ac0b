"""State changes: each takes tables and a table of changes and returns tables; nothing is updated in place.

Changes arrive in bulk, keyed like the rows they touch, so that one pass serves
any number of them.  Fixed values: the names of states, sources and reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import code_key, join_numbered
from tabulon.operators.views import codebooks_in_force

#: Most codes of a codebook that a researcher adds to, and longest note, theme and keywords.
MOST_CODES, NOTE_MOST, THEME_MOST, KEYWORDS_MOST = 20, 4000, 200, 1000


def _fresh(name: str, *frames: DataFrame) -> str:
    """``name`` with underscores behind it until no column of the frames has it, letter case aside."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def last_changes(changes: DataFrame, keys: list[str], columns: list[str], name: str, at: str | None = None) -> DataFrame:
    """Keys and one struct ``name`` of ``columns``: of several changes to a key the last by ``at``, then the greatest by its values."""
    values = F.struct(*columns)
    order = F.struct(F.col(at), values) if at else values
    return changes.groupBy(*keys).agg(F.max_by(values, order).alias(name))


def _changed(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], at: str | None) -> tuple[DataFrame, str]:
    """``df`` with the last change of each row as a struct under a name that it doesn't have, null where there is none."""
    name = _fresh("change", df)
    return df.join(last_changes(changes, keys, columns, name, at), keys, "left"), name


def set_columns(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], at: str | None = None) -> DataFrame:
    """``df`` with the columns of changed rows replaced; a null in a change is a value.  Of several changes to a key the last by ``at`` counts."""
    both, new = _changed(df, changes, keys, columns, at)
    return both.select(*[F.when(F.col(new).isNotNull(), F.col(f"{new}.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def upsert(df: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] = (), at: str | None = None) -> DataFrame:
    """Rows of ``changes`` in place of those with their keys, others stay; columns in ``keep`` keep an old value where there is one, others where the new one is null.

    Of several changes to a key the last by ``at`` counts, so a key gets one row.
    A few changes are joined without moving ``df``: rows that are there take
    theirs, and those that meet none are added.
    """
    columns = [c for c in df.columns if c in changes.columns and c not in keys]
    both, new = _changed(df, changes, keys, columns, at)

    def pick(c: str) -> Column:
        first, second = (c, f"{new}.{c}") if c in keep else (f"{new}.{c}", c)
        return F.coalesce(F.col(first), F.col(second)).alias(c)

    there = both.select(*[pick(c) if c in columns else F.col(c) for c in df.columns])
    due = last_changes(changes, keys, columns, new, at)
    met = df.select(*keys).join(due.select(*keys), keys, "left_semi").distinct()
    added = due.join(met, keys, "left_anti")
    return there.unionByName(added.select(*[F.col(c) if c in keys else F.col(f"{new}.{c}").alias(c) if c in columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))


def review_candidates(candidates: DataFrame, changes: DataFrame, at: str | None = None) -> DataFrame:
    """Candidates after changes (candidate_id, action accept, reject, restore or delete, text): an accepted one takes an edited text and is marked edited where that differs."""
    both, new = _changed(candidates, changes, ["candidate_id"], ["action", "text"], at)
    action, text = F.col(f"{new}.action"), F.nullif(F.trim(F.col(f"{new}.text")), F.lit(""))
    left = both.where(action.isNull() | (action != "delete"))
    accepts = F.coalesce(action == "accept", F.lit(False))
    after = {
        "candidate_text": F.when(accepts, F.coalesce(text, "candidate_text")).otherwise(F.col("candidate_text")),
        "status": F.when(action.isin("accept", "restore"), "accepted").when(action == "reject", "rejected").otherwise(F.col("status")),
        "edited": F.when(accepts, F.coalesce(text != F.col("candidate_text"), F.lit(False))).otherwise(F.col("edited")),
    }
    return left.select(*[after[c].alias(c) if c in after else F.col(c) for c in candidates.columns])


def add_candidates(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates written by a researcher (candidate_id, run_id, kind, candidate_text, created_at): accepted at once; blank ones don't count."""
    own = texts.where("trim(candidate_text) <> ''").select("candidate_id", "run_id", "kind", F.trim("candidate_text").alias("candidate_text"), F.lit("researcher_authored").alias("source"), F.lit("accepted").alias("status"), F.lit(False).alias("edited"), "created_at")
    return candidates.unionByName(own)


def regenerate_candidates(candidates: DataFrame, runs: DataFrame, suggested: DataFrame) -> DataFrame:
    """Suggestions of the given runs that nobody edited or rejected give way to new ones, accepted at once."""
    goes = F.coalesce((F.col("source") == "ai_suggested") & (F.col("status") != "rejected") & ~F.col("edited"), F.lit(False))
    marked = candidates.join(runs.select("run_id").distinct().withColumn("again", F.lit(True)), "run_id", "left")
    new = suggested.select("candidate_id", "run_id", "kind", "candidate_text", F.lit("ai_suggested").alias("source"), F.lit("accepted").alias("status"), F.lit(False).alias("edited"), "created_at")
    return marked.where(~(F.coalesce("again", F.lit(False)) & goes)).select(*candidates.columns).unionByName(new)


def derived_statements(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, kind, statement): the accepted candidates of each run as one text, numbered if there are several; null if there are none."""
    texts = candidates.where("status = 'accepted'").groupBy("run_id", "kind").agg(F.sort_array(F.collect_list(F.struct("created_at", "candidate_id", "candidate_text"))).alias("l"))
    made = texts.select("run_id", "kind", join_numbered(F.transform("l", lambda x: x["candidate_text"])).alias("statement"))
    kinds = runs.select("run_id", F.explode(F.array(F.lit("decision"), F.lit("objective"))).alias("kind"))
    return kinds.join(made, ["run_id", "kind"], "left")


def review_recommendations(recs: DataFrame, changes: DataFrame, scores: list[str], at: str | None = None) -> DataFrame:
    """Recommendations after changes (rec_id, action accept, reject, restore or edit, text): an edit accepts, marks and clears the scores."""
    both, new = _changed(recs, changes, ["rec_id"], ["action", "text"], at)
    action = F.col(f"{new}.action")
    edit = F.coalesce(action == "edit", F.lit(False))
    after = {
        "status": F.when(action.isin("accept", "restore", "edit"), "accepted").when(action == "reject", "rejected").otherwise(F.col("status")),
        "edited": F.col("edited") | edit,
        "action_text": F.when(edit, F.col(f"{new}.text")).otherwise(F.col("action_text")),
        **{c: F.when(~edit, F.col(c)) for c in scores},
    }
    return both.select(*[after[c].alias(c) if c in after else F.col(c) for c in recs.columns])


def add_recommendations(recs: DataFrame, own: DataFrame) -> DataFrame:
    """Recommendations written by a researcher on an insight or a synthesized one; those on neither don't count."""
    fine = own.where("(insight_id IS NOT NULL OR synth_id IS NOT NULL) AND trim(action_text) <> ''").withColumns({"source": F.lit("researcher_authored"), "status": F.lit("accepted"), "edited": F.lit(False)})
    return recs.unionByName(fine, allowMissingColumns=True)


def review_synths(synths: DataFrame, changes: DataFrame, history: DataFrame, sources: DataFrame, insights: DataFrame, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(synths, history) after changes (synth_id, action accept, reject or delete); deleted ones are archived first, with their source headlines, once."""
    both, new = _changed(synths, changes, ["synth_id"], ["action"], at)
    action = F.col(f"{new}.action")
    status = F.when(action == "accept", "accepted").when(action == "reject", "rejected").otherwise(F.col("review_status"))
    kept = both.where(action.isNull() | (action != "delete")).withColumn("review_status", status).select(*synths.columns)
    lines = sources.join(insights.select("insight_id", "headline", "created_at"), "insight_id").groupBy("synth_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "insight_id", "headline"))).alias("l"))
    gone = both.where(action == "delete").join(lines, "synth_id", "left").join(history.select("synth_id"), "synth_id", "left_anti")
    archived = gone.select("synth_id", "run_id", "headline", "review_status", F.coalesce(F.array_join(F.transform("l", lambda x: x["headline"]), " | "), F.lit("")).alias("source_headlines"), F.lit("researcher_deleted").alias("archived_reason"))
    return kept, history.unionByName(archived)


def edit_findings(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings after changes (finding_id, field status, finding_kind, theme or note, value); of several for one field the last by ``at`` counts; a blank note is none."""
    last = changes.groupBy("finding_id", "field").agg(F.max_by("value", "at").alias("value"))
    one = last.groupBy("finding_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    out = findings.join(one, "finding_id", "left")
    has = lambda f: F.coalesce(F.array_contains(F.map_keys("m"), f), F.lit(False))
    set_ = {f: F.when(has(f), F.try_element_at("m", F.lit(f))).otherwise(F.col(f)) for f in ("status", "finding_kind", "theme")}
    if "note" in findings.columns:
        set_["note"] = F.when(has("note"), F.nullif(F.trim(F.try_element_at("m", F.lit("note"))), F.lit(""))).otherwise(F.col("note"))
    return out.withColumns(set_).select(*findings.columns)


def set_statuses(findings: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Findings with the status of many set at once."""
    return set_columns(findings, ids.select("finding_id", F.lit(status).alias("status")), ["finding_id"], ["status"])


def reverify(verdicts: DataFrame, findings: DataFrame, runs: DataFrame, fresh: DataFrame) -> DataFrame:
    """(finding_id, verdict_tier) after the verdicts of some runs were dropped and decided anew (finding_id, tier)."""
    again = findings.join(runs.select("run_id"), "run_id", "left_semi").select("finding_id")
    kept = verdicts.join(again, "finding_id", "left_anti").select("finding_id", "verdict_tier")
    return kept.union(fresh.join(again, "finding_id", "left_semi").select("finding_id", F.col("tier").alias("verdict_tier")))


def insert_codebooks(codebooks: DataFrame, new: DataFrame) -> DataFrame:
    """Codebooks with new ones (codebook_id, doc, run_id, source): the version behind each document's latest."""
    latest = codebooks.groupBy("doc").agg(F.max("version").alias("last"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("codebook_id"))
    made = new.withColumn("k", place).join(latest, "doc", "left").withColumn("version", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("int"))
    return codebooks.unionByName(made.select(*codebooks.columns))


def restore_codebooks(codebooks: DataFrame, codes: DataFrame, assignments: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codebooks, codes, assignments) with earlier versions (codebook_id) brought back as new ones.

    The new codebook's id is the old one's with ``restored`` added (a given
    offset), codes and assignments are copied; versions in force stay.
    """
    old = codebooks.join(wanted.select("codebook_id", "restored"), "codebook_id").join(codebooks_in_force(codebooks).select("codebook_id"), "codebook_id", "left_anti")
    books = insert_codebooks(codebooks, old.select((F.col("codebook_id") + F.col("restored")).alias("codebook_id"), "doc", "run_id", F.lit("edited").alias("source")))
    moved = codes.join(old.select("codebook_id", "restored"), "codebook_id")
    copies = moved.withColumn("old_id", F.col("code_id")).withColumn("code_id", F.col("code_id") + F.col("restored") * 10).withColumn("codebook_id", F.col("codebook_id") + F.col("restored"))
    placed = assignments.join(copies.select(F.col("old_id").alias("code_id"), F.col("code_id").alias("new_id")), "code_id").select("segment_id", F.col("new_id").alias("code_id"))
    return books, codes.unionByName(copies.select(*codes.columns)), assignments.unionByName(placed)


def replace_partition(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``new`` has give way to its rows: segments of a document, validations of a run."""
    return df.join(new.select(key).distinct(), key, "left_anti").select(*df.columns).unionByName(new.select(*df.columns))


def add_codes(codes: DataFrame, codebooks: DataFrame, new: DataFrame) -> DataFrame:
    """Codes with a researcher's (code_id, codebook_id, name, definition): into codebooks in force, under a name that is new there, behind the last one, while there are fewer than twenty."""
    own = new.where("trim(name) <> '' AND trim(definition) <> ''").join(codebooks_in_force(codebooks).select("codebook_id"), "codebook_id", "left_semi").withColumn("key", code_key(F.col("name")))
    fresh = own.join(codes.select("codebook_id", code_key(F.col("name")).alias("key")), ["codebook_id", "key"], "left_anti").dropDuplicates(["codebook_id", "key"])
    state = codes.groupBy("codebook_id").agg(F.max("position").alias("last"), F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("codebook_id").orderBy("code_id"))
    fits = fresh.join(state, "codebook_id", "left").na.fill({"last": -1, "n": 0}).withColumn("k", k).where(F.col("n") + F.col("k") <= MOST_CODES)
    made = fits.withColumns({"position": (F.col("last") + F.col("k")).cast("int"), "added_by_researcher": F.lit(True), "name": F.trim("name"), "definition": F.trim("definition")})
    return codes.unionByName(made.select(*[c for c in codes.columns if c in made.columns]), allowMissingColumns=True)


def change_codes(assignments: DataFrame, overrides: DataFrame, changes: DataFrame, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignments, overrides) after changes (doc, idx, code, action) of single turns.

    Assignments are (doc, idx, code, source model or researcher), overrides (doc,
    idx, code, action).  Adding what the model had puts it back and drops the
    override; removing a researcher's own addition does too.  Changes that
    change nothing leave no trace.
    """
    key = ["doc", "idx", "code"]
    one = last_changes(changes, key, ["action"], "want", at).withColumn("want", F.col("want.action"))
    both = one.join(assignments, key, "left").join(overrides.select(*key, F.col("action").alias("prior")), key, "left")
    adds = (F.col("want") == "add") & F.col("source").isNull()
    removes = (F.col("want") == "remove") & F.col("source").isNotNull()
    again = adds & F.coalesce(F.col("prior") == "remove", F.lit(False))
    moved = both.withColumn("effect", F.when(adds | removes, F.col("want"))).where("effect IS NOT NULL")
    new = moved.where("effect = 'add'").select(*key, F.when(again, "model").otherwise("researcher").alias("source"))
    kept = assignments.join(moved.select(*key), key, "left_anti").select(*key, "source")
    left = overrides.join(moved.select(*key), key, "left_anti").select(*key, "action")
    noted = moved.where(~again & ~(removes & (F.col("source") == "researcher"))).select(*key, F.col("effect").alias("action"))
    return kept.union(new), left.union(noted)


def carry_flags(codes: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Codes in force with the researcher's mark of a code of that name in an earlier version of the document."""
    books = codes.join(codebooks.select("codebook_id", "doc"), "codebook_id").withColumn("key", F.lower(F.trim("name")))
    marked = books.where("added_by_researcher").select("doc", "key").distinct().withColumn("mark", F.lit(True))
    current = codebooks_in_force(codebooks).select("codebook_id", F.lit(True).alias("current"))
    out = books.join(marked, ["doc", "key"], "left").join(current, "codebook_id", "left")
    return out.withColumn("added_by_researcher", F.col("added_by_researcher") | (F.coalesce("mark", F.lit(False)) & F.coalesce("current", F.lit(False)))).select(*codes.columns)


def save_code_meta(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Code metadata after entries (doc, name, theme, note, keywords): null fields keep what is there, new rows have empty texts."""
    cut = [F.left(F.trim(c), F.lit(n)).alias(c) for c, n in (("theme", THEME_MOST), ("note", NOTE_MOST), ("keywords", KEYWORDS_MOST))]
    new = entries.select("doc", code_key(F.col("name")).alias("code_key"), *cut).where("code_key <> ''")
    return upsert(meta, new, ["doc", "code_key"]).na.fill("", ["theme", "note", "keywords"])


def save_notes(notes: DataFrame, changes: DataFrame, keys: list[str], column: str, at: str | None = None) -> DataFrame:
    """Notes or respondent keys after changes: trimmed, and a blank one deletes the row."""
    own = changes.select(*[F.left(F.trim(column), F.lit(NOTE_MOST)).alias(column) if c == column else F.col(c) for c in changes.columns])
    return upsert(notes, own, keys, at=at).where(F.col(column) != "")


def save_setup(settings: DataFrame, changes: DataFrame, at: str | None = None) -> DataFrame:
    """Transcript settings after changes; the time of the first confirmation stays."""
    return upsert(settings, changes, ["document_id"], keep=["setup_confirmed_at"], at=at)


def add_links(links: DataFrame, changes: DataFrame, at: str | None = None) -> DataFrame:
    """Variable links (doc, code, variable, direction, status, source) after a researcher's (doc, code, variable, direction): accepted, of the last direction."""
    own = changes.withColumns({"status": F.lit("accepted"), "source": F.lit("researcher")})
    return upsert(links, own, ["doc", "code", "variable"], keep=["source"], at=at)


def refresh_negatives(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Negative cases (doc, code, idx, reason, status): those decided stay, pending ones give way to what was found, once each."""
    decided = cases.where("status <> 'pending'")
    new = found.select("doc", "code", "idx", "reason", F.lit("pending").alias("status")).dropDuplicates(["doc", "code", "idx"]).join(decided.select("doc", "code", "idx"), ["doc", "code", "idx"], "left_anti")
    return decided.unionByName(new)


def calibration_labels(labels: DataFrame, codes: DataFrame, sample: DataFrame, applied: DataFrame) -> DataFrame:
    """Labels (doc, idx, code, applies) after turns were judged: each code of the document's book gets a row on each judged turn of the sample.

    ``applied`` holds (doc, idx, codes), the codes ticked on each judged turn.
    """
    judged = applied.join(sample.select("doc", "idx"), ["doc", "idx"], "left_semi")
    each = judged.join(codes.select("doc", "code"), "doc").select("doc", "idx", "code", F.array_contains("codes", F.col("code")).alias("applies"))
    return labels.join(judged.select("doc", "idx"), ["doc", "idx"], "left_anti").unionByName(each)


def sync_themes(findings: DataFrame, codes: DataFrame, codebooks: DataFrame, meta: DataFrame) -> DataFrame:
    """(finding_id, theme) of coded findings (finding_id, doc, code_id, theme) whose theme isn't their code's: its theme, or its name where it has none."""
    current = codes.join(codebooks_in_force(codebooks).select("codebook_id", "doc"), "codebook_id").withColumn("code_key", code_key(F.col("name")))
    named = current.join(meta.select("doc", "code_key", F.col("theme").alias("own")), ["doc", "code_key"], "left").select("code_id", "doc", F.coalesce(F.nullif("own", F.lit("")), F.col("name")).alias("wanted"))
    both = findings.join(named, ["code_id", "doc"])
    return both.where(~F.col("theme").eqNullSafe(F.col("wanted"))).select("finding_id", F.col("wanted").alias("theme"))


def cascade_delete(gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Tables without the rows that hang on deleted keys."""
    return [c.join(gone.select(key), key, "left_anti").select(*c.columns) for c in children]


def archive_findings(findings: DataFrame, documents: DataFrame, history: DataFrame, reason: str, only_rejected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, history): findings of the documents are archived with a reason, once, and go."""
    due = findings.join(documents.select(F.col("document_id").alias("source_document_id")), "source_document_id", "left_semi")
    due = due.where("status = 'rejected'") if only_rejected else due
    new = due.select(F.col("finding_id").alias("original_finding_id"), "run_id", "finding_text", "theme", "status", F.lit(reason).alias("archived_reason")).join(history.select("original_finding_id"), "original_finding_id", "left_anti")
    return findings.join(due.select("finding_id"), "finding_id", "left_anti").select(*findings.columns), history.unionByName(new.select(*history.columns))


def picked_insights(insights: DataFrame) -> DataFrame:
    """The oldest insight of each finding, the one that an archive keeps."""
    return insights.withColumn("k", F.row_number().over(Window.partitionBy("finding_id").orderBy("created_at", "insight_id"))).where("k = 1").drop("k")


def merge_attributes(attributes: DataFrame, changes: DataFrame) -> DataFrame:
    """Respondents' attributes (doc, speaker, attributes map) after changes of the same columns: a value replaces or adds, a null one deletes; respondents left without any go.

    A respondent stands once in each table.
    """
    both = attributes.select("doc", "speaker", F.col("attributes").alias("before")).join(changes.select("doc", "speaker", F.col("attributes").alias("after")), ["doc", "speaker"], "full")
    empty = F.create_map().cast(attributes.schema["attributes"].dataType)
    before, after = (F.coalesce(c, empty) for c in ("before", "after"))
    merged = F.map_filter(F.map_zip_with(before, after, lambda k, old, new: F.when(F.map_contains_key(after, k), new).otherwise(old)), lambda k, v: v.isNotNull())
    return both.select("doc", "speaker", merged.alias("attributes")).where(F.size("attributes") > 0)


def save_reading(settings: DataFrame, attributes: DataFrame, readings: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settings, attributes) after transcripts were read: how each was read (document_id, mode, resolved, notes, moderators), and all its respondents' attributes anew from (doc, speaker, field, value)."""
    mapped = profiles.groupBy("doc", "speaker", "field").agg(F.max("value").alias("value")).groupBy("doc", "speaker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("attributes"))
    kept = attributes.join(readings.select(F.col("document_id").alias("doc")).distinct(), "doc", "left_anti")
    return upsert(settings, readings, ["document_id"]), kept.select("doc", "speaker", "attributes").unionByName(mapped)


def start_calibration(samples: DataFrame, drawn: DataFrame) -> DataFrame:
    """Samples (codebook_id, segment_id) with those drawn for codebooks that have none yet."""
    return samples.unionByName(drawn.select("codebook_id", "segment_id").distinct().join(samples.select("codebook_id").distinct(), "codebook_id", "left_anti").select(*samples.columns), allowMissingColumns=True)


def reset_calibration(samples: DataFrame, labels: DataFrame, codes: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, labels) without those of some codebooks (codebook_id): labels (segment_id, code_id, applies) go by their code."""
    own = codes.join(books.select("codebook_id"), "codebook_id", "left_semi").select("code_id")
    return samples.join(books.select("codebook_id"), "codebook_id", "left_anti").select(*samples.columns), labels.join(own, "code_id", "left_anti").select(*labels.columns)


def append_manifest(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with rows (doc, codebook_id, stage, prompt, input, detail) added: prompt and input as SHA-256."""
    return manifest.unionByName(rows.select("doc", "codebook_id", "stage", F.sha2("prompt", 256).alias("prompt_sha"), F.sha2("input", 256).alias("input_sha"), "detail"))


def support_links(found: DataFrame) -> DataFrame:
    """(finding_id, supports): ids behind the raw numbers that stated insights (chunk, raw_index, finding_id, finding_kind, supporting array) point to, in order; numbers of findings that didn't survive don't count."""
    asked = found.where("finding_kind = 'stated_insight'").select("chunk", "finding_id", "raw_index", F.posexplode("supporting").alias("at", "to")).where("to <> raw_index")
    ids = found.select("chunk", F.col("raw_index").alias("to"), F.col("finding_id").alias("support"))
    g = asked.join(ids, ["chunk", "to"]).groupBy("finding_id").agg(F.sort_array(F.collect_list(F.struct("at", "support"))).alias("l"))
    return g.select("finding_id", F.to_json(F.transform("l", lambda x: x["support"])).alias("supports"))


def revise_pillars(narratives: DataFrame, changes: DataFrame) -> DataFrame:
    """Narratives with one pillar's headline replaced: changes (run_id, pillar, headline) meet the list ``pillars`` by place."""
    one = changes.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("pillar", "headline"))).alias("m"))
    both = narratives.join(one, "run_id", "left")
    return both.withColumn("pillars", F.transform("pillars", lambda p, i: F.coalesce(F.try_element_at("m", i), p))).select(*narratives.columns)
