"""Queries of stored tables, workbooks, readings, manifests and coded findings over the fixture tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import coding as K
from tabulon.catalog.fixtures import oracle, tables
from tabulon.functions import exprs as X
from tabulon.operators import changes as C
from tabulon.operators import coding as Q
from tabulon.operators import judge as J
from tabulon.operators import transcripts as R
from tabulon.operators import views as V
from tabulon.sources import store as S
from tabulon.sources import tables as IO
from tabulon.streaming import usage as U

_SPECS: dict[str, tuple] = {}


def _spec(name: str, function, names: str, sql: str) -> None:
    _SPECS[name] = (function, names.split(), sql)


# Tables of a document found again: every third document's first table has a new label, told twice, and every fifth a table more.
def _found(file_tables):
    old = file_tables.select("table_id", "document_id", "table_index", F.lit("old").alias("label"), "headers")
    again = old.where("document_id % 3 = 0 AND table_index = 0")
    new = again.select((F.col("table_id") + 500_000).alias("table_id"), "document_id", "table_index", F.lit("zz first").alias("label"), "headers", F.lit(1).alias("at"))
    new = new.union(again.select((F.col("table_id") + 500_000).alias("table_id"), "document_id", "table_index", F.lit("last").alias("label"), F.lit(None).cast("string"), F.lit(2)))
    more = old.where("document_id % 5 = 0 AND table_index = 0").select((F.col("table_id") + 7).alias("table_id"), "document_id", F.lit(7).alias("table_index"), F.lit("more").alias("label"), "headers", F.lit(1))
    return C.upsert(old, new.union(more), ["document_id", "table_index"], keep=["table_id"], at="at")


_spec("table_upsert", _found, "file_tables", """SELECT table_id, document_id, table_index, CASE WHEN document_id % 3 = 0 AND table_index = 0 THEN 'last' ELSE 'old' END AS label, headers FROM file_tables
UNION ALL SELECT table_id + 7, document_id, 7, 'more', headers FROM file_tables WHERE document_id % 5 = 0 AND table_index = 0""")


def _attributes(segments):
    """Each speaker's attributes: the parity of the document, the first letter of the name, and how often they spoke."""
    g = segments.where("speaker IS NOT NULL").groupBy("doc", "speaker").agg(F.count(F.lit(1)).alias("n"))
    return g.select("doc", "speaker", F.create_map(F.lit("parity"), (F.col("doc") % 2).cast("string"), F.lit("letter"), F.left("speaker", F.lit(1)), F.lit("turns"), F.col("n").cast("string")).alias("attributes"))


def _listed(attributes):
    return attributes.select("doc", "speaker", F.explode("attributes").alias("field", "value"))


def _merged(segments):
    old = _attributes(segments)
    empty = F.lit(None).cast("string")
    change = old.where("doc % 3 <> 2").select("doc", "speaker", F.when(F.col("doc") % 3 == 0, F.create_map(F.lit("letter"), empty, F.lit("turns"), F.lit("many"), F.lit("none"), empty)).otherwise(F.create_map(F.lit("parity"), empty, F.lit("letter"), empty, F.lit("turns"), empty)).alias("attributes"))
    change = change.union(old.where("doc % 3 = 2 AND speaker = 'user'").select("doc", F.lit("new").alias("speaker"), F.create_map(F.lit("turns"), F.lit("0"))))
    return _listed(C.merge_attributes(old, change))


_SPOKEN = "g AS (SELECT doc, speaker, count(*) AS n FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2), a AS (SELECT doc, speaker, 'parity' AS field, (doc % 2)::VARCHAR AS value FROM g UNION ALL SELECT doc, speaker, 'letter', left(speaker, 1) FROM g UNION ALL SELECT doc, speaker, 'turns', n::VARCHAR FROM g)"
_spec("attribute_merge", _merged, "segments", f"WITH {_SPOKEN} SELECT doc, speaker, field, CASE WHEN doc % 3 = 0 AND field = 'turns' THEN 'many' ELSE value END AS value FROM a WHERE doc % 3 = 2 OR (doc % 3 = 0 AND field <> 'letter') UNION ALL SELECT doc, 'new', 'turns', '0' FROM g WHERE doc % 3 = 2 AND speaker = 'user'")


def _read_again(settings, segments):
    readings = settings.where("document_id % 2 = 0").select("document_id", F.lit("group").alias("session_type"))
    readings = readings.union(settings.sparkSession.createDataFrame([(10_000_000, "fresh"), (2, "fresh")], "document_id long, session_type string"))
    after, own = C.save_reading(settings.select("document_id", "session_type"), _attributes(segments), readings, segments.where("doc % 2 = 0 AND idx < 4 AND speaker IS NOT NULL").select("doc", "speaker", F.lit("Age").alias("field"), F.col("idx").cast("string").alias("value")))
    return after.select("document_id", F.lit(None).cast("string").alias("speaker"), F.lit("session").alias("field"), F.col("session_type").alias("value")).union(_listed(own))


_spec("reading_save", _read_again, "settings segments", f"""WITH {_SPOKEN}, r AS (SELECT document_id FROM settings WHERE document_id % 2 = 0 UNION SELECT 10000000 UNION SELECT 2)
SELECT document_id, NULL AS speaker, 'session' AS field, CASE WHEN document_id = 2 THEN CASE WHEN 2 IN (SELECT document_id FROM settings) THEN 'group' ELSE 'fresh' END WHEN document_id % 2 = 0 THEN 'group' ELSE session_type END AS value FROM settings
UNION ALL SELECT document_id, NULL, 'session', 'fresh' FROM r WHERE document_id NOT IN (SELECT document_id FROM settings)
UNION ALL SELECT doc, speaker, field, value FROM a WHERE doc NOT IN (SELECT document_id FROM r)
UNION ALL SELECT doc, speaker, 'Age', max(idx::VARCHAR) FROM segments WHERE doc % 2 = 0 AND idx < 4 AND speaker IS NOT NULL GROUP BY 1, 2""")


def _calibrated(segments, codebooks, codes):
    drawn = segments.join(codebooks.select("codebook_id", "doc"), "doc").where("idx < 3").select("codebook_id", "segment_id")
    samples = C.start_calibration(drawn.where("codebook_id % 2 = 0 AND segment_id % 2 = 0"), drawn)
    labels = samples.join(codes.select("codebook_id", "code_id"), "codebook_id").select("segment_id", "code_id", F.lit(True).alias("applies"))
    samples, labels = C.reset_calibration(samples, labels, codes, codebooks.where("version = 1 AND doc % 3 = 0"))
    n = labels.join(codes.select("codebook_id", "code_id"), "code_id").groupBy("codebook_id").agg(F.count(F.lit(1)).alias("labels"))
    return samples.groupBy("codebook_id").agg(F.count(F.lit(1)).alias("samples")).join(n, "codebook_id")


_spec("calibration_reset", _calibrated, "segments codebooks codes", """WITH d AS (SELECT codebook_id, segment_id FROM segments JOIN codebooks USING (doc) WHERE idx < 3), first AS (SELECT * FROM d WHERE codebook_id % 2 = 0 AND segment_id % 2 = 0),
s AS (SELECT * FROM first UNION ALL SELECT * FROM d WHERE codebook_id NOT IN (SELECT codebook_id FROM first)), k AS (SELECT * FROM s WHERE codebook_id NOT IN (SELECT codebook_id FROM codebooks WHERE version = 1 AND doc % 3 = 0)), n AS (SELECT codebook_id, count(*) AS codes FROM codes GROUP BY 1)
SELECT codebook_id, count(*) AS samples, count(*) * any_value(codes) AS labels FROM k JOIN n USING (codebook_id) GROUP BY 1""")


def _sheets(findings, files, codebooks, codes, segments):
    from tabulon.operators import exports as X

    return S.workbook_manifest({"Codebook": codes.select("code_id", "name", "definition"), "Findings": X.findings_sheet(findings, files, accepted_only=True), "Turns": segments.where("role <> 'moderator'"), "Versions": codebooks})


_spec("workbook_manifest", _sheets, "findings files codebooks codes segments", """SELECT 0 AS place, 'Codebook' AS sheet, 3 AS columns, count(*) AS rows FROM codes UNION ALL SELECT 1, 'Findings', 10, count(*) FROM findings WHERE status = 'accepted'
UNION ALL SELECT 2, 'Turns', 6, count(*) FROM segments WHERE role <> 'moderator' UNION ALL SELECT 3, 'Versions', 5, count(*) FROM codebooks""")


def _log(codebooks):
    detail = F.to_json(F.struct(F.col("version").alias("themes_returned"), (F.col("version") - 1).alias("themes_kept"), F.struct((F.col("doc") % 4).alias("exact"), F.lit(1).alias("near"), F.lit("x").alias("none")).alias("quotes"), (F.col("doc") % 3 == 0).alias("input_truncated")))
    told = codebooks.select("doc", "codebook_id", "version", F.col("source").alias("input"), detail.alias("detail"))
    rows = told.select("doc", "codebook_id", F.explode(F.array(*[F.struct(F.lit(stage).alias("stage"), F.concat(F.lit(f"{stage} "), F.col("version").cast("string")).alias("prompt")) for stage in ("open_coding", "open_coding", "apply")])).alias("s"), "input", "detail")
    empty = rows.limit(0).select("doc", "codebook_id", F.lit("").alias("stage"), F.lit("").alias("prompt_sha"), F.lit("").alias("input_sha"), "detail")
    return C.append_manifest(empty, rows.select("doc", "codebook_id", "s.*", "input", "detail"))


_spec("manifest_append", lambda b: _log(b).select("doc", "codebook_id", "stage", "prompt_sha", "input_sha"), "codebooks", "SELECT doc, codebook_id, stage, sha256(stage || ' ' || version) AS prompt_sha, sha256(source) AS input_sha FROM codebooks CROSS JOIN (VALUES ('open_coding'), ('open_coding'), ('apply')) s(stage)")
_spec("open_coding_passes", lambda b: V.open_coding_passes(_log(b), b), "codebooks", """SELECT doc, 2 AS passes, 2 * version AS returned, 2 * (version - 1) AS kept, 2 * (doc % 4) AS exact, 2 AS near, 0 AS none, doc % 3 = 0 AS truncated
FROM codebooks WHERE source = 'induced' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1""")


def _pillars(narratives):
    made = narratives.select("run_id", F.array(F.lit("a"), F.col("governing_thought"), F.lit("c")).alias("pillars"))
    changes = narratives.select("run_id", F.explode(F.array(F.struct(F.lit(1).alias("pillar"), F.lit("new").alias("headline")), F.struct(F.lit(5).alias("pillar"), F.lit("beyond").alias("headline")))).alias("c")).select("run_id", "c.*").where("run_id % 2 = 0")
    return C.revise_pillars(made, changes).select("run_id", F.array_join("pillars", "|").alias("pillars"))


_spec("pillar_revision", _pillars, "narratives", "SELECT run_id, 'a|' || CASE WHEN run_id % 2 = 0 THEN 'new' ELSE governing_thought END || '|c' AS pillars FROM narratives")
_spec("cluster_acceptance", lambda i: J.accepted_clusters(i.select((F.col("insight_id") % 7 + F.col("run_id") * 10).alias("cluster"), F.col("finding_id").alias("member")).union(i.select((F.col("insight_id") % 11 + F.col("run_id") * 10).alias("cluster"), F.col("finding_id")))).select("cluster", F.size("members").cast("long").alias("members"), F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last")), "insights", """WITH c AS (SELECT finding_id AS m, least(insight_id % 7, insight_id % 11) + run_id * 10 AS cluster FROM insights)
SELECT cluster, count(*) AS members, min(m) AS first, max(m) AS last FROM c GROUP BY 1 HAVING count(*) >= 2""")
_spec("speaker_sessions", lambda s: s.select("segment_id", F.concat(F.coalesce("speaker", F.lit("none")), F.when(F.col("doc") % 3 == 0, F.concat(F.lit(" ( Group "), F.col("doc").cast("string"), F.lit(" )"))).when(F.col("doc") % 3 == 1, F.lit(" (a) later")).otherwise("")).alias("s")).select("segment_id", R.session_of_speaker(F.col("s")).alias("session")), "segments", "SELECT segment_id, CASE WHEN doc % 3 = 0 THEN 'Group ' || doc END AS session FROM segments")
_spec("clean_cells", lambda o: IO.clean_cells(o.select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"), F.to_date("o_orderdate").alias("day"))), "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
_spec("blank_cells", lambda n: IO.blank_cells(n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, " N/A ").when(F.col("n_nationkey") % 3 == 1, "").otherwise(F.col("n_name")).alias("name")), ["name"]), "nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN n_name END AS name FROM nation")


def _book(spark):
    return [(c, K.THEMES.get(c, "")) for c in K.KEYWORDS]


def _coded_findings(spark, sf_dir):
    """Findings of the codes that stand on two turns of a conversation or more."""
    turns, codes = K._both(spark, sf_dir)
    book = turns.select("doc").distinct().crossJoin(F.broadcast(spark.createDataFrame(_book(spark), "code string, theme string"))).withColumns({"reproduced_runs": (F.col("doc") % 4).cast("int"), "total_runs": F.lit(3)})
    return Q.coded_findings(turns, codes, book)


def _counts(spark, sf_dir):
    """The counts behind each coded finding: its code's, its focus groups' and its theme's."""
    turns, codes = K._both(spark, sf_dir)
    found = _coded_findings(spark, sf_dir).select(F.xxhash64("doc", "code").alias("finding_id"), "doc", "code")
    groups = K._groups(turns)
    themed = Q.code_stats(turns, Q.theme_rollup(codes, K.THEMES), groups).select("doc", F.col("code").alias("theme"), F.col("turns").alias("theme_turns"), F.col("speakers_with").alias("theme_speakers"))
    rollup = themed.join(F.broadcast(spark.createDataFrame(list(K.THEMES.items()), "code string, theme string")), "theme").drop("theme")
    stats = Q.code_stats(turns, codes, groups).select("doc", "code", "turns", "speakers_with")
    return V.finding_counts(found, stats, Q.group_coverage(turns, codes, groups), rollup).drop("finding_id")


_THEMED = ", ".join(f"('{c}', {t!r})" for c, t in K.THEMES.items())
_QUOTE = "trim(text)"
_LONG = "SELECT doc, code, idx, text, abs(length(text) - 220) + CASE WHEN length(text) < 40 THEN 200 ELSE 0 END AS s FROM codes JOIN turns USING (doc, idx)"
_HEAD = "left(t, 500)"


def _behind(mark: str) -> str:
    """Place of the character before the last ``mark`` of the head, as in the exemplars' rule."""
    return f"(500 - CASE WHEN instr(reverse({_HEAD}), '{mark[::-1]}') = 0 THEN 501 ELSE instr(reverse({_HEAD}), '{mark[::-1]}') END - {len(mark)} + 1)"


_SENTENCE = f"greatest({', '.join(_behind(m) for m in ('. ', '? ', '! '))})"
_FOUND = f"""n AS (SELECT doc, code, count(*) AS turns, count(DISTINCT speaker) AS speakers FROM codes JOIN turns USING (doc, idx) GROUP BY 1, 2 HAVING count(*) >= 2),
best AS (SELECT doc, code, idx, trim(text) AS t FROM ({_LONG}) x QUALIFY row_number() OVER (PARTITION BY doc, code ORDER BY s, idx) = 1), themes(code, theme) AS (VALUES {_THEMED}),
found AS (SELECT n.doc, n.code, turns, speakers, idx, CASE WHEN length(t) <= 500 THEN t WHEN {_SENTENCE} > 500 / 3.0 THEN left({_HEAD}, ({_SENTENCE} + 1)::INTEGER) ELSE trim(left({_HEAD}, greatest(0, {_behind(' ')})::INTEGER)) END AS quote, (n.doc % 4)::INTEGER AS reproduced_runs, 3 AS total_runs, coalesce(theme, n.code) AS theme FROM n JOIN best USING (doc, code) LEFT JOIN themes ON themes.code = n.code)"""


# Every turn with single blanks, capped as a headline and as a paragraph of a story are.
def _capped(conversations):
    said = F.regexp_replace("text", r"\s+", " ")
    return conversations.select("conv_id", "turn", X.cap_words(said, F.lit(22)).alias("headline"), X.cap_words(said, F.lit(75)).alias("paragraph"))


_CAP = """CASE WHEN len(w) <= {n} THEN t ELSE coalesce((SELECT array_to_string(w[1:max(i)], ' ') FROM range({low}, {n} + 1) r(i) WHERE regexp_matches(w[i], '[.!?]$') HAVING max(i) IS NOT NULL), array_to_string(w[1:{n}], ' ') || '…') END"""
_spec("story_caps", _capped, "conversations", f"""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations), x AS (SELECT *, string_split(t, ' ') AS w FROM s)
SELECT conv_id, turn, {_CAP.format(n=22, low=14)} AS headline, {_CAP.format(n=75, low=45)} AS paragraph FROM x""")


# Four lines of each part as a numbered block, two of them blank or a bare number.
def _items(part):
    block = F.concat(F.lit("1. "), "p_name", F.lit("\n \n\t2."), "p_brand", F.lit(" \n3.\n"), "p_type", F.lit(" 4. x"))
    return part.select("p_partkey", F.posexplode(X.split_numbered(block)).alias("place", "item"))


_spec("numbered_items", _items, "part", "SELECT p_partkey, unnest(range(4))::INTEGER AS place, unnest([trim(p_name), trim(p_brand), '', trim(p_type) || ' 4. x']) AS item FROM part")


def _query(name: str):
    function, names, _ = _SPECS[name]
    return lambda spark, sf_dir: function(*tables(spark, sf_dir, *names))


QUERIES = {name: _query(name) for name in _SPECS}
ORACLE_SQL = {name: oracle(sql, *names) for name, (_, names, sql) in _SPECS.items()}


def _owned_usage(spark, sf_dir):
    """Usage events by the last signup of their user within a year, summed by it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    markers = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"))
    usage = e.where("event_type <> 'signup'").select("user_id", "event_id", F.col("ts").alias("at"), F.get_json_object("props", "$.k").try_cast("double").alias("tokens"))
    out = U.batch_totals(markers, U.own_batches(markers, usage, "user_id", reach="365 days"), "user_id")
    return out.withColumn("batch_at", F.date_format("batch_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


QUERIES["owned_usage"] = _owned_usage
ORACLE_SQL["owned_usage"] = """WITH m AS (SELECT DISTINCT user_id, ts AS began FROM events WHERE event_type = 'signup'), u AS (SELECT e.user_id, m.began, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS tokens FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF JOIN m ON m.user_id = e.user_id AND m.began <= e.ts WHERE m.began >= e.ts - INTERVAL 365 DAY)
SELECT m.user_id, strftime(m.began, '%Y-%m-%d %H:%M:%S.%f') AS batch_at, count(u.user_id) AS events, floor(coalesce(sum(tokens), 0) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS tokens FROM m LEFT JOIN u USING (user_id, began) GROUP BY 1, 2"""
QUERIES["coded_findings"] = _coded_findings
ORACLE_SQL["coded_findings"] = f"WITH {K._CODES}, {_FOUND} SELECT * FROM found"
QUERIES["finding_counts"] = _counts
ORACLE_SQL["finding_counts"] = f"""WITH {K._CODES}, {_FOUND}, t AS (SELECT DISTINCT doc, idx, theme FROM codes JOIN themes USING (code)), ts AS (SELECT doc, theme, count(*) AS theme_turns, count(DISTINCT speaker) AS theme_speakers FROM t JOIN turns USING (doc, idx) GROUP BY 1, 2),
g AS (SELECT code, count(DISTINCT doc) AS groups_with FROM codes WHERE doc % 2 = 0 GROUP BY 1), own AS (SELECT f.doc, f.code, f.turns, f.speakers AS speakers_with, h.theme FROM found f LEFT JOIN themes h ON h.code = f.code)
SELECT doc, code, turns, speakers_with, groups_with, CASE WHEN groups_with IS NOT NULL THEN (SELECT count(DISTINCT doc) FROM turns WHERE doc % 2 = 0) END AS groups_total, theme_turns, theme_speakers FROM own LEFT JOIN g USING (code) LEFT JOIN ts USING (doc, theme)"""
