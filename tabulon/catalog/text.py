"""Queries of transcripts, quotes, coding grids, scalar functions, windowed usage and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog.fixtures import oracle, tables
from tabulon.functions import exprs as X
from tabulon.operators import judge as J
from tabulon.operators import quotes as U
from tabulon.operators import transcripts as R
from tabulon.operators import validators as W
from tabulon.sources import grids as G
from tabulon.sources import tables as IO
from tabulon.streaming.usage import windowed_usage


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("idx"), F.lit("participant").alias("role"), "text")


def _transcripts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    line = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", "\n", " "))
    rows = c.groupBy(F.col("conv_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def quote_exact_match(spark, sf_dir):
    """The first document that holds each benchmark text."""
    return U.quotes_in_corpus(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), _whole(spark, sf_dir))


def _segments(spark, sf_dir):
    return tables(spark, sf_dir, "segments")[0]


def _matches(spark, sf_dir):
    """The inside of each first turn, sought in its own conversation."""
    s = _segments(spark, sf_dir)
    quotes = s.where("idx = 0").select(F.col("doc").alias("quote_id"), "doc", F.substring("text", 6, 60).alias("quote"))
    return U.match_quotes(quotes, s)


def _kept(spark, sf_dir):
    m = _matches(spark, sf_dir)
    return U.kept_themes(m.select("quote_id", F.lit("t").alias("theme")), m)


def _pages(spark, sf_dir):
    """Conversations as documents with a page a turn, and quotes from one page under another's number."""
    c = _t(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text")
    quotes = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("quote_id"), F.col("conv_id").alias("doc"), F.when(F.col("turn") % 4 != 3, F.col("turn") % 3).alias("page"), F.substring("text", 1, 40).alias("quote"))
    return U.quotes_on_pages(quotes, pages).select("quote_id", "verified")


def _grid(spark, sf_dir):
    """Parts as coding grids, seven sheets: a theme now and then, two codes, a quote with an attribution and a count."""
    p = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("sheet"), (F.col("p_partkey") + 1).alias("row"), F.array(
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(""), F.concat("p_type", F.lit(";  - "), F.upper("p_name")), F.concat(F.lit("“Quite a "), "p_name", F.lit(" thing here” (P1, Line 3)\nnext line")), F.col("p_size").cast("string")).alias("cells"))
    head = p.select("sheet").distinct().select("sheet", F.lit(0).cast("long").alias("row"), F.array(*map(F.lit, ("Theme", "Sub-theme / Code", "Illustrative quote", "Count"))).alias("cells"))
    return p.union(head)


def _matrix(spark, sf_dir):
    """Parts as one matrix of marks, some of which aren't marks."""
    mark = F.when(F.col("p_size") % 4 == 0, "1").when(F.col("p_size") % 4 == 1, "X").when(F.col("p_size") % 4 == 2, "maybe").otherwise("")
    p = _t(spark, sf_dir, "part").select(F.lit("m").alias("sheet"), (F.col("p_partkey") + 1).alias("row"), F.array("p_name", mark, F.when(F.col("p_partkey") % 3 == 0, "yes").otherwise("no"), F.lit("1")).alias("cells"))
    head = p.limit(1).select("sheet", F.lit(0).cast("long").alias("row"), F.array(*map(F.lit, ("Sentence", "Price", "Support", "Count"))).alias("cells"))
    return p.union(head)


def _paragraphs(spark, sf_dir):
    """Customers as lines of themed extracts, one a nation."""
    k = F.col("c_custkey") % 5
    line = F.when(k == 0, F.concat(F.lit("THEME A:  "), "c_mktsegment")).when(k == 1, F.concat(F.lit("Code: "), "c_name")).when(k == 4, F.lit('[note: "not a quote, but a note"]')).otherwise(F.concat(F.lit('P3: "I am '), "c_name", F.lit(' indeed" and "some other words"')))
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), F.col("c_custkey").alias("row"), line.alias("line"))


def _imported(spark, sf_dir):
    """Entries of the inside of every third turn, under two codes, and of words that nobody said."""
    s = _segments(spark, sf_dir)
    said = F.when(F.col("idx") % 3 == 0, F.substring("text", 6, 50)).when(F.col("idx") % 3 == 1, F.lit("zq xw never said by anybody"))
    entries = s.select("doc", F.col("segment_id").alias("quote_id"), F.when(F.col("idx") % 2 == 0, "a").otherwise("B").alias("code"), said.alias("quote"))
    return G.import_coding(entries, U.match_quotes(entries.where("quote IS NOT NULL").select("quote_id", "doc", "quote"), s))


def _answers(spark, sf_dir, answer):
    """Model answers of each nation, as JSON."""
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), answer.alias("answer"))


def _scores(spark, sf_dir):
    item = lambda i, a, r: F.format_string('{"index":%d,"one_score":%d,"two_score":3,"rationale":"%s"}', i, a, F.lit(r))
    k = F.col("n_nationkey")
    body = F.concat(F.lit('{"groups":['), item(F.lit(0), k % 6, "r"), F.lit(","), item(F.lit(0), F.lit(5), "again"), F.lit(","), item(k % 4, F.lit(1), "s"), F.lit(","), item(F.lit(1), F.lit(5), " "), F.lit("]}"))
    counts = _t(spark, sf_dir, "nation").select(k.alias("key"), F.lit(3).alias("n"))
    return W.valid_scores(_answers(spark, sf_dir, body), ["one", "two"], counts)


def _assigned(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit('[{"index":1,"codes":[1,1,"2",9,"x"]},{"index":'), k, F.lit(',"codes":[3]},{"index":7,"codes":[]}]'))
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    asked = n.select("key", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("index"))
    return W.valid_assignments(_answers(spark, sf_dir, body), asked, n.select("key", F.lit(4).alias("n")))


def _linked(spark, sf_dir):
    k = F.col("n_nationkey")
    body = F.concat(F.lit('[{"code":1,"variable":" FEE ","direction":"higher","rationale":" why "},{"code":1,"variable":"fee","direction":"lower","rationale":"again"},{"code":'), (k % 5).cast("string"), F.lit(',"variable":"age","direction":"lower","rationale":"r"},{"code":2,"variable":"none","direction":"lower","rationale":"r"}]'))
    n = _t(spark, sf_dir, "nation").select(k.alias("key"))
    return W.valid_links(_answers(spark, sf_dir, body), n.select("key", F.lit(3).alias("n")), n.select("key", F.explode(F.array(F.lit("Fee"), F.lit("Age"))).alias("variable")))


def _negatives(spark, sf_dir):
    body = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit('{"code":1,"index":'), ((i + F.col("n_nationkey")) % 6).cast("string"), F.lit(',"reason":"r"}'))), ","), F.lit("]"))
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    return W.valid_negatives(_answers(spark, sf_dir, body), n.select("key", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("index")), n.select("key", F.lit(2).alias("n")))


def _chains(spark, sf_dir):
    k = F.col("n_nationkey")
    outcome = F.when(k % 5 == 0, "supported").when(k % 5 == 1, "overreach").when(k % 5 == 2, "contradicted").when(k % 5 == 3, "unsupported").otherwise("odd")
    body = F.concat(F.lit('{"outcome":"'), outcome, F.lit('","rationale":"r","relied_indices":[0,'), (k % 4).cast("string"), F.lit(',9],"contradicting_indices":[2,2]}'))
    pool = _t(spark, sf_dir, "nation").select(k.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("index")).withColumn("finding_id", F.col("key").cast("long") * 10 + F.col("index"))
    return W.chain_verdicts(_answers(spark, sf_dir, body), pool)


def scalars(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", X.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), X.fnv1a(F.concat("p_name", F.lit(" é€"))).alias("fnv"), X.code_key(F.upper("p_name")).alias("key"), X.num_to_text(F.floor("p_retailprice").cast("double")).alias("price"))


QUERIES = {
    "quote_exact_match": quote_exact_match,
    "quote_matches": lambda s, d: _matches(s, d).select("quote_id", "match", "idx", "role"),
    "quote_tally": lambda s, d: U.quote_tally(_matches(s, d)),
    "quote_kept_themes": lambda s, d: _kept(s, d).select("quote_id", "kept", "reason"),
    "quotes_on_pages": _pages,
    "transcript_summary": lambda s, d: R.summarize_reading(R.read_transcripts(_transcripts(s, d))).select("doc", "mode", "respondents", "moderator_turns"),
    "transcript_segments": lambda s, d: R.read_transcripts(_transcripts(s, d)).segments.groupBy("doc").agg(F.md5(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), ""), r"\s", "")).alias("said"), (F.max(F.length("text")) <= 1200).alias("short")),
    "setup_suggestions": lambda s, d: R.suggest_setup(_transcripts(s, d).withColumn("filename", F.when(F.col("doc") % 3 == 0, "Focus_Group.txt").otherwise("a.txt"))).select("doc", "session_type", "mode"),
    "coding_batches": lambda s, d: R.coding_batches(_segments(s, d), chars=900, items=4),
    "previous_prompt": lambda s, d: R.with_context(_segments(s, d)).select("doc", "idx", "context"),
    "open_excerpt": lambda s, d: R.open_excerpt(_segments(s, d), most=600),
    "page_of_turn": lambda s, d: R.page_of_turn(_t(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), "text"), _t(s, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text")),
    "page_batches": lambda s, d: IO.page_batches(_t(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"), size=2).select("doc", "batch", "first", "last", F.md5("text").alias("text")),
    "table_records": lambda s, d: IO.records(_t(s, d, "part").select((F.col("p_partkey") % 9).alias("table_id"), F.col("p_partkey").alias("row"), F.array(F.lit("name"), F.lit("size"), F.lit("none")).alias("headers"), F.array("p_name", F.col("p_size").cast("string")).alias("cells"))).select("table_id", "row", F.element_at("record", "name").alias("name"), F.element_at("record", "size").alias("size"), F.element_at("record", "none").alias("none")),
    "upload_register": lambda s, d: IO.register_uploads(*_uploads(s, d)).groupBy("kind", "ingestion_type").agg(F.count(F.lit(1)).alias("n")),
    "label_decode": lambda s, d: IO.decode_labels(_t(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), _t(s, d, "nation").select(F.lit("c_nationkey").alias("column"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label")).where("n_nationkey < 20")),
    "grid_entries": lambda s, d: G.parse_grid(_grid(s, d)).select("sheet", "row", "theme", "code", "quote"),
    "grid_matrix": lambda s, d: G.parse_grid(_matrix(s, d)).select("row", "code", "quote"),
    "grid_codes": lambda s, d: G.unique_codes(G.merge_parts(G.parse_grid(_grid(s, d)).withColumn("sheet", F.col("sheet").cast("string")), G.parse_paragraphs(_paragraphs(s, d)).withColumn("sheet", F.concat(F.lit("z"), F.lpad(F.col("sheet").cast("string"), 3, "0"))))).select("key", "code", "theme"),
    "grid_paragraphs": lambda s, d: G.parse_paragraphs(_paragraphs(s, d)).select("sheet", "row", "theme", "code", "quote"),
    "coding_import": _imported,
    "answer_scores": _scores,
    "answer_assignments": _assigned,
    "answer_links": _linked,
    "answer_negatives": _negatives,
    "answer_chains": _chains,
    "objective_scores_current": lambda s, d: W.scores_current(*tables(s, d, "validations", "objective_scores")),
    "scalar_functions": scalars,
    "windowed_usage": lambda s, d: windowed_usage(_t(s, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
    "judge_roundtrip": lambda s, d: J.valid_scores(J.judge(_t(s, d, "benchmark"), "item_id", F.col("text"), J.stub_provider), "item_id"),
}


def _uploads(spark, sf_dir):
    files = tables(spark, sf_dir, "files")[0].select("document_id", "run_id", "kind", "ingestion_type", "source_filename")
    k = F.col("document_id")
    # Even ids move behind all ids there are, so that they are new however many files there are.
    span = files.agg((F.max(k) - F.min(k) + 1).alias("span"))
    new = files.join(F.broadcast(span)).select((k + F.when(k % 2 == 0, F.col("span")).otherwise(0)).alias("document_id"), "run_id", F.when(k % 3 == 0, "table").when(k % 3 == 1, "report").otherwise("song").alias("kind"), F.when(k % 4 == 0, "raw").alias("ingestion_type"), "source_filename")
    return files, new


#: Two single quotes as an SQL text that goes on.
_SINGLES = "'" * 5


def _normal(x: str) -> str:
    return f"trim(lower(regexp_replace(replace(translate({x}, '‘’“”–—', {_SINGLES}\"\"--'), chr(173), ''), '[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g')))"


_FRAGMENT = f"trim(regexp_replace({_normal('substr(text, {a}, {n})')}, '^[\"'']+|[\"'']+$', '', 'g'))"
_QUOTES = "q AS (SELECT doc AS quote_id, doc, " + _FRAGMENT.replace("{a}", "6").replace("{n}", "60") + f" AS q FROM segments WHERE idx = 0), t AS (SELECT doc, idx, role, {_normal('text')} AS t FROM segments), m AS (SELECT quote_id, first(t.idx ORDER BY t.role = 'moderator', t.idx) AS idx, first(t.role ORDER BY t.role = 'moderator', t.idx) AS role FROM q JOIN t USING (doc) WHERE length(q) >= 8 AND contains(t.t, q) GROUP BY 1)"
_LINES = "lines AS (SELECT conv_id AS doc, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE regexp_matches(text, '\\S')), n AS (SELECT doc, role, count(*) AS n FROM lines GROUP BY 1, 2), modes AS (SELECT doc, CASE WHEN coalesce(sum(n) FILTER (n >= 2), 0) >= 3 THEN 'labels' ELSE 'none' END AS mode, count(*) AS people FROM n GROUP BY 1)"
_GRID = """g AS (SELECT p_partkey % 7 AS sheet, p_partkey + 1 AS row, last_value(CASE WHEN p_partkey % 5 = 0 THEN p_brand END IGNORE NULLS) OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS theme, p_type, upper(p_name) AS other, 'Quite a ' || p_name || ' thing here' AS q1 FROM part),
e AS (SELECT sheet, row, theme, unnest([p_type, other]) AS code, unnest([1, 2]) AS i, q1 FROM g), entries AS (SELECT sheet, row, theme, code, i, unnest([q1, 'next line']) AS quote FROM e)"""
_PARAS = """p AS (SELECT c_nationkey AS sheet, c_custkey AS row, c_custkey % 5 AS k, c_name, c_mktsegment, count(*) FILTER (c_custkey % 5 = 0) OVER w AS block, last_value(CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END IGNORE NULLS) OVER w AS theme FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, last_value(CASE WHEN k = 1 THEN c_name END IGNORE NULLS) OVER (PARTITION BY sheet, block ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code FROM p),
paras AS (SELECT sheet, row, theme, code, NULL AS quote FROM c WHERE k = 1 UNION ALL SELECT sheet, row, CASE WHEN code IS NOT NULL THEN theme END, coalesce(code, theme), 'I am ' || c_name || ' indeed' FROM c WHERE k IN (2, 3) AND coalesce(code, theme) IS NOT NULL)"""
_ITEMS = "range(25) t(key)"
ORACLE_SQL = {
    "quote_exact_match": f"""WITH q AS (SELECT item_id AS quote_id, {_normal("text")} AS q FROM benchmark), d AS (SELECT doc_id, {_normal("text")} AS t FROM documents)
SELECT quote_id, min(doc_id) AS doc, 0::INTEGER AS idx FROM q JOIN d ON contains(t, q) WHERE length(q) >= 8 GROUP BY 1""",
    "quote_matches": oracle(f"WITH {_QUOTES} SELECT quote_id, CASE WHEN m.idx IS NULL THEN 'none' ELSE 'exact' END AS match, idx, role FROM q LEFT JOIN m USING (quote_id)", "segments"),
    "quote_tally": oracle(f"WITH {_QUOTES} SELECT count(*) FILTER (idx IS NOT NULL AND role <> 'moderator') AS exact, 0::BIGINT AS near, count(*) FILTER (idx IS NULL) AS none, count(*) FILTER (role = 'moderator') AS moderator FROM q LEFT JOIN m USING (quote_id)", "segments"),
    "quote_kept_themes": oracle(f"WITH {_QUOTES} SELECT quote_id, coalesce(role <> 'moderator', false) AS kept, CASE WHEN idx IS NULL THEN 'quote was not found in the transcript' WHEN role = 'moderator' THEN 'quote came from the moderator' END AS reason FROM q LEFT JOIN m USING (quote_id)", "segments"),
    "quotes_on_pages": f"""WITH p AS (SELECT conv_id, turn + 1 AS page, text FROM conversations), q AS (SELECT conv_id * 1000 + turn AS quote_id, conv_id, CASE WHEN turn % 4 <> 3 THEN turn % 3 END AS page, {_normal("substr(text, 1, 40)")} AS q FROM conversations),
j AS (SELECT quote_id, q, string_agg(p.text, ' ' ORDER BY p.page) FILTER (q.page IS NULL OR p.page = q.page) AS own, string_agg(p.text, ' ' ORDER BY p.page) FILTER (p.page <> q.page) AS beside FROM q JOIN p ON p.conv_id = q.conv_id AND (q.page IS NULL OR abs(p.page - q.page) <= 1) GROUP BY 1, 2)
SELECT quote_id, coalesce(length(q.q) > 0 AND (contains({_normal("coalesce(own, '')")}, q.q) OR contains({_normal("coalesce(beside, '')")}, q.q)), false) AS verified FROM q LEFT JOIN j USING (quote_id)""",
    "transcript_summary": f"WITH {_LINES} SELECT doc, mode, CASE WHEN mode = 'labels' THEN people END AS respondents, 0::BIGINT AS moderator_turns FROM modes",
    "transcript_segments": f"""WITH {_LINES}, s AS (SELECT conv_id AS doc, string_agg(CASE WHEN mode = 'labels' THEN text ELSE upper(left(role, 1)) || substr(role, 2) || ': ' || text END, '' ORDER BY turn) AS t FROM conversations JOIN modes ON doc = conv_id GROUP BY 1) SELECT doc, md5(regexp_replace(t, '\\s', '', 'g')) AS said, true AS short FROM s""",
    "setup_suggestions": f"""WITH {_LINES}, x AS (SELECT conv_id AS doc, sum(length(role || ': ' || text) + 1) - 1 AS n FROM conversations GROUP BY 1) SELECT doc, CASE WHEN doc % 3 = 0 THEN 'focus_group' ELSE 'individual' END AS session_type, CASE WHEN n >= 50 THEN mode ELSE 'auto' END AS mode FROM x JOIN modes USING (doc) WHERE n >= 50 OR doc % 3 = 0""",
    "coding_batches": oracle("""WITH RECURSIVE c AS (SELECT *, CASE WHEN lag(role) OVER w = 'moderator' THEN left(lag(text) OVER w, 240) END AS ctx FROM segments WINDOW w AS (PARTITION BY doc ORDER BY idx)), t AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k, length(text) + coalesce(length(ctx), 0) + 20 AS cost FROM c WHERE role <> 'moderator'),
f(doc, k, idx, batch, used, n) AS (SELECT doc, k, idx, 0, cost, 1 FROM t WHERE k = 1 UNION ALL SELECT t.doc, t.k, t.idx, CASE WHEN used + cost > 900 OR n >= 4 THEN batch + 1 ELSE batch END, CASE WHEN used + cost > 900 OR n >= 4 THEN cost ELSE used + cost END, CASE WHEN used + cost > 900 OR n >= 4 THEN 1 ELSE n + 1 END FROM f JOIN t ON t.doc = f.doc AND t.k = f.k + 1) SELECT doc, idx, batch FROM f""", "segments"),
    "previous_prompt": oracle("WITH c AS (SELECT *, CASE WHEN lag(role) OVER w = 'moderator' THEN left(lag(text) OVER w, 240) END AS context FROM segments WINDOW w AS (PARTITION BY doc ORDER BY idx)) SELECT doc, idx, context FROM c WHERE role <> 'moderator'", "segments"),
    "open_excerpt": oracle("WITH u AS (SELECT doc, sum(length(text) + coalesce(length(speaker) + 2, 0) + 1) OVER (PARTITION BY doc ORDER BY idx) AS u FROM segments) SELECT doc, count(*) FILTER (u <= 600) AS turns, coalesce(max(u) FILTER (u <= 600), 0)::BIGINT AS chars, max(u) > 600 AS truncated FROM u GROUP BY 1", "segments"),
    "page_of_turn": f"""WITH t AS (SELECT conv_id, turn, {_normal("text")} AS b FROM conversations) SELECT a.conv_id AS doc, a.turn AS idx, min(p.turn + 1) AS page FROM t a JOIN t p ON a.conv_id = p.conv_id AND contains(p.b, left(a.b, 60)) WHERE length(left(a.b, 60)) >= 12 GROUP BY 1, 2""",
    "page_batches": "WITH p AS (SELECT conv_id AS doc, turn, text, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2)::BIGINT AS batch FROM conversations) SELECT doc, batch, min(turn) AS first, max(turn) AS last, md5(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS text FROM p GROUP BY 1, 2",
    "table_records": "SELECT p_partkey % 9 AS table_id, p_partkey AS row, p_name AS name, p_size::VARCHAR AS size, NULL::VARCHAR AS none FROM part",
    "upload_register": oracle("SELECT kind, ingestion_type, count(*) AS n FROM (SELECT kind, ingestion_type FROM files UNION ALL SELECT CASE document_id % 3 WHEN 0 THEN 'table' ELSE 'report' END, CASE WHEN document_id % 3 = 0 THEN CASE WHEN document_id % 4 = 0 THEN 'raw' ELSE 'aggregated' END END FROM files WHERE document_id % 2 = 0 AND document_id % 3 < 2) u GROUP BY 1, 2", "files"),
    "label_decode": "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS c_nationkey, c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20",
    "grid_entries": f"WITH {_GRID} SELECT sheet, row, theme, code, quote FROM entries",
    "grid_matrix": "SELECT p_partkey + 1 AS row, 'Price' AS code, p_name AS quote FROM part WHERE p_size % 4 < 2 UNION ALL SELECT p_partkey + 1, 'Support', p_name FROM part WHERE p_partkey % 3 = 0",
    "grid_paragraphs": f"WITH {_PARAS} SELECT sheet, row, theme, code, quote FROM paras",
    "grid_codes": f"""WITH {_GRID}, {_PARAS}, a AS (SELECT sheet::VARCHAR AS sheet, row, i, theme, code FROM entries UNION ALL SELECT 'z' || lpad(sheet::VARCHAR, 3, '0'), row, 0, theme, code FROM paras)
SELECT lower(code) AS key, first(code ORDER BY sheet, row, i) AS code, first(theme ORDER BY sheet, row, i) FILTER (theme IS NOT NULL) AS theme FROM a GROUP BY 1""",
    "coding_import": oracle("WITH q AS (SELECT doc, segment_id, idx, idx % 2 = 0 AS a, CASE WHEN idx % 3 = 0 THEN " + _FRAGMENT.replace("{a}", "6").replace("{n}", "50") + f""" END AS q FROM segments), t AS (SELECT doc, idx, role, {_normal("text")} AS t FROM segments), m AS (SELECT segment_id, bool_or(role <> 'moderator') AS ok FROM q JOIN t USING (doc) WHERE length(q) >= 8 AND contains(t, q) GROUP BY 1)
SELECT doc, count(*) FILTER (q.idx % 3 < 2) AS quotes_total, count(*) FILTER (ok) AS quotes_matched, count(*) FILTER (NOT ok) AS in_moderator_turns, count(DISTINCT a) AS codes, count(DISTINCT a) - count(DISTINCT a) FILTER (ok) AS codes_without_quotes FROM q LEFT JOIN m USING (segment_id) GROUP BY 1""", "segments"),
    # The score hangs on the hash modulo 3, which is that of its digits' sum.
    "judge_roundtrip": "SELECT item_id, [1, 3, 5][1 + (list_sum(list_transform(string_split(sha256(text), ''), lambda c: position(c IN '0123456789abcdef') - 1)) % 3)::BIGINT] AS score, 'stub' AS rationale FROM benchmark QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sha256(text)) = 1",
    "answer_scores": f"""WITH i AS (SELECT key::INTEGER AS key, 0 AS place, 0 AS index, (key % 6)::INTEGER AS one_score, 'r' AS rationale FROM {_ITEMS} UNION ALL SELECT key, 1, 0, 5, 'again' FROM {_ITEMS} UNION ALL SELECT key, 2, key % 4, 1, 's' FROM {_ITEMS})
SELECT key::INTEGER AS key, index::INTEGER AS index, one_score, 3 AS two_score, one_score + 3 AS total, rationale FROM i WHERE one_score IN (1, 3, 5) AND index < 3 QUALIFY row_number() OVER (PARTITION BY key, index ORDER BY place) = 1""",
    "answer_assignments": f"SELECT key::INTEGER AS key, 1 AS index, unnest([1, 2]) AS code FROM {_ITEMS} WHERE key <> 1 UNION ALL SELECT key::INTEGER, key::INTEGER, 3 FROM {_ITEMS} WHERE key BETWEEN 1 AND 10",
    "answer_links": f"SELECT key::INTEGER AS key, 1 AS code, 'Fee' AS variable, 'higher' AS direction, 'why' AS rationale FROM {_ITEMS} UNION ALL SELECT key::INTEGER, (key % 5)::INTEGER, 'Age', 'lower', 'r' FROM {_ITEMS} WHERE key % 5 BETWEEN 1 AND 3",
    "answer_negatives": f"WITH i AS (SELECT key::INTEGER AS key, unnest(range(8)) AS place FROM {_ITEMS}), x AS (SELECT key, place, ((place + key) % 6)::INTEGER AS index FROM i), f AS (SELECT * FROM x WHERE index BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY key, index ORDER BY place) = 1) SELECT key, 1 AS code, index, 'r' AS reason FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) <= 3",
    "answer_chains": f"""WITH i AS (SELECT key::INTEGER AS key, key % 5 AS o, key % 4 AS r FROM {_ITEMS} WHERE key % 5 < 4) SELECT key, CASE o WHEN 0 THEN 'robust' WHEN 1 THEN 'use_with_caution' WHEN 2 THEN 'not_supported' ELSE 'insufficient_information' END AS tier, CASE WHEN o = 2 THEN 'contradicted' WHEN r IN (1, 2) THEN 'cross_source_corroborated' ELSE 'single_source' END AS level,
  (key * 10) || CASE WHEN r IN (1, 2) THEN ',' || (key * 10 + r) ELSE '' END AS relied, CASE WHEN o = 2 THEN (key * 10 + 2)::VARCHAR ELSE '' END AS contradicting FROM i""",
    "objective_scores_current": oracle("SELECT run_id, coalesce(bool_and(v.item_text IS NOT DISTINCT FROM s.item_text), false) AS current FROM validations v FULL JOIN objective_scores s USING (run_id, item_order) GROUP BY 1", "validations", "objective_scores"),
    "scalar_functions": """SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug,
  list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name || ' é€', ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS fnv,
  lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) AS key, floor(p_retailprice)::BIGINT::VARCHAR AS price FROM part""",
    "windowed_usage": "SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls, sum(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS tokens FROM events GROUP BY 1, 2",
}
