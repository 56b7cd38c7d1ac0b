"""Queries of the qualitative operators: conversations are transcripts, keywords stand for codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.exprs import count_sentences, count_words
from tabulon.operators import coding as C
from tabulon.operators import exports as X
from tabulon.operators import saturation as S
from tabulon.operators import views as V

KEYWORDS = {"article": "the", "joining": "and", "owning": "of", "near": "with", "plain": "die", "asking": "que"}
THEMES = {"article": "grammar", "joining": "grammar", "owning": "grammar", "near": "place", "plain": "place"}


def _turns(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), F.when(F.col("role") == "system", "moderator").otherwise("participant").alias("role"), "text")


def _both(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return turns, C.assign_by_keyword(turns, KEYWORDS)


def _attributes(turns):
    """Respondents' attribute: the parity of their conversation, blank for every fifth."""
    return turns.where("role <> 'moderator'").select("doc", "speaker").distinct().withColumn("value", F.when(F.col("doc") % 5 == 0, " ").when(F.col("doc") % 2 == 0, "even").otherwise("odd"))


def _long_attributes(turns):
    a = _attributes(turns)
    who = F.concat_ws(":", F.col("doc").cast("string"), "speaker")
    return a.select(F.lit("parity").alias("attribute"), "value").union(a.select(F.lit("one"), F.lit("x"))).union(a.select(F.lit("self"), who))


def _study(spark, sf_dir):
    """Twelve conversations as one document of eight respondents; users' first turns are the moderator's in every fifth."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role = F.when((F.col("role") == "system") | ((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0)), "moderator").otherwise("participant")
    return t.select(F.floor(F.col("conv_id") / 12).alias("doc"), (F.col("conv_id") % 12 * 100 + F.col("turn")).alias("idx"), F.concat(F.lit("p"), (F.col("conv_id") % 12 % 8).cast("string")).alias("speaker"), role.alias("role"), "text")


def _coded_study(spark, sf_dir):
    turns = _study(spark, sf_dir)
    return turns, C.assign_by_keyword(turns, KEYWORDS)


def _said_twice(turns):
    """Every second turn is said again, behind a blank."""
    return turns.union(turns.where("idx % 2 = 0").select("doc", F.col("idx") + 1000, "speaker", "role", F.concat(F.lit(" "), "text")))


def _groups(turns):
    return turns.where("doc % 2 = 0").select("doc").distinct()


def _cells(spark, sf_dir):
    """Orders as survey cells: three variables of each row."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pairs = [("case", F.concat(F.lit(" C"), (F.col("o_custkey") % 40).cast("string"))), ("price", F.col("o_totalprice").cast("string")), ("percent", F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit("%"))), ("state", F.col("o_orderstatus"))]
    return o.select(F.col("o_orderkey").alias("row"), F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), v.alias("value")) for n, v in pairs])).alias("c")).select("row", "c.*")


def _keys(spark, sf_dir):
    return _attributes(_turns(spark, sf_dir)).select("doc", "speaker", F.when(F.col("doc") % 6 == 0, " ").otherwise(F.concat(F.lit("c"), (F.col("doc") % 50).cast("string"))).alias("case_key"))


def _dissonance(spark, sf_dir):
    turns, codes = _both(spark, sf_dir)
    links = spark.createDataFrame([("article", "price", "higher"), ("joining", "percent", "lower"), ("near", "state", "higher")], "code string, variable string, direction string")
    return S.dissonance(S.voiced(turns, codes), _keys(spark, sf_dir), _cells(spark, sf_dir), "case", links)


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES = {
    "keyword_counts": lambda s, d: C.keyword_counts(_turns(s, d), list(KEYWORDS.values())),
    "code_stats": lambda s, d: C.code_stats(*_both(s, d), _groups(_turns(s, d))),
    "code_episodes": lambda s, d: C.episodes(*_both(s, d)),
    "code_echoes": lambda s, d: C.echoes(*_both(s, d)),
    "group_coverage": lambda s, d: C.group_coverage(*_both(s, d), _groups(_turns(s, d))),
    "respondents": lambda s, d: C.respondents(_turns(s, d)),
    "word_spread": lambda s, d: C.spread(_turns(s, d).select(count_words(F.col("text")).alias("n")), "n"),
    "word_spread_by_role": lambda s, d: C.spread(_turns(s, d).select("speaker", count_words(F.col("text")).alias("n")), "n", ["speaker"]),
    "word_sentence_counts": lambda s, d: _turns(s, d).select("doc", "idx", count_words(F.col("text")).alias("words"), count_sentences(F.col("text")).alias("sentences")),
    "duplicate_turns": lambda s, d: C.duplicate_turns(_said_twice(_turns(s, d))),
    "themes_by_attribute": lambda s, d: C.themes_by_attribute(_both(s, d)[1], _turns(s, d), _attributes(_turns(s, d))),
    "cooccurrence": lambda s, d: C.cooccurrence(_both(s, d)[1], _turns(s, d)),
    "usable_attributes": lambda s, d: C.usable_attributes(_long_attributes(_turns(s, d))),
    "theme_rollup": lambda s, d: C.theme_rollup(_both(s, d)[1], THEMES).groupBy("code").agg(F.count(F.lit(1)).alias("turns")),
    "across_documents": lambda s, d: C.across_documents(C.code_stats(*_both(s, d), _groups(_turns(s, d)))),
    "kappa_labels": lambda s, d: C.kappa(_labels(s, d), "quality", "toxic"),
    "exemplars": lambda s, d: C.exemplars(*_both(s, d)),
    "saturation_curve": lambda s, d: S.saturation_curve(*_coded_study(s, d)),
    "simple_saturation": lambda s, d: S.simple_saturation(S.saturation_curve(*_coded_study(s, d))),
    "theme_saturation": lambda s, d: S.theme_saturation(*_coded_study(s, d)),
    "shuffled_saturation": lambda s, d: S.shuffled_saturation(*_coded_study(s, d)),
    "data_quality": lambda s, d: S.data_quality(*_coded_study(s, d)).select("doc", "respondents", "participant_turns", "moderator_turns", "total_words", "participant_words", "moderator_word_share", "sentences_per_turn", "top_speaker_share", "top_three_share", "thin_respondents", "duplicate_turns", "coded_share", "thin_themes", F.size("notes").alias("notes")),
    "meaning_split": lambda s, d: S.meaning_split(*_coded_study(s, d)),
    "calibration_sample": lambda s, d: S.calibration_sample(_study(s, d).withColumn("id", F.col("idx")), _coded_study(s, d)[1]),
    "numeric_variables": lambda s, d: S.numeric_variables(_cells(s, d)),
    "case_rows": lambda s, d: S.case_rows(_keys(s, d), _cells(s, d).where("variable = 'case'").select("row", F.col("value").alias("key"))),
    "dissonance": _dissonance,
    "verbatim_rows": lambda s, d: X.verbatim_rows(_turns(s, d), _both(s, d)[1], s.createDataFrame(list(THEMES.items()), "code string, theme string")),
    "themed_extract": lambda s, d: X.themed_extract(_turns(s, d), _both(s, d)[1], s.createDataFrame(list(THEMES.items()), "code string, theme string")),
    "respondent_matrix": lambda s, d: X.respondent_matrix(C.respondents(*_both(s, d)), sorted(KEYWORDS), _turns(s, d).select("doc").distinct().withColumn("codes", F.when(F.col("doc") % 2 == 0, F.array(F.lit("article"), F.lit("near"))).otherwise(F.array(*map(F.lit, sorted(KEYWORDS)))))),
    "verbatim_search": lambda s, d: V.search_verbatims(V.verbatims(_turns(s, d), _both(s, d)[1]), " TH", code="article").select("doc", "idx"),
    "verbatim_uncoded": lambda s, d: V.search_verbatims(V.verbatims(_turns(s, d), _both(s, d)[1]), "user", uncoded=True).select("doc", "idx"),
}

_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w = k)"
_KEYS = ", ".join(f"('{c}', '{k}')" for c, k in KEYWORDS.items())
_TURNS = "turns AS (SELECT conv_id AS doc, turn AS idx, role AS speaker, CASE WHEN role = 'system' THEN 'moderator' ELSE 'participant' END AS role, text FROM conversations)"
_STUDY = "turns AS (SELECT conv_id // 12 AS doc, conv_id % 12 * 100 + turn AS idx, 'p' || (conv_id % 12 % 8) AS speaker, CASE WHEN role = 'system' OR (conv_id % 5 = 0 AND turn = 0) THEN 'moderator' ELSE 'participant' END AS role, text FROM conversations)"
_CODED = f"keys(code, k) AS (VALUES {_KEYS}), codes AS (SELECT doc, idx, code FROM turns CROSS JOIN keys WHERE role <> 'moderator' AND len({_WORDS}) > 0)"
_CODES, _STUDY_CODES = f"{_TURNS}, {_CODED}", f"{_STUDY}, {_CODED}"
_COUNT_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')))"
_SENTENCES = "greatest(1, len(list_filter(string_split_regex(text, '[.!?]+(?:\\s|$)'), lambda p: trim(p) <> '')))"
_EPISODES = "gaps AS (SELECT doc, code, idx, idx - lag(idx) OVER (PARTITION BY doc, code ORDER BY idx) AS gap FROM codes), runs AS (SELECT doc, code, count(*) FILTER (gap IS NULL OR gap > 3) AS episodes FROM gaps GROUP BY 1, 2)"
_PARTS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}'']+'), lambda w: w <> '')"
_ECHOES = f"""coded AS (SELECT c.doc, c.idx, c.code, t.speaker, len({_PARTS}) AS n, list_distinct(list_filter({_PARTS}, lambda w: length(w) > 2)) AS bag FROM codes c JOIN turns t USING (doc, idx)),
echo AS (SELECT DISTINCT a.doc, a.idx, a.code FROM coded a JOIN coded b ON a.doc = b.doc AND a.code = b.code AND b.idx BETWEEN a.idx - 4 AND a.idx - 1 AND a.speaker <> b.speaker
  WHERE a.n <= 15 OR (len(a.bag) > 0 AND len(b.bag) > 0 AND len(list_intersect(a.bag, b.bag)) >= 0.5 * len(list_distinct(list_concat(a.bag, b.bag)))))"""
_ATTR = "attr AS (SELECT DISTINCT doc, speaker, CASE WHEN doc % 5 = 0 THEN ' ' WHEN doc % 2 = 0 THEN 'even' ELSE 'odd' END AS value FROM turns WHERE role <> 'moderator')"
_THEME = ", ".join(f"('{c}', '{t}')" for c, t in THEMES.items())
_STATS = f"""b AS (SELECT c.doc, c.code, count(*) AS turns, count(DISTINCT speaker) AS speakers_with, count(*) FILTER (e.doc IS NOT NULL AND c.doc % 2 = 0) AS echo_turns, count(DISTINCT speaker) FILTER (e.doc IS NULL) AS free FROM codes c JOIN turns USING (doc, idx) LEFT JOIN echo e USING (doc, idx, code) GROUP BY 1, 2),
p AS (SELECT doc, count(*) AS participant_turns, count(DISTINCT speaker) AS speakers_total FROM turns WHERE role <> 'moderator' GROUP BY 1),
stats AS (SELECT b.doc, b.code, turns, participant_turns, speakers_with, speakers_total, episodes, echo_turns, CASE WHEN b.doc % 2 = 0 THEN free END AS independent_speakers FROM b JOIN p USING (doc) JOIN runs USING (doc, code))"""
_ORDER = "o AS (SELECT doc, speaker, row_number() OVER (PARTITION BY doc ORDER BY min(idx)) AS position, count(*) OVER (PARTITION BY doc) AS people FROM turns WHERE role <> 'moderator' GROUP BY 1, 2), v AS (SELECT DISTINCT doc, speaker, code FROM codes JOIN turns USING (doc, idx))"
_CURVE = f"""{_ORDER}, f AS (SELECT doc, code, min(position) AS position FROM v JOIN o USING (doc, speaker) GROUP BY 1, 2), n AS (SELECT doc, position, count(*) AS new_codes FROM f GROUP BY 1, 2),
curve AS (SELECT doc, position::INTEGER AS position, coalesce(new_codes, 0) AS new_codes, (sum(coalesce(new_codes, 0)) OVER (PARTITION BY doc ORDER BY position))::BIGINT AS cumulative FROM o LEFT JOIN n USING (doc, position))"""
_R4 = "floor(({x}) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE"
_CELLS = """cells AS (SELECT o_orderkey AS row, 'case' AS variable, ' C' || (o_custkey % 40) AS value FROM orders UNION ALL SELECT o_orderkey, 'price', o_totalprice::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'percent', (o_orderkey % 90) || '%' FROM orders UNION ALL SELECT o_orderkey, 'state', o_orderstatus FROM orders)"""
_SURVEY = f"""{_CELLS}, keyed AS (SELECT doc, speaker, CASE WHEN doc % 6 = 0 THEN ' ' ELSE 'c' || (doc % 50) END AS k FROM (SELECT DISTINCT doc, speaker FROM turns WHERE role <> 'moderator') r),
hit AS (SELECT lower(trim(value)) AS k, min(row) AS row, count(*) AS matches FROM cells WHERE variable = 'case' GROUP BY 1), found AS (SELECT doc, speaker, row, coalesce(matches, 0) AS matches FROM keyed LEFT JOIN hit USING (k)),
medians AS (SELECT 'price' AS variable, median(o_totalprice) AS median, count(*) AS n FROM orders UNION ALL SELECT 'percent', median((o_orderkey % 90)::DOUBLE), count(*) FROM orders)"""
_HASH = f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split('{S.SAMPLE_SEED}:' || idx, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
# A step for each code in order, one for turns without a code, one for all turns; each takes what earlier steps left of its list.
_SAMPLE = f"""pool AS (SELECT doc, idx, {_HASH} AS rank FROM turns WHERE role <> 'moderator'),
lists AS (SELECT doc, 0 AS kind, code, {S.PER_CODE} AS most, list(idx ORDER BY rank, idx) AS l FROM pool JOIN codes USING (doc, idx) GROUP BY doc, code UNION ALL SELECT doc, 1, '', {max(2, S.SAMPLE // 3)}, list(idx ORDER BY rank, idx) FROM pool WHERE (doc, idx) NOT IN (SELECT (doc, idx) FROM codes) GROUP BY doc UNION ALL SELECT doc, 2, '', {S.SAMPLE}, list(idx ORDER BY rank, idx) FROM pool GROUP BY doc),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY kind, code) AS s, count(*) OVER (PARTITION BY doc) AS last FROM lists),
fold(doc, s, last, taken) AS (SELECT DISTINCT doc, 0::BIGINT, last, []::BIGINT[] FROM steps UNION ALL SELECT f.doc, f.s + 1, f.last, list_concat(f.taken, list_filter(t.l, lambda x: NOT list_contains(f.taken, x))[1:least(t.most, {S.SAMPLE} - len(f.taken))]) FROM fold f JOIN steps t ON t.doc = f.doc AND t.s = f.s + 1)"""
_EXEMPLAR = "CASE WHEN length(t) <= 500 THEN t WHEN greatest(d1, d2, d3) > 500 / 3.0 THEN left(t, greatest(d1, d2, d3) + 1) ELSE trim(left(left(t, 500), 500 - position(' ' IN reverse(left(t, 500))))) END"


def _behind(mark: str) -> str:
    return f"CASE WHEN position('{mark[::-1]}' IN reverse(left(t, 500))) > 0 THEN 500 - position('{mark[::-1]}' IN reverse(left(t, 500))) - 1 ELSE -1 END"


ORACLE_SQL = {
    "keyword_counts": f"WITH {_TURNS}, keys(code, k) AS (VALUES {_KEYS}), n AS (SELECT k, doc, speaker, len({_WORDS}) AS n FROM turns CROSS JOIN keys WHERE role <> 'moderator') SELECT k AS keyword, sum(n)::BIGINT AS mentions, count(*) FILTER (n > 0) AS turns, count(DISTINCT (doc, speaker)) FILTER (n > 0) AS speakers FROM n GROUP BY 1",
    "code_episodes": f"WITH {_CODES}, {_EPISODES} SELECT doc, code, episodes FROM runs",
    "code_echoes": f"WITH {_CODES}, {_ECHOES} SELECT doc, idx, code FROM echo",
    "code_stats": f"WITH {_CODES}, {_EPISODES}, {_ECHOES}, {_STATS} SELECT * FROM stats",
    "group_coverage": f"WITH {_CODES} SELECT code, count(DISTINCT doc) AS groups_with, (SELECT count(DISTINCT doc) FROM turns WHERE doc % 2 = 0) AS groups_total FROM codes WHERE doc % 2 = 0 GROUP BY 1",
    "respondents": f"WITH {_TURNS} SELECT doc, speaker, speaker AS label, count(*) AS turns, sum({_COUNT_WORDS})::BIGINT AS words, sum({_SENTENCES})::BIGINT AS sentences FROM turns WHERE role <> 'moderator' GROUP BY 1, 2",
    "word_spread": f"WITH n AS (SELECT {_COUNT_WORDS}::DOUBLE AS n FROM conversations) SELECT count(n) AS n, min(n) AS min, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, max(n) AS max FROM n",
    "word_spread_by_role": f"WITH n AS (SELECT role AS speaker, {_COUNT_WORDS}::DOUBLE AS n FROM conversations) SELECT speaker, count(n) AS n, min(n) AS min, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, max(n) AS max FROM n GROUP BY 1",
    "word_sentence_counts": f"SELECT conv_id AS doc, turn AS idx, {_COUNT_WORDS}::INTEGER AS words, {_SENTENCES}::INTEGER AS sentences FROM conversations",
    "duplicate_turns": f"WITH {_TURNS}, a AS (SELECT * FROM turns UNION ALL SELECT doc, idx + 1000, speaker, role, ' ' || text FROM turns WHERE idx % 2 = 0), r AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc, speaker, lower(trim(text)) ORDER BY idx) AS k FROM a WHERE role <> 'moderator' AND trim(text) <> '') SELECT doc, idx FROM r WHERE k > 1",
    "themes_by_attribute": f"""WITH {_CODES}, {_ATTR}, known AS (SELECT doc, speaker, nullif(trim(value), '') AS value FROM attr), base AS (SELECT value, count(*) AS base FROM known WHERE value IS NOT NULL GROUP BY 1), said AS (SELECT code, doc, speaker, count(*) AS n FROM codes JOIN turns USING (doc, idx) GROUP BY 1, 2, 3),
seen AS (SELECT code, value, count(*) AS with_code, sum(n)::BIGINT AS turns FROM said JOIN known USING (doc, speaker) WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT k.code, value, coalesce(with_code, 0) AS with_code, base, floor(coalesce(with_code, 0) * 100.0::DOUBLE / base * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS share, coalesce(turns, 0) AS turns, base < 5 AS small_base, (SELECT count(*) FROM known WHERE value IS NULL) AS unknown
FROM (SELECT DISTINCT code FROM said) k CROSS JOIN base LEFT JOIN seen USING (code, value)""",
    "cooccurrence": f"""WITH {_CODES}, t AS (SELECT a.code AS code_a, b.code AS code_b, count(*) AS turns FROM codes a JOIN codes b USING (doc, idx) WHERE a.code <= b.code GROUP BY 1, 2), s AS (SELECT DISTINCT doc, speaker, code FROM codes JOIN turns USING (doc, idx)),
d AS (SELECT a.code AS code_a, b.code AS code_b, count(*) AS respondents FROM s a JOIN s b USING (doc, speaker) WHERE a.code <= b.code GROUP BY 1, 2) SELECT code_a, code_b, coalesce(turns, 0) AS turns, coalesce(respondents, 0) AS respondents FROM t FULL JOIN d USING (code_a, code_b)""",
    "usable_attributes": f"WITH {_TURNS}, {_ATTR}, l AS (SELECT 'parity' AS attribute, value FROM attr UNION ALL SELECT 'one', 'x' FROM attr UNION ALL SELECT 'self', doc || ':' || speaker FROM attr) SELECT attribute, count(*) AS covered, count(DISTINCT value) AS distinct_values FROM l GROUP BY 1 HAVING count(DISTINCT value) >= 2 AND count(DISTINCT value) < count(*)",
    "theme_rollup": f"WITH {_CODES}, th(code, theme) AS (VALUES {_THEME}) SELECT theme AS code, count(DISTINCT (doc, idx)) AS turns FROM codes JOIN th USING (code) GROUP BY 1",
    "across_documents": f"WITH {_CODES}, {_EPISODES}, {_ECHOES}, {_STATS} SELECT code, count(*) AS documents_with, (SELECT count(DISTINCT doc) FROM stats) AS documents_total, sum(turns)::BIGINT AS turns, sum(speakers_with)::BIGINT AS speakers_with, sum(speakers_total)::BIGINT AS speakers_total FROM stats GROUP BY 1",
    "kappa_labels": f"""WITH g AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS both_yes, count(*) FILTER (quality = 1 AND toxic <> 1) AS model_only, count(*) FILTER (quality <> 1 AND toxic = 1) AS researcher_only, count(*) FILTER (quality <> 1 AND toxic <> 1) AS both_no FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
e AS (SELECT *, (both_yes + both_no)::DOUBLE / n AS o, ((both_yes + model_only)::DOUBLE / n) * ((both_yes + researcher_only)::DOUBLE / n) + (1 - (both_yes + model_only)::DOUBLE / n) * (1 - (both_yes + researcher_only)::DOUBLE / n) AS x FROM g), k AS (SELECT *, CASE WHEN x < 1 THEN (o - x) / (1 - x) END AS k FROM e)
SELECT n, both_yes, model_only, researcher_only, both_no, {_R4.format(x="o")} AS agreement, {_R4.format(x="k")} AS kappa, CASE WHEN k IS NULL THEN 'Not defined' WHEN k < 0 THEN 'Worse than chance' WHEN k <= 0.2 THEN 'Slight' WHEN k <= 0.4 THEN 'Fair' WHEN k <= 0.6 THEN 'Moderate' WHEN k <= 0.8 THEN 'Substantial' ELSE 'Almost perfect' END AS band,
  CASE WHEN n < 20 THEN 'Only ' || n || ' turn' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' judged; kappa is unstable below 20.' WHEN least(both_yes + model_only, both_yes + researcher_only) < 3 THEN 'The code applies to very few of the judged turns, so kappa is unstable.' END AS caveat FROM k""",
    "exemplars": f"""WITH {_CODES}, r AS (SELECT doc, code, idx, trim(text) AS t, row_number() OVER (PARTITION BY doc, code ORDER BY abs(length(text) - 220) + CASE WHEN length(text) < 40 THEN 200 ELSE 0 END, idx) AS k FROM codes JOIN turns USING (doc, idx)),
d AS (SELECT *, {_behind(". ")} AS d1, {_behind("? ")} AS d2, {_behind("! ")} AS d3 FROM r WHERE k = 1) SELECT doc, code, idx, {_EXEMPLAR} AS quote FROM d""",
    "saturation_curve": f"WITH {_STUDY_CODES}, {_CURVE} SELECT doc, position, new_codes, cumulative FROM curve",
    "simple_saturation": f"WITH {_STUDY_CODES}, {_CURVE}, g AS (SELECT doc, max(cumulative) FILTER (position = 4) AS b, max(cumulative) FILTER (position = 6) AS u FROM curve GROUP BY 1 HAVING count(*) >= 6) SELECT doc, b AS base_codes, u - b AS new_in_run, CASE WHEN b > 0 THEN {_R4.format(x='(u - b)::DOUBLE / b')} END AS ratio, coalesce(b > 0 AND (u - b)::DOUBLE / b <= 0.05, false) AS saturated FROM g",
    "theme_saturation": f"WITH {_STUDY_CODES}, {_ORDER} SELECT doc, code, count(*) AS participants, min(position)::INTEGER AS first_seen_at, count(*) FILTER (position <= ceil(people / 2.0)) AS in_first_half, count(*) FILTER (position > floor(people * 2 / 3.0)) AS added_in_last_third FROM v JOIN o USING (doc, speaker) GROUP BY 1, 2",
    "data_quality": f"""WITH {_STUDY_CODES}, {_ORDER}, w AS (SELECT *, {_COUNT_WORDS} AS words, {_SENTENCES} AS sents, role <> 'moderator' AS spoken, (doc, idx) IN (SELECT (doc, idx) FROM codes) AS coded FROM turns),
g AS (SELECT doc, count(*) FILTER (spoken) AS participant_turns, count(*) FILTER (NOT spoken) AS moderator_turns, sum(words)::BIGINT AS total_words, coalesce(sum(words) FILTER (spoken), 0)::BIGINT AS participant_words, sum(sents) FILTER (spoken) AS s, count(*) FILTER (spoken AND coded) AS c FROM w GROUP BY 1),
p AS (SELECT doc, speaker, sum(words) AS words, row_number() OVER (PARTITION BY doc ORDER BY sum(words) DESC) AS k FROM w WHERE spoken GROUP BY 1, 2), q AS (SELECT doc, count(*) AS respondents, sum(words) AS a, sum(words) FILTER (k = 1) AS one, sum(words) FILTER (k <= 3) AS three, count(*) FILTER (words < 50) AS thin_respondents FROM p GROUP BY 1),
t AS (SELECT doc, count(*) FILTER (k > 1) AS duplicate_turns FROM (SELECT doc, row_number() OVER (PARTITION BY doc, speaker, lower(trim(text)) ORDER BY idx) AS k FROM turns WHERE role <> 'moderator' AND trim(text) <> '') z GROUP BY 1), h AS (SELECT doc, count(*) FILTER (n < 3) AS thin_themes FROM (SELECT doc, code, count(*) AS n FROM v GROUP BY 1, 2) z GROUP BY 1),
j AS (SELECT *, CASE WHEN moderator_turns > 0 THEN (total_words - participant_words)::DOUBLE / total_words END AS m FROM g LEFT JOIN q USING (doc) LEFT JOIN t USING (doc) LEFT JOIN h USING (doc))
SELECT doc, coalesce(respondents, 0) AS respondents, participant_turns, moderator_turns, total_words, participant_words, {_R4.format(x="m")} AS moderator_word_share, {_R4.format(x="s::DOUBLE / participant_turns")} AS sentences_per_turn, {_R4.format(x="one::DOUBLE / a")} AS top_speaker_share, {_R4.format(x="three::DOUBLE / a")} AS top_three_share,
  coalesce(thin_respondents, 0) AS thin_respondents, coalesce(duplicate_turns, 0) AS duplicate_turns, {_R4.format(x="c::DOUBLE / participant_turns")} AS coded_share, coalesce(thin_themes, 0) AS thin_themes, (CASE WHEN respondents < 8 THEN 1 ELSE 0 END + CASE WHEN m > 0.4 THEN 1 ELSE 0 END + CASE WHEN respondents >= 4 AND one::DOUBLE / a > 0.3 THEN 1 ELSE 0 END)::INTEGER AS notes FROM j""",
    "calibration_sample": f"WITH RECURSIVE {_STUDY_CODES}, {_SAMPLE} SELECT doc, unnest(taken) AS idx FROM fold WHERE s = last",
    "meaning_split": f"WITH {_STUDY_CODES}, {_ORDER}, g AS (SELECT c.doc, c.code, count(*) FILTER (position <= floor(people * 2 / 3.0)) AS early_turns, count(*) FILTER (position > floor(people * 2 / 3.0)) AS late_turns FROM codes c JOIN turns USING (doc, idx) JOIN o USING (doc, speaker) WHERE people >= 6 GROUP BY 1, 2) SELECT *, CASE WHEN early_turns < 3 OR late_turns = 0 THEN 'too_few_turns' ELSE 'ready' END AS verdict FROM g",
    "numeric_variables": f'WITH {_TURNS}, {_SURVEY} SELECT variable, median, n AS "values" FROM medians',
    "case_rows": f"WITH {_TURNS}, {_SURVEY} SELECT doc, speaker, row, matches FROM found",
    "dissonance": f"""WITH {_CODES}, {_SURVEY}, l(code, variable, direction) AS (VALUES ('article', 'price', 'higher'), ('joining', 'percent', 'lower')), v AS (SELECT DISTINCT doc, speaker, code FROM codes JOIN turns USING (doc, idx)), j AS (SELECT v.doc, v.speaker, v.code, variable, direction, median, try_cast(replace(c.value, '%', '') AS DOUBLE) AS value FROM v JOIN l USING (code) JOIN medians USING (variable) LEFT JOIN found USING (doc, speaker) LEFT JOIN cells c USING (row, variable))
SELECT doc, speaker, code, variable, direction, value, median, CASE WHEN value IS NULL THEN 'unmatched' WHEN (direction = 'higher' AND value < median) OR (direction = 'lower' AND value > median) THEN 'dissonant' ELSE 'consistent' END AS state FROM j""",
    "verbatim_rows": f"""WITH {_CODES}, th(code, theme) AS (VALUES {_THEME}) SELECT c.doc, c.code, theme, speaker, idx + 1 AS turn, (SELECT string_agg(o.code, '; ' ORDER BY o.code) FROM codes o WHERE o.doc = c.doc AND o.idx = c.idx AND o.code <> c.code) AS also FROM codes c JOIN turns USING (doc, idx) LEFT JOIN th USING (code)""",
    "themed_extract": f"""WITH {_CODES}, th(code, theme) AS (VALUES {_THEME}) SELECT c.doc, (row_number() OVER (PARTITION BY c.doc ORDER BY theme ASC NULLS LAST, c.code, idx))::INTEGER AS place, theme, c.code, speaker || ' (turn ' || (idx + 1) || ')' AS who FROM codes c JOIN turns USING (doc, idx) LEFT JOIN th USING (code)""",
    "respondent_matrix": f"WITH {_CODES}, p AS (SELECT doc, speaker AS label, count(*) AS turns FROM turns WHERE role <> 'moderator' GROUP BY 1, 2), n AS (SELECT doc, speaker AS label, code, count(*) AS n FROM codes JOIN turns USING (doc, idx) GROUP BY 1, 2, 3) SELECT doc, label, turns, " + ", ".join(f"CASE WHEN doc % 2 <> 0 OR {c in ('article', 'near')} THEN coalesce((SELECT n FROM n WHERE n.doc = p.doc AND n.label = p.label AND code = '{c}'), 0) END AS {c}" for c in sorted(KEYWORDS)) + " FROM p",
    "verbatim_search": f"WITH {_CODES} SELECT doc, idx FROM codes JOIN turns USING (doc, idx) WHERE code = 'article' AND (contains(lower(text), 'th') OR contains(speaker, 'th'))",
    "verbatim_uncoded": f"WITH {_CODES} SELECT doc, idx FROM turns t WHERE role <> 'moderator' AND NOT EXISTS (SELECT 1 FROM codes c WHERE c.doc = t.doc AND c.idx = t.idx) AND (contains(lower(text), 'user') OR contains(speaker, 'user'))",
}
