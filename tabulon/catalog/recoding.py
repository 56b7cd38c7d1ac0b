"""Queries of transcripts read again, edited codebooks and the composed analysis over the fixture tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import coding as K
from tabulon.catalog.fixtures import oracle, tables
from tabulon.operators import analysis as A
from tabulon.operators import resegment as R

_SPECS: dict[str, tuple] = {}


def _spec(name: str, function, names: str, sql: str) -> None:
    _SPECS[name] = (function, names.split(), sql)


# Even documents are read again with turns merged in pairs, odd ones with each turn cut at its middle.
def _texts(segments):
    rows = segments.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    return rows.select("doc", F.array_join(F.transform("l", lambda x: F.concat(F.lit("Line: "), x["t"])), "\n\n").alias("text"))


def _merged(segments):
    even = segments.where("doc % 2 = 0").groupBy("doc", F.floor(F.col("idx") / 2).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.struct((F.col("idx") * 2).alias("idx"), F.left("text", half).alias("text")), F.struct((F.col("idx") * 2 + 1).alias("idx"), F.expr("substr(text, CAST(floor(length(text) / 2) AS INT) + 1)").alias("text")))
    odd = segments.where("doc % 2 = 1").select("doc", F.explode(parts).alias("p")).select("doc", "p.*")
    return even.select("doc", "idx", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text")).union(odd)


_NEW = r"""squeezed AS (SELECT doc, regexp_replace(string_agg('Line: ' || coalesce(text, ''), chr(10) ORDER BY idx), '[ \t\n\r\f\v]+', '', 'g') AS body FROM segments GROUP BY doc),
fresh AS (SELECT doc, idx // 2 AS idx, string_agg(coalesce(text, ''), ' ' ORDER BY idx) AS text FROM segments WHERE doc % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT doc, idx * 2 + h, CASE h WHEN 0 THEN left(text, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END FROM segments CROSS JOIN range(2) r(h) WHERE doc % 2 = 1),
turns AS (SELECT *, row_number() OVER (PARTITION BY side, doc ORDER BY idx) AS k, length(own) AS n FROM (
  SELECT 'old' AS side, doc, idx, regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g') AS own FROM segments UNION ALL SELECT 'new', doc, idx, regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g') FROM fresh) x WHERE length(own) > 0),
places(side, doc, k, idx, start, stop) AS (
  SELECT DISTINCT side, doc, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT FROM turns
  UNION ALL SELECT side, doc, k, idx, CASE WHEN z IS NULL THEN NULL ELSE stop + instr(rest, left(own, z)) - 1 END,
    CASE WHEN z IS NULL THEN stop ELSE stop + instr(rest, left(own, z)) + n - 2 + instr(substr(rest, instr(rest, left(own, z)) + n - z), right(own, z)) END
  FROM (SELECT *, CASE WHEN instr(rest, own) > 0 THEN n WHEN FIND40 THEN 40 WHEN FIND20 THEN 20 WHEN FIND10 THEN 10 WHEN FIND4 THEN 4 END AS z FROM (
    SELECT t.*, p.stop, substr(s.body, p.stop + 1) AS rest FROM places p JOIN turns t ON t.side = p.side AND t.doc = p.doc AND t.k = p.k + 1 JOIN squeezed s ON s.doc = t.doc) y) x),
aligned AS (SELECT o.doc, o.idx AS old_idx, n.idx AS new_idx, least(o.stop, n.stop) - greatest(o.start, n.start) AS overlap FROM places o JOIN places n ON o.side = 'old' AND n.side = 'new' AND n.doc = o.doc AND n.start < o.stop AND n.stop > o.start WHERE o.k > 0 AND n.k > 0),
best AS (SELECT doc, old_idx AS idx, first(new_idx ORDER BY overlap DESC, new_idx) AS new_idx, max(overlap) AS overlap FROM aligned GROUP BY 1, 2)"""
for _n in R.ENDS:
    _NEW = _NEW.replace(f"FIND{_n} ", f"n > {_n} AND instr(rest, left(own, {_n})) > 0 AND instr(substr(rest, instr(rest, left(own, {_n})) + n - {_n}), right(own, {_n})) > 0 ")
_spec("turn_alignment", lambda s: R.align_turns(R.turn_spans(_texts(s), s), R.turn_spans(_texts(s), _merged(s)), 64), "segments", f"WITH RECURSIVE {_NEW} SELECT doc, old_idx, new_idx, overlap FROM aligned")


def _held(segments, assignments):
    codes = assignments.join(segments.select("segment_id", "doc", "idx"), "segment_id").select("doc", "idx", (F.col("code_id") % 10).alias("code")).distinct()
    return codes, segments.where("idx % 2 = 0").select("doc", "idx", F.concat(F.lit("note "), F.col("idx").cast("string")).alias("note"))


def _carried(segments, assignments, overrides):
    codes, notes = _held(segments, assignments)
    out = R.resegment(_texts(segments), segments, _merged(segments), codes, overrides, notes)
    rows = out.assignments.select("doc", "idx", F.lit("code").alias("kind"), F.col("code").cast("string").alias("what"))
    rows = rows.union(out.overrides.select("doc", "idx", F.lit("override"), F.concat_ws(":", F.lower(F.trim("name")), "action"))).union(out.notes.select("doc", "idx", F.lit("note"), "note"))
    return rows.union(out.lost.select("doc", F.lit(-1).cast("long"), F.concat(F.lit("lost "), "kind"), F.col("lost").cast("string")))


_spec("resegment_carry", _carried, "segments assignments overrides", f"""WITH RECURSIVE {_NEW},
held AS (SELECT DISTINCT doc, idx, code_id % 10 AS code FROM assignments JOIN segments USING (segment_id)), noted AS (SELECT doc, idx, 'note ' || idx AS note FROM segments WHERE idx % 2 = 0)
SELECT DISTINCT doc, new_idx AS idx, 'code' AS kind, code::VARCHAR AS what FROM held JOIN best USING (doc, idx)
UNION ALL SELECT doc, new_idx, 'override', first(lower(trim(name)) || ':' || action ORDER BY overlap DESC, idx) FROM overrides JOIN best USING (doc, idx) GROUP BY doc, new_idx, lower(regexp_replace(trim(name), '\\s+', ' ', 'g'))
UNION ALL SELECT doc, new_idx, 'note', first(note ORDER BY overlap DESC, idx) FROM noted JOIN best USING (doc, idx) GROUP BY doc, new_idx
UNION ALL SELECT doc, -1, 'lost ' || kind, count(*)::VARCHAR FROM (SELECT 'assignments' AS kind, doc, idx FROM held UNION ALL SELECT 'overrides', doc, idx FROM overrides UNION ALL SELECT 'notes', doc, idx FROM noted) l ANTI JOIN best USING (doc, idx) GROUP BY doc, kind""")

# Every second document renames a code, drops one and adds one; every seventh has edits that can't be a codebook.
_EDITS = """SELECT doc, position AS place, code_id, CASE WHEN doc % 7 = 3 THEN 'Twice' WHEN name = 'Trust' AND doc % 2 = 0 THEN 'Faith' WHEN name = 'Price' THEN ' price ' ELSE name END AS name, CASE WHEN name = 'Time' OR doc % 7 = 5 THEN ' ' ELSE definition END AS definition
FROM {codes} JOIN {books} ON codes.codebook_id = books.codebook_id UNION ALL SELECT doc, 9, NULL, 'Care', 'new' FROM {books} WHERE doc % 2 = 0 AND doc % 7 <> 5"""


def _reapplied(codes, codebooks, assignments):
    from tabulon.operators.views import codebooks_in_force

    force = codebooks_in_force(codebooks)
    edits = codes.sparkSession.sql(_EDITS.replace("{codes}", "{codes} AS codes").replace("{books} ", "{books} AS books ").replace("{books}\n", "{books} AS books\n"), codes=codes, books=force)
    new = force.select("doc", (F.col("codebook_id") + 1_000_000).alias("codebook_id"), "run_id")
    out = R.reapply_codebook(codebooks, codes, assignments, edits, new)
    turns = out.assignments.groupBy("code_id").agg(F.count(F.lit(1)).alias("turns"))
    left = out.open.select("code_id", F.lit(True).alias("open"))
    rows = out.codes.join(out.codebooks.select("codebook_id", "doc", "version"), "codebook_id").join(turns, "code_id", "left").join(left, "code_id", "left")
    rows = rows.select("doc", "code_id", F.col("version").cast("int").alias("version"), F.trim("name").alias("name"), F.col("position").cast("int").alias("position"), F.col("reproduced_runs").cast("int").alias("reproduced_runs"), "added_by_researcher", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("open", F.lit(False)).alias("open"), F.lit(None).cast("string").alias("problem"))
    none = F.lit(None)
    bad = out.problems.select("doc", none.cast("long"), none.cast("int"), none.cast("string"), none.cast("int"), none.cast("int"), none.cast("boolean"), none.cast("long"), none.cast("boolean"), "reason")
    return rows.union(bad)


_BOOKS = "books AS (SELECT * FROM codebooks QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1)"
_spec("codebook_reapply", _reapplied, "codes codebooks assignments", f"""WITH {_BOOKS}, edits AS ({_EDITS.format(codes="codes", books="books")}),
filled AS (SELECT doc, place, code_id, trim(name) AS name FROM edits WHERE trim(definition) <> '' AND trim(name) <> ''),
bad AS (SELECT b.doc, CASE WHEN count(f.doc) = 0 THEN '{R.NO_CODES}' ELSE 'Two codes are both called "Twice".' END AS reason FROM books b LEFT JOIN filled f ON f.doc = b.doc GROUP BY b.doc HAVING count(f.doc) = 0 OR count(DISTINCT lower(f.name)) < count(*)),
made AS (SELECT f.doc, b.codebook_id + 1000000 AS codebook_id, b.version + 1 AS version, f.name, row_number() OVER (PARTITION BY f.doc ORDER BY place) - 1 AS position, c.code_id AS old_id, coalesce(lower(trim(c.name)) = lower(f.name), false) AS keeps, c.reproduced_runs
  FROM filled f JOIN books b ON b.doc = f.doc LEFT JOIN codes c ON c.code_id = f.code_id WHERE f.doc NOT IN (SELECT doc FROM bad)),
marked AS (SELECT DISTINCT doc, lower(trim(name)) AS key FROM codes JOIN codebooks USING (codebook_id) WHERE added_by_researcher), n AS (SELECT code_id, count(*) AS turns FROM assignments GROUP BY 1)
SELECT doc, code_id, version::INTEGER AS version, trim(c.name) AS name, position::INTEGER AS position, reproduced_runs::INTEGER AS reproduced_runs,
  added_by_researcher OR (doc IN (SELECT doc FROM bad) AND codebook_id IN (SELECT codebook_id FROM books) AND EXISTS (SELECT 1 FROM marked m WHERE m.doc = k.doc AND m.key = lower(trim(c.name)))) AS added_by_researcher, coalesce(turns, 0) AS turns, false AS open, NULL AS problem
FROM codes c JOIN codebooks k USING (codebook_id) LEFT JOIN n USING (code_id)
UNION ALL SELECT doc, codebook_id * 100 + position, version, name, position, CASE WHEN keeps THEN reproduced_runs END, EXISTS (SELECT 1 FROM marked m WHERE m.doc = made.doc AND m.key = lower(made.name)), CASE WHEN keeps THEN coalesce(turns, 0) ELSE 0 END, NOT keeps, NULL FROM made LEFT JOIN n ON n.code_id = old_id
UNION ALL SELECT doc, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM bad""")


# The composed analysis: conversations as transcripts, every second one a focus group; one code has a keyword of two terms, one is on no turn.
_BOOK = [(1, "article", "grammar", "the, that"), (2, "joining", "grammar", ""), (3, "owning", "grammar", ""), (4, "near", "place", "with"), (5, "plain", "place", None), (6, "asking", None, None), (7, "unused", "", "zzzz")]


def _analysis(spark, sf_dir):
    turns, codes = K._both(spark, sf_dir)
    book = turns.select("doc").distinct().crossJoin(F.broadcast(spark.createDataFrame(_BOOK, "number int, code string, theme string, keywords string")))
    return A.analysis_view(turns, codes, book, K._groups(turns))


def _line(items, *fields: str):
    text = lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])
    return F.array_join(F.transform(items, text), ";")


def _analysis_text(spark, sf_dir):
    """The nested results of each document as lines of text."""
    v = _analysis(spark, sf_dir)
    keywords = F.flatten(F.transform("codes", lambda c: c["keywords"]))
    held = F.array_join(F.transform("respondents", lambda r: F.array_join(F.transform(r["code_turns"], lambda c: F.concat_ws("=", c["code"], c["turns"].cast("string"))), ",")), ";")
    measures = ("turns", "speakers_with", "episodes", "echo_turns", "independent")
    return v.select(
        "doc", "focus", "participant_turns", "moderator_turns", "unlabelled_turns", F.col("speakers_total").cast("long").alias("speakers_total"), _line("codes", "number", "code", "theme", *measures).alias("codes"), _line("themes", "theme", *measures).alias("themes"),
        _line(keywords, "term", "mentions", "turns", "speakers").alias("keywords"), _line("respondents", "label", "turns", "words", "sentences").alias("respondents"), held.alias("held"), _line("speakers", "label", "turns", "moderator").alias("speakers"), F.array_join(F.transform("curve", lambda n: n.cast("string")), ",").alias("curve"),
    )


def _analysis_sql() -> str:
    values = ", ".join("(" + ", ".join("NULL" if x is None or x == "" else repr(x) for x in row[:3]) + ")" for row in _BOOK)
    terms = ", ".join(f"({row[0]}, {i}, '{t.strip()}')" for row in _BOOK for i, t in enumerate((row[3] or "").split(",")) if t.strip())

    def measured(side: str) -> str:
        """Turns, speakers, episodes and echoes of the units (doc, code, idx) of a relation."""
        echo = K._ECHOES.replace("codes c", f"{side} c").replace("coded", f"coded_{side}").replace("echo AS", f"echo_{side} AS")
        return f"""{echo}, gaps_{side} AS (SELECT doc, code, idx - lag(idx) OVER (PARTITION BY doc, code ORDER BY idx) AS gap FROM {side}), runs_{side} AS (SELECT doc, code, count(*) FILTER (gap IS NULL OR gap > 3) AS episodes FROM gaps_{side} GROUP BY 1, 2),
stats_{side} AS (SELECT c.doc, c.code, count(*) AS turns, count(DISTINCT speaker) AS speakers_with, any_value(r.episodes) AS episodes, count(*) FILTER (e.doc IS NOT NULL AND c.doc % 2 = 0) AS echo_turns, count(DISTINCT speaker) FILTER (e.doc IS NULL) AS free
  FROM {side} c JOIN turns USING (doc, idx) LEFT JOIN echo_{side} e USING (doc, idx, code) JOIN runs_{side} r USING (doc, code) GROUP BY 1, 2)"""

    shown = "coalesce(turns, 0) || '|' || CASE WHEN total IS NULL THEN '-' ELSE coalesce(speakers_with, 0)::VARCHAR END || '|' || coalesce(episodes, 0) || '|' || coalesce(echo_turns, 0) || '|' || CASE WHEN total IS NULL OR d.doc % 2 = 1 THEN '-' ELSE coalesce(free, 0)::VARCHAR END"
    mentions = "len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w = term))"
    return f"""WITH {K._CODES}, book(number, code, theme) AS (VALUES {values}), terms(number, spot, term) AS (VALUES {terms}),
themed AS (SELECT DISTINCT doc, idx, theme AS code FROM codes JOIN book USING (code) WHERE theme IS NOT NULL), {measured('codes')}, {measured('themed')},
d AS (SELECT doc, count(*) FILTER (role <> 'moderator') AS participant_turns, count(*) FILTER (role = 'moderator') AS moderator_turns, count(*) FILTER (role <> 'moderator' AND speaker IS NULL) AS unlabelled_turns, nullif(count(DISTINCT speaker) FILTER (role <> 'moderator'), 0) AS total FROM turns GROUP BY 1),
code_lines AS (SELECT d.doc, string_agg(number || '|' || b.code || '|' || coalesce(theme, '-') || '|' || {shown}, ';' ORDER BY number) AS t FROM d CROSS JOIN book b LEFT JOIN stats_codes s ON s.doc = d.doc AND s.code = b.code GROUP BY 1),
theme_lines AS (SELECT d.doc, string_agg(theme || '|' || {shown}, ';' ORDER BY number) AS t FROM d CROSS JOIN (SELECT theme, min(number) AS number FROM book WHERE theme IS NOT NULL GROUP BY 1) b LEFT JOIN stats_themed s ON s.doc = d.doc AND s.code = b.theme GROUP BY 1),
hits AS (SELECT doc, number, spot, term, {mentions} AS n, speaker FROM turns CROSS JOIN terms WHERE role <> 'moderator'),
term_lines AS (SELECT doc, string_agg(term || '|' || m || '|' || k || '|' || CASE WHEN total IS NULL THEN '-' ELSE w::VARCHAR END, ';' ORDER BY number, spot) AS t FROM (SELECT doc, number, spot, term, sum(n)::BIGINT AS m, count(*) FILTER (n > 0) AS k, count(DISTINCT speaker) FILTER (n > 0) AS w FROM hits GROUP BY 1, 2, 3, 4) h JOIN d USING (doc) GROUP BY doc),
people AS (SELECT doc, speaker, min(idx) AS first, count(*) AS turns, sum({K._COUNT_WORDS}) AS words, sum({K._SENTENCES}) AS sentences FROM turns JOIN d USING (doc) WHERE role <> 'moderator' AND (speaker IS NOT NULL OR total IS NULL) GROUP BY 1, 2),
voices AS (SELECT doc, speaker, code, count(*) AS n FROM codes JOIN turns USING (doc, idx) GROUP BY 1, 2, 3), own AS (SELECT doc, speaker, string_agg(code || '=' || n, ',' ORDER BY code) AS t FROM voices GROUP BY 1, 2),
people_lines AS (SELECT doc, string_agg(coalesce(speaker, '{A.WHOLE}') || '|' || turns || '|' || words || '|' || sentences, ';' ORDER BY first) AS t, string_agg(coalesce(own.t, ''), ';' ORDER BY first) AS h FROM people LEFT JOIN own USING (doc, speaker) GROUP BY 1),
speaker_lines AS (SELECT doc, string_agg(speaker || '|' || n || '|' || asks, ';' ORDER BY first) AS t FROM (SELECT doc, speaker, min(idx) AS first, count(*) AS n, role = 'moderator' AS asks FROM turns WHERE speaker IS NOT NULL GROUP BY doc, speaker, role) x GROUP BY 1),
places AS (SELECT doc, speaker, row_number() OVER (PARTITION BY doc ORDER BY first) AS place FROM people WHERE speaker IS NOT NULL), met AS (SELECT doc, code, min(place) AS place FROM voices JOIN places USING (doc, speaker) GROUP BY 1, 2),
curve AS (SELECT doc, string_agg(n::VARCHAR, ',' ORDER BY place) AS t FROM (SELECT p.doc, p.place, count(m.code) AS n FROM places p LEFT JOIN met m USING (doc, place) GROUP BY 1, 2) x GROUP BY 1)
SELECT d.doc, d.doc % 2 = 0 AS focus, participant_turns, moderator_turns, unlabelled_turns, total AS speakers_total, c.t AS codes, m.t AS themes, coalesce(k.t, '') AS keywords, coalesce(p.t, '') AS respondents, coalesce(p.h, '') AS held, coalesce(s.t, '') AS speakers, coalesce(v.t, '') AS curve
FROM d JOIN code_lines c USING (doc) JOIN theme_lines m USING (doc) LEFT JOIN term_lines k USING (doc) LEFT JOIN people_lines p USING (doc) LEFT JOIN speaker_lines s USING (doc) LEFT JOIN curve v USING (doc)"""


def _query(name: str):
    function, names, _ = _SPECS[name]
    return lambda spark, sf_dir: function(*tables(spark, sf_dir, *names))


QUERIES = {name: _query(name) for name in _SPECS}
ORACLE_SQL = {name: oracle(sql, *names) for name, (_, names, sql) in _SPECS.items()}
QUERIES["analysis_view"] = _analysis_text
ORACLE_SQL["analysis_view"] = _analysis_sql()
