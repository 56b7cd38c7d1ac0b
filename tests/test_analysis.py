"""The composed analysis against the operators that it is composed of, and its edge cases."""

from pyspark.sql import functions as F

from tabulon.functions.exprs import split_keywords
from tabulon.operators import analysis as A
from tabulon.operators import coding as C
from tabulon.operators import saturation as S

TURNS = "doc long, idx long, speaker string, role string, text string"


def study(spark):
    said = ["I pay the price and the fee", "same here", "the taste is fine", "no price at all for the taste of it", "", "price"]
    rows = [(d, i, [None, "Ann", "Bob", "Cy"][1 + (i * (d + 1)) % 3] if d != 3 else None, "moderator" if i % 5 == 0 else "participant", said[(i + d) % 6] if i != 7 else None) for d in range(4) for i in range(14)]
    rows += [(1, 20, None, "unknown", "who said the price")]
    turns = spark.createDataFrame(rows, TURNS)
    return turns, C.assign_by_keyword(turns, {"cost": "price", "food": "taste", "me": "same"})


def test_parts_equal_the_single_operators(spark):
    turns, codes = study(spark)
    book = spark.createDataFrame([(d, n, c, t, k) for d in range(4) for n, c, t, k in ((1, "cost", "money", "price; fee"), (2, "food", "senses", None), (3, "me", "money", ""), (4, "none", None, None))], "doc long, number int, code string, theme string, keywords string")
    focus = turns.where("doc % 2 = 1").select("doc")
    view = {r.doc: r for r in A.analysis_view(turns, codes.union(codes.limit(2)).union(turns.select("doc", "idx", F.lit("stranger"))), book, focus).collect()}
    for r in C.code_stats(turns, codes, focus).collect():
        own = next(c for c in view[r.doc].codes if c.code == r.code)
        assert (own.turns, own.speakers_with, own.episodes, own.echo_turns, own.independent) == (r.turns, r.speakers_with, r.episodes, r.echo_turns, r.independent_speakers)
        assert view[r.doc].participant_turns == r.participant_turns and view[r.doc].speakers_total == r.speakers_total
    for r in C.code_stats(turns, C.theme_rollup(codes, {"cost": "money", "me": "money", "food": "senses"}), focus).collect():
        own = next(c for c in view[r.doc].themes if c.theme == r.code)
        assert (own.turns, own.speakers_with, own.episodes, own.echo_turns, own.independent) == (r.turns, r.speakers_with, r.episodes, r.echo_turns, r.independent_speakers)
    for r in C.respondents(turns, codes).collect():
        own = next(p for p in view[r.doc].respondents if p.label == r.label)
        assert (own.turns, own.words, own.sentences, {c.code: c.turns for c in own.code_turns}) == (r.turns, r.words, r.sentences, r.code_turns)
    for r in S.saturation_curve(turns, codes).collect():
        assert view[r.doc].curve[r.position - 1] == r.new_codes
    for d in range(4):
        assert [c.number for c in view[d].codes] == [1, 2, 3, 4] and view[d].codes[3].turns == 0
        assert [t.theme for t in view[d].themes] == ["money", "senses"] and view[d].themes[0].codes == ["cost", "me"]
        want = {r.keyword: (r.mentions, r.turns, r.speakers) for r in C.keyword_counts(turns.where(f"doc = {d}"), ["price", "fee"]).collect()}
        assert {k.term: (k.mentions, k.turns, k.speakers) for k in view[d].codes[0].keywords} == want
    assert [p.label for p in view[3].respondents] == [A.WHOLE] and view[3].speakers_total is None and view[3].curve == [] and view[1].unlabelled_turns == 1
    assert sorted((s.label, s.moderator) for s in view[0].speakers)[:2] == [("Ann", False), ("Ann", True)]


def test_documents_without_turns_have_zeros(spark):
    turns, codes = study(spark)
    book = spark.createDataFrame([(9, 1, "cost", None, None)], "doc long, number int, code string, theme string, keywords string")
    r = A.analysis_view(turns, codes, book, turns.select("doc")).first()
    assert (r.doc, r.focus, r.participant_turns, r.codes[0].turns, r.codes[0].speakers_with, r.themes, r.respondents, r.curve) == (9, False, 0, 0, None, [], [], [])
    assert A.analysis_view(turns, codes, book.limit(0), turns.select("doc")).count() == 0
    assert A.analysis_view(turns.limit(0), codes.limit(0), book, turns.select("doc").limit(0)).count() == 1


def test_turns_are_read_once(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), F.lit("participant").alias("role"), "text")
    codes = spark.createDataFrame([(1, 1, "a")], "doc long, idx long, code string")
    book = spark.createDataFrame([(1, 1, "a", "t", "k")], "doc long, number int, code string, theme string, keywords string")
    plan = A.analysis_view(turns, codes, book, codes.select("doc"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_keywords_are_trimmed(spark):
    got = spark.createDataFrame([(" the,  that ;1 price1\nx",), ('say "in deed" now',)], "k string").select(split_keywords(F.col("k")).alias("t")).collect()
    assert [r.t for r in got] == [["the", "that", "1 price1", "x"], ["in deed"]]
