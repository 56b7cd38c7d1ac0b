"""Operators on small literal tables with answers worked out by hand."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions import exprs as X
from tabulon.functions import stats as ST
from tabulon.operators import coding as C
from tabulon.operators import evidence as E
from tabulon.operators import judge as J
from tabulon.operators import patterns as P
from tabulon.operators import quotes as Q
from tabulon.operators import saturation as S
from tabulon.operators import tables as T
from tabulon.operators import transcripts as R
from tabulon.operators import validators as V
from tabulon.operators.changes import upsert
from tabulon.plans.components import connected_components
from tabulon.sources import grids as G
from tabulon.sources import tables as IO
from tabulon.streaming.usage import usage_stream, windowed_usage


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_rounding_is_half_up(spark):
    assert one(spark, X.jround(F.lit(-0.125), 2)) == -0.12
    assert one(spark, X.jround(F.lit(2.5))) == 3.0


def test_missing_and_numbers(spark):
    rows = spark.createDataFrame([(v,) for v in ("", " N/A ", ".", "x", None, "1,234", "12%", "Infinity", "1d")], "v string").select(X.is_missing(F.col("v")).alias("m"), X.as_number(F.col("v"), percent=True).alias("n")).collect()
    assert [r.m for r in rows] == [True, True, True, False, True, False, False, False, False]
    assert [r.n for r in rows] == [None, None, None, None, None, 1234.0, 12.0, None, None]


def test_text_helpers(spark):
    assert one(spark, X.normalize_text(F.lit("  “A” –  b c"))) == '"a" - b c'
    assert one(spark, X.join_numbered(F.array(F.lit("a")))) == "a"
    assert one(spark, X.join_numbered(F.array(F.lit("a"), F.lit("b")))) == "1. a\n2. b"
    assert one(spark, X.fnv1a(F.lit(""))) == 2166136261 and one(spark, X.fnv1a(F.lit(None).cast("string"))) is None
    hashed, said = 2166136261, "naïve € 😀".encode("utf-16-be")
    for i in range(0, len(said), 2):
        hashed = (hashed ^ int.from_bytes(said[i : i + 2])) * 16777619 % 2**32
    assert one(spark, X.fnv1a(F.lit("naïve € 😀"))) == hashed
    assert one(spark, X.split_numbered(F.lit("1. a\n2. b"))) == ["a", "b"]
    assert one(spark, X.cap_words(F.lit("One two. Three four five six"), F.lit(3))) == "One two."
    assert one(spark, X.split_numbered(F.lit("\t1. a\n \n2.\n3b\u00a0"))) == ["a", "", "3b"]
    assert one(spark, X.cap_words(F.lit(" One\n two.\u00a0 Three, (four)! five six "), F.lit(4))) == "One\n two.\u00a0 Three, (four)!"
    assert one(spark, X.cap_words(F.lit(None).cast("string"), F.lit(4))) == "" and one(spark, X.cap_words(F.lit("One"), F.lit(4))) == "One"
    assert one(spark, X.cap_words(F.lit("One two. Three"), F.lit(1))) == "One…"
    assert one(spark, X.cap_words(F.lit("One. two three, four five six"), F.lit(3))) == "One. two three,…"
    assert one(spark, X.keyword_count(F.lit("price Priced PRICE"), F.lit("price"))) == 2


def test_statistics(spark):
    assert one(spark, ST.margin_of_error(F.lit(100), F.lit(0.5))) == 9.8
    gap, z, significant = ST.proportion_gap(F.lit(100), F.lit(0.6), F.lit(100), F.lit(0.4))
    assert (one(spark, gap), one(spark, z), one(spark, significant)) == (20.0, 2.83, True)
    gap, t, _ = ST.mean_gap(F.lit(10), F.lit(5.0), F.lit(4.0), F.lit(10), F.lit(3.0), F.lit(4.0))
    assert (one(spark, gap), one(spark, t)) == (2.0, 2.24)
    assert ST.f_tail(4.2565, 2, 9) == pytest.approx(0.05, abs=1e-4)
    assert one(spark, ST.log_gamma(F.lit(5.0))) == pytest.approx(math.log(24))


def test_anova_without_spread_and_small_groups(spark):
    rows = [("a", 1.0, 0), ("a", 1.0, 1), ("b", 2.0, 2), ("b", 2.0, 3), ("c", 9.0, 4)]
    got = T.anova(spark.createDataFrame(rows, "g string, v double, r int"), "g", "v", "r").first()
    assert (got.k, got.n, got.f_stat, got.p_value, got.significant) == (2, 4, None, 0.0, True)


def test_banner_plan_stops_at_a_flat_anova(spark):
    rows = [(g, float(i % 3), i) for i, g in enumerate(["a", "b", "c"] * 12)]
    rows = [(g, 1.0 + (i // 3) % 2, i) for i, (g, _, _) in enumerate(rows)]
    got = P.banner_plan(spark.createDataFrame(rows, "g string, v double, r int"), ["g"], ["v"], "r", {"v"}).collect()
    assert [r.test for r in got] == ["anova"] and "not_significant" in got[0].caveats


def test_banner_plan_tells_what_it_cannot_test(spark):
    rows = [("a", 1.0, 0), ("b", 2.5, 1), ("c", 9.0, 2)]
    got = P.banner_plan(spark.createDataFrame(rows, "g string, v double, r int"), ["g"], ["v"], "r", {"v"}).orderBy("place").collect()
    assert [(r.test, r.cat_a, r.caveats) for r in got] == [("descriptive", c, ["insufficient_n_for_test", "sampling_assumed_random"]) for c in "abc"]
    assert got[1].description == 'g "b" has a single v reading of 2.5, too little data in this group alone to test against the others.'
    with pytest.raises(ValueError):
        P.banner_plan(spark.createDataFrame(rows, "g string, v double, r int"), [], ["v"], "r", {"v"})


def test_outlier_is_judged_against_the_others(spark):
    rows = [(i, float(v)) for i, v in enumerate([10, 11, 9, 10, 12, 60])]
    assert [r.row for r in T.outliers(spark.createDataFrame(rows, "r int, v double"), "v", "r").collect()] == [5]


def test_best_split(spark):
    rows = [(float(i), 10.0 + (i % 3) + (20 if i >= 10 else 0)) for i in range(20)]
    got = T.best_split(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (got.label, got.n_1, got.n_2) == ("x < 9.5", 10, 10)


def test_row_order_is_kept_by_the_ordinal(spark):
    rows = [(i, random.Random(i).choice("xyz"), random.Random(i * 7).choice("pq")) for i in range(60)]
    a = T.crosstab(spark.createDataFrame(rows, "r int, b string, s string"), "b", "s", "r").collect()
    random.Random(1).shuffle(rows)
    b = T.crosstab(spark.createDataFrame(rows, "r int, b string, s string"), "b", "s", "r").collect()
    assert sorted(a) == sorted(b) and sum(r.n for r in a) == 60


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_match_union_find(spark, small):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TURNS = [(1, 0, "M", "moderator", "Why?"), (1, 1, "A", "participant", "the price is too high for me and my family now"), (1, 2, "B", "participant", "yes the price"), (1, 9, "A", "participant", "the price again")]


def test_codes_episodes_and_echoes(spark):
    turns = spark.createDataFrame(TURNS, "doc long, idx int, speaker string, role string, text string")
    codes = C.assign_by_keyword(turns, {"cost": "price"})
    got = C.code_stats(turns, codes, turns.select("doc")).first()
    assert (got.turns, got.participant_turns, got.speakers_with, got.speakers_total, got.episodes, got.echo_turns, got.independent_speakers) == (3, 3, 2, 2, 2, 1, 1)
    assert C.code_stats(turns, codes, turns.select("doc").limit(0)).first().echo_turns == 0
    bare = turns.withColumn("speaker", F.lit(None).cast("string"))
    assert C.code_stats(bare, codes, turns.select("doc")).first().speakers_with is None
    assert [r.label for r in C.respondents(bare, codes).collect()] == ["Whole transcript"]
    assert [r.context for r in R.with_context(turns).orderBy("idx").collect()] == ["Why?", None, None]


@pytest.mark.parametrize(("counts", "kappa", "band"), [((20, 5, 10, 15), 0.4, "Fair"), ((5, 5, 5, 5), 0.0, "Slight"), ((5, 0, 0, 5), 1.0, "Almost perfect"), ((0, 0, 5, 5), None, "Not defined")])
def test_kappa(spark, counts, kappa, band):
    pairs = [(1, 1)] * counts[0] + [(1, 0)] * counts[1] + [(0, 1)] * counts[2] + [(0, 0)] * counts[3]
    if kappa is None:
        pairs = [(0, 0)] * 10
    got = C.kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    assert (got.kappa, got.band) == (kappa, band) and (got.caveat is None) == (len(pairs) >= 20)
    edges = spark.createDataFrame([(v,) for v in (-0.1, 0.2, 0.204, 0.41, 0.61, 0.81)], "k double").select(C.kappa_band(F.col("k")).alias("b")).collect()
    assert [r.b for r in edges] == ["Worse than chance", "Slight", "Fair", "Moderate", "Substantial", "Almost perfect"]


def test_exemplars_are_cut_behind_a_sentence(spark):
    long = "word " * 50 + "end. " + "more " * 60
    turns = spark.createDataFrame([(1, 0, "A", "participant", long), (2, 0, "A", "participant", "word " * 300), (3, 0, "M", "moderator", "x" * 220)], "doc long, idx int, speaker string, role string, text string")
    got = {r.doc: r.quote for r in C.exemplars(turns, turns.select("doc", "idx", F.lit("c").alias("code"))).collect()}
    assert got[1] == ("word " * 50 + "end.") and got[2] == ("word " * 100).strip() and 3 not in got


def test_calibration_sample(spark):
    rows = [(1, f"s{i}", i, "moderator" if i % 10 == 0 else "participant") for i in range(60)]
    codes = [(1, i, "a") for i in range(1, 60, 6)] + [(1, i, "b") for i in (3, 4, 5)]
    turns, marks = spark.createDataFrame(rows, "doc long, id string, idx long, role string"), spark.createDataFrame(codes, "doc long, idx long, code string")
    got = [r.idx for r in S.calibration_sample(turns, marks, size=12).collect()]
    assert len(got) == 12 == len(set(got)) and got == sorted(got) and not any(i % 10 == 0 for i in got)
    for c in "ab":
        assert sum((1, i, c) in codes for i in got) >= 2
    assert sum(all(i != j for _, j, _ in codes) for i in got) >= 2


def test_shuffled_saturation_is_seeded(spark):
    first = list(itertools.islice(S.uniform_stream(20260101), 3))
    assert all(0 <= x < 1 for x in first) and first == list(itertools.islice(S.uniform_stream(20260101), 3))
    turns = spark.createDataFrame([(1, i, f"p{i}", "participant", "t") for i in range(5)], "doc long, idx int, speaker string, role string, text string")
    codes = spark.createDataFrame([(1, i, f"c{min(i, 2)}") for i in range(5)], "doc long, idx int, code string")
    got = S.shuffled_saturation(turns, codes).orderBy("position").collect()
    assert len(got) == 5 and got[0].median == 1.0 and got[-1].low == got[-1].high == 3.0 and all(r.low <= r.median <= r.high for r in got)


def test_duplicate_statements(spark):
    rows = [(1, "Price drives choice among young buyers"), (2, "Price drives choice among the young buyers today"), (3, "Stores matter little")]
    got = {r.id: r.group_id for r in E.duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == {1: 1, 2: 1}


@pytest.mark.parametrize("likeness", [0.3, 0.55, 0.8, 1.0])
def test_similar_sets_lose_no_pair(spark, likeness):
    """Short and long sets, families of near copies, words that nearly all hold, against every pair."""
    rng = random.Random(11)
    texts = []
    for size in (1, 2, 3, 8, 40, 600):
        for _ in range(6):
            base = [f"w{rng.randrange(4 * size + 3)}" for _ in range(size)] + ["hot", "hotter"] * (size > 2)
            texts += [" ".join(w for w in base if rng.random() > loss) for loss in (0, 0.02, 0.2, 0.5)]
    texts += ["", "  ", None, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset((t or "").split()), i)
    sets.pop(frozenset())
    want = set()
    for (x, a), (y, b) in itertools.combinations(sets.items(), 2):
        if len(x & y) >= likeness * len(x | y):
            want.add((a, b, math.floor(len(x & y) / len(x | y) * 1000 + 0.5) / 1000))
    got = [tuple(r) for r in E.similar_statements(df, "id", "t", likeness).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (want or likeness == 1.0)
    assert E.similar_statements(df.limit(0), "id", "t", likeness).count() == 0


def test_archive_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "rejected"), (2, "accepted")], "id long, status string")
    kept, history = E.archive(rows, rows.limit(0), "id", F.col("status") == "rejected")
    assert [r.id for r in kept.collect()] == [2] and history.count() == 1
    assert E.archive(rows, history, "id", F.col("status") == "rejected")[1].count() == 1


LABELLED = """Moderator: How do you feel about the new fees?
Thandi: Honestly I think the fees are too high for what we get. I do not see the value.
Moderator: And you?
Sipho: For me it is the trust. I do not trust the app with my money.
Moderator: Say more about that.
Sipho: Last year they froze my account for a week and nobody called me back."""


def read(spark, text, **how):
    reading = R.read_transcripts(spark.createDataFrame([(1, text)], "doc long, text string"), **how)
    return reading.segments.orderBy("idx").collect(), reading.modes.first(), {(r.speaker, r.field): r.value for r in reading.profiles.collect()}


def test_labelled_transcripts(spark):
    got, mode, _ = read(spark, LABELLED)
    assert mode.mode == "labels" and [(r.speaker, r.role) for r in got[:2]] == [("Moderator", "moderator"), ("Thandi", "participant")] and len(got) == 6
    once, _, _ = read(spark, "Moderator: Why?\nAnna: Price.\nModerator: And?\nBen: Taste.\nModerator: Thanks.")
    assert [r.speaker for r in once] == ["Moderator", "Anna", "Moderator", "Ben", "Moderator"]
    prose, mode, _ = read(spark, "The reason: it was late.\n\nAnother paragraph here with no labels at all.")
    assert mode.mode == "none" and [(r.speaker, r.role) for r in prose] == [(None, "unknown")] * 2
    more, _, _ = read(spark, "Q: First?\nA: one line\nand more of the answer\nQ: Second?\nA: another\nQ: Third?\nA: last")
    assert (more[1].text, more[1].role, more[0].role) == ("one line and more of the answer", "participant", "moderator")
    named, _, _ = read(spark, "Anna: How do you feel?\nBen: Fine thanks.\nAnna: And the cost?\nBen: Too high.", moderators=["anna"])
    assert [r.role for r in named].count("moderator") == 2
    assert all(len(p) <= 1200 for p in R.split_long("This is a fairly long sentence about prices. " * 60))


def test_headings_and_sessions(spark):
    notes = "Interview 1 Transcript\nDemographics\n- Sex: Male\n- Age Group: 25-34\nCharging stations are limited.\n\nInterview 2 Transcript\nDemographics\nSex: Female\nCost is the main worry."
    got, mode, profiles = read(spark, notes)
    assert mode.mode == "headings" and [r.speaker for r in got] == ["Interview 1", "Interview 2"] and "Cost is the main worry" in got[1].text and "Sex" not in got[0].text
    assert profiles == {("Interview 1", "Sex"): "Male", ("Interview 1", "Age Group"): "25-34", ("Interview 2", "Sex"): "Female"}
    groups = "Setting: fictional\n\nFOCUS GROUP 1: PREPAID CUSTOMERS\nModerator: M, facilitator.\n[00:00-06:00] Introductions\nM: Welcome.\nP1: Prices vary.\nP2: I agree.\nM: Thanks.\nFOCUS GROUP 2: CONTRACT\nM: Hello.\nP1: Fine.\nP2: Fees."
    got, mode, profiles = read(spark, groups)
    assert mode.mode == "sessions" and {r.speaker for r in got if r.role == "participant"} == {"P1 (Focus group 1)", "P2 (Focus group 1)", "P1 (Focus group 2)", "P2 (Focus group 2)"}
    assert any(r.speaker == "M" and r.role == "moderator" for r in got) and not any("Introductions" in r.text for r in got) and "before the first session heading" in mode.notes[0]
    assert profiles["P1 (Focus group 1)", "Session title"] == "PREPAID CUSTOMERS"
    talks = "Index\nU01 Unstructured\n\nU01: Unstructured interview\nNandi, 26 | Student | Prepaid\nI: Tell me about it.\nR: It is fine.\nI: And?\nR: Good.\nS01: Semi-structured\nI: Start.\nR: Yes."
    got, mode, profiles = read(spark, talks)
    assert mode.mode == "sessions" and {r.speaker for r in got if r.role == "participant"} == {"U01", "S01"} and {r.speaker for r in got if r.role == "moderator"} == {"I"}
    assert profiles["U01", "Session title"] == "Unstructured interview" and "Nandi" in profiles["U01", "Profile"]
    two, _, _ = read(spark, "First person says this.\n\nSecond person says that.", mode="paragraphs")
    assert [r.speaker for r in two] == ["Respondent 1", "Respondent 2"]
    _, mode, _ = read(spark, "Just prose.\n\nMore prose.", mode="headings")
    assert mode.mode == "none" and "No headings" in mode.notes[0]
    empty = R.read_transcripts(spark.createDataFrame([(1, None), (2, "")], "doc long, text string"))
    assert empty.segments.count() == 0 and empty.modes.count() == 2
    summary = R.summarize_reading(R.read_transcripts(spark.createDataFrame([(1, "Some text.\n\nOther text.")], "doc long, text string"))).first()
    assert summary.respondents is None and len(summary.warnings) == 2


@pytest.mark.parametrize(("quote", "match", "who"), [
    ("I do not trust the app with my money", "exact", "Sipho"), ("“FOR ME IT IS THE TRUST”", "exact", "Sipho"), ("Last year they froze my account ... nobody called me back", "exact", "Sipho"),
    ("Last year they froze my account for a whole week and nobody phoned me back", "near", "Sipho"), ("I love the rewards programme and the cashback", "none", None), ("How do you feel about the new fees", "exact", "Moderator"),
    ("I do not see the value. And you? For me it is the trust", "near", None), ("st the app with my mone", "exact", "Sipho"), ("short", "none", None),
])
def test_quotes_are_matched(spark, quote, match, who):
    segments = R.read_transcripts(spark.createDataFrame([(1, LABELLED)], "doc long, text string")).segments
    got = Q.match_quotes(spark.createDataFrame([(7, 1, quote)], "quote_id long, doc long, quote string"), segments).first()
    assert (got.match, got.speaker) == (match, who) and got.spans_turns == ("And you" in quote)


def test_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert Q.longest_common(a, b) == row[-1]


def test_quotes_in_a_corpus_may_stand_inside_words(spark):
    turns = spark.createDataFrame([(1, 0, "participant", "It is inexpensive."), (2, 0, "moderator", "shot days"), (3, 1, "participant", None)], "doc long, idx int, role string, text string")
    quotes = spark.createDataFrame([(1, "expensive"), (2, "hot days"), (3, "nowhere")], "quote_id long, quote string")
    assert sorted(map(tuple, Q.quotes_in_corpus(quotes, turns).collect())) == [(1, 1, 0), (2, 2, 0)]


def grid(spark, rows, fallback=None):
    return spark.createDataFrame([("s", i, r, fallback) for i, r in enumerate(rows)], "sheet string, row int, cells array<string>, fallback string")


def test_coding_grids(spark):
    got = G.parse_grid(grid(spark, [["Theme", "Definition", "Count", "Illustrative quotes"], ["Confusing pricing, offers", "People cannot tell", "18", "I never know what my bill will be\nThe promotion ended and nobody told me"], ["Retention", "", "5", "They offered me a discount but not a fix"]])).collect()
    assert len(got) == 3 and got[0].definition == "People cannot tell" and {r.code for r in got} == {"Confusing pricing, offers", "Retention"}
    rows = [["Document", "Quotation Content", "Codes", "Comment"], ["P1", "My data ran out and I was charged again", "Billing; Bundle confusion", ""], ["P2", "Nothing was coded here", "", ""]]
    assert [(r.code, r.quote) for r in G.parse_grid(grid(spark, rows)).collect()] == [("Billing", "My data ran out and I was charged again"), ("Bundle confusion", "My data ran out and I was charged again")]
    assert G.skipped_rows(grid(spark, rows)).first().skipped == 1
    matrix = [["Sentence", "Pricing", "Support"], ["The price changed without warning", "1", ""], ["The agent never called back", "", "x"], ["Both things happened to me", "1", "maybe"]]
    assert sorted((r.row, r.code) for r in G.parse_grid(grid(spark, matrix)).collect()) == [(1, "Pricing"), (2, "Support"), (3, "Pricing")]
    quotes = [["Quotation Content", "Comment"], ["A quote that is long enough to match", ""]]
    assert G.parse_grid(grid(spark, quotes)).count() == 0 and G.parse_grid(grid(spark, quotes, "Trust in staff")).first().code == "Trust in staff"
    assert G.parse_grid(grid(spark, [["Coding report"], [""], ["Theme", "Quote"], ["Trust", "They really helped me out on the phone"]])).count() == 1
    two = [["Theme", "Sub-Theme / Code", "Code Definition", "Frequency", "Representative Quote"], ["Digital Fatigue", "Always-On", "Forced.", "14", '"If I don\'t reply by 8 PM, I feel lazy." (P3, Line 42)'], ["", "Meeting Overload", "Calls.", "9", '"By the third Zoom call my brain shuts off." (P7, Line 1)']]
    got = G.parse_grid(grid(spark, two)).orderBy("row").collect()
    assert (got[0].quote, got[1].theme, got[1].code) == ("If I don't reply by 8 PM, I feel lazy.", "Digital Fatigue", "Meeting Overload")
    roles = ["Codes", "Category ID", "Illustrative quote", "Number of participants", "Key words", "Zzz"]
    assert [r.r for r in spark.createDataFrame([(h,) for h in roles], "h string").select(G.header_role(F.col("h")).alias("r")).collect()] == ["code", "other", "quote", "count", "keywords", "other"]


def test_themed_paragraphs(spark):
    lines = ["THEME A: DIGITAL FATIGUE", "Code: Always-On Expectation", 'P3: "If I don\'t reply by 8 PM, I feel lazy."', 'P5: "My manager sends emails at midnight."', '[Note: "the pressure isn\'t always explicit" for later]', "Code: Meeting Overload", 'P7: "By the third Zoom call my brain shuts off."']
    got = G.parse_paragraphs(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "sheet string, row int, line string"))
    assert got.where("quote IS NOT NULL").count() == 3 and {(r.code, r.theme) for r in G.unique_codes(got).collect()} == {("Always-On Expectation", "DIGITAL FATIGUE"), ("Meeting Overload", "DIGITAL FATIGUE")}


def test_sources(spark, tmp_path):
    assert IO.unique_headers(["q1", "q2", "q3"], ["Age", "Age", None]) == ["Age", "Age (q2)", "q3"]
    old, new = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string"), spark.createDataFrame([(1, None, "c"), (2, "d", None)], "k int, x string, y string")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a", "c"), (2, "d", None)]
    labels = spark.createDataFrame([("k", "1", "one"), ("k", "1", "eins")], "column string, code string, label string")
    assert [tuple(r) for r in IO.decode_labels(old, labels).collect()] == [("eins", "a", "b")]
    for name, text in (("a.csv", "x,y\n3,p\n1,\n"), ("b.csv", "x,y\n2,q\n")):
        (tmp_path / name).write_text(text)
    assert [(r.x, r.y) for r in IO.load_csv(spark, str(tmp_path)).orderBy("__row").collect()] == [(3, "p"), (1, None), (2, "q")]


def test_answers_are_validated(spark):
    def answers(text):
        return spark.createDataFrame([(1, text)], "key int, answer string")

    n = spark.createDataFrame([(1, 5)], "key int, n int")
    runs = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 1)], "key int, run int, themes int")
    codes = '[{"name":"Trust","definition":"d","members":[{"run":3,"theme":1}]},{"name":"Fees","definition":"d","members":[{"run":1,"theme":1},{"run":2,"theme":2},{"run":2,"theme":1}]},{"name":"fees","definition":"d","members":[{"run":1,"theme":1}]},{"name":"Ghost","definition":"d","members":[{"run":9,"theme":1},{"run":1,"theme":99}]},{"name":"","definition":"d","members":[]}]'
    assert [(r.name, r.reproduced_runs) for r in V.consolidated_codes(answers(codes), runs).orderBy("rank").collect()] == [("Fees", 2), ("Trust", 1)]
    themes = '{"groups": "[{\\"theme\\":\\"A\\",\\"codes\\":[1,2,\\"3\\"]},{\\"theme\\":\\"B\\",\\"codes\\":[3,4]},{\\"theme\\":\\"a\\",\\"codes\\":[4,5]},{\\"theme\\":\\"C\\",\\"codes\\":[4,5,9]}]"}'
    assert sorted((r.theme, r.codes) for r in V.theme_groups(answers(themes), n).collect()) == [("A", [1, 2, 3]), ("C", [4, 5])]
    loose = 'x "theme": "Q", "codes": [1, 2], y'
    assert V.find_list(loose) == [{"theme": "Q", "codes": [1, 2]}] and V.find_list({"A": [1]}) == [{"theme": "A", "codes": [1]}] and V.find_list("no") is None and V.find_list({"groups": "[1]"}) == [1]
    groups, left = spark.createDataFrame([(1, 1, "A"), (1, 2, "C")], "key int, number int, theme string"), spark.createDataFrame([(1, c) for c in (6, 7, 8, 9)], "key int, code int")
    put = '[{"code":6,"theme":2},{"code":7,"new_theme":"New"},{"code":8,"new_theme":"new "},{"code":9,"new_theme":"Lone"},{"code":6,"theme":1},{"code":5,"theme":1}]'
    assert sorted((r.code, r.theme) for r in V.place_leftovers(answers(put), groups, left).collect()) == [(6, "C"), (7, "New"), (8, "New"), (9, V.HOLDING_THEME)]
    insights = spark.createDataFrame([(1, i, 100 + i, t, s, f"h{i}") for i, (t, s) in enumerate([("moderate", 9), ("strong", 5), ("exploratory", 20), ("strong", 8)])], "key int, index int, synth_id int, confidence_tier string, quality_score int, headline string")
    said = '[{"theme":"T","headline":"H","insight_indices":[0,1,2,3,3,7]},{"theme":"","headline":"","insight_indices":[1]}]'
    assert [tuple(r) for r in V.pillars(answers(said), insights).collect()] == [(1, 0, "T", "H", "103,101,100", 1)]
    assert V.pillars(answers("[]"), insights).count() == 4


def test_judge_answers_are_checked(spark):
    bad = spark.createDataFrame([(1, "x", '{"score": 4, "rationale": "r"}'), (1, "y", '{"score": 3, "rationale": " "}'), (2, "z", '{"score": 5, "rationale": "r"}'), (3, "w", "not json")], "id long, prompt_sha string, answer string")
    assert [tuple(r) for r in J.valid_scores(bad, "id").collect()] == [(2, 5, "r")]


def test_usage_stream_equals_the_batch(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:10:00", "a", '{"k": 2}'), ("2024-01-01 00:50:00", "a", '{"k": 3}'), ("2024-01-01 01:10:00", "b", "{}")], "ts string, event_type string, props string").withColumn("ts", F.to_timestamp("ts"))
    log.write.parquet(str(tmp_path / "log"))
    stream = windowed_usage(usage_stream(spark, str(tmp_path / "log"), "ts timestamp, event_type string, props string"))
    query = stream.writeStream.format("memory").queryName("usage_log").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("usage_log").collect())) == sorted(map(tuple, windowed_usage(log).collect()))
