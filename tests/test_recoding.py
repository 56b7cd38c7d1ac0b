"""Transcripts read again and edited codebooks, on small tables with nulls, ties and turns without a place."""

from collections import Counter

from tabulon.operators import resegment as R

TURN = "doc long, idx long, text string"


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_turns_are_placed_in_order(spark):
    docs = spark.createDataFrame([(1, "A: yes\nB: yes  sure\nA: no"), (2, None), (3, "x")], "doc long, text string")
    turns = spark.createDataFrame([(1, 0, "yes"), (1, 1, "yes sure"), (1, 2, "not there"), (1, 3, "no"), (1, 4, None), (1, 5, "  "), (2, 0, "a"), (4, 0, "b")], TURN)
    assert rows(R.turn_spans(docs, turns), "doc", "idx", "start", "stop") == Counter([(1, 0, 2, 5), (1, 1, 7, 14), (1, 3, 16, 18)])
    assert R.turn_spans(docs.limit(0), turns).count() == 0 == R.turn_spans(docs, turns.limit(0)).count()


def test_codes_follow_split_and_merged_turns(spark):
    a, b, c = "I like the price of it", "but the taste is odd to me, it really is", "fine"
    docs = spark.createDataFrame([(1, f"P: {a}\nQ: {b}\nP: {c}")], "doc long, text string")
    old = spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, c)], TURN)
    # The first two turns become one, cut off before its last words; the rest is split from it.
    new = spark.createDataFrame([(1, 0, f"{a} but the taste is"), (1, 1, "odd to me, it really is"), (1, 2, c)], TURN)
    codes = spark.createDataFrame([(1, 0, "price"), (1, 0, "like"), (1, 1, "taste"), (1, 1, "like"), (1, 2, "end"), (1, 9, "gone")], "doc long, idx long, code string")
    overrides = spark.createDataFrame([(1, 0, "Price", "add"), (1, 1, " PRICE ", "remove"), (1, 2, "End", "add"), (1, 7, "x", "add")], "doc long, idx long, name string, action string")
    notes = spark.createDataFrame([(1, 0, "n0"), (1, 1, "n1")], "doc long, idx long, note string")
    out = R.resegment(docs, old, new, codes, overrides, notes)
    # Turn 1 shares 14 characters ("butthetasteis" and one more place) with new turn 0 and 18 with new turn 1.
    assert rows(out.assignments, "idx", "code") == Counter([(0, "price"), (0, "like"), (1, "taste"), (1, "like"), (2, "end")])
    assert rows(out.overrides, "idx", "name", "action") == Counter([(0, "Price", "add"), (1, " PRICE ", "remove"), (2, "End", "add")])
    assert rows(out.notes, "idx", "note") == Counter([(0, "n0"), (1, "n1")])
    assert rows(out.lost, "doc", "kind", "lost") == Counter([(1, "assignments", 1), (1, "overrides", 1)])
    whole = spark.createDataFrame([(1, 0, f"{a} {b} {c}")], TURN)
    merged = R.resegment(docs, old, whole, codes, overrides, notes)
    assert rows(merged.assignments, "idx", "code") == Counter([(0, x) for x in ("price", "like", "taste", "end")])
    # Of what meets on one turn the longer old turn's stays.
    assert rows(merged.overrides, "idx", "name", "action") == Counter([(0, " PRICE ", "remove"), (0, "End", "add")])
    assert rows(merged.notes, "idx", "note") == Counter([(0, "n1")])


def test_long_turns_meet_once(spark):
    spans = spark.createDataFrame([(1, 0, 0, 10_000), (1, 1, 10_000, 10_001)], "doc long, idx long, start long, stop long")
    parts = spark.createDataFrame([(1, i, i * 700, (i + 1) * 700) for i in range(15)] + [(2, 0, 0, 9)], "doc long, idx long, start long, stop long")
    found = rows(R.align_turns(spans, parts, 64), "old_idx", "new_idx", "overlap")
    assert found == Counter([(0, i, 700) for i in range(14)] + [(0, 14, 200), (1, 14, 1)])
    tie = R.best_turns(spark.createDataFrame([(1, 0, 3, 5), (1, 0, 2, 5)], "doc long, old_idx long, new_idx long, overlap long"))
    assert tie.first()["new_idx"] == 2


def test_edits_are_checked(spark):
    edits = [(1, i, None, f"c{i}", "d") for i in range(29)] + [(2, 0, 5, " Price ", " d "), (2, 1, None, "price", "d"), (3, 0, None, "a", None), (4, 0, 7, "a", "d"), (4, 1, None, " ", "d")]
    fine, problems = R.check_edits(spark.createDataFrame(edits, "doc long, place int, code_id long, name string, definition string"))
    assert rows(fine, "doc", "name", "definition") == Counter([(4, "a", "d")])
    assert rows(problems, "doc", "reason") == Counter([(1, R.TOO_MANY), (2, 'Two codes are both called "price".'), (3, R.NO_CODES)])


def test_codes_that_keep_their_name_keep_their_turns(spark):
    books = spark.createDataFrame([(10, 1, 5, 1, "induced"), (20, 2, 5, 1, "induced")], "codebook_id long, doc long, run_id long, version int, source string")
    codes = spark.createDataFrame([(100, 10, 0, "Price", 3, 3, True), (101, 10, 1, "Taste", 2, 3, False), (200, 20, 0, "Other", 1, 3, False)], "code_id long, codebook_id long, position int, name string, reproduced_runs int, total_runs int, added_by_researcher boolean")
    held = spark.createDataFrame([(7, 100), (8, 100), (7, 101), (9, 200)], "segment_id long, code_id long")
    edits = spark.createDataFrame([(1, 5, 101, "Flavour", "d"), (1, 2, 100, " PRICE", "d"), (1, 9, 200, "Other", "d")], "doc long, place int, code_id long, name string, definition string")
    new = spark.createDataFrame([(1, 30, 5), (2, 40, 5)], "doc long, codebook_id long, run_id long")
    out = R.reapply_codebook(books, codes, held, edits, new)
    assert rows(out.codebooks.where("codebook_id >= 30"), "codebook_id", "doc", "version", "source") == Counter([(30, 1, 2, "edited")])
    made = out.codes.where("codebook_id = 30")
    assert rows(made, "code_id", "position", "name", "reproduced_runs", "total_runs", "added_by_researcher") == Counter([(3000, 0, "PRICE", 3, 3, True), (3001, 1, "Flavour", None, None, False), (3002, 2, "Other", None, None, False)])
    assert rows(out.assignments.where("code_id >= 3000"), "segment_id", "code_id") == Counter([(7, 3000), (8, 3000)])
    assert rows(out.open, "doc", "code_id") == Counter([(1, 3001), (1, 3002)]) and out.problems.count() == 0
