"""Chart datasets from stored findings: the cases that a findings page has to draw or to leave alone."""

import json

import pytest

from tabulon.operators import charts as C

KIND = "run_id int, finding_id string, place int, origin string, pattern_type string, theme string, stated_stats string"
AGE = {"bannerColumn": "AgeBand", "stubColumn": "PreferredChannel", "stubCategory": "App", "group1Label": "18-24", "group2Label": "25-34", "pctA": 40, "pctB": 25, "gapPercent": 15, "zScore": 2.5, "significant": True}
PAIR = {"bannerColumn": "Gender", "stubColumn": "Spend", "group1Label": "Male", "group2Label": "Female", "mean1": 120, "mean2": 95, "gap": 25, "tScore": 1.8, "significant": False, "n1": 40, "n2": 42}


def draw(spark, *findings):
    """The chart of one theme from (pattern_type, stats) pairs, or None."""
    rows = [(1, f"f{i}", i, f[2] if len(f) > 2 else "generated", f[0], "T", None if f[1] is None else json.dumps(f[1])) for i, f in enumerate(findings)]
    got = C.theme_charts(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) <= 1
    return got[0] if got else None


def bars(chart):
    return [(b["label"], b["series"], b["value"], b["n"]) for b in chart["bars"]]


def test_no_findings_no_chart(spark):
    assert draw(spark) is None


def test_a_theme_with_a_stated_finding_is_left_alone(spark):
    assert draw(spark, ("banner_comparison", AGE), (None, None, "stated")) is None
    assert draw(spark, ("banner_comparison", AGE), ("banner_comparison", AGE, "coded")) is None


def test_shares_that_repeat_are_one_bar(spark):
    c = draw(spark, ("banner_comparison", AGE), ("banner_comparison", {**AGE, "group2Label": "35-44", "pctB": 20, "gapPercent": 20, "zScore": 3.1}), ("banner_comparison", {**AGE, "stubCategory": "Branch", "pctA": 10, "pctB": 12, "gapPercent": -2, "zScore": 0.4, "significant": False}))
    assert (c.kind, c.a, c.b, c.comparisons, c.significant) == ("categorical_crosstab", "AgeBand", "PreferredChannel", 3, 2)
    assert bars(c) == [("App", "18-24", 40, None), ("App", "25-34", 25, None), ("App", "35-44", 20, None), ("Branch", "18-24", 10, None), ("Branch", "25-34", 12, None)]
    assert c.caption == '2 of 3 comparisons statistically significant. Largest gap: AgeBand "18-24" vs "35-44" on PreferredChannel="App" (20 points, z=3.1).'


def test_the_first_of_equal_gaps_is_named_and_the_last_share_drawn(spark):
    c = draw(spark, ("banner_comparison", AGE), ("banner_comparison", {**AGE, "group2Label": "z", "gapPercent": -15, "zScore": None, "pctA": 41}))
    assert 'vs "25-34"' in c.caption and bars(c)[0][2] == 41


def test_shares_that_are_missing_give_no_chart(spark):
    assert draw(spark, ("banner_comparison", {k: v for k, v in AGE.items() if k not in ("pctA", "pctB")})) is None
    c = draw(spark, ("banner_comparison", AGE), ("banner_comparison", {**AGE, "pctA": "40"}))
    assert c.comparisons == 2 and c.significant == 1


def test_means_come_from_the_test_of_variance(spark):
    groups = [{"label": "Degree", "n": 40, "mean": 7.48}, {"label": "Postgrad", "n": 30, "mean": 6.76}, {"label": "Diploma", "n": 25, "mean": 7.1}, {"label": 4, "mean": "x"}, {"label": "No mean", "n": 1}]
    base = {"bannerColumn": "Education", "stubColumn": "Satisfaction"}
    anova = {**base, "testType": "one_way_anova", "fStat": 5.2, "pValue": 0.0004, "significant": True, "groupMeans": groups}
    pair = {**base, "group1Label": "Degree", "group2Label": "Postgrad", "mean1": 7.48, "mean2": 6.76, "gap": 0.72, "tScore": 2.9, "significant": True, "n1": 40, "n2": 30}
    c = draw(spark, ("banner_comparison", anova), ("banner_comparison", pair))
    assert (c.kind, c.test, c.comparisons, c.significant) == ("group_means", "anova", 2, 1)
    assert bars(c) == [("Degree", None, 7.48, 40), ("Postgrad", None, 6.76, 30), ("Diploma", None, 7.1, 25)]
    assert c.caption == 'Significant overall difference across 3 Education groups on Satisfaction (F=5.2, p=<0.001). Highest: "Degree" at 7.48, lowest: "Postgrad" at 6.76.'
    c = draw(spark, ("banner_comparison", {**anova, "significant": False, "pValue": 0.2}))
    assert c.caption == "No statistically significant overall difference across 3 Education groups on Satisfaction (F=5.2, p=0.2)."
    assert draw(spark, ("banner_comparison", {**anova, "groupMeans": []}), ("banner_comparison", pair)) is None


@pytest.mark.parametrize("kind", ["banner_comparison", "segment_difference"])
def test_a_lone_pair_of_means(spark, kind):
    c = draw(spark, (kind, PAIR))
    assert (c.test, c.comparisons, c.significant, bars(c)) == ("pairwise", 1, 0, [("Male", None, 120, 40), ("Female", None, 95, 42)])
    assert c.caption == "No statistically significant gap found on Spend between these Gender groups."
    c = draw(spark, (kind, {**PAIR, "significant": True, "gap": -1.1, "n1": None}))
    assert c.caption == "Statistically significant gap of 1.1 on Spend between Gender groups (t=1.8)." and bars(c)[0][3] == 0


def test_mixed_kinds_and_columns_are_left_alone(spark):
    assert draw(spark, ("segment_difference", PAIR), ("banner_comparison", PAIR)) is None
    assert draw(spark, ("banner_comparison", PAIR), ("banner_comparison", {**PAIR, "stubColumn": "Visits"})) is None
    assert draw(spark, ("banner_comparison", {**PAIR, "bannerColumn": ""})) is None
    assert draw(spark, ("banner_comparison", {"testType": "descriptive_summary", "bannerColumn": "A", "stubColumn": "B", "mean1": 1, "mean2": 2})) is None
    assert draw(spark, ("segment_split", PAIR)) is None


def test_the_stronger_correlation_is_drawn(spark):
    points = [{"x": i, "y": i * 2} for i in range(10)] + [{"x": "a", "y": 1}, {"y": 3}]
    base = {"variable1": "Spend", "variable2": "Visits", "pairCount": 10, "points": points}
    c = draw(spark, ("relationship", {**base, "r": 0.42}), ("relationship", {**base, "r": -0.81}))
    assert (c.kind, c.a, c.b) == ("scatter", "Spend", "Visits") and bars(c) == [(None, None, i, i * 2) for i in range(10)]
    assert c.caption == "Strong negative association between Spend and Visits across 10 rows (r=-0.81). Descriptive association only, not evidence of causation."
    assert draw(spark, ("relationship", {k: v for k, v in {**base, "r": 0.42}.items() if k != "points"})) is None
    assert draw(spark, ("relationship", base)) is None


def test_outliers_are_ranked(spark):
    own = [("outlier", {"column": "MonthlySpend", "z": z, "value": v}) for z, v in ((2.1, 980), (-3.4, 12), (2.6, 1100))]
    c = draw(spark, *own)
    assert bars(c) == [("#1", None, -3.4, 12), ("#2", None, 2.6, 1100), ("#3", None, 2.1, 980)]
    assert c.caption == "3 values flagged as unusual on MonthlySpend, ranked by size of deviation (not row order). Largest: 12 (-3.4 SD from the comparison mean). Descriptive heuristic, not a formal outlier test."
    assert draw(spark, *own, ("outlier", {"column": "Visits", "z": 3, "value": 1})) is None
    assert "1 value flagged" in draw(spark, ("outlier", {"column": "M", "z": 2, "value": 1.5}), ("outlier", {"column": "M"})).caption


def test_themes_of_runs_stay_apart(spark):
    rows = [(1, "a", 0, "generated", "outlier", None, json.dumps({"column": "M", "z": 2, "value": 1})), (2, "b", 0, "generated", "outlier", None, json.dumps({"column": "M", "z": 3, "value": 4})), (2, "c", 1, "stated", None, "S", None)]
    got = C.theme_charts(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.run_id, r.theme) for r in got) == [(1, C.NO_THEME), (2, C.NO_THEME)]
    assert C.theme_charts(spark.createDataFrame([], KIND)).count() == 0


def test_points_are_complete_pairs_evenly_spaced(spark):
    from tabulon.operators import patterns as P
    from tabulon.operators import tables as T

    rows = [(i, float(i), None if i % 4 == 0 else 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    whole = [(x, y) for _, x, y in rows if y is not None]
    found = T.relationships(df, ["a", "b"])
    got = {most: [(p.x, p.y) for p in T.relationship_points(df, found, "k", most).first().points] for most in (300, 7)}
    assert got[300] == whole and got[7] == [whole[int(i * (len(whole) / 7))] for i in range(7)]
    assert T.relationship_points(df, found.limit(0), "k").count() == 0
    table = spark.createDataFrame([(i, "x" if i % 2 else "y", 10.0 + i % 3 + (50 if i % 2 else 0) + (900 if i == 9 else 0)) for i in range(30)], "k long, c string, v double")
    patterns = P.table_patterns(table, ["c", "v"], "k")
    behind = {}
    for r in P.pattern_rows(table, patterns, "k").collect():
        behind.setdefault(r.pattern, set()).add(r["row"])
    kinds = {r.pattern: r.pattern_type for r in patterns.collect()}
    assert {k: behind[p] for p, k in kinds.items()} == {"segment_difference": set(range(30)), "outlier": {9}} or behind[max(kinds)] == {9}
    cells = {r.pattern_type: r.source_cells for r in P.pattern_findings(patterns, C.F.lit(1), C.F.lit(1), C.F.col("pattern_type")).collect()}
    assert cells["outlier"] == '{"rowIndices":[9]}'
    assert P.pattern_findings(patterns, C.F.lit(1), C.F.lit(1), C.F.col("pattern_type"), "raw").count() == 0
