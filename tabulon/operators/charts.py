"""Datasets behind charts of findings: each holds what is drawn, in drawing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import num_to_text
from tabulon.operators import tables as T
from tabulon.plans.lineage import cut

#: Strength of a correlation by lower bound.
STRENGTH = ((0.7, "strong"), (0.5, "moderate"))


def crosstab_chart(df: DataFrame, banner: str, stub: str, row: str) -> DataFrame:
    """(stub, banner, pct, significant_pairs, largest_gap): bars with the number of significant tests and the widest gap of each stub."""
    bars = T.crosstab(df, banner, stub, row).select("stub", "banner", "pct")
    tests = T.proportion_pairs(df, banner, stub, row).groupBy("stub").agg(F.count_if("significant").alias("significant_pairs"), F.max(F.abs("gap_points")).alias("largest_gap"))
    return bars.join(F.broadcast(tests), "stub", "left")


def means_chart(df: DataFrame, banner: str, value: str, row: str) -> DataFrame:
    """(position, banner, mean, n): group means from high to low, ties by first appearance."""
    g = T.group_summary(df, banner, value, row)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), "banner_ord"))  # at most ten rows
    return g.withColumn("position", place).select("position", "banner", T.jround(F.col("mean"), 2).alias("mean"), "n")


def strength(r: Column) -> Column:
    out = F.when(F.abs(r) >= STRENGTH[0][0], STRENGTH[0][1])
    return out.when(F.abs(r) >= STRENGTH[1][0], STRENGTH[1][1]).otherwise("weak")


def scatter_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, strength, slope, intercept) of the least-squares line; nulls without spread."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.try_divide(F.col("c"), F.col("sx") * F.col("sx"))
    r = T.jround(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")), 2)
    return sums.select("n", r.alias("r"), strength(r).alias("strength"), T.jround(slope, 2).alias("slope"), T.jround(F.col("my") - slope * F.col("mx"), 1).alias("intercept"))


def outlier_strip(df: DataFrame, value: str, row: str) -> DataFrame:
    """(label, row, v, z): outliers by distance, labelled #1, #2 and on.

    The rank runs over outliers alone, at most a small share of the table.
    """
    found = T.outliers(df, value, row)
    ranked = T.global_rank(found.withColumn("far", -F.abs("z")), "rank", "far", "row")
    return ranked.select(F.concat(F.lit("#"), (F.col("rank") + 1).cast("string")).alias("label"), "row", "v", "z")


#: Findings whose statistics can be drawn, and the name of a theme that is missing.
COMPARISONS, CHARTABLE = ("banner_comparison", "segment_difference"), ("banner_comparison", "segment_difference", "relationship", "outlier")
NO_THEME = "Uncategorized"
#: The statistics that findings state, by name and kind.
_STATS = """testType string, bannerColumn string, stubColumn string, stubCategory string, group1Label string, group2Label string, pctA double, pctB double, gapPercent double, zScore double, significant boolean,
  mean1 double, mean2 double, n1 double, n2 double, gap double, tScore double, fStat double, pValue double, groupMeans array<struct<label: string, n: double, mean: double>>,
  variable1 string, variable2 string, r double, pairCount double, points array<struct<x: double, y: double>>, column string, z double, value double"""
_BARS = "array<struct<label: string, series: string, value: double, n: double>>"


def _told(x: Column) -> Column:
    return num_to_text(x)


def _bar(label: Column, series: Column, value: Column, n: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), series.cast("string").alias("series"), value.cast("double").alias("value"), n.cast("double").alias("n"))


def chart_stats(findings: DataFrame) -> DataFrame:
    """Findings (run_id, finding_id, place, origin, pattern_type, theme, stated_stats) of themes that can be drawn, their statistics read once.

    Every finding of such a theme is computed and of one kind that has charts;
    ``place`` orders a theme's findings.  Statistics of the wrong kind are null.
    """
    named = findings.withColumn("theme", F.coalesce("theme", F.lit(NO_THEME)))
    fits = (F.col("origin") == "generated") & F.col("pattern_type").isin(*CHARTABLE)
    g = named.groupBy("run_id", "theme").agg(F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("fit"), F.count_distinct("pattern_type").alias("kinds"), F.count("stated_stats").alias("told"))
    fine = g.where("n = fit AND kinds = 1 AND told > 0").select("run_id", "theme")
    rows = named.where(fits & F.col("stated_stats").isNotNull()).join(fine, ["run_id", "theme"])
    read = rows.select("run_id", "theme", "place", "finding_id", "pattern_type", F.from_json("stated_stats", _STATS).alias("s")).where("s IS NOT NULL")
    blank = {c: F.nullif(F.col(f"s.{c}"), F.lit("")) for c in ("bannerColumn", "stubColumn", "stubCategory", "group1Label", "group2Label", "variable1", "variable2", "column")}
    return read.withColumns({f"_{c}": x for c, x in blank.items()}).select("run_id", "theme", F.struct("place", "finding_id").alias("at"), "pattern_type", F.col("s").alias("t"), *[F.col(f"_{c}").alias(c) for c in blank])


_KEY = ["run_id", "theme"]


def _first(column: str) -> Column:
    return F.min_by(column, "at")


def _pairs(rows: DataFrame) -> DataFrame:
    """Comparisons of themes that are about one pair of columns."""
    one = rows.where(F.col("pattern_type").isin(*COMPARISONS)).groupBy(*_KEY).agg(F.count_distinct("bannerColumn", "stubColumn").alias("pairs"), F.count_if(F.col("bannerColumn").isNull() | F.col("stubColumn").isNull()).alias("without"))
    return rows.join(one.where("pairs = 1 AND without = 0").select(*_KEY), _KEY, "left_semi")


def _crosstab_charts(pairs: DataFrame) -> DataFrame:
    """A bar for each category and banner of a theme, its last stated share, in order of first mention."""
    rows = pairs.where("stubCategory IS NOT NULL")
    count = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("comparisons"), _first("bannerColumn").alias("a"), _first("stubColumn").alias("b"))
    whole = rows.where("group1Label IS NOT NULL AND group2Label IS NOT NULL AND t.pctA IS NOT NULL AND t.pctB IS NOT NULL")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("group1Label").alias("banner"), F.col("t.pctA").alias("pct")), F.struct(F.lit(1).alias("side"), F.col("group2Label").alias("banner"), F.col("t.pctB").alias("pct")))
    each = whole.select(*_KEY, "at", "stubCategory", F.explode(sides).alias("x")).withColumn("spot", F.struct("at", "x.side"))
    bars = each.groupBy(*_KEY, "stubCategory", "x.banner").agg(F.min("spot").alias("spot"), F.max_by("x.pct", "spot").alias("pct"))
    lined = bars.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("spot", _bar(F.col("stubCategory"), F.col("banner"), F.col("pct"), F.lit(None)).alias("bar")))).alias("l"))
    wide = F.struct(F.abs("t.gapPercent").alias("gap"), "group1Label", "group2Label", "stubCategory", F.col("t.zScore").alias("z"))
    # Of equal gaps the first: the highest of the reversed order.
    marked = whole.withColumn("back", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("at"))))
    sums = marked.groupBy(*_KEY).agg(F.count_if("t.significant").alias("significant"), F.max_by(F.when(F.col("t.gapPercent").isNotNull(), wide), F.when(F.col("t.gapPercent").isNotNull(), F.struct(F.abs("t.gapPercent"), F.col("back")))).alias("w"))
    z = F.coalesce(F.concat(F.lit(", z="), _told(F.col("w.z"))), F.lit(""))
    widest = F.coalesce(F.concat(F.lit(" Largest gap: "), "a", F.lit(' "'), "w.group1Label", F.lit('" vs "'), "w.group2Label", F.lit('" on '), "b", F.lit('="'), "w.stubCategory", F.lit('" ('), _told(F.col("w.gap")), F.lit(" points"), z, F.lit(").")), F.lit(""))
    said = F.concat(F.col("significant").cast("string"), F.lit(" of "), F.col("comparisons").cast("string"), F.lit(" comparisons statistically significant."), widest)
    return count.join(lined, _KEY).join(sums, _KEY).select(*_KEY, F.lit("categorical_crosstab").alias("kind"), "a", "b", F.lit(None).cast("string").alias("test"), "comparisons", "significant", said.alias("caption"), F.transform("l", lambda x: x["bar"]).alias("bars"))


def _means_charts(pairs: DataFrame) -> DataFrame:
    """Group means of a theme's test of variance, or where there is none of its pairs of means; themes with shares have none."""
    test = F.coalesce(F.col("t.testType"), F.lit(""))
    shares = pairs.where("stubCategory IS NOT NULL").select(*_KEY).distinct()
    rows = pairs.where("stubCategory IS NULL").join(shares, _KEY, "left_anti").withColumn("variance", test == "one_way_anova")
    rows = rows.withColumn("pair", ~F.col("variance") & (test != "descriptive_summary") & F.col("t.mean1").isNotNull() & F.col("t.mean2").isNotNull())
    g = rows.groupBy(*_KEY).agg(
        _first("bannerColumn").alias("a"), _first("stubColumn").alias("b"), F.count_if("variance").alias("variances"), F.count_if("pair").alias("pairs"), F.count_if(F.col("pair") & F.coalesce("t.significant", F.lit(False))).alias("significant"),
        F.min_by(F.when(F.col("variance"), F.col("t")), F.when(F.col("variance"), F.col("at"))).alias("v"), F.min_by(F.when(F.col("pair"), F.col("t")), F.when(F.col("pair"), F.col("at"))).alias("p"),
    )
    means = F.filter("v.groupMeans", lambda m: m["label"].isNotNull() & m["mean"].isNotNull())
    f = F.coalesce(F.concat(F.lit(" (F="), _told(F.col("v.fStat")), F.lit(", p="), F.when(F.col("v.pValue") < 0.001, "<0.001").otherwise(_told(F.col("v.pValue"))), F.lit(")")), F.lit(""))
    ranked = F.array_sort("m", lambda x, y: F.when(x["mean"] > y["mean"], -1).when(x["mean"] < y["mean"], 1).otherwise(0))
    v = g.where("variances > 0").withColumn("m", means).where(F.size("m") > 0).withColumn("k", ranked)
    groups = F.concat(F.size("m").cast("string"), F.lit(" "), "a", F.lit(" groups on "), "b", f, F.lit("."))
    ends = F.concat(F.lit(' Highest: "'), F.element_at("k", 1)["label"], F.lit('" at '), _told(F.element_at("k", 1)["mean"]), F.lit(', lowest: "'), F.element_at("k", -1)["label"], F.lit('" at '), _told(F.element_at("k", -1)["mean"]), F.lit("."))
    said = F.when(F.coalesce("v.significant", F.lit(False)), F.concat(F.lit("Significant overall difference across "), groups, ends)).otherwise(F.concat(F.lit("No statistically significant overall difference across "), groups))
    whole = v.select(*_KEY, F.lit("group_means").alias("kind"), "a", "b", F.lit("anova").alias("test"), (F.col("pairs") + 1).alias("comparisons"), "significant", said.alias("caption"), F.transform("m", lambda m: _bar(m["label"], F.lit(None), m["mean"], m["n"])).alias("bars"))

    two = rows.where("pair AND group1Label IS NOT NULL AND group2Label IS NOT NULL").join(g.where("variances = 0").select(*_KEY), _KEY, "left_semi")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("group1Label").alias("label"), F.col("t.mean1").alias("mean"), F.coalesce("t.n1", F.lit(0.0)).alias("n")), F.struct(F.lit(1).alias("side"), F.col("group2Label").alias("label"), F.col("t.mean2").alias("mean"), F.coalesce("t.n2", F.lit(0.0)).alias("n")))
    each = two.select(*_KEY, "at", "t.significant", F.explode(sides).alias("x")).withColumn("spot", F.struct("at", "x.side"))
    bars = each.groupBy(*_KEY, "x.label").agg(F.min("spot").alias("spot"), F.max_by(F.struct("x.mean", "x.n"), "spot").alias("y"))
    lined = bars.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("spot", _bar(F.col("label"), F.lit(None), F.col("y.mean"), F.col("y.n")).alias("bar")))).alias("l"))
    sure = two.groupBy(*_KEY).agg(F.count_if(F.coalesce("t.significant", F.lit(False))).alias("sure"))
    t = F.coalesce(F.concat(F.lit(" (t="), _told(F.col("p.tScore")), F.lit(")")), F.lit(""))
    gap = F.coalesce(_told(F.abs("p.gap")), F.lit("?"))
    said = F.when(F.coalesce("p.significant", F.lit(False)), F.concat(F.lit("Statistically significant gap of "), gap, F.lit(" on "), "b", F.lit(" between "), "a", F.lit(" groups"), t, F.lit("."))).otherwise(F.concat(F.lit("No statistically significant gap found on "), "b", F.lit(" between these "), "a", F.lit(" groups.")))
    paired = g.where("variances = 0").join(lined, _KEY).join(sure, _KEY).select(*_KEY, F.lit("group_means").alias("kind"), "a", "b", F.lit("pairwise").alias("test"), F.col("pairs").alias("comparisons"), F.col("sure").alias("significant"), said.alias("caption"), F.transform("l", lambda x: x["bar"]).alias("bars"))
    return whole.union(paired)


def _scatter_charts(rows: DataFrame) -> DataFrame:
    """The points of a theme's strongest correlation, the first of equals."""
    r = F.col("t.r")
    best = rows.where("pattern_type = 'relationship' AND t.r IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc(F.abs("t.r")), "at"))).where("k = 1")
    points = F.filter("t.points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    drawn = best.withColumn("p", points).where(F.col("variable1").isNotNull() & F.col("variable2").isNotNull() & (F.size("p") > 0))
    word = strength(r)
    n = _told(F.coalesce(F.col("t.pairCount"), F.size("p").cast("double")))
    said = F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 20), F.lit(" "), F.when(r > 0, "positive").otherwise("negative"), F.lit(" association between "), "variable1", F.lit(" and "), "variable2", F.lit(" across "), n, F.lit(" rows (r="), _told(r), F.lit("). Descriptive association only, not evidence of causation."))
    none = F.lit(None)
    return drawn.select(*_KEY, F.lit("scatter").alias("kind"), F.col("variable1").alias("a"), F.col("variable2").alias("b"), none.cast("string").alias("test"), none.cast("long").alias("comparisons"), none.cast("long").alias("significant"), said.alias("caption"), F.transform("p", lambda p: _bar(none, none, p["x"], p["y"])).alias("bars"))


def _outlier_charts(rows: DataFrame) -> DataFrame:
    """A bar for each unusual value of a theme's column, farthest first."""
    own = rows.where("pattern_type = 'outlier'")
    one = own.groupBy(*_KEY).agg(F.count_distinct("column").alias("columns"), F.count_if(F.col("column").isNull()).alias("without"), F.min("column").alias("a")).where("columns = 1 AND without = 0")
    seen = own.where("t.z IS NOT NULL AND t.value IS NOT NULL").groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct((-F.abs("t.z")).alias("far"), "at", F.col("t.z").alias("z"), F.col("t.value").alias("value")))).alias("l"))
    both = one.join(seen, _KEY)
    n, top = F.size("l"), F.element_at("l", 1)
    said = F.concat(n.cast("string"), F.lit(" value"), F.when(n == 1, "").otherwise("s"), F.lit(" flagged as unusual on "), "a", F.lit(", ranked by size of deviation (not row order). Largest: "), _told(top["value"]), F.lit(" ("), F.when(top["z"] >= 0, "+").otherwise(""), _told(top["z"]), F.lit(" SD from the comparison mean). Descriptive heuristic, not a formal outlier test."))
    none = F.lit(None)
    bars = F.transform("l", lambda x, i: _bar(F.concat(F.lit("#"), (i + 1).cast("string")), none, x["z"], x["value"]))
    return both.select(*_KEY, F.lit("outlier_strip").alias("kind"), "a", none.cast("string").alias("b"), none.cast("string").alias("test"), none.cast("long").alias("comparisons"), none.cast("long").alias("significant"), said.alias("caption"), bars.alias("bars"))


def theme_charts(findings: DataFrame) -> DataFrame:
    """One dataset for each theme that can be drawn: (run_id, theme, kind, a, b, test, comparisons, significant, caption, bars).

    findings are (run_id, finding_id, place, origin, pattern_type, theme,
    stated_stats JSON).  ``a`` and ``b`` are its columns (banner and stub, the two
    variables, or the one column); bars are (label, series, value, n): category,
    banner and share; group, -, mean and size; -, -, x and y; or rank, -,
    deviations and value.  Themes with a stated or coded finding, of several
    kinds, about several pairs of columns, or whose statistics lack what their
    chart needs have no row.
    """
    # Each kind of chart reads the statistics anew.
    rows = cut(chart_stats(cut(findings.select("run_id", "finding_id", "place", "origin", "pattern_type", "theme", "stated_stats"))))
    pairs = _pairs(rows)
    parts = [_crosstab_charts(pairs), _means_charts(pairs), _scatter_charts(rows), _outlier_charts(rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("bars", F.col("bars").cast(_BARS))
