"""Patterns of a table as findings: the scan of an aggregated table, the banner plan of a raw one, their sentences, digests and charts.

Sentences, theme names, tags and caps are values that must match and are
written out plainly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import jround, num_to_text
from tabulon.operators import tables as T
from tabulon.operators.charts import strength

#: Lines of a digest, facts of a grounding digest, kinds of patterns that have charts.
DIGEST_LINES, GROUNDING_FACTS = 8, 20
CHARTABLE = ("banner_comparison", "segment_difference", "relationship", "outlier")


def theme_name(*columns: Column) -> Column:
    """The first three different column names, joined by ampersands."""
    names = F.array_distinct(F.filter(F.transform(F.array(*columns), lambda c: F.trim(c)), lambda c: c != ""))
    return F.array_join(F.slice(names, 1, 3), " & ")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _tags(*tags) -> Column:
    return F.filter(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in tags]), lambda x: x.isNotNull())


def table_patterns(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """(pattern, pattern_type, theme, description, statistic, caveats, stated_stats, row) of an aggregated table, 25 at most.

    Differences come first, by category and value column, then relationships of
    columns, then outliers by column and row: the caps follow that order.
    ``stated_stats`` holds each pattern's figures as JSON, a relationship's points
    among them; ``row`` is an outlier's.  ``pattern_rows`` gives the rows of all.
    """
    numeric, categorical = T.column_kinds(df, columns)
    numeric, categorical = [c for c in numeric if c != row], [c for c in categorical if c != row]
    caveat = _tags("uncorrected_multiple_comparisons")
    parts = []
    no_row = F.lit(None).cast(df.schema[row].dataType).alias("row")
    if numeric and categorical:
        d = T.segment_differences(df, categorical, numeric, row)
        c, v = F.col("category_column"), F.col("value_column")
        said = _text(c, ' "', F.col("cat_a"), '" averages ', num_to_text(F.col("mean_a")), " on ", v, " (n=", F.col("n_a").cast("string"), "), versus ", num_to_text(F.col("mean_b")), ' for "', F.col("cat_b"), '" (n=', F.col("n_b").cast("string"), "): a gap of ", num_to_text(F.col("gap")), " (t=", num_to_text(F.col("t")), ").")
        parts.append(d.select(F.lit(0).alias("o1"), F.col("i").cast("long").alias("o2"), F.col("j").cast("long").alias("o3"), F.lit("segment_difference").alias("pattern_type"), theme_name(c, v).alias("theme"), said.alias("description"), F.col("t").alias("statistic"), caveat.alias("caveats"), _figures(mean1="mean_a", mean2="mean_b", gap="gap", tScore="t", significant=F.lit(True), group1Label="cat_a", group2Label="cat_b", n1="n_a", n2="n_b", bannerColumn="category_column", stubColumn="value_column", caveats=caveat), no_row))
    if len(numeric) > 1:
        place = lambda c: F.array_position(F.array(*map(F.lit, numeric)), F.col(c))
        r = T.relationships(df, numeric)
        r = r.join(F.broadcast(T.relationship_points(df, r, row)), ["col_a", "col_b"], "left")
        note = F.lit("Descriptive association only, not evidence of causation.")
        said = _text(F.col("col_a"), " and ", F.col("col_b"), " move together across ", F.col("n").cast("string"), " rows (r=", num_to_text(F.col("r")), "). ", note)
        parts.append(r.select(F.lit(1).alias("o1"), place("col_a").alias("o2"), place("col_b").alias("o3"), F.lit("relationship").alias("pattern_type"), theme_name(F.col("col_a"), F.col("col_b")).alias("theme"), said.alias("description"), F.col("r").alias("statistic"), caveat.alias("caveats"), _figures(r="r", n="n", note=note, variable1="col_a", variable2="col_b", pairCount="n", points="points", caveats=caveat), no_row))
    for i, c in enumerate(numeric):
        # No column can bring more rows than the cap, so the first ones by row are enough.
        o = T.outliers(df, c, row).orderBy("row").limit(T.PATTERNS)
        said = _text(f"{c} value of ", num_to_text(F.col("v")), " at row ", F.col("row").cast("string"), " (z=", num_to_text(F.col("z")), ").")
        parts.append(o.select(F.lit(2).alias("o1"), F.lit(i).cast("long").alias("o2"), F.col("row").cast("long").alias("o3"), F.lit("outlier").alias("pattern_type"), F.lit(c).alias("theme"), said.alias("description"), F.col("z").alias("statistic"), _tags().cast("array<string>").alias("caveats"), _figures(z="z", column=F.lit(c), value="v"), F.col("row").alias("row")))
    if not parts:
        return df.sparkSession.createDataFrame([], "pattern int, pattern_type string, theme string, description string, statistic double, caveats array<string>, stated_stats string, row long")
    first = reduce(DataFrame.unionByName, parts).orderBy("o1", "o2", "o3").limit(T.PATTERNS)
    ranked = first.withColumn("pattern", F.row_number().over(Window.orderBy("o1", "o2", "o3")))  # 25 rows at most
    return ranked.select("pattern", "pattern_type", "theme", "description", "statistic", "caveats", "stated_stats", "row")


def _figures(**named) -> Column:
    """JSON of named columns, nulls left out."""
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()])).alias("stated_stats")


def pattern_rows(df: DataFrame, patterns: DataFrame, row: str) -> DataFrame:
    """(pattern, side, row): the rows of a table that stand behind its patterns, side 1 or 2 of a difference; relationships rest on whole columns and have none.

    One pass over the table; the patterns of a table are 25 at most.
    """
    told = "bannerColumn string, stubColumn string, group1Label string, group2Label string"
    specs = patterns.where("pattern_type = 'segment_difference'").select("pattern", F.from_json("stated_stats", told).alias("s")).collect()
    found = patterns.where("pattern_type = 'outlier'").select("pattern", F.lit(1).alias("side"), "row")
    if not specs:
        return found
    each = []
    for r in specs:
        category = T.as_category(df, r.s["bannerColumn"])
        side = F.when(category == r.s["group1Label"], 1).when(category == r.s["group2Label"], 2)
        each.append(F.when(side.isNotNull() & F.col(r.s["stubColumn"]).isNotNull(), F.struct(F.lit(r["pattern"]).alias("pattern"), side.alias("side"))))
    behind = df.select(F.col(row).alias("row"), F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e"))
    return behind.select("e.pattern", "e.side", "row").union(found)


def digest(patterns: DataFrame) -> DataFrame:
    """One text: a line for each of the first eight patterns."""
    lines = patterns.where(F.col("pattern") <= DIGEST_LINES).agg(F.sort_array(F.collect_list(F.struct("pattern", F.concat(F.lit("- "), "description").alias("d")))).alias("l"))
    return lines.select(F.array_join(F.transform("l", lambda x: x["d"]), "\n").alias("digest"))


def banner_plan(df: DataFrame, banners: list[str], stubs: list[str], row: str, numeric: set[str]) -> DataFrame:
    """Finding rows of every banner against every other stub of a raw table.

    Numeric stub and more than two categories: one row of the test of variance,
    then, if it is significant, all pairs; where nothing can be tested, a
    descriptive row for each category.  Numeric stub and two categories: the
    pair.  Other stubs: two-proportion tests of the first ten categories.
    Numeric banners with more than ten values are left out.  An empty plan is
    an error.  Columns: banner_column, stub_column, place (order inside the
    pair), test, stub, cat_a, cat_b, n_a, n_b, gap, statistic, significant,
    caveats, theme, description.
    """
    if not banners or not stubs:
        raise ValueError("a banner plan names at least one banner and one stub column")
    parts = []
    for banner in banners:
        if banner in numeric and df.select(banner).where(F.col(banner).isNotNull()).distinct().limit(T.CATEGORIES + 1).count() > T.CATEGORIES:
            continue
        for stub in stubs:
            if stub != banner:
                parts += _numeric_rows(df, banner, stub, row) if stub in numeric else [_proportion_rows(df, banner, stub, row)]
    if not parts:
        return df.sparkSession.createDataFrame([], _PLAN)
    return reduce(DataFrame.unionByName, parts)


_PLAN = "banner_column string, stub_column string, place long, test string, stub string, cat_a string, cat_b string, n_a long, n_b long, gap double, statistic double, significant boolean, caveats array<string>, theme string, description string, stated_stats string"


def _plan_row(rows: DataFrame, banner: str, stub_column: str, test: str, place: Column, caveats: Column, said: Column, told: dict, **named) -> DataFrame:
    kinds = {"stub": "string", "cat_a": "string", "cat_b": "string", "n_a": "long", "n_b": "long", "gap": "double", "statistic": "double", "significant": "boolean"}
    values = [named.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return rows.select(F.lit(banner).alias("banner_column"), F.lit(stub_column).alias("stub_column"), place.cast("long").alias("place"), F.lit(test).alias("test"), *values, caveats.alias("caveats"), F.lit(f"{banner} & {stub_column}").alias("theme"), said.alias("description"), _figures(**told, bannerColumn=F.lit(banner), stubColumn=F.lit(stub_column), caveats=caveats))


def _proportion_rows(df: DataFrame, banner: str, stub: str, row: str) -> DataFrame:
    cells = T.crosstab(df, banner, stub, row).select("banner", "banner_ord", "stub", "stub_ord", "n", "base", "pct")
    a = cells.select("stub", "stub_ord", *[F.col(c).alias(f"a_{c}") for c in ("banner", "banner_ord", "n", "base", "pct")])
    b = cells.select("stub", *[F.col(c).alias(f"b_{c}") for c in ("banner", "banner_ord", "n", "base", "pct")])
    gap, z, significant = T.proportion_gap(F.col("a_base"), F.col("a_n") / F.col("a_base"), F.col("b_base"), F.col("b_n") / F.col("b_base"))
    p = a.join(b, "stub").where("a_banner_ord < b_banner_ord").withColumns({"gap": gap, "z": z, "significant": significant})
    z_text = F.coalesce(F.concat(F.lit("z="), num_to_text(F.col("z"))), F.lit("z n/a"))
    size = num_to_text(F.abs("gap"))
    figures = _text("(", num_to_text(F.col("a_pct")), "% vs ", num_to_text(F.col("b_pct")), "%, n=", F.col("a_base").cast("string"), " vs ", F.col("b_base").cast("string"), ")")
    place = _text(f"{stub}=" + '"', F.col("stub"), '"')
    clause = F.when(F.col("significant"), _text("a statistically significant ", size, "-point gap (", z_text, ")")).otherwise(_text("not a statistically significant difference (", size, "-point gap, ", z_text, ")"))
    said = F.when(F.col("gap") == 0, _text(f'{banner} "', F.col("a_banner"), '" and "', F.col("b_banner"), '" are equally likely to fall into ', place, " ", figures, ", no gap at all (", z_text, ").")).otherwise(
        _text(f'{banner} "', F.col("a_banner"), '" is ', F.when(F.col("gap") > 0, "more").otherwise("less"), ' likely than "', F.col("b_banner"), '" to fall into ', place, " ", figures, ": ", clause, ".")
    )
    order = F.col("a_banner_ord") * 10_000 + F.col("b_banner_ord") * 100 + F.col("stub_ord")
    caveats = _tags(F.when(~F.col("significant"), "not_significant"), "uncorrected_multiple_comparisons", "sampling_assumed_random")
    told = {"gapPercent": "gap", "zScore": "z", "significant": "significant", "group1Label": "a_banner", "group2Label": "b_banner", "n1": "a_base", "n2": "b_base", "pctA": "a_pct", "pctB": "b_pct", "stubCategory": "stub"}
    return _plan_row(p, banner, stub, "proportions", order, caveats, said, told, stub=F.col("stub"), cat_a=F.col("a_banner"), cat_b=F.col("b_banner"), n_a=F.col("a_base"), n_b=F.col("b_base"), gap=F.col("gap"), statistic=F.col("z"), significant=F.col("significant"))


def _p_text(p: Column) -> Column:
    return F.when(p < 0.001, "p<0.001").otherwise(F.concat(F.lit("p="), num_to_text(p)))


def _numeric_rows(df: DataFrame, banner: str, stub: str, row: str) -> list[DataFrame]:
    groups = T.group_summary(df, banner, stub, row).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).withColumn("m", jround(F.col("mean"), 2))  # ten groups at most
    test = T.anova(df, banner, stub, row).select("f_stat", "p_value", "significant")
    lined = groups.where("n >= 2").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("s"), "banner_ord", "banner", "m", "n"))).alias("g"))
    one = lined.join(F.broadcast(test)).where("k > 2 AND NOT (f_stat IS NULL AND p_value IS NULL)")
    listing = F.array_join(F.transform("g", lambda g: F.concat(g["banner"], F.lit(" "), num_to_text(g["m"]), F.lit(" (n="), g["n"].cast("string"), F.lit(")"))), ", ")
    stats = F.coalesce(_text(" (F=", num_to_text(F.col("f_stat")), ", ", _p_text(F.col("p_value")), ")"), F.lit(""))
    top, bottom = F.element_at("g", 1), F.element_at("g", -1)
    differs = _text(f'{stub} differs by {banner}: highest for "', top["banner"], '" at ', num_to_text(top["m"]), ', lowest for "', bottom["banner"], '" at ', num_to_text(bottom["m"]), " (full breakdown: ", listing, ")", stats, ", a statistically significant spread across all ", F.size("g").cast("string"), " groups (one-way ANOVA).")
    alike = _text(f"{stub} looks broadly similar across {banner} groups: ", listing, stats, ", no statistically significant difference overall (one-way ANOVA).")
    whole = _plan_row(one, banner, stub, "anova", F.lit(0), _tags(F.when(~F.col("significant"), "not_significant"), "sampling_assumed_random"), F.when(F.col("significant"), differs).otherwise(alike), {"testType": F.lit("one_way_anova"), "fStat": "f_stat", "pValue": "p_value", "significant": "significant", "groupMeans": F.transform(F.array_sort("g", lambda x, y: x["banner_ord"] - y["banner_ord"]), lambda g: F.struct(g["banner"].alias("label"), g["n"].alias("n"), g["m"].alias("mean")))}, n_a=F.col("n"), statistic=F.col("f_stat"), significant=F.col("significant"))

    bare = groups.where("k > 2 AND n > 0").join(F.broadcast(test)).where("f_stat IS NULL AND p_value IS NULL")
    mean = num_to_text(F.col("m"))
    said = F.when(F.col("n") > 1, _text(f'{banner} "', F.col("banner"), '" averages ', mean, f" on {stub} (n=", F.col("n").cast("string"), "), too little data in this group alone to test against the others.")).otherwise(
        _text(f'{banner} "', F.col("banner"), f'" has a single {stub} reading of ', mean, ", too little data in this group alone to test against the others.")
    )
    told = _plan_row(bare, banner, stub, "descriptive", F.col("banner_ord"), _tags("insufficient_n_for_test", "sampling_assumed_random"), said, {"testType": F.lit("descriptive_summary"), "category": "banner", "n": "n", "mean": "m"}, cat_a=F.col("banner"), n_a=F.col("n"))

    gap, t, significant = T.mean_gap(*[F.col(c) for c in ("a_n", "a_mean", "a_var", "b_n", "b_mean", "b_var")])
    pairs = T.category_pairs(groups).where("a_n >= 2 AND b_n >= 2").join(F.broadcast(test.select(F.col("significant").alias("overall")))).where("a_k = 2 OR overall").withColumns({"gap": gap, "t": t, "significant": significant})
    t_text = F.coalesce(F.concat(F.lit("t="), num_to_text(F.col("t"))), F.lit("t n/a"))
    n = _text("n=", F.col("a_n").cast("string"), " vs ", F.col("b_n").cast("string"))
    clause = F.when(F.col("significant"), _text("a statistically significant gap of ", num_to_text(F.abs("gap")), " (", t_text, ")")).otherwise(_text("not a statistically significant difference (gap of ", num_to_text(F.abs("gap")), ", ", t_text, ")"))
    sentence = F.when(F.col("gap") == 0, _text(f'{banner} "', F.col("a_banner"), '" and "', F.col("b_banner"), f'" average the same on {stub} (', num_to_text(F.col("a_m")), ", ", n, "), no gap at all (", t_text, ").")).otherwise(
        _text(f'{banner} "', F.col("a_banner"), '" averages ', F.when(F.col("gap") > 0, "higher").otherwise("lower"), f" on {stub} than ", '"', F.col("b_banner"), '" (', num_to_text(F.col("a_m")), " vs ", num_to_text(F.col("b_m")), ", ", n, "): ", clause, ".")
    )
    after = F.when(F.col("a_k") > 2, " Post-hoc comparison, following a significant overall difference across all groups.").otherwise("")
    caveats = _tags(F.when(~F.col("significant"), "not_significant"), "uncorrected_multiple_comparisons", "sampling_assumed_random", F.when(F.col("a_k") > 2, "post_hoc_after_significant_anova"))
    order = F.col("a_banner_ord") * 100 + F.col("b_banner_ord")
    means = _plan_row(pairs, banner, stub, "means", order, caveats, F.concat(sentence, after), {"mean1": "a_m", "mean2": "b_m", "gap": "gap", "tScore": "t", "significant": "significant", "group1Label": "a_banner", "group2Label": "b_banner", "n1": "a_n", "n2": "b_n"}, cat_a=F.col("a_banner"), cat_b=F.col("b_banner"), n_a=F.col("a_n"), n_b=F.col("b_n"), gap=F.col("gap"), statistic=F.col("t"), significant=F.col("significant"))
    return [whole, told, means]


def pattern_findings(patterns: DataFrame, table_id: Column, run_id: Column, pattern_type: Column, kind: str = "aggregated") -> DataFrame:
    """Finding rows of patterns: generated, quantitative, accepted until someone rejects them; figures as JSON, and an outlier's row as the cells it rests on.

    A raw table's scan gives none: raw tables wait for a banner plan, whose rows
    are taken with ``kind`` "plan".
    """
    if kind not in ("aggregated", "raw", "plan"):
        raise ValueError("kind is aggregated, raw or plan")
    cells = F.when(F.col("row").isNotNull(), F.to_json(F.struct(F.array("row").alias("rowIndices")))) if "row" in patterns.columns else F.lit(None).cast("string")
    rows = patterns.where(F.lit(kind != "raw"))
    return rows.select(run_id.alias("run_id"), F.lit("generated").alias("origin"), F.col("description").alias("finding_text"), "theme", pattern_type.alias("pattern_type"), "stated_stats", table_id.alias("source_table_id"), cells.alias("source_cells"), F.lit("quantitative").alias("data_type"), F.lit("accepted").alias("status"))


def grounding_digest(findings: DataFrame, most: int = GROUNDING_FACTS) -> DataFrame:
    """(run_id, index, finding_id, text): the first twenty computed findings of each run that aren't rejected, numbered from 1."""
    live = findings.where("origin = 'generated' AND status <> 'rejected'")
    index = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "finding_id"))
    return live.select("run_id", index.alias("index"), "finding_id", F.col("finding_text").alias("text")).where(F.col("index") <= most)


def grounded(proposed: DataFrame, digest: DataFrame) -> DataFrame:
    """Proposed findings with the id that their number in the run's digest stands for; numbers outside give none."""
    return proposed.join(digest.select("run_id", F.col("index").alias("grounded_pattern_index"), F.col("finding_id").alias("grounded_by_finding_id")), ["run_id", "grounded_pattern_index"], "left")


def chart_eligibility(findings: DataFrame) -> DataFrame:
    """(run_id, theme, chart): the kind of chart of themes whose findings are all computed and of one kind that has charts, on one pair of columns."""
    g = findings.groupBy("run_id", "theme").agg(
        F.count_if((F.col("origin") != "generated") | F.col("stated_stats").isNull()).alias("others"), F.count_distinct("pattern_type").alias("kinds"), F.min("pattern_type").alias("kind"), F.count_if(F.col("pattern_type").isNull()).alias("untyped"),
        F.count_distinct("banner_column", "stub_column").alias("pairs"), F.count_if(F.col("stub_category").isNotNull()).alias("shares"),
    )
    fine = g.where((F.col("others") == 0) & (F.col("kinds") == 1) & (F.col("untyped") == 0) & F.col("kind").isin(*CHARTABLE))
    kind = F.when(F.col("kind") == "relationship", "scatter").when(F.col("kind") == "outlier", "outlier_strip").when((F.col("pairs") == 1) & (F.col("shares") > 0), "categorical_crosstab").when(F.col("pairs") == 1, "group_means")
    return fine.select("run_id", "theme", kind.alias("chart")).where("chart IS NOT NULL")


def crosstab_caption(plan: DataFrame) -> DataFrame:
    """(theme, comparisons, significant, caption) of proportion rows: the widest gap is the first of equals."""
    p = plan.where("test = 'proportions'")
    widest = F.max_by(F.struct("banner_column", "stub_column", "stub", "cat_a", "cat_b", F.abs("gap").alias("gap"), "statistic"), F.struct(F.abs("gap").alias("g"), (-F.col("place")).alias("p")))
    g = p.groupBy("theme").agg(F.count(F.lit(1)).alias("comparisons"), F.count_if("significant").alias("significant"), widest.alias("w"))
    z = F.coalesce(F.concat(F.lit(", z="), num_to_text(F.col("w.statistic"))), F.lit(""))
    said = _text(F.col("significant").cast("string"), " of ", F.col("comparisons").cast("string"), " comparisons statistically significant. Largest gap: ", F.col("w.banner_column"), ' "', F.col("w.cat_a"), '" vs "', F.col("w.cat_b"), '" on ', F.col("w.stub_column"), '="', F.col("w.stub"), '" (', num_to_text(F.col("w.gap")), " points", z, ").")
    return g.select("theme", "comparisons", "significant", said.alias("caption"))


def scatter_caption(relations: DataFrame) -> DataFrame:
    """(col_a, col_b, r, caption) of the strongest relation."""
    best = relations.orderBy(F.desc(F.abs("r")), "col_a", "col_b").limit(1)
    word = strength(F.col("r"))
    said = _text(F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 20)), " ", F.when(F.col("r") > 0, "positive").otherwise("negative"), " association between ", F.col("col_a"), " and ", F.col("col_b"), " across ", F.col("n").cast("string"), " rows (r=", num_to_text(F.col("r")), "). Descriptive association only, not evidence of causation.")
    return best.select("col_a", "col_b", "r", said.alias("caption"))
