"""Table statistics: categories, crosstabs, tests between groups, scans, digests and quality checks.

``row`` names the column that gives the order of ingest.  Category tables hold
at most CATEGORIES rows, so joins to them are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import generic_header, is_missing, jround, num_to_text
from tabulon.functions.stats import CRITICAL, f_p_value, mean_gap, pearson, proportion_gap

#: Caps and thresholds of the scans.
CATEGORIES, HEADERS, PATTERNS, GROUP_LEAST, POINTS, STRONG_ENOUGH = 10, 15, 25, 5, 300, 0.3
DIGEST_CATEGORIES, BINS_MOST, BINS_LEAST = 8, 10, 3
VARIABLE_MISSING, OVERALL_MISSING, CASES = (20.0, 50.0), (5.0, 20.0), (100, 30)


def as_category(df: DataFrame, column: str) -> Column:
    """A cell's category text: numbers print without needless fractions, null stays null."""
    kind = dict(df.dtypes)[column]
    return num_to_text(F.col(column)) if kind in ("double", "float") else F.col(column).cast("string")


def first_categories(df: DataFrame, column: str, row: str, cap: int = CATEGORIES) -> DataFrame:
    """(category, ord, first_row, n): categories by first appearance, ``cap`` at most, ord from 1."""
    seen = df.select(as_category(df, column).alias("category"), F.col(row).alias("r")).where("category IS NOT NULL")
    first = seen.groupBy("category").agg(F.min("r").alias("first_row"), F.count(F.lit(1)).alias("n")).orderBy("first_row", "category").limit(cap)
    return first.withColumn("ord", F.row_number().over(Window.orderBy("first_row", "category")))


def _named(categories: DataFrame, name: str, order: str) -> DataFrame:
    return categories.select(F.col("category").alias(name), F.col("ord").alias(order))


def crosstab(df: DataFrame, banner: str, stub: str, row: str) -> DataFrame:
    """(banner, stub, n, base, pct) for the first categories of both; base counts every row of the group."""
    banners, stubs = first_categories(df, banner, row), first_categories(df, stub, row)
    cells = df.select(as_category(df, banner).alias("banner"), as_category(df, stub).alias("stub")).groupBy("banner", "stub").agg(F.count(F.lit(1)).alias("n"))
    base = cells.groupBy("banner").agg(F.sum("n").alias("base"))
    grid = _named(banners, "banner", "banner_ord").join(F.broadcast(base), "banner").crossJoin(F.broadcast(_named(stubs, "stub", "stub_ord")))
    filled = grid.join(cells, ["banner", "stub"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("pct", jround(F.col("n") * 100.0 / F.col("base"), 1))


def group_summary(df: DataFrame, banner: str, value: str, row: str) -> DataFrame:
    """(banner, n, mean, sd) of the present values of each of the first categories."""
    banners = F.broadcast(_named(first_categories(df, banner, row), "banner", "banner_ord"))
    rows = df.select(as_category(df, banner).alias("banner"), F.col(value).cast("double").alias("v"))
    stats = rows.groupBy("banner").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    return stats.join(banners, "banner")


def group_table(df: DataFrame, banner: str, value: str, row: str) -> DataFrame:
    """``group_summary`` rounded for reading."""
    return group_summary(df, banner, value, row).select("banner", "n", jround(F.col("mean"), 2).alias("mean"), jround(F.sqrt("var"), 2).alias("sd"))


def category_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a_*, b_*) of groups, the earlier first."""
    a = groups.select([F.col(c).alias(f"a_{c}") for c in groups.columns])
    b = groups.select([F.col(c).alias(f"b_{c}") for c in groups.columns])
    return a.join(F.broadcast(b), F.col("a_banner_ord") < F.col("b_banner_ord"))


def proportion_pairs(df: DataFrame, banner: str, stub: str, row: str) -> DataFrame:
    """Two-proportion tests of every stub category between every two banner categories."""
    cells = crosstab(df, banner, stub, row).select("banner", "banner_ord", "stub", "n", "base")
    a = cells.select([F.col(c).alias(f"a_{c}") if c != "stub" else F.col(c) for c in cells.columns])
    b = cells.select([F.col(c).alias(f"b_{c}") if c != "stub" else F.col(c) for c in cells.columns])
    pairs = a.join(b, "stub").where("a_banner_ord < b_banner_ord")
    gap, z, significant = proportion_gap(F.col("a_base"), F.col("a_n") / F.col("a_base"), F.col("b_base"), F.col("b_n") / F.col("b_base"))
    return pairs.select("stub", F.col("a_banner").alias("cat_a"), F.col("b_banner").alias("cat_b"), F.col("a_base").alias("n_a"), F.col("b_base").alias("n_b"), gap.alias("gap_points"), z.alias("z"), significant.alias("significant"))


def mean_pairs(df: DataFrame, banner: str, value: str, row: str) -> DataFrame:
    """Welch tests of a value between every two banner categories."""
    pairs = category_pairs(group_summary(df, banner, value, row))
    gap, t, significant = mean_gap(*[F.col(c) for c in ("a_n", "a_mean", "a_var", "b_n", "b_mean", "b_var")])
    return pairs.select(
        F.col("a_banner").alias("cat_a"), F.col("b_banner").alias("cat_b"), F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"),
        jround(F.col("a_mean"), 2).alias("mean_a"), jround(F.col("b_mean"), 2).alias("mean_b"), gap.alias("gap"), t.alias("t"), significant.alias("significant"),
    )


def anova(df: DataFrame, banner: str, value: str, row: str) -> DataFrame:
    """One row: groups k, n, F (two decimals), p (three), significant at 5 %.

    Groups under two values are left out.  No spread inside groups: F is null and p is 0 or 1.
    """
    groups = group_summary(df, banner, value, row).where("n >= 2")
    total = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("ss"), F.sum((F.col("n") - 1) * F.col("var")).alias("within")
    )
    between = F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    fits = (F.col("k") >= 2) & (F.col("n") > F.col("k"))
    ms_within = F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    raw = F.when(fits & (F.col("within") > 0), between / F.nullif(F.col("k") - 1, F.lit(0)) / F.nullif(ms_within, F.lit(0.0)))
    p = F.when(fits, F.when(F.col("within") > 0, f_p_value(F.col("f"), F.col("k") - 1.0, (F.col("n") - F.col("k")).cast("double"))).otherwise(F.when(F.col("between") > 0, 0.0).otherwise(1.0)))
    out = total.withColumn("f", raw).withColumn("between", between).withColumn("p", p)
    return out.select("k", "n", jround(F.col("f"), 2).alias("f_stat"), jround(F.col("p"), 3).alias("p_value"), F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant"))


def column_kinds(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) of the first fifteen columns, from one pass.

    Numeric: a number type with five values.  Categorical: others with ten
    values, of which two to ten differ.
    """
    kinds = dict(df.dtypes)
    numeric_type = {c for c in columns[:HEADERS] if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")}
    aggs = [F.count(c).alias(f"n_{i}") for i, c in enumerate(columns[:HEADERS])]
    # More than ten categories count as eleven: a set of eleven first values tells them apart.
    aggs += [F.approx_count_distinct(as_category(df, c)).alias(f"d_{i}") for i, c in enumerate(columns[:HEADERS]) if c not in numeric_type]
    row = df.agg(*aggs).first().asDict()
    numeric = [c for i, c in enumerate(columns[:HEADERS]) if c in numeric_type and row[f"n_{i}"] >= GROUP_LEAST]
    near = [(i, c) for i, c in enumerate(columns[:HEADERS]) if c not in numeric_type and row[f"n_{i}"] >= 2 * GROUP_LEAST and row[f"d_{i}"] <= 2 * CATEGORIES]
    exact = {c: df.select(as_category(df, c).alias("c")).where("c IS NOT NULL").distinct().limit(CATEGORIES + 1).count() for _, c in near}
    return numeric, [c for _, c in near if 2 <= exact[c] <= CATEGORIES]


def segment_differences(df: DataFrame, categories: list[str], values: list[str], row: str) -> DataFrame:
    """Significant mean gaps between the two largest groups (ties: first seen) of each category and value column.

    All pairs of columns are aggregated in one pass: a row gives one line for
    each category column with all values beside it.
    """
    pairs = [(i, c) for i, c in enumerate(categories[:HEADERS])]
    sized = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("category_column"), as_category(df, c).alias("banner")) for i, c in pairs])).alias("g"), F.col(row).alias("r"), *[F.col(v).cast("double").alias(v) for v in values[:HEADERS]]).select("g.*", "r", *values[:HEADERS]).where("banner IS NOT NULL")
    stats = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(v).alias("value_column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var")) for j, v in enumerate(values[:HEADERS])])
    groups = sized.groupBy("i", "category_column", "banner").agg(F.min("r").alias("first"), stats.alias("s")).select("i", "category_column", "banner", "first", F.explode("s").alias("s")).select("i", "category_column", "banner", "first", "s.*")
    place = Window.partitionBy("i", "j").orderBy(F.desc("n"), "first")
    top = groups.where(F.col("n") >= GROUP_LEAST).withColumn("k", F.row_number().over(place)).where("k <= 2")
    key = ["i", "j", "category_column", "value_column"]
    a, b = (top.where(F.col("k") == k).select(*key, *[F.col(c).alias(f"{x}_{c}") for c in ("banner", "n", "mean", "var")]) for k, x in ((1, "a"), (2, "b")))
    gap, t, significant = mean_gap(*[F.col(x) for x in ("a_n", "a_mean", "a_var", "b_n", "b_mean", "b_var")])
    both = a.join(b, key).where(significant)
    return both.select(*key, F.col("a_banner").alias("cat_a"), F.col("b_banner").alias("cat_b"), F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"), jround(F.col("a_mean"), 2).alias("mean_a"), jround(F.col("b_mean"), 2).alias("mean_b"), gap.alias("gap"), t.alias("t"))


def relationships(df: DataFrame, values: list[str]) -> DataFrame:
    """(col_a, col_b, n, r) of value columns whose correlation is at least STRONG_ENOUGH, in one pass over the table.

    Sums are of values less the column's mean, so that large values don't cancel.
    """
    values = values[:HEADERS]
    means = df.agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values]).first()
    centred = df.select([(F.col(v).cast("double") - F.lit(means[v] or 0.0)).alias(v) for v in values])
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    aggs = []
    for a, b in pairs:
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
        aggs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")))
    rows = centred.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    r = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return rows.select("col_a", "col_b", "n", r.alias("r")).where(F.abs("r") >= STRONG_ENOUGH)


#: Fixed value: most points of a relationship that are kept for drawing.
POINTS = 300


def relationship_points(df: DataFrame, relations: DataFrame, row: str, most: int = POINTS) -> DataFrame:
    """(col_a, col_b, points) of each relation (col_a, col_b, n): its complete pairs (x, y) in row order, ``most`` of them evenly spaced if there are more.

    All relations are ranked in one pass: a running count each of the rows that
    have both values, range by range.  Relations are pairs of a table's first
    columns, so they are few.
    """
    pairs = [(r["col_a"], r["col_b"], r["n"]) for r in relations.select("col_a", "col_b", "n").collect()]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, points array<struct<x:double,y:double>>")
    names = sorted({c for a, b, _ in pairs for c in (a, b)})
    values = df.select(F.col(row).alias("r"), *[F.col(c).cast("double").alias(f"v_{i}") for i, c in enumerate(names)])
    at = {c: f"v_{i}" for i, c in enumerate(names)}
    both = values.withColumns({f"b_{k}": (F.col(at[a]).isNotNull() & F.col(at[b]).isNotNull()).cast("long") for k, (a, b, _) in enumerate(pairs)})
    ranked = running_sum(both, "r", {f"b_{k}": f"u_{k}" for k in range(len(pairs))})
    each = F.array(*[F.when(F.col(f"b_{k}") == 1, F.struct(F.lit(k).alias("k"), (F.col(f"u_{k}") - 1).alias("spot"), F.col(at[a]).alias("x"), F.col(at[b]).alias("y"))) for k, (a, b, _) in enumerate(pairs)])
    rows = ranked.select(F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("e.*")
    # At most ``most`` places for each relation.
    spots = [(k, int(i * (n / most)) if n > most else i, i) for k, (_, _, n) in enumerate(pairs) for i in range(min(n, most))]
    wanted = df.sparkSession.createDataFrame(spots, "k int, spot long, i int")
    named = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, col_a string, col_b string")
    g = rows.join(F.broadcast(wanted), ["k", "spot"]).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", F.struct("x", "y").alias("p")))).alias("l"))
    return g.join(F.broadcast(named), "k").select("col_a", "col_b", F.transform("l", lambda e: e["p"]).alias("points"))


def outliers(df: DataFrame, value: str, row: str) -> DataFrame:
    """Rows two or more deviations from the mean of all others (leave-one-out in closed form); needs four values."""
    present = df.select(F.col(row).alias("row"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    mean = present.agg(F.avg("v").alias("m"))
    centred = present.join(F.broadcast(mean)).select("row", "v", "m", (F.col("v") - F.col("m")).alias("c"))
    sums = centred.agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    out = centred.join(F.broadcast(sums)).where("n >= 4")
    others = (F.col("s") - F.col("c")) / (F.col("n") - 1)
    variance = (F.col("ss") - F.col("c") * F.col("c")) / (F.col("n") - 1) - others * others
    z = F.when(variance > 0, (F.col("c") - others) / F.sqrt(variance))
    return out.withColumn("z", z).where(F.abs("z") >= 2).select("row", "v", jround(F.col("z"), 1).alias("z"))


def even_sample(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Rows at floor(i * n / k) for i under k, in the given order; all rows if there are no more than k.

    The rank is found by range: rows are ranked inside sorted partitions and offsets added, so no task holds all rows.
    """
    ranked = global_rank(df, "rank", *order)
    n = ranked.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n <= k:
        return ranked.drop("rank")
    spots = df.sparkSession.range(k).select(F.floor(F.col("id") * n / k).alias("rank")).distinct()
    return ranked.join(F.broadcast(spots), "rank").drop("rank")


def global_rank(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` plus a 0-based rank over the whole table, without a one-partition window."""
    from tabulon.plans.lineage import cut

    lined = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))
    starts = lined.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    offsets = starts.withColumn("__off", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["__off"])
    placed = lined.join(F.broadcast(offsets), "__p")
    return placed.withColumn(name, F.col("__off") + F.col("__m") - F.col("__first")).drop("__p", "__m", "__n", "__first", "__off")


def running_sum(df: DataFrame, order: str, sums: dict[str, str], after: str | None = None) -> DataFrame:
    """``df`` plus running sums of columns in the order of a column without ties, and, as ``after``, the next value of that column.

    Rows are cut into ranges; sums run inside each and the totals of those
    before are added, so no task holds more than a range.
    """
    from tabulon.plans.lineage import cut

    lined = cut(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    inside = Window.partitionBy("__p").orderBy(order)
    ranges = Window.orderBy("__p")  # one row a range
    totals = lined.groupBy("__p").agg(F.min(order).alias("__low"), *[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = totals.select("__p", F.lead("__low").over(ranges).alias("__next"), *[F.coalesce(F.sum(f"__t_{c}").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{c}") for c in sums])
    upto = [(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col(f"__b_{c}")).alias(name) for c, name in sums.items()]
    next_ = [F.coalesce(F.lead(order).over(inside), F.col("__next")).alias(after)] if after else []
    return lined.join(F.broadcast(before), "__p").select(*df.columns, *upto, *next_)


def best_split(df: DataFrame, split: str, outcome: str) -> DataFrame:
    """Best cut of ``split`` for the mean of ``outcome``: largest rounded abs(t) that reaches 1.96, first of equals.

    Numbers are cut at the middle of two neighbouring values, anything else is
    one category against the rest, in order of appearance of the text.
    Columns: label, n_1, n_2, mean_1, mean_2, gap, t.
    """
    kind = dict(df.dtypes)[split]
    numeric = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
    x = F.col(split).cast("double") if numeric else as_category(df, split)
    rows = df.select(x.alias("x"), F.col(outcome).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    centre = rows.agg(F.avg("y").alias("m"))
    each = rows.join(F.broadcast(centre)).withColumn("c", F.col("y") - F.col("m")).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    sums = each.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    if numeric:
        lined = running_sum(each, "x", {"n": "n1", "s": "s1", "ss": "ss1"}, after="after").where("after IS NOT NULL")
        place = (F.col("x") + F.col("after")) / 2
        label = F.concat(F.lit(f"{split} < "), num_to_text(jround(place, 2)))
    else:
        lined = each.select("x", F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("ss").alias("ss1"))
        place, label = F.col("x"), F.concat(F.lit(f'{split} = "'), F.col("x"), F.lit('"'))
    cuts = lined.join(F.broadcast(sums)).join(F.broadcast(centre))
    n1, s1, ss1 = F.col("n1"), F.col("s1"), F.col("ss1")
    n2, s2, ss2 = F.col("tn") - n1, F.col("ts") - s1, F.col("tss") - ss1
    v1 = F.try_divide(ss1 - s1 * s1 / n1, n1 - 1)
    v2 = F.try_divide(ss2 - s2 * s2 / n2, n2 - 1)
    fits = cuts.where((n1 >= GROUP_LEAST) & (n2 >= GROUP_LEAST)).withColumn("gap", s1 / n1 - s2 / n2).withColumn("se", F.sqrt(v1 / n1 + v2 / n2))
    scored = fits.where("se > 0").withColumn("t", jround(F.col("gap") / F.col("se"), 2)).withColumn("place", place)
    best = scored.where(F.abs("t") >= CRITICAL[95]).orderBy(F.desc(F.abs("t")), "place").limit(1)
    return best.select(label.alias("label"), n1.alias("n_1"), n2.alias("n_2"), jround(F.col("m") + s1 / n1, 2).alias("mean_1"), jround(F.col("m") + s2 / n2, 2).alias("mean_2"), jround(F.col("gap"), 2).alias("gap"), "t")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, low, high, n): round(sqrt n) bins between 3 and 10, last one closed; one bin without spread."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    s = v.agg(F.count("v").alias("count"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    bins = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.lit(BINS_MOST), F.greatest(F.lit(BINS_LEAST), jround(F.sqrt("count")).cast("int"))))
    shape = s.where("count > 0").withColumn("bins", bins).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    spine = shape.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    put = v.join(F.broadcast(shape)).select(F.when(F.col("width") == 0, 0).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / F.nullif("width", F.lit(0.0))))).cast("int").alias("bin"))
    counts = put.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(spine).join(counts, "bin", "left").select("bin", jround(F.col("lo") + F.col("bin") * F.col("width"), 2).alias("low"), jround(F.col("lo") + (F.col("bin") + 1) * F.col("width"), 2).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def numeric_digest(df: DataFrame, value: str) -> DataFrame:
    """(n, mean, median, min, max) of the present values, exact median read off counted values."""
    from tabulon.operators.coding import spread

    v = df.select(F.col(value).cast("double").alias("v"))
    return spread(v, "v").join(F.broadcast(v.agg(jround(F.avg("v"), 2).alias("mean")))).select("n", "mean", jround(F.col("median"), 2).alias("median"), "min", "max")


def category_digest(df: DataFrame, column: str, row: str) -> DataFrame:
    """(category, n, pct): the largest eight, ties by first appearance, the rest as Other."""
    text = as_category(df, column)
    seen = df.select(text.alias("category"), F.col(row).alias("r")).where("category IS NOT NULL AND category <> ''")
    counts = seen.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "first").limit(DIGEST_CATEGORIES)
    rest = counts.join(F.broadcast(top.select("category")), "category", "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("Other").alias("category"), "n")
    return top.select("category", "n").union(rest).join(F.broadcast(total)).select("category", "n", jround(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, reason, n, distinct_values) of the first fifteen columns: numeric, categorical, or skipped and why.

    Fixed values: three values at least and ten categories at most.
    """
    kinds, parts = dict(df.dtypes), []
    for place, c in enumerate(columns[:HEADERS]):
        numeric = kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
        v = df.select(as_category(df, c).alias("v")).where("v IS NOT NULL AND v <> ''").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        g = v.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("distinct_values"))
        reason = F.when(F.col("n") < BINS_LEAST, "no_usable_values").when(F.lit(not numeric) & (F.col("distinct_values") > CATEGORIES), "too_many_distinct_values")
        parts.append(g.select(F.lit(place).alias("place"), F.lit(c).alias("column"), F.when(reason.isNotNull(), "skipped").otherwise("numeric" if numeric else "categorical").alias("kind"), reason.alias("reason"), "n", "distinct_values"))
    return reduce(DataFrame.unionByName, parts)


def crosstab_preview(df: DataFrame, banners: list[str], stubs: list[str], row: str, numeric: set[str]) -> DataFrame:
    """(banner_column, stub_column, kind, categories, banner_truncated, stub_truncated, banner_is_continuous, f_stat, p_value, significant) of every pair.

    The cells are ``crosstab`` or ``group_table``; numeric stubs get the test of
    variance from three categories on.
    """
    parts = []
    for banner in banners:
        many = df.select(as_category(df, banner).alias("c")).where("c IS NOT NULL").agg(F.count_distinct("c").alias("all"))
        for stub in stubs:
            if stub == banner:
                continue
            base = many
            if stub in numeric:
                tested = anova(df, banner, stub, row).select("f_stat", "p_value", "significant")
                base = base.join(F.broadcast(tested)).withColumn("stubs", F.lit(0).cast("long"))
            else:
                base = base.join(F.broadcast(df.select(as_category(df, stub).alias("c")).where("c IS NOT NULL").agg(F.count_distinct("c").alias("stubs")))).select("*", F.lit(None).cast("double").alias("f_stat"), F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("boolean").alias("significant"))
            shown = F.least(F.col("all"), F.lit(CATEGORIES))
            only = lambda c, n=shown: F.when(n > 2, F.col(c)).alias(c)
            parts.append(base.where("all > 0").select(
                F.lit(banner).alias("banner_column"), F.lit(stub).alias("stub_column"), F.lit("numeric" if stub in numeric else "categorical").alias("kind"), shown.cast("int").alias("categories"), (F.col("all") > CATEGORIES).alias("banner_truncated"),
                (F.col("stubs") > CATEGORIES).alias("stub_truncated"), (F.lit(banner in numeric) & (F.col("all") > CATEGORIES)).alias("banner_is_continuous"), only("f_stat"), only("p_value"), only("significant"),
            ))
    return reduce(DataFrame.unionByName, parts)


def variable_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: missing, distinct, constant, unlabelled header, share missing, type.

    Cells are counted by (column, value), which partial sums shrink before the
    shuffle; columns' figures come from the counted values.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), as_category(df, c).alias("v")) for c in columns])).alias("c")).select("c.*")
    counted = cells.groupBy("variable", "v").agg(F.count(F.lit(1)).alias("c"))
    number = F.when(~is_missing(F.col("v")), F.regexp_replace(F.trim("v"), ",", "").try_cast("double"))
    marked = counted.select("variable", "v", "c", is_missing(F.col("v")).alias("gone"), F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number).alias("number"))
    rows = marked.groupBy("variable").agg(
        F.sum("c").alias("cases"), F.sum(F.when(F.col("gone"), F.col("c")).otherwise(0)).alias("missing"), F.count_if(~F.col("gone")).alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("c"))), F.lit(0)).alias("numbers"), F.count_distinct("number").alias("distinct_numbers"), F.coalesce(F.bool_and(F.col("number") == F.floor("number")), F.lit(True)).alias("whole"),
    )
    empty = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    rows = empty.join(rows, "variable", "left").na.fill(0, ["cases", "missing", "distinct_values", "numbers", "distinct_numbers"])
    present = F.col("cases") - F.col("missing")
    kind = (
        F.when((present == 0) | (F.col("numbers") < present * 0.9) | (F.col("distinct_numbers") <= 2), "categorical")
        .when(F.col("whole") & (F.col("distinct_numbers") <= 10), "discrete")
        .otherwise("continuous")
    )
    pct = jround(F.try_divide(F.col("missing") * 100.0, F.col("cases")), 1)
    status = F.when(pct > VARIABLE_MISSING[1], "fail").when(pct > VARIABLE_MISSING[0], "warn").otherwise("pass")
    return rows.select("variable", "cases", "missing", "distinct_values", ((F.col("cases") > 1) & (F.col("distinct_values") <= 1)).alias("constant"), generic_header(F.col("variable")).alias("unlabelled"), pct.alias("missing_pct"), kind.alias("kind"), status.alias("status"))


def worst_variables(quality: DataFrame, columns: list[str], most: int = 8) -> DataFrame:
    """(place, variable, missing_pct): the eight columns with most missing among those with a fault, ties in column order."""
    order = F.array_position(F.array(*map(F.lit, columns)), F.col("variable"))
    faulty = quality.where("missing > 0 OR constant OR unlabelled")
    return faulty.withColumn("place", F.row_number().over(Window.orderBy(F.desc("missing_pct"), order))).where(F.col("place") <= most).select("place", "variable", "missing_pct")


def duplicate_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cases, distinct_cases, duplicates) over the columns, null cells included."""
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return distinct.agg(F.sum("n").alias("cases"), F.count(F.lit(1)).alias("distinct_cases")).withColumn("duplicates", F.col("cases") - F.col("distinct_cases"))


def table_quality(df: DataFrame, columns: list[str], kind: str = "raw") -> DataFrame:
    """(check, value, status) of the checks of a table; cases, duplicates and constant columns are checked of raw tables only.

    Fixed values: the names of the checks and of the states.
    """
    v = variable_quality(df, columns)
    total = v.agg(F.max("cases").alias("cases"), F.sum("missing").alias("missing"), F.sum("cases").alias("cells"), F.count_if("constant").alias("constant"), F.count_if("unlabelled").alias("unlabelled"), F.count_if(F.col("status") != "pass").alias("gappy"), F.count_if(F.col("status") == "fail").alias("bad"))
    pct = jround(F.try_divide(F.col("missing") * 100.0, F.col("cells")), 1)
    some = lambda x: F.when(x > 0, "warn").otherwise("pass")
    checks = [
        ("missing_overall", pct, F.when(pct > OVERALL_MISSING[1], "fail").when(pct > OVERALL_MISSING[0], "warn").otherwise("pass")),
        ("missing_by_variable", F.col("gappy"), F.when(F.col("bad") > 0, "fail").when(F.col("gappy") > 0, "warn").otherwise("pass")),
        ("labels", F.col("unlabelled"), some(F.col("unlabelled"))),
    ]
    if kind == "raw":
        total = total.join(F.broadcast(duplicate_cases(df, columns).select("duplicates")))
        checks += [
            ("sample_size", F.col("cases"), F.when(F.col("cases") < CASES[1], "fail").when(F.col("cases") < CASES[0], "warn").otherwise("pass")),
            ("duplicates", F.col("duplicates"), some(F.col("duplicates"))),
            ("constant", F.col("constant"), some(F.col("constant"))),
        ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), x.cast("double").alias("value"), s.alias("status")) for n, x, s in checks])
    return total.select(F.explode(rows).alias("c")).select("c.*")
