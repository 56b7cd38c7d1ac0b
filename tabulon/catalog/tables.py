"""Queries of the table statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabulon.catalog.fixtures import oracle, tables
from tabulon.functions import stats
from tabulon.functions.exprs import jround
from tabulon.operators import charts as K
from tabulon.operators import patterns as P
from tabulon.operators import tables as T


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders")


LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
FILE_COLUMNS = ["document_id", "kind", "ingestion_type", "extracted_text"]


def base_sizes(spark, sf_dir):
    """Base-size tag and margin of error at each share of the orders, by customer."""
    g = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return g.select("o_custkey", "n", stats.base_size_tag(F.col("n")).alias("tag"), stats.margin_of_error(F.col("n"), F.col("f") / F.col("n")).alias("margin"))


def _lines(spark, sf_dir):
    """Line items with the net price, which hangs on the discount."""
    return _t(spark, sf_dir, "lineitem").withColumn("l_net", F.col("l_extendedprice") * (1 - 4 * F.col("l_discount")))


def _priced(spark, sf_dir):
    """Orders with a price that hangs on their state."""
    return _orders(spark, sf_dir).withColumn("adjusted", F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "O", 40000.0).when(F.col("o_orderstatus") == "P", 80000.0).otherwise(0.0))


def _patterns(spark, sf_dir):
    """Suppliers as an aggregated table: two numbers that move together, one with far values, a category."""
    return P.table_patterns(_aggregated(spark, sf_dir), ["half", "s_acctbal", "twice", "far"], "s_suppkey")


@F.pandas_udf(DoubleType())
def _fourth_power(x: pd.Series) -> pd.Series:
    """The C library's power, as the SQL has it: the JVM's own differs from it in the last digit of some values, and sentences print all digits."""
    return x.map(lambda v: None if pd.isna(v) else math.pow(v, 4.0)).astype("float64")


def _aggregated(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").withColumns({"twice": F.col("s_acctbal") * 2 + F.col("s_suppkey") % 7, "far": _fourth_power(F.col("s_acctbal") / 1000), "half": F.when(F.col("s_acctbal") > 4500, "high").otherwise("low")})
    return s.select("s_suppkey", "half", "s_acctbal", "twice", "far")


def _gappy(spark, sf_dir):
    """Orders with three prices that move together, two of them with gaps."""
    o = _priced(spark, sf_dir)
    return o.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("adjusted")).alias("adjusted"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * F.col("o_totalprice") / 1e6).alias("square"))


def _charts(spark, sf_dir):
    """Charts of the banner plan's findings; captions of shares only, as those of means round a probability."""
    f = P.pattern_findings(_plan(spark, sf_dir).orderBy("banner_column", "stub_column", "place"), F.lit(7), F.lit(1), F.lit("banner_comparison"), "plan")
    placed = f.withColumns({"finding_id": F.col("finding_text"), "place": F.lit(0)})
    c = K.theme_charts(placed).withColumn("b_", F.explode("bars"))
    return c.select("theme", "kind", F.col("a").alias("banner"), F.col("b").alias("stub"), "test", "comparisons", "significant", F.when(F.col("kind") == "categorical_crosstab", F.regexp_extract("caption", r"^\d+ of \d+", 0)).alias("caption"), "b_.label", "b_.series", "b_.value", "b_.n")


def _plan(spark, sf_dir):
    return P.banner_plan(_orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus", "o_totalprice"], ["o_orderstatus", "o_totalprice", "o_orderpriority"], "o_orderkey", {"o_totalprice"})


QUERIES = {
    "crosstab_orders": lambda s, d: T.crosstab(_orders(s, d), "o_orderpriority", "o_orderstatus", "o_orderkey").select("banner", "stub", "n", "base", "pct"),
    "category_order_brands": lambda s, d: T.first_categories(_t(s, d, "part"), "p_brand", "p_partkey").select("category", "ord", "n"),
    "group_summary_orders": lambda s, d: T.group_table(_orders(s, d), "o_orderpriority", "o_totalprice", "o_orderkey"),
    "proportion_pairs_orders": lambda s, d: T.proportion_pairs(_orders(s, d), "o_orderpriority", "o_orderstatus", "o_orderkey"),
    "mean_pairs_orders": lambda s, d: T.mean_pairs(_orders(s, d), "o_orderpriority", "o_totalprice", "o_orderkey"),
    "anova_orders": lambda s, d: T.anova(_orders(s, d), "o_orderpriority", "o_totalprice", "o_orderkey"),
    "anova_f_customers": lambda s, d: T.anova(_t(s, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey").select("k", "n", "f_stat"),
    "banner_plan_orders": lambda s, d: _plan(s, d).select("banner_column", "stub_column", "place", "test", "stub", "cat_a", "cat_b", "n_a", "n_b", "gap", "statistic", "significant", "description", F.array_join("caveats", ",").alias("caveats")),
    "banner_plan_captions": lambda s, d: P.crosstab_caption(_plan(s, d)),
    "table_patterns": lambda s, d: _patterns(s, d).select("pattern", "pattern_type", "theme", "description"),
    "pattern_digest": lambda s, d: P.digest(_patterns(s, d)),
    "pattern_findings": lambda s, d: P.pattern_findings(_patterns(s, d), F.lit(7), F.lit(1), F.col("pattern_type")).select("origin", "pattern_type", "theme", "finding_text", "status", "source_cells"),
    "pattern_rows": lambda s, d: P.pattern_rows(_aggregated(s, d), _patterns(s, d), "s_suppkey"),
    "pattern_points": lambda s, d: T.relationship_points(_gappy(s, d), T.relationships(_gappy(s, d), ["o_totalprice", "adjusted", "square"]), "o_orderkey").select("col_a", "col_b", F.posexplode("points").alias("place", "p")).select("col_a", "col_b", "place", "p.x", "p.y"),
    "plan_charts": lambda s, d: _charts(s, d),
    "scatter_caption": lambda s, d: P.scatter_caption(T.relationships(_lines(s, d), [*LINE_VALUES, "l_net"])),
    "crosstab_preview": lambda s, d: T.crosstab_preview(_orders(s, d), ["o_orderpriority", "o_orderstatus", "o_totalprice"], ["o_orderstatus", "o_totalprice"], "o_orderkey", {"o_totalprice"}).drop("p_value"),
    "table_digest": lambda s, d: T.table_digest(_t(s, d, "part"), ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "worst_variables": lambda s, d: T.worst_variables(T.variable_quality(tables(s, d, "files")[0], FILE_COLUMNS), FILE_COLUMNS),
    "best_split_category": lambda s, d: T.best_split(_priced(s, d), "o_orderstatus", "adjusted"),
    "segment_differences_orders": lambda s, d: T.segment_differences(_priced(s, d), ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "adjusted"], "o_orderkey").drop("i", "j"),
    "relationships_lineitem": lambda s, d: T.relationships(_lines(s, d), [*LINE_VALUES, "l_net"]),
    "outliers_orders": lambda s, d: T.outliers(_orders(s, d).withColumn("square", F.col("o_totalprice") * F.col("o_totalprice") / 1e6), "square", "o_orderkey"),
    "base_sizes_customers": base_sizes,
    "design_effect_lineitem": lambda s, d: _t(s, d, "lineitem").groupBy("l_returnflag").agg(stats.design_effect(F.col("l_quantity")).alias("deff")),
    "best_split_lineitem": lambda s, d: T.best_split(_lines(s, d), "l_discount", "l_net"),
    "variable_quality_orders": lambda s, d: T.variable_quality(_orders(s, d), ORDER_COLUMNS).select("variable", "cases", "missing", "distinct_values", "constant", "unlabelled", "missing_pct", "kind", "status"),
    "duplicate_cases_documents": lambda s, d: T.duplicate_cases(_t(s, d, "documents"), ["text", "lang"]),
    "table_quality_orders": lambda s, d: T.table_quality(_orders(s, d), ORDER_COLUMNS),
    "numeric_digest_events": lambda s, d: T.numeric_digest(_t(s, d, "events"), "value"),
    "histogram_lineitem": lambda s, d: T.histogram(_t(s, d, "lineitem"), "l_extendedprice"),
    "category_digest_brands": lambda s, d: T.category_digest(_t(s, d, "part"), "p_brand", "p_partkey"),
    "even_sample_orders": lambda s, d: T.even_sample(_orders(s, d).select("o_orderkey", "o_totalprice"), T.POINTS, "o_orderkey"),
    "chart_crosstab_orders": lambda s, d: K.crosstab_chart(_orders(s, d), "o_orderpriority", "o_orderstatus", "o_orderkey"),
    "chart_means_orders": lambda s, d: K.means_chart(_orders(s, d), "o_orderpriority", "o_totalprice", "o_orderkey"),
    "chart_scatter_line_part": lambda s, d: K.scatter_line(_t(s, d, "part"), "p_partkey", "p_retailprice"),
    "chart_outliers_events": lambda s, d: K.outlier_strip(_t(s, d, "events"), "value", "event_id"),
    "fitted_line_lineitem": lambda s, d: _t(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), jround(F.regr_slope("l_extendedprice", "l_quantity"), 2).alias("slope"), jround(F.regr_intercept("l_extendedprice", "l_quantity"), 1).alias("intercept")),
}

_R = "floor(({x}) * {s} + 0.5) / {s}"


def _r(x: str, digits: int) -> str:
    """The same rounding in SQL: half up."""
    return _R.format(x=x, s=f"{float(10**digits)}::DOUBLE")


def _top(table: str, column: str, key: str, cap: int = 10) -> str:
    return f"SELECT {column} AS category, row_number() OVER (ORDER BY min({key})) AS ord FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT {cap}"


_CELLS = f"""b AS ({_top("orders", "o_orderpriority", "o_orderkey")}), s AS ({_top("orders", "o_orderstatus", "o_orderkey")}),
base AS (SELECT o_orderpriority AS banner, count(*) AS base FROM orders GROUP BY 1),
cells AS (SELECT b.category AS banner, b.ord, s.category AS stub, base.base, (SELECT count(*) FROM orders WHERE o_orderpriority = b.category AND o_orderstatus = s.category) AS n
  FROM b CROSS JOIN s JOIN base ON base.banner = b.category)"""
_GROUPS = f"""b AS ({_top("orders", "o_orderpriority", "o_orderkey")}),
g AS (SELECT o_orderpriority AS banner, ord, count(o_totalprice) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS var FROM orders JOIN b ON category = o_orderpriority GROUP BY 1, 2)"""


def _anova(table: str, banner: str, value: str, key: str) -> str:
    return f"""WITH b AS ({_top(table, banner, key)}),
g AS (SELECT {banner} AS banner, count({value}) AS n, avg({value}) AS mean, var_samp({value}) AS var FROM {table} JOIN b ON category = {banner} GROUP BY 1 HAVING count({value}) >= 2),
t AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * mean) AS s, sum(n * mean * mean) AS ss, sum((n - 1) * var) AS w FROM g)
SELECT k, n, {_r("((ss - s * s / n) / (k - 1)) / (w / (n - k))", 2)} AS f_stat FROM t"""


def _quality_row(column: str, table: str = "orders") -> str:
    text = f"CASE WHEN {column} = floor({column}) THEN ({column}::BIGINT)::VARCHAR ELSE {column}::VARCHAR END" if column == "o_totalprice" else f"{column}::VARCHAR"
    return f"SELECT '{column}' AS variable, {text} AS v FROM {table}"


def _variables(columns: list[str], table: str) -> str:
    return f"""cells AS ({" UNION ALL ".join(_quality_row(c, table) for c in columns)}),
flags AS (SELECT variable, v, v IS NULL OR lower(trim(v)) IN ('', 'na', 'n/a', 'nan', 'null', '#n/a', '.') AS gone FROM cells),
v AS (SELECT variable, count(*) AS cases, count(*) FILTER (gone) AS missing, count(DISTINCT v) FILTER (NOT gone) AS distinct_values, count(try_cast(v AS DOUBLE)) FILTER (NOT gone) AS numbers, count(DISTINCT try_cast(v AS DOUBLE)) FILTER (NOT gone) AS dn,
  count(*) FILTER (NOT gone AND try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))) AS whole FROM flags GROUP BY 1),
q AS (SELECT variable, cases, missing, distinct_values, cases > 1 AND distinct_values <= 1 AS constant, variable = '' OR regexp_matches(lower(variable), '^(var|v|q|col|column|field|x)[\\s_]*[0-9]+$') AS unlabelled, {_r("missing * 100.0::DOUBLE / cases", 1)} AS missing_pct,
  CASE WHEN cases = missing OR numbers < (cases - missing) * 0.9 OR dn <= 2 THEN 'categorical' WHEN whole = numbers AND dn <= 10 THEN 'discrete' ELSE 'continuous' END AS kind FROM v),
vq AS (SELECT *, CASE WHEN missing_pct > 50 THEN 'fail' WHEN missing_pct > 20 THEN 'warn' ELSE 'pass' END AS status FROM q)"""


_VARIABLES = _variables(ORDER_COLUMNS, "orders")


def _num(x: str) -> str:
    """A rounded number as text."""
    return f"CASE WHEN ({x}) = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END"


def _tail(f: str, d1: int, d2: str) -> str:
    """P(F >= f) for even d1: a finite sum."""
    x = f"({d2} / ({d2} + {d1} * {f}))"
    terms = {2: "1", 4: f"1 + {d2} / 2.0 * (1 - {x})"}
    return f"pow({x}, {d2} / 2.0) * ({terms[d1]})"


def _groups(banner: str) -> str:
    return f"""b AS ({_top("orders", banner, "o_orderkey")}),
g AS (SELECT {banner} AS banner, ord, count(o_totalprice) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS var FROM orders JOIN b ON category = {banner} GROUP BY 1, 2),
t0 AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * mean) AS s, sum(n * mean * mean) AS ss, sum((n - 1) * var) AS w FROM g WHERE n >= 2), t1 AS (SELECT *, ((ss - s * s / n) / (k - 1)) / (w / (n - k)) AS f FROM t0)"""


def _one_way(banner: str, d1: int) -> str:
    return f"{_groups(banner)}, t AS (SELECT k, n, {_r('f', 2)} AS f_stat, {_r(_tail('f', d1, '(n - k)'), 3)} AS p_value, {_tail('f', d1, '(n - k)')} < 0.05 AS significant FROM t1)"


def _plan_means(banner: str, d1: int) -> str:
    m = lambda c: _num(_r(c, 2))
    return f"""SELECT * FROM (WITH {_one_way(banner, d1)}, l AS (SELECT string_agg(banner || ' ' || {m("mean")} || ' (n=' || n || ')', ', ' ORDER BY {_r("mean", 2)} DESC, ord) AS listing, first(banner ORDER BY {_r("mean", 2)} DESC, ord) AS hi, first(banner ORDER BY {_r("mean", 2)}, ord DESC) AS lo, max({_r("mean", 2)}) AS himean, min({_r("mean", 2)}) AS lomean, count(*) AS k FROM g WHERE n >= 2),
p AS (SELECT a.banner AS cat_a, c.banner AS cat_b, a.ord * 100 + c.ord AS place, a.n AS n_a, c.n AS n_b, {_r("a.mean", 2)} AS m1, {_r("c.mean", 2)} AS m2, {_r("a.mean - c.mean", 2)} AS gap, (a.mean - c.mean) / sqrt(a.var / a.n + c.var / c.n) AS tt FROM g a JOIN g c ON a.ord < c.ord)
SELECT '{banner}' AS banner_column, 'o_totalprice' AS stub_column, 0::BIGINT AS place, 'anova' AS test, NULL AS stub, NULL AS cat_a, NULL AS cat_b, n AS n_a, NULL::BIGINT AS n_b, NULL::DOUBLE AS gap, f_stat AS statistic, significant, CASE WHEN significant THEN 'o_totalprice differs by {banner}: highest for "' || hi || '" at ' || {_num("himean")} || ', lowest for "' || lo || '" at ' || {_num("lomean")} || ' (full breakdown: ' || listing || ')' || st || ', a statistically significant spread across all ' || l.k || ' groups (one-way ANOVA).'
  ELSE 'o_totalprice looks broadly similar across {banner} groups: ' || listing || st || ', no statistically significant difference overall (one-way ANOVA).' END AS description, CASE WHEN significant THEN 'sampling_assumed_random' ELSE 'not_significant,sampling_assumed_random' END AS caveats
FROM (SELECT *, ' (F=' || {_num("f_stat")} || ', ' || CASE WHEN p_value < 0.001 THEN 'p<0.001' ELSE 'p=' || {_num("p_value")} END || ')' AS st FROM t) t, l
UNION ALL SELECT '{banner}', 'o_totalprice', place, 'means', NULL, cat_a, cat_b, n_a, n_b, gap, {_r("tt", 2)}, abs(tt) >= 1.96, CASE WHEN gap = 0 THEN '{banner} "' || cat_a || '" and "' || cat_b || '" average the same on o_totalprice (' || {_num("m1")} || ', n=' || n_a || ' vs ' || n_b || '), no gap at all (t=' || {_num(_r("tt", 2))} || ').'
  ELSE '{banner} "' || cat_a || '" averages ' || CASE WHEN gap > 0 THEN 'higher' ELSE 'lower' END || ' on o_totalprice than "' || cat_b || '" (' || {_num("m1")} || ' vs ' || {_num("m2")} || ', n=' || n_a || ' vs ' || n_b || '): ' || CASE WHEN abs(tt) >= 1.96 THEN 'a statistically significant gap of ' || {_num("abs(gap)")} || ' (t=' || {_num(_r("tt", 2))} || ')' ELSE 'not a statistically significant difference (gap of ' || {_num("abs(gap)")} || ', t=' || {_num(_r("tt", 2))} || ')' END || '.' END || ' Post-hoc comparison, following a significant overall difference across all groups.',
  CASE WHEN abs(tt) >= 1.96 THEN '' ELSE 'not_significant,' END || 'uncorrected_multiple_comparisons,sampling_assumed_random,post_hoc_after_significant_anova' FROM p WHERE (SELECT significant FROM t)) m"""


def _plan_shares(banner: str, stub: str) -> str:
    return f"""SELECT * FROM (WITH b AS ({_top("orders", banner, "o_orderkey")}), s AS ({_top("orders", stub, "o_orderkey")}), base AS (SELECT {banner} AS banner, count(*) AS base FROM orders GROUP BY 1),
c AS (SELECT b.category AS banner, b.ord, s.category AS stub, s.ord AS so, base.base, (SELECT count(*) FROM orders WHERE {banner} = b.category AND {stub} = s.category) AS n FROM b CROSS JOIN s JOIN base ON base.banner = b.category),
p AS (SELECT a.stub, a.banner AS cat_a, d.banner AS cat_b, a.ord * 10000 + d.ord * 100 + a.so AS place, a.base AS n_a, d.base AS n_b, {_r("a.n * 100.0::DOUBLE / a.base", 1)} AS pa, {_r("d.n * 100.0::DOUBLE / d.base", 1)} AS pb, a.n::DOUBLE / a.base AS p1, d.n::DOUBLE / d.base AS p2, (a.n + d.n)::DOUBLE / (a.base + d.base) AS pp FROM c a JOIN c d ON a.stub = d.stub AND a.ord < d.ord),
z AS (SELECT *, {_r("(p1 - p2) * 100", 1)} AS gap, CASE WHEN pp * (1 - pp) > 0 THEN (p1 - p2) / sqrt(pp * (1 - pp) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)) END AS zz FROM p), y AS (SELECT *, coalesce(abs(zz) >= 1.96, false) AS sig, coalesce('z=' || {_num(_r("zz", 2))}, 'z n/a') AS zt, '(' || {_num("pa")} || '% vs ' || {_num("pb")} || '%, n=' || n_a || ' vs ' || n_b || ')' AS fig FROM z)
SELECT '{banner}' AS banner_column, '{stub}' AS stub_column, place, 'proportions' AS test, stub, cat_a, cat_b, n_a, n_b, gap, {_r("zz", 2)} AS statistic, sig AS significant, CASE WHEN gap = 0 THEN '{banner} "' || cat_a || '" and "' || cat_b || '" are equally likely to fall into {stub}="' || stub || '" ' || fig || ', no gap at all (' || zt || ').'
  ELSE '{banner} "' || cat_a || '" is ' || CASE WHEN gap > 0 THEN 'more' ELSE 'less' END || ' likely than "' || cat_b || '" to fall into {stub}="' || stub || '" ' || fig || ': ' || CASE WHEN sig THEN 'a statistically significant ' || {_num("abs(gap)")} || '-point gap (' || zt || ')' ELSE 'not a statistically significant difference (' || {_num("abs(gap)")} || '-point gap, ' || zt || ')' END || '.' END AS description, CASE WHEN sig THEN '' ELSE 'not_significant,' END || 'uncorrected_multiple_comparisons,sampling_assumed_random' AS caveats FROM y) m"""


_PLAN_SQL = " UNION ALL ".join([_plan_shares("o_orderpriority", "o_orderstatus"), _plan_means("o_orderpriority", 4), _plan_means("o_orderstatus", 2), _plan_shares("o_orderstatus", "o_orderpriority")])
_LINES = "lines AS (SELECT *, l_extendedprice * (1 - 4 * l_discount) AS l_net FROM lineitem)"
_PRICED = "priced AS (SELECT *, o_totalprice + CASE o_orderstatus WHEN 'O' THEN 40000.0::DOUBLE WHEN 'P' THEN 80000.0::DOUBLE ELSE 0.0::DOUBLE END AS adjusted FROM orders)"


_AGGREGATED = "agg AS (SELECT s_suppkey, CASE WHEN s_acctbal > 4500 THEN 'high' ELSE 'low' END AS half, s_acctbal, s_acctbal * 2 + s_suppkey % 7 AS twice, pow(s_acctbal / 1000, 4.0::DOUBLE) AS far FROM supplier)"
_AGG_VALUES = ("s_acctbal", "twice", "far")


def _patterns_sql() -> str:
    """Differences by value column, relationships by pair, outliers by column and row, the first 25; and the rows behind them."""
    parts, rest = [], []
    for j, v in enumerate(_AGG_VALUES):
        g = f"(SELECT half, count({v}) AS n, avg({v}) AS m, var_samp({v}) AS var, row_number() OVER (ORDER BY count({v}) DESC, min(s_suppkey)) AS k FROM agg GROUP BY half HAVING count({v}) >= 5)"
        t = "(a.m - b.m) / sqrt(a.var / a.n + b.var / b.n)"
        said = f"""'half "' || a.half || '" averages ' || {_num(_r("a.m", 2))} || ' on {v} (n=' || a.n || '), versus ' || {_num(_r("b.m", 2))} || ' for "' || b.half || '" (n=' || b.n || '): a gap of ' || {_num(_r("a.m - b.m", 2))} || ' (t=' || {_num(_r(t, 2))} || ').'"""
        parts.append(f"SELECT 0 AS o1, 0 AS o2, {j}::BIGINT AS o3, 'segment_difference' AS pattern_type, 'half & {v}' AS theme, {said} AS description, NULL::BIGINT AS row, a.half AS cat_a, b.half AS cat_b, '{v}' AS v FROM {g} a JOIN {g} b ON a.k = 1 AND b.k = 2 WHERE abs({t}) >= 1.96")
    for i, a in enumerate(_AGG_VALUES):
        for j, b in list(enumerate(_AGG_VALUES))[i + 1 :]:
            r = _r(f"corr({a}::DOUBLE, {b}::DOUBLE)", 2)
            parts.append(f"SELECT 1, {i + 1}, {j + 1}, 'relationship', '{a} & {b}', '{a} and {b} move together across ' || count(*) || ' rows (r=' || {_num(r)} || '). Descriptive association only, not evidence of causation.', NULL, NULL, NULL, NULL FROM agg HAVING abs({r}) >= 0.3")
    for i, v in enumerate(_AGG_VALUES):
        rest.append(f"""c{i} AS (SELECT s_suppkey AS row, {v}::DOUBLE AS v, {v} - avg({v}) OVER () AS c FROM agg), s{i} AS (SELECT count(*) AS n, sum(c) AS s, sum(c * c) AS ss FROM c{i}),
z{i} AS (SELECT row, v, (c - (s - c) / (n - 1)) / sqrt((ss - c * c) / (n - 1) - ((s - c) / (n - 1)) * ((s - c) / (n - 1))) AS z FROM c{i} CROSS JOIN s{i})""")
        parts.append(f"SELECT 2, {i}, row, 'outlier', '{v}', '{v} value of ' || {_num('v')} || ' at row ' || row || ' (z=' || {_num(_r('z', 1))} || ').', row, NULL, NULL, NULL FROM z{i} WHERE abs(z) >= 2")
    return f"{_AGGREGATED}, {', '.join(rest)}, patterns AS (SELECT row_number() OVER (ORDER BY o1, o2, o3)::INTEGER AS pattern, * FROM ({' UNION ALL '.join(parts)}) x QUALIFY row_number() OVER (ORDER BY o1, o2, o3) <= 25)"


_PATTERNS_SQL = _patterns_sql()


def _points_sql() -> str:
    """300 points, evenly spaced in row order, of each pair of columns that move together."""
    values = ["o_totalprice", "adjusted", "square"]
    gappy = "gappy AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN adjusted END AS adjusted, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * o_totalprice / 1e6 END AS square FROM priced)"
    parts = [
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, i::INTEGER AS place, {a} AS x, {b} AS y FROM (SELECT {a}, {b}, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n, {_r(f'corr({a}, {b}) OVER ()', 2)} AS r FROM gappy WHERE {a} IS NOT NULL AND {b} IS NOT NULL) c
JOIN range(300) t(i) ON CASE WHEN n > 300 THEN k = floor(i * (n / 300.0::DOUBLE)) ELSE k = i END WHERE abs(r) >= 0.3"""
        for i, a in enumerate(values)
        for b in values[i + 1 :]
    ]
    return f"WITH {_PRICED}, {gappy} {' UNION ALL '.join(parts)}"


def _charts_sql() -> str:
    """Bars of the banner plan: shares as in the crosstab, groups of the tests of variance and pairs of means."""
    parts = []
    for banner, stub in (("o_orderpriority", "o_orderstatus"), ("o_orderstatus", "o_orderpriority")):
        parts.append(f"""SELECT theme, 'categorical_crosstab' AS kind, '{banner}' AS banner, '{stub}' AS stub, NULL AS test, comparisons, significant, significant || ' of ' || comparisons AS caption, label, series, value, NULL::DOUBLE AS n
FROM (SELECT '{banner} & {stub}' AS theme, count(*) AS comparisons, count(*) FILTER (significant) AS significant FROM plan WHERE banner_column = '{banner}' AND stub_column = '{stub}') c CROSS JOIN (SELECT s.v AS label, b.v AS series, {_r(f"(SELECT count(*) FROM orders WHERE {banner} = b.v AND {stub} = s.v) * 100.0::DOUBLE / (SELECT count(*) FROM orders WHERE {banner} = b.v)", 1)} AS value FROM (SELECT DISTINCT {banner} AS v FROM orders) b CROSS JOIN (SELECT DISTINCT {stub} AS v FROM orders) s) x""")
    for banner in ("o_orderpriority", "o_orderstatus"):
        own = f"FROM plan WHERE banner_column = '{banner}' AND stub_column = 'o_totalprice'"
        parts.append(f"""SELECT '{banner} & o_totalprice', 'group_means', '{banner}', 'o_totalprice', 'anova', (SELECT count(*) {own}), (SELECT count(*) FILTER (significant AND test = 'means') {own}), NULL, {banner}, NULL, {_r("avg(o_totalprice)", 2)}, count(o_totalprice)::DOUBLE FROM orders GROUP BY {banner}""")
    return f"WITH plan AS ({_PLAN_SQL}) {' UNION ALL '.join(parts)}"


def _split(groups: str, label: str, place: str) -> str:
    return f"""{groups}, f AS (SELECT *, s1 / n1 - s2 / n2 AS gap, sqrt(v1 / n1 + v2 / n2) AS se FROM c WHERE n1 >= 5 AND n2 >= 5), r AS (SELECT *, {_r("gap / se", 2)} AS t FROM f WHERE se > 0)
SELECT {label} AS label, n1 AS n_1, n2 AS n_2, {_r("s1 / n1", 2)} AS mean_1, {_r("s2 / n2", 2)} AS mean_2, {_r("gap", 2)} AS gap, t FROM r WHERE abs(t) >= 1.96 ORDER BY abs(t) DESC, {place} LIMIT 1"""


ORACLE_SQL = {
    "crosstab_orders": f"WITH {_CELLS} SELECT banner, stub, n, base, {_r('n * 100.0::DOUBLE / base', 1)} AS pct FROM cells",
    "category_order_brands": "SELECT p_brand AS category, (row_number() OVER (ORDER BY min(p_partkey)))::INTEGER AS ord, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 10",
    "group_summary_orders": f"WITH {_GROUPS} SELECT banner, n, {_r('mean', 2)} AS mean, {_r('sqrt(var)', 2)} AS sd FROM g",
    "proportion_pairs_orders": f"""WITH {_CELLS},
p AS (SELECT a.stub, a.banner AS cat_a, c.banner AS cat_b, a.base AS n_a, c.base AS n_b, a.n::DOUBLE / a.base AS p1, c.n::DOUBLE / c.base AS p2, (a.n + c.n)::DOUBLE / (a.base + c.base) AS pp
  FROM cells a JOIN cells c ON a.stub = c.stub AND a.ord < c.ord),
z AS (SELECT *, CASE WHEN pp * (1 - pp) > 0 THEN (p1 - p2) / sqrt(pp * (1 - pp) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)) END AS zz FROM p)
SELECT stub, cat_a, cat_b, n_a, n_b, {_r("(p1 - p2) * 100", 1)} AS gap_points, {_r("zz", 2)} AS z, coalesce(abs(zz) >= 1.96, false) AS significant FROM z""",
    "mean_pairs_orders": f"""WITH {_GROUPS}, p AS (SELECT a.banner AS cat_a, c.banner AS cat_b, a.n AS n_a, c.n AS n_b, a.mean AS m1, c.mean AS m2, (a.mean - c.mean) / sqrt(a.var / a.n + c.var / c.n) AS tt FROM g a JOIN g c ON a.ord < c.ord)
SELECT cat_a, cat_b, n_a, n_b, {_r("m1", 2)} AS mean_a, {_r("m2", 2)} AS mean_b, {_r("m1 - m2", 2)} AS gap, {_r("tt", 2)} AS t, abs(tt) >= 1.96 AS significant FROM p""",
    "anova_f_customers": _anova("customer", "c_mktsegment", "c_acctbal", "c_custkey"),
    "segment_differences_orders": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_PRICED}, g AS (SELECT {c} AS banner, count({v}) AS n, avg({v}) AS mean, var_samp({v}) AS var, min(o_orderkey) AS f FROM priced WHERE {c} IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS k FROM g WHERE n >= 5)
SELECT '{c}' AS category_column, '{v}' AS value_column, a.banner AS cat_a, b.banner AS cat_b, a.n AS n_a, b.n AS n_b, {_r("a.mean", 2)} AS mean_a, {_r("b.mean", 2)} AS mean_b, {_r("a.mean - b.mean", 2)} AS gap, {_r("(a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n)", 2)} AS t
FROM r a JOIN r b ON a.k = 1 AND b.k = 2 WHERE abs((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n)) >= 1.96)"""
        for c in ("o_orderpriority", "o_orderstatus")
        for v in ("o_totalprice", "adjusted")
    ),
    "relationships_lineitem": " UNION ALL ".join(
        f"SELECT * FROM (WITH {_LINES} SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, {_r(f'corr({a}::DOUBLE, {b}::DOUBLE)', 2)} AS r FROM lines WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WHERE abs(r) >= 0.3"
        for i, a in enumerate([*LINE_VALUES, "l_net"])
        for b in [*LINE_VALUES, "l_net"][i + 1 :]
    ),
    "table_patterns": f"WITH {_PATTERNS_SQL} SELECT pattern, pattern_type, theme, description FROM patterns",
    "pattern_digest": f"WITH {_PATTERNS_SQL} SELECT string_agg('- ' || description, chr(10) ORDER BY pattern) AS digest FROM patterns WHERE pattern <= 8",
    "pattern_findings": f"WITH {_PATTERNS_SQL} SELECT 'generated' AS origin, pattern_type, theme, description AS finding_text, 'accepted' AS status, CASE WHEN row IS NOT NULL THEN '{{\"rowIndices\":[' || row || ']}}' END AS source_cells FROM patterns",
    "pattern_rows": f"WITH {_PATTERNS_SQL} SELECT pattern, CASE WHEN half = cat_a THEN 1 ELSE 2 END AS side, s_suppkey AS row FROM patterns JOIN agg ON half IN (cat_a, cat_b) WHERE pattern_type = 'segment_difference' UNION ALL SELECT pattern, 1, row FROM patterns WHERE pattern_type = 'outlier'",
    "pattern_points": _points_sql(),
    "plan_charts": _charts_sql(),
    "outliers_orders": f"""WITH m AS (SELECT o_orderkey AS row, o_totalprice * o_totalprice / 1e6 AS v, o_totalprice * o_totalprice / 1e6 - avg(o_totalprice * o_totalprice / 1e6) OVER () AS c FROM orders WHERE o_totalprice IS NOT NULL),
s AS (SELECT count(*) AS n, sum(c) AS s, sum(c * c) AS ss FROM m),
z AS (SELECT row, v, (c - (s - c) / (n - 1)) / sqrt((ss - c * c) / (n - 1) - ((s - c) / (n - 1)) * ((s - c) / (n - 1))) AS z FROM m CROSS JOIN s)
SELECT row, v, {_r("z", 1)} AS z FROM z WHERE abs(z) >= 2""",
    "base_sizes_customers": f"""WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS p FROM orders GROUP BY 1)
SELECT o_custkey, n, CASE WHEN n < 30 THEN 'base_size_small' WHEN n < 50 THEN 'base_size_borderline' END AS tag, {_r("1.96::DOUBLE * sqrt(p * (1 - p) / n) * 100", 1)} AS margin FROM g""",
    "design_effect_lineitem": f"SELECT l_returnflag, {_r('1 + pow(stddev_pop(l_quantity) / avg(l_quantity), 2.0::DOUBLE)', 2)} AS deff FROM lineitem GROUP BY 1",
    "variable_quality_orders": f"WITH {_VARIABLES} SELECT variable, cases, missing, distinct_values, constant, unlabelled, missing_pct, kind, status FROM vq",
    "duplicate_cases_documents": "SELECT count(*) AS cases, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS distinct_cases, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents",
    "table_quality_orders": f"""WITH {_VARIABLES}, t AS (SELECT max(cases) AS cases, sum(missing) * 100.0::DOUBLE / sum(cases) AS pct, count(*) FILTER (constant) AS constant, count(*) FILTER (unlabelled) AS unlabelled, count(*) FILTER (status <> 'pass') AS gappy, count(*) FILTER (status = 'fail') AS bad,
  (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(ORDER_COLUMNS)} FROM orders)) FROM orders) AS dup FROM vq)
SELECT 'sample_size' AS "check", cases::DOUBLE AS value, CASE WHEN cases < 30 THEN 'fail' WHEN cases < 100 THEN 'warn' ELSE 'pass' END AS status FROM t
UNION ALL SELECT 'missing_overall', {_r("pct", 1)}, CASE WHEN {_r("pct", 1)} > 20 THEN 'fail' WHEN {_r("pct", 1)} > 5 THEN 'warn' ELSE 'pass' END FROM t
UNION ALL SELECT 'missing_by_variable', gappy::DOUBLE, CASE WHEN bad > 0 THEN 'fail' WHEN gappy > 0 THEN 'warn' ELSE 'pass' END FROM t
UNION ALL SELECT 'constant', constant::DOUBLE, CASE WHEN constant > 0 THEN 'warn' ELSE 'pass' END FROM t
UNION ALL SELECT 'labels', unlabelled::DOUBLE, CASE WHEN unlabelled > 0 THEN 'warn' ELSE 'pass' END FROM t
UNION ALL SELECT 'duplicates', dup::DOUBLE, CASE WHEN dup > 0 THEN 'warn' ELSE 'pass' END FROM t""",
    "worst_variables": oracle(f"""WITH {_variables(FILE_COLUMNS, "files")}, c AS (SELECT variable, missing_pct, row_number() OVER (ORDER BY missing_pct DESC, list_position({FILE_COLUMNS}, variable)) AS place FROM vq WHERE missing > 0 OR constant OR unlabelled) SELECT place::INTEGER AS place, variable, missing_pct FROM c WHERE place <= 8""", "files"),
    "anova_orders": f"WITH {_one_way('o_orderpriority', 4)} SELECT * FROM t",
    "banner_plan_orders": _PLAN_SQL,
    "banner_plan_captions": f"""WITH plan AS ({_PLAN_SQL}), p AS (SELECT *, banner_column || ' & ' || stub_column AS theme FROM plan WHERE test = 'proportions'), w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY theme ORDER BY abs(gap) DESC, place) = 1), n AS (SELECT theme, count(*) AS comparisons, count(*) FILTER (significant) AS significant FROM p GROUP BY 1)
SELECT theme, comparisons, n.significant, n.significant || ' of ' || comparisons || ' comparisons statistically significant. Largest gap: ' || banner_column || ' "' || cat_a || '" vs "' || cat_b || '" on ' || stub_column || '="' || stub || '" (' || {_num("abs(gap)")} || ' points' || coalesce(', z=' || {_num("statistic")}, '') || ').' AS caption FROM n JOIN w USING (theme)""",
    "scatter_caption": f"""WITH {_LINES}, r AS ({" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, {_r(f'corr({a}, {b})', 2)} AS r FROM lines" for i, a in enumerate([*LINE_VALUES, "l_net"]) for b in [*LINE_VALUES, "l_net"][i + 1 :])}), m AS (SELECT * FROM r ORDER BY abs(r) DESC, col_a, col_b LIMIT 1)
SELECT col_a, col_b, r, CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate' ELSE 'Weak' END || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END || ' association between ' || col_a || ' and ' || col_b || ' across ' || n || ' rows (r=' || {_num("r")} || '). Descriptive association only, not evidence of causation.' AS caption FROM m""",
    "crosstab_preview": " UNION ALL ".join(f"SELECT * FROM (WITH {_one_way(b, d) if d else 't AS (SELECT NULL::DOUBLE AS f_stat, NULL::BOOLEAN AS significant)'} SELECT '{b}' AS banner_column, '{s}' AS stub_column, '{'numeric' if d else 'categorical'}' AS kind, least(10, (SELECT count(DISTINCT {b}) FROM orders))::INTEGER AS categories, (SELECT count(DISTINCT {b}) FROM orders) > 10 AS banner_truncated, false AS stub_truncated, {'true' if b == 'o_totalprice' else 'false'} AS banner_is_continuous, f_stat, significant FROM t) x" for b, s, d in (("o_orderpriority", "o_orderstatus", 0), ("o_orderpriority", "o_totalprice", 4), ("o_orderstatus", "o_totalprice", 2), ("o_totalprice", "o_orderstatus", 0))),
    "table_digest": " UNION ALL ".join(f"SELECT {i}::INTEGER AS place, '{c}' AS \"column\", CASE WHEN count({c}) < 3 OR ({n == 0} AND count(DISTINCT {c}) > 10) THEN 'skipped' ELSE '{'numeric' if n else 'categorical'}' END AS kind, CASE WHEN count({c}) < 3 THEN 'no_usable_values' WHEN {n == 0} AND count(DISTINCT {c}) > 10 THEN 'too_many_distinct_values' END AS reason, count({c}) AS n, count(DISTINCT {c}) AS distinct_values FROM part" for i, (c, n) in enumerate((("p_name", 0), ("p_brand", 0), ("p_type", 0), ("p_size", 1), ("p_retailprice", 1)))),
    "best_split_lineitem": _split(f"""WITH {_LINES}, e AS (SELECT l_discount AS x, count(*) AS n, sum(l_net) AS s, sum(l_net * l_net) AS ss FROM lines GROUP BY 1), w AS (SELECT x, lead(x) OVER o AS y, (sum(n) OVER o)::BIGINT AS n1, sum(s) OVER o AS s1, sum(ss) OVER o AS ss1, (sum(n) OVER ())::BIGINT AS tn, sum(s) OVER () AS ts, sum(ss) OVER () AS tss FROM e WINDOW o AS (ORDER BY x)),
c AS (SELECT (x + y) / 2 AS place, n1, tn - n1 AS n2, s1, ts - s1 AS s2, (ss1 - s1 * s1 / n1) / (n1 - 1) AS v1, ((tss - ss1) - (ts - s1) * (ts - s1) / (tn - n1)) / (tn - n1 - 1) AS v2 FROM w WHERE y IS NOT NULL)""", f"'l_discount < ' || {_num(_r('place', 2))}", "place"),
    "best_split_category": _split(f"""WITH {_PRICED}, e AS (SELECT o_orderstatus AS place, count(*) AS n1, sum(adjusted) AS s1, sum(adjusted * adjusted) AS ss1, (sum(count(*)) OVER ())::BIGINT AS tn, sum(sum(adjusted)) OVER () AS ts, sum(sum(adjusted * adjusted)) OVER () AS tss FROM priced GROUP BY 1),
c AS (SELECT place, n1, tn - n1 AS n2, s1, ts - s1 AS s2, (ss1 - s1 * s1 / n1) / (n1 - 1) AS v1, ((tss - ss1) - (ts - s1) * (ts - s1) / (tn - n1)) / (tn - n1 - 1) AS v2 FROM e)""", "'o_orderstatus = \"' || place || '\"'", "place"),
    "numeric_digest_events": f"SELECT count(value) AS n, {_r('avg(value)', 2)} AS mean, {_r("quantile_cont(value::DOUBLE, 0.5)", 2)} AS median, min(value::DOUBLE) AS min, max(value::DOUBLE) AS max FROM events",
    "histogram_lineitem": f"""WITH s AS (SELECT count(l_extendedprice) AS c, min(l_extendedprice::DOUBLE) AS lo, max(l_extendedprice::DOUBLE) AS hi FROM lineitem),
k AS (SELECT *, least(10, greatest(3, floor(sqrt(c) + 0.5)::INTEGER)) AS bins FROM s), w AS (SELECT *, (hi - lo) / bins AS width, unnest(range(0, bins)) AS bin FROM k),
p AS (SELECT least(bins - 1, floor((l_extendedprice - lo) / ((hi - lo) / bins))::INTEGER) AS bin, count(*) AS n FROM lineitem CROSS JOIN k WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT w.bin::INTEGER AS bin, {_r("lo + w.bin * width", 2)} AS low, {_r("lo + (w.bin + 1) * width", 2)} AS high, coalesce(n, 0) AS n FROM w LEFT JOIN p ON p.bin = w.bin""",
    "category_digest_brands": f"""WITH c AS (SELECT p_brand AS category, count(*) AS n, min(p_partkey) AS f FROM part WHERE p_brand <> '' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS k, sum(n) OVER () AS total FROM c)
SELECT CASE WHEN k > 8 THEN 'Other' ELSE category END AS category, sum(n)::BIGINT AS n, {_r("sum(n) * 100.0::DOUBLE / max(total)", 1)} AS pct FROM r GROUP BY 1""",
    "even_sample_orders": """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM r WHERE n <= 300 OR rank IN (SELECT floor(i * n / 300.0) FROM range(300) t(i))""",
    "chart_crosstab_orders": f"""WITH {_CELLS},
p AS (SELECT a.stub, a.n::DOUBLE / a.base AS p1, c.n::DOUBLE / c.base AS p2, a.base AS n_a, c.base AS n_b, (a.n + c.n)::DOUBLE / (a.base + c.base) AS pp FROM cells a JOIN cells c ON a.stub = c.stub AND a.ord < c.ord),
t AS (SELECT stub, count(*) FILTER (pp * (1 - pp) > 0 AND abs((p1 - p2) / sqrt(pp * (1 - pp) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b))) >= 1.96) AS significant_pairs, max(abs({_r("(p1 - p2) * 100", 1)})) AS largest_gap FROM p GROUP BY 1)
SELECT stub, banner, {_r("n * 100.0::DOUBLE / base", 1)} AS pct, significant_pairs, largest_gap FROM cells LEFT JOIN t USING (stub)""",
    "chart_means_orders": f"WITH {_GROUPS} SELECT (row_number() OVER (ORDER BY mean DESC NULLS LAST, ord))::INTEGER AS position, banner, {_r('mean', 2)} AS mean, n FROM g",
    "chart_scatter_line_part": f"""WITH s AS (SELECT count(*) AS n, {_r("corr(p_partkey::DOUBLE, p_retailprice::DOUBLE)", 2)} AS r, regr_slope(p_retailprice, p_partkey) AS b, regr_intercept(p_retailprice, p_partkey) AS a FROM part)
SELECT n, r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength, {_r("b", 2)} AS slope, {_r("a", 1)} AS intercept FROM s""",
    "chart_outliers_events": f"""WITH m AS (SELECT event_id AS row, value::DOUBLE AS v, value::DOUBLE - avg(value::DOUBLE) OVER () AS c FROM events WHERE value IS NOT NULL),
s AS (SELECT count(*) AS n, sum(c) AS s, sum(c * c) AS ss FROM m),
z AS (SELECT row, v, (c - (s - c) / (n - 1)) / sqrt((ss - c * c) / (n - 1) - ((s - c) / (n - 1)) * ((s - c) / (n - 1))) AS z FROM m CROSS JOIN s),
o AS (SELECT row, v, {_r("z", 1)} AS z FROM z WHERE abs(z) >= 2)
SELECT '#' || row_number() OVER (ORDER BY abs(z) DESC, row) AS label, row, v, z FROM o""",
    "fitted_line_lineitem": f"SELECT count(*) AS n, {_r('regr_slope(l_extendedprice, l_quantity)', 2)} AS slope, {_r('regr_intercept(l_extendedprice, l_quantity)', 1)} AS intercept FROM lineitem",
}
