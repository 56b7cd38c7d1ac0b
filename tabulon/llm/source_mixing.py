"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a mean repetition rate: rate = budget x share / size, where
share is its target weight over the sum of weights.  A document's count is
the Poisson quantile of a uniform number seeded by a hash of its id, so the
same document always gets the same count and no state is kept.  Documents
are exploded by their count and shuffled globally: a hash of (id, copy) deals
each copy to a partition and gives its place there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.words import fresh
from tabulon.plans.lineage import cut

#: Sources whose rates are broadcast, counted before; the rates of more come by a shuffle join.
MOST_BROADCAST = 100_000
#: 52 hash bits, exact in a double.
_HEX_DIGITS, _SCALE = 13, float(1 << 52)


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by '|'; null parts read 'null'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("double") / F.lit(_SCALE)


def poisson_quantile(u: Column, rate: Column) -> Column:
    """Least k with P(X <= k) > u for X of that mean: the inverse of the distribution, term by term.

    Terms are taken by their logarithms, as exp(-rate) underflows from about 745 on.
    The walk ends at mean + 12 deviations + 20, beyond which less than 2**-52 is left.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate)).cast("int") + 20
    state = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.lit(0).alias("k"), (-rate).alias("log"), F.exp(-rate).alias("sum")),
        lambda s, i: F.when(u < s["sum"], s).otherwise(
            F.struct(
                i.alias("k"),
                (s["log"] + F.log(rate / i)).alias("log"),
                (s["sum"] + F.exp(s["log"] + F.log(rate / i))).alias("sum"),
            )
        ),
        lambda s: s["k"],
    )
    return F.when((rate > 0) & (u > 0), state).otherwise(0).cast("int")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, budget_ratio: float, temperature: float) -> DataFrame:
    """(source_key, mix_rate) for each source, null being a source of its own.

    The size of a source is its number of rows.  With ``weights``, a source
    without a weight gets rate 0.  Without, target weights are size ** temperature.
    """
    sizes = docs.groupBy(F.col("source").alias("source_key")).agg(F.count(F.lit(1)).cast("double").alias("mix_size"))
    if weights is None:
        sizes = sizes.withColumn("mix_weight", F.pow("mix_size", F.lit(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map()
        weight = F.coalesce(F.try_element_at(named.cast("map<string,double>"), F.col("source_key")), F.lit(0.0))
        sizes = sizes.withColumn("mix_weight", weight)
    totals = sizes.agg(F.sum("mix_size").alias("mix_rows"), F.sum("mix_weight").alias("mix_weights"))
    # One row of totals: the join to it is a scalar look-up, not a product of two tables.
    rate = F.lit(budget_ratio) * F.col("mix_rows") * F.try_divide(F.col("mix_weight"), F.col("mix_weights")) / F.col("mix_size")
    return sizes.join(F.broadcast(totals)).select("source_key", F.coalesce(rate, F.lit(0.0)).alias("mix_rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget_ratio: float = 1.0,
    temperature: float = 0.5,
    seed: str = "mix",
    add_columns: bool = True,
) -> DataFrame:
    """Documents replicated to the target mix and shuffled globally.

    Needs doc_id and source; other columns pass through.  With
    ``add_columns``, mix_copy (0-based), mix_count and mix_key (the sort key)
    are added, replacing columns of those names.  Rows with equal ids draw
    equal counts.  Null sources form one source.  An empty table gives an
    empty result.
    """
    columns = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_count", "mix_key")]
    key, rate = fresh("source_key", columns), fresh("mix_rate", columns)
    rates = cut(source_rates(docs.select("source"), weights, budget_ratio, temperature)).toDF(key, rate)
    few = rates.count() <= MOST_BROADCAST
    rated = docs.select(*columns).join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col(key)))
    count = poisson_quantile(hash_uniform(F.col("doc_id"), F.lit(seed)), F.col(rate))
    counted = rated.withColumn("mix_count", count).where("mix_count > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1)))
    place = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mix_copy").cast("string"), F.lit(seed)))
    shuffled = copies.withColumn("mix_key", place).repartition("mix_key").sortWithinPartitions("mix_key", "doc_id")
    return shuffled.select(*columns, *(["mix_copy", "mix_count", "mix_key"] if add_columns else []))


MIX_SQL = """
WITH sizes AS (
  SELECT source AS source_key, count(*)::DOUBLE AS mix_size FROM documents GROUP BY 1),
rates AS (
  SELECT source_key,
         1.0::DOUBLE * sum(mix_size) OVER () * (pow(mix_size, 0.5::DOUBLE) / sum(pow(mix_size, 0.5::DOUBLE)) OVER ()) / mix_size AS rate
  FROM sizes),
terms AS (
  SELECT source_key, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate)) + 20)::BIGINT)) AS k FROM rates),
steps AS (
  SELECT source_key, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY source_key ORDER BY k) AS p FROM terms),
distribution AS (SELECT source_key, list(p ORDER BY p) AS ps FROM steps GROUP BY 1),
draws AS (
  SELECT doc_id, text, source, ps,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents JOIN distribution ON source IS NOT DISTINCT FROM source_key),
counted AS (
  SELECT doc_id, text, source, CASE WHEN u > 0 THEN len(list_filter(ps, lambda p: p <= u)) ELSE 0 END::INTEGER AS mix_count FROM draws)
SELECT doc_id, text, source, unnest(range(0, mix_count))::INTEGER AS mix_copy, mix_count,
       md5(coalesce(doc_id::VARCHAR, 'null') || '|' || unnest(range(0, mix_count))::VARCHAR || '|mix') AS mix_key
FROM counted
"""
