"""Queries of what survives of codebook and story answers, one answer to each customer, and their SQL.

The answers are made from the customer's key by rules that SQL repeats.  They hold
what such answers get wrong: numbers outside the lists, repeats, names that
differ in case only, blank texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.operators import validators as W


#: Answers that one task makes and reads.
_ANSWERS_EACH = 25_000


def _keys(spark, sf_dir):
    """Customers' keys, dealt out before an answer is made of each: the file is small and comes in few pieces, its answers don't."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return keys.repartition(keys.count() // _ANSWERS_EACH + spark.sparkContext.defaultParallelism, "key")


def _range(first: int, last: int) -> Column:
    return F.sequence(F.lit(first), F.lit(last))


def _codes(spark, sf_dir):
    """Fourteen codes; the sixth has no definition, the last is called like the first, run 4 doesn't exist."""
    keys, k = _keys(spark, sf_dir), F.col("key")

    def code(i: Column) -> Column:
        members = F.transform(_range(1, 4), lambda r: F.struct(r.alias("run"), ((k + i * r) % 4).alias("theme")))
        kept = F.filter(members, lambda m: (k + i + m["run"]) % 3 > 0)
        name = F.when(i == 13, " A ").otherwise(F.char(i + 97))
        return F.struct(name.alias("name"), F.when(i == 5, " ").otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("definition"), F.concat(kept, kept).alias("members"))

    answers = keys.select("key", F.to_json(F.struct(F.transform(_range(0, 13), code).alias("merges"))).alias("answer"))
    themes = keys.select("key", F.explode(_range(1, 3)).alias("run")).withColumn("themes", F.col("run") + 1)
    return W.consolidated_codes(answers, themes)


#: Names of the proposed themes in the order of the answer; "a" is "A" again.
_THEMES = ("A", " b ", "a", "C", "D")


def _theme_codes(place: int, key: str) -> list[str]:
    return (["1", "2", f"{key} % 5"], ["2", "3", f"{key} % 7"], ["4", "5"], ["4", "5", "99", f"{key} % 6 + 1"], ["6", "7", "7", f"{key} % 9"])[place]


def _themes(spark, sf_dir):
    """Five themes that ask for each other's codes: as a list, as a list inside a text, or as a map of names to codes."""
    keys, k = _keys(spark, sf_dir), F.col("key")
    codes = [F.array(*[F.expr(c).cast("int") for c in _theme_codes(i, "key")]) for i in range(len(_THEMES))]
    plain = F.to_json(F.array(*[F.struct(F.lit(n).alias("theme"), c.alias("codes")) for n, c in zip(_THEMES, codes, strict=True)]))
    named = F.to_json(F.struct(*[c.alias(n) for n, c in zip(_THEMES, codes, strict=True)]))
    answer = F.when(k % 3 == 0, plain).when(k % 3 == 1, F.to_json(F.struct(plain.alias("groups")))).otherwise(named)
    out = W.theme_groups(keys.select("key", answer.alias("answer")), keys.select("key", (k % 3 + 6).cast("int").alias("n")))
    return out.select("key", "theme", F.array_join(F.array_sort("codes"), ",").alias("codes"))


def _theme_sql() -> str:
    """A step for each theme: it gets what is asked for, exists and is left, if that is two codes or more and its name is new."""
    steps = ["t0 AS (SELECT c_custkey AS key, c_custkey % 3 + 6 AS n, []::BIGINT[] AS used, []::VARCHAR[] AS names FROM customer)"]
    rows = []
    for i, name in enumerate(_THEMES):
        asked = f"list_distinct(list_filter([{', '.join(_theme_codes(i, 'key'))}]::BIGINT[], lambda c: c >= 1 AND c <= n AND NOT list_contains(used, c)))"
        steps.append(f"a{i} AS (SELECT *, {asked} AS own, NOT list_contains(names, '{name.strip().lower()}') AS new FROM t{i})")
        steps.append(f"t{i + 1} AS (SELECT key, n, CASE WHEN len(own) >= 2 AND new THEN list_concat(used, own) ELSE used END AS used, CASE WHEN len(own) >= 2 AND new THEN list_append(names, '{name.strip().lower()}') ELSE names END AS names FROM a{i})")
        rows.append(f"SELECT key, '{name.strip()}' AS theme, array_to_string(list_sort(own), ',') AS codes FROM a{i} WHERE len(own) >= 2 AND new")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(rows)}"


def _placements(spark, sf_dir):
    """Six placements of the codes 5 to 9: in themes 1 to 3, in a theme that isn't there, or in new ones, whose names repeat."""
    keys, k = _keys(spark, sf_dir), F.col("key")

    def entry(i: Column) -> Column:
        kind, word = (k + i) % 5, k * i % 3
        new = F.when(word == 0, "New").when(word == 1, " new ").otherwise("Old")
        theme = F.when(kind.between(1, 3), kind).when(kind == 4, 99)
        return F.struct((i % 5 + 5).alias("code"), theme.alias("theme"), F.when(kind == 0, new).when(kind == 4, F.when(word == 2, new).otherwise(" ")).alias("new_theme"))

    answers = keys.select("key", F.to_json(F.struct(F.transform(_range(0, 5), entry).alias("placements"))).alias("answer"))
    groups = keys.select("key", F.posexplode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("number", "theme")).withColumn("number", F.col("number") + 1)
    return W.place_leftovers(answers, groups, keys.select("key", F.explode(_range(5, 8)).alias("code")))


def _pillars(spark, sf_dir):
    """Three pillars of six insights, the last without a headline; every fourth answer has none at all."""
    keys, k = _keys(spark, sf_dir), F.col("key")
    pillar = lambda theme, headline, *at: F.struct(F.lit(theme).alias("theme"), F.lit(headline).alias("headline"), F.array(*[F.expr(str(a)).cast("int") for a in at]).alias("insight_indices"))
    said = F.to_json(F.array(pillar(" T ", " H ", 0, 1, 2, "key % 6", "key % 6", 9), pillar("", "second", 5, 3), pillar("x", " ", 4)))
    answers = keys.select("key", F.when(k % 4 == 3, "[]").otherwise(said).alias("answer"))
    i = F.col("index")
    tier = F.when((k + i) % 4 == 0, "strong").when((k + i) % 4 == 1, "moderate").when((k + i) % 4 == 2, "exploratory")
    insights = keys.select("key", F.explode(_range(0, 5)).alias("index")).select("key", "index", (k * 10 + i).alias("synth_id"), tier.alias("confidence_tier"), F.when((k + i) % 5 > 0, k * i % 7).alias("quality_score"), F.concat(F.lit("h"), i.cast("string")).alias("headline"))
    return W.pillars(answers, insights)


QUERIES = {"answer_codes": _codes, "answer_themes": _themes, "answer_placements": _placements, "answer_pillars": _pillars}

ORACLE_SQL = {
    "answer_codes": """WITH e AS (SELECT c_custkey AS key, i, r, (c_custkey + i * r) % 4 AS theme FROM customer, range(14) a(i), range(1, 4) b(r) WHERE (c_custkey + i + r) % 3 > 0 AND i <> 5),
n AS (SELECT key, i, CASE i WHEN 13 THEN 'A' ELSE chr(97 + i::INTEGER) END AS name, count(DISTINCT r) AS reproduced_runs FROM e WHERE theme BETWEEN 1 AND r + 1 GROUP BY 1, 2),
d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY key, lower(name) ORDER BY i) = 1)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY reproduced_runs DESC, i) AS rank, name, 'd' || i AS definition, reproduced_runs FROM d QUALIFY rank <= 12""",
    "answer_themes": _theme_sql(),
    "answer_placements": f"""WITH e AS (SELECT c_custkey AS key, i, i % 5 + 5 AS code, (c_custkey + i) % 5 AS kind, CASE c_custkey * i % 3 WHEN 2 THEN 'Old' WHEN 1 THEN 'new' ELSE 'New' END AS word FROM customer, range(6) a(i)),
f AS (SELECT * FROM e WHERE code < 9 QUALIFY row_number() OVER (PARTITION BY key, code ORDER BY i) = 1),
w AS (SELECT *, count(*) OVER g AS n, first_value(word) OVER (g ORDER BY i) AS label FROM f WHERE kind = 0 OR kind = 4 AND word = 'Old' WINDOW g AS (PARTITION BY key, lower(word)))
SELECT key, chr(64 + kind::INTEGER) AS theme, code FROM f WHERE kind BETWEEN 1 AND 3 UNION ALL SELECT key, CASE WHEN n >= 2 THEN label ELSE '{W.HOLDING_THEME}' END, code FROM w""",
    "answer_pillars": """WITH s AS (SELECT c_custkey AS key, i AS index, c_custkey * 10 + i AS synth_id, (c_custkey + i) % 4 AS tier, CASE WHEN (c_custkey + i) % 5 > 0 THEN c_custkey * i % 7 ELSE 0 END AS score FROM customer, range(6) a(i)),
p AS (SELECT key, 0 AS pillar, index, index AS spot, synth_id, tier, score FROM s WHERE index < 3 OR index = key % 6 UNION ALL SELECT key, 1, index, CASE index WHEN 5 THEN 0 ELSE 1 END, synth_id, tier, score FROM s WHERE index IN (3, 5)),
r AS (SELECT *, row_number() OVER (w ORDER BY tier, score DESC, spot) AS k, count(*) OVER w AS n FROM p WHERE key % 4 <> 3 WINDOW w AS (PARTITION BY key, pillar))
SELECT key, pillar, CASE pillar WHEN 0 THEN 'T' ELSE 'Key finding' END AS theme, CASE pillar WHEN 0 THEN 'H' ELSE 'second' END AS headline, string_agg(synth_id::VARCHAR, ',' ORDER BY k) AS insight_ids, greatest(0, max(n) - 3) AS overflow FROM r WHERE k <= 3 GROUP BY key, pillar
UNION ALL SELECT key, index, CASE tier WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'exploratory' ELSE 'Key finding' END, 'h' || index, synth_id::VARCHAR, 0 FROM s WHERE key % 4 = 3""",
}
