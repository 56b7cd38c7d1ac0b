"""What must hold as tables grow: nothing made by exploding is broadcast whole, and pairs aren't made to be thrown away."""

import itertools
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon import catalog
from tabulon.functions import exprs as X
from tabulon.operators import evidence as E
from tabulon.operators import quotes as U
from tabulon.operators import validators as W
from tabulon.operators import views as V
from tabulon.plans import components, lineage


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _keys(spark):
    return spark.range(3).select(F.col("id").alias("key"))


def test_pillars_stay_off_the_driver(spark):
    said = '[{"theme": " ", "headline": " h ", "insight_indices": [1, 0, 1, 9]}, {"headline": "", "insight_indices": [0]}]'
    answers = _keys(spark).where("key > 0").select("key", F.when(F.col("key") == 1, said).otherwise("none").alias("answer"))
    insights = _keys(spark).select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("index")).select("*", (F.col("index") + 7).alias("synth_id"), F.lit("strong").alias("confidence_tier"), F.col("index").alias("quality_score"), F.lit("own").alias("headline"))
    found = W.pillars(answers, insights, most=1)
    assert "Broadcast" not in _plan(found)
    bare = [(k, i, "strong", "own", str(i + 7), 0) for k in (0, 2) for i in (0, 1)]
    assert sorted(map(tuple, found.collect())) == sorted([(1, 0, "Key finding", "h", "8", 1), *bare])


def test_codes_and_themes_stay_off_the_driver(spark):
    said = '[{"name": "A", "definition": "d", "members": [{"run": 1, "theme": 2}, {"run": 1, "theme": 1}, {"run": 2, "theme": 9}, {"run": 3, "theme": 1}]}, {"name": "a ", "definition": "e", "members": [{"run": 2, "theme": 1}]}, {"name": "b", "definition": "f", "members": [{"run": 2, "theme": 3}, {"run": 1, "theme": 2}]}]'
    themes = _keys(spark).select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("run")).withColumn("themes", F.col("run") + 1)
    found = W.consolidated_codes(_keys(spark).select("key", F.lit(said).alias("answer")), themes)
    assert "Broadcast" not in _plan(found)
    assert sorted(map(tuple, found.where("key = 1").collect())) == [(1, 1, "b", "f", 2), (1, 2, "A", "d", 1)]
    groups = W.theme_groups(_keys(spark).select("key", F.lit('{"A": [1, 2, 9], "B": [2, 3]}').alias("answer")), _keys(spark).withColumn("n", F.lit(3)))
    assert "Broadcast" not in _plan(groups)
    assert [tuple(r) for r in groups.where("key = 1").collect()] == [(1, "A", [1, 2])]


def test_placements_stay_off_the_driver(spark):
    said = '[{"code": 5, "theme": 1}, {"code": 5, "theme": 2}, {"code": 6, "new_theme": " New "}, {"code": 7, "theme": 9, "new_theme": "new"}, {"code": 8, "new_theme": "old"}, {"code": 4, "theme": 1}, {"code": 9, "theme": 9, "new_theme": " "}]'
    groups = _keys(spark).select("key", F.lit(1).alias("number"), F.lit("A").alias("theme"))
    left = _keys(spark).select("key", F.explode(F.sequence(F.lit(5), F.lit(9))).alias("code"))
    found = W.place_leftovers(_keys(spark).select("key", F.lit(said).alias("answer")), groups, left)
    assert "Broadcast" not in _plan(found)
    assert sorted(tuple(r) for r in found.where("key = 1").collect()) == [(1, "A", 5), (1, "New", 6), (1, "New", 7), (1, W.HOLDING_THEME, 8)]


def test_claims_sort_short_lists_not_their_whole_run(spark):
    cells = "run_id long, finding_id long, theme string, created_at long, finding_kind string, status string"
    rows = [(i % 2, i, ("a", "b", None)[i % 3], 50 - i // 2, ("fact", "stated_insight")[i % 11 == 5], ("pending", "rejected")[i % 13 == 4]) for i in range(60)]
    findings = spark.createDataFrame(rows, cells)
    told = [(100, 0, "a", [2, 4, 7]), (101, 0, None, [0]), (102, 1, "b", None), (103, 1, "c", []), (104, 5, "a", [2])]
    claims = spark.createDataFrame(told, "claim_id long, run_id long, theme string, cited array<long>")
    found = V.evidence_pool(claims, findings, findings.where("finding_id % 7 <> 3").select("finding_id"), most=3)
    assert not [x for x in _plan(found).splitlines() if "Window" in x and "claim_id" in x]
    live = [r for r in rows if r[4] == "fact" and r[5] == "pending" and r[1] % 7 != 3]
    want = []
    for claim, run, theme, cited in told:
        own = sorted((r for r in live if r[0] == run), key=lambda r: (r[1] not in (cited or []), r[2] != theme, r[3], r[1]))
        want += [(claim, i, r[1]) for i, r in enumerate(own[:3])]
    assert sorted(map(tuple, found.collect())) == want


def _same(spark, folder, name):
    """The query's rows over a folder against its SQL's."""
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, str(folder))
    c.execute(f"CREATE TABLE wanted AS {catalog.ORACLE_SQL[name]}")
    wanted = c.execute(f"SELECT {', '.join(df.columns)} FROM wanted").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(wanted)


@pytest.mark.parametrize("name", ["table_patterns", "pattern_findings"])
def test_patterns_of_many_suppliers(spark, tmp_path, name):
    duckdb.execute(f"COPY (SELECT s_suppkey + i * 1000 AS s_suppkey, s_name, s_nationkey, s_acctbal FROM '/root/testdata/sf0.1/supplier.parquet', range(6) r(i)) TO '{tmp_path}/supplier.parquet'")
    _same(spark, tmp_path, name)


def test_uploads_are_new_however_many_files_there_are(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT (i // 8) * 100000 + i % 8 AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, (i * 7 % 50)::INTEGER AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(16) r(i)) TO '{tmp_path}/part.parquet'")
    _same(spark, tmp_path, "upload_register")


def test_caps_split_a_text_once(spark):
    shown = spark.range(1).select(X.cap_words(F.col("id").cast("string"), F.lit(75)).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("split(") == 1
    told = "One two. Three four? " + "five " * 9 + "end"
    got = spark.createDataFrame([(told,)], "t string").select(X.cap_words(F.col("t"), F.lit(6)), X.cap_words(F.col("t"), F.lit(8)), X.cap_words(F.col("t"), F.lit(14))).first()
    assert tuple(got) == ("One two. Three four?", "One two. Three four? five five five five…", told)


def test_quotes_are_cut_into_words_once(spark):
    segments = spark.createDataFrame([(1, 0, "a", "participant", "we like the cheap green tea a lot"), (1, 1, "b", "moderator", "why is that")], "doc long, idx int, speaker string, role string, text string")
    quotes = spark.createDataFrame([(7, 1, "we like the cheap green tea lot")], "quote_id long, doc long, quote string")
    found = U.match_quotes(quotes, segments)
    lambdas = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "array_contains(" in x]
    assert lambdas and not any("regexp_replace(" in x for x in lambdas)
    assert [(r["match"], r["idx"], r["score"]) for r in found.collect()] == [("near", 0, 1.0)]


def _families(rng):
    """Families whose texts differ in two of four words, one with strays that share only its common words or link it to another."""
    kin = lambda name, *w: " ".join(f"{name}{x}" for x in ("one", "two", "three", "four", "five")) + " " + " ".join(f"{name}{p}{x}" for p, x in zip("pqrs", w, strict=True))
    texts = {kin("a", *(rng.randrange(k) for k in (9, 5, 4, 3))) for _ in range(150)}
    texts |= {kin("b", *(rng.randrange(k) for k in (4, 3, 3, 2))) for _ in range(40)}
    texts |= {f"{t} {rng.randrange(9)}x {rng.randrange(9)}y" for t in rng.sample(sorted(texts), 20)}
    texts |= {"aone atwo athree afour afive z1 z2 z3 z4", "aone atwo athree", "bone btwo bthree bfour bfive z1 z2 z3 z4", "alone here", "here alone now", ""}
    return sorted(texts) * 2


@pytest.mark.parametrize("least", [2, 64])
def test_families_are_grouped_without_all_their_pairs(spark, monkeypatch, least):
    made = []
    monkeypatch.setattr(E, "connected_components", lambda edges: made.append(edges.count()) or components.connected_components(edges))
    monkeypatch.setattr(E, "FAMILY", least, raising=False)
    texts = _families(random.Random(5))
    sets = [frozenset(t.split()) for t in texts]
    root = list(range(len(texts)))
    pairs = 0
    for j, i in itertools.combinations(range(len(texts)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.55 * len(sets[i] | sets[j]):
            pairs += sets[i] != sets[j]
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    size = Counter(root)
    want = {(i, r) for i, r in enumerate(root) if size[r] > 1 and sets[i]}
    got = E.duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    assert set(map(tuple, got.collect())) == want
    assert pairs > 8 * len(texts) and sum(made) < 3 * len(texts)


def test_signatures_tell_long_sets_apart(spark, monkeypatch):
    """Sets of 200 words that share a third of them pass the join's bound for few pairs but the true ones."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(100)]
    texts = [" ".join([*rng.sample(common, 80), *(f"w{rng.randrange(4000)}" for _ in range(120))]) for _ in range(60)]
    texts += [t.rsplit(" ", 4)[0] for t in texts[:5]]
    stored = []
    monkeypatch.setattr(E, "cut", lambda df: stored.append(lineage.cut(df)) or stored[-1])
    found = E.similar_statements(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()
    prefix = next(df for df in stored if "s0" in df.columns)
    bits = [c for c in prefix.columns if re.fullmatch(r"s\d+", c)]
    rows = prefix.select("set", "n", *bits).distinct().collect()
    passed = sum(sum((x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(a[2:], b[2:], strict=True)) <= (a.n + b.n) * 0.45 / 1.55 for a, b in itertools.combinations(rows, 2))
    assert sorted((r.a, r.b) for r in found) == [(i, 60 + i) for i in range(5)]
    assert len(rows) == 65 and 5 <= passed < 50
