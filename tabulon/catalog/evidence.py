"""Queries of the evidence operators and the relational read models; orders, events and documents stand for findings and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.catalog.changes import TOKENS
from tabulon.catalog.tables import _CELLS
from tabulon.functions.exprs import jround, ordered_list
from tabulon.operators import evidence as E
from tabulon.operators import tables as T
from tabulon.sources.tables import manifest


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").try_cast("double")


def usage_by_type(spark, sf_dir):
    g = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(_k()).alias("tokens"))
    return g.withColumn("cost_usd", jround(E.cost_usd(F.col("tokens"), F.col("calls")), 6))


def usage_batches(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    out = E.usage_batches(e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at")), e.where("event_type <> 'signup'").select("user_id", F.col("ts").alias("at"), _k().alias("tokens")), "user_id")
    return out.withColumn("batch_at", F.date_format("batch_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def errors_since_batch(spark, sf_dir):
    """Each user's errors at or after the latest signup; all of them where there is none."""
    e = _t(spark, sf_dir, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("since"))
    return e.where("event_type = 'error'").join(last, "user_id", "left").where(F.col("since").isNull() | (F.col("ts") >= F.col("since"))).select("event_id", "user_id")


def order_verdicts(spark, sf_dir):
    """A verdict for each test between order priorities."""
    p = T.proportion_pairs(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey")
    caveats = F.filter(F.array(F.when(~F.col("significant"), "not_significant")), lambda x: x.isNotNull())
    return p.select("stub", "cat_a", "cat_b", E.verdict_tier(caveats, E.base_caution(F.col("n_a"), F.col("n_b"))).alias("tier"))


def provenance(spark, sf_dir):
    """Members and sources behind each group of copies, with a tier."""
    g = _t(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("members"), F.count_distinct("source").alias("themes"))
    return g.select("group_id", "members", "themes", E.confidence_tier(F.col("members"), F.col("themes")).alias("tier"))


def restore_check(spark, sf_dir):
    """Row counts wanted by a manifest against those found; the manifest expects one region too many."""
    got = manifest(spark, {n: f"{sf_dir}/{n}.parquet" for n in TABLES}).withColumnRenamed("n", "got")
    want = got.select("table_name", F.when(F.col("table_name") == "region", F.col("got") + 1).otherwise(F.col("got")).alias("want"))
    return want.join(got, "table_name", "full").select("table_name", "want", "got", F.coalesce(F.col("want") == F.col("got"), F.lit(False)).alias("ok"))


def latest_order(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return E.latest_per_key(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


def not_processed(spark, sf_dir):
    """Customers without a finished order."""
    done = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


def exists_flags(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    flag = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("p")).distinct()
    return _t(spark, sf_dir, "customer").join(flag, "c_custkey", "left").select("c_custkey", F.col("p").isNotNull().alias("has_pending"))


def orders_listed(spark, sf_dir):
    """Each customer's order keys by price, joined into one text."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(ordered_list(F.col("o_orderkey").cast("string"), -F.col("o_totalprice"), F.col("o_orderkey")).alias("keys"))
    return o.select("o_custkey", F.array_join("keys", " | ").alias("keys"))


def ranked(spark, sf_dir):
    """Each priority's three dearest orders, with page numbers of two cards."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_orderpriority", "o_orderkey", "k", F.floor((F.col("k") - 1) / 2).alias("page"))


def next_event(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select("event_id", F.lead("event_id").over(w).alias("next_id"))


def nation_tallies(spark, sf_dir):
    """Nations with conditional and distinct counts of their customers, zero where there are none."""
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"), F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("segments"))
    return _t(spark, sf_dir, "nation").join(c, "n_nationkey", "left").na.fill(0, ["customers", "overdrawn", "segments"]).select("n_nationkey", "customers", "overdrawn", "segments")


def statements(spark, sf_dir):
    """Every turn as a statement, and every third once more without its first word."""
    c = _t(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    again = c.where("turn % 3 = 0").select((key + 500).alias("id"), F.regexp_replace("text", r"^\S+\s+", "").alias("text"))
    return c.select(key.alias("id"), "text").union(again)


QUERIES = {
    "usage_by_type": usage_by_type,
    "usage_batches": usage_batches,
    "errors_since_batch": errors_since_batch,
    "order_verdicts": order_verdicts,
    "provenance": provenance,
    "restore_check": restore_check,
    "latest_order": latest_order,
    "not_yet_processed": not_processed,
    "exists_flags": exists_flags,
    "orders_listed": orders_listed,
    "top3_per_group": ranked,
    "next_event": next_event,
    "nation_tallies": nation_tallies,
    "similar_statements": lambda s, d: E.similar_statements(statements(s, d), "id", "text"),
    "duplicate_statements": lambda s, d: E.duplicate_groups(statements(s, d), "id", "text"),
    "structural_duplicates": lambda s, d: E.structural_duplicates(_t(s, d, "documents"), ["text", "lang"], "doc_id"),
}

_K = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"
_SETS = f"""said AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT conv_id * 1000 + turn + 500, regexp_replace(text, '^\\S+\\s+', '') FROM conversations WHERE turn % 3 = 0), sets AS (SELECT id, list_sort({TOKENS.format(x="text")}) AS w FROM said WHERE len({TOKENS.format(x="text")}) > 0), uniq AS (SELECT w, min(id) AS id FROM sets GROUP BY 1),
pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE AS j FROM uniq a JOIN uniq b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) >= 0.55 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))"""
_TAG = "CASE WHEN least(n_a, n_b) < 30 THEN 2 WHEN least(n_a, n_b) < 50 THEN 1 ELSE 0 END"

ORACLE_SQL = {
    "usage_by_type": f"SELECT event_type, count(*) AS calls, sum({_K}) AS tokens, floor((sum({_K}) / 1e6 * 2 + count(*) / 1e6 * 10) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS cost_usd FROM events GROUP BY 1",
    "usage_batches": f"""WITH m AS (SELECT DISTINCT user_id, ts AS began FROM events WHERE event_type = 'signup'), u AS (SELECT e.user_id, {_K} AS tokens, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS began FROM events e WHERE e.event_type <> 'signup')
SELECT m.user_id, strftime(m.began, '%Y-%m-%d %H:%M:%S.%f') AS batch_at, count(u.user_id) AS events, floor(coalesce(sum(tokens), 0) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS tokens FROM m LEFT JOIN u USING (user_id, began) GROUP BY 1, 2""",
    "order_verdicts": f"""WITH {_CELLS}, p AS (SELECT a.stub, a.banner AS cat_a, c.banner AS cat_b, a.base AS n_a, c.base AS n_b, a.n::DOUBLE / a.base AS p1, c.n::DOUBLE / c.base AS p2, (a.n + c.n)::DOUBLE / (a.base + c.base) AS pp FROM cells a JOIN cells c ON a.stub = c.stub AND a.ord < c.ord)
SELECT stub, cat_a, cat_b, CASE WHEN NOT coalesce(abs(CASE WHEN pp * (1 - pp) > 0 THEN (p1 - p2) / sqrt(pp * (1 - pp) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)) END) >= 1.96, false) THEN 'not_supported' WHEN {_TAG} > 0 THEN 'use_with_caution' ELSE 'robust' END AS tier FROM p""",
    "errors_since_batch": "WITH l AS (SELECT user_id, max(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT event_id, events.user_id FROM events LEFT JOIN l ON l.user_id = events.user_id WHERE event_type = 'error' AND (since IS NULL OR ts >= since)",
    "provenance": "WITH g AS (SELECT min(doc_id) AS group_id, count(*) AS members, count(DISTINCT source) AS themes FROM documents GROUP BY text) SELECT *, CASE WHEN members >= 3 AND themes >= 2 THEN 'strong' WHEN members >= 3 OR themes >= 2 THEN 'moderate' ELSE 'exploratory' END AS tier FROM g",
    "restore_check": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) + {int(n == 'region')} AS want, count(*) AS got, {str(n != 'region').lower()} AS ok FROM {n}" for n in TABLES),
    "latest_order": "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k = 1",
    "not_yet_processed": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "exists_flags": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer",
    "orders_listed": "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' | ' ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM orders GROUP BY 1",
    "top3_per_group": "WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS k FROM orders) SELECT o_orderpriority, o_orderkey, k::INTEGER AS k, ((k - 1) // 2)::BIGINT AS page FROM r WHERE k <= 3",
    "next_event": "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events",
    "nation_tallies": "SELECT n_nationkey, count(c_custkey) AS customers, count(*) FILTER (c_acctbal < 0) AS overdrawn, count(DISTINCT c_mktsegment) FILTER (c_acctbal > 0) AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    "similar_statements": f"WITH {_SETS} SELECT a, b, floor(j * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS likeness FROM pairs",
    "duplicate_statements": f"""WITH RECURSIVE {_SETS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(id, root) AS (SELECT id, id FROM uniq UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT s.id, c.root AS group_id FROM sets s JOIN uniq USING (w) JOIN c ON c.id = uniq.id WHERE c.root IN (SELECT c.root FROM sets JOIN uniq USING (w) JOIN c ON c.id = uniq.id GROUP BY 1 HAVING count(*) > 1)""",
    "structural_duplicates": "SELECT min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1",
}
