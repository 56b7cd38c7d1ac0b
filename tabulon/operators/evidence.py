"""Findings, verdicts and insights: tiers, corroboration, duplicates, contradictions, archives and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import jround, statement_tokens
from tabulon.functions.stats import base_size_tag
from tabulon.plans.components import connected_components
from tabulon.plans.lineage import cut

#: Likeness of duplicate statements, prices in USD for a million tokens, tier bounds.
DUPLICATE_LIKENESS, PRICE_IN, PRICE_OUT = 0.55, 2.0, 10.0


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def base_caution(*bases: Column) -> Column:
    """'base_size_unknown' if any base is null, else the worst tag of the bases, else null."""
    tags = F.array(*[F.coalesce(base_size_tag(b), F.lit("")) for b in bases])
    unknown = F.exists(F.array(*bases), lambda b: b.isNull())
    return F.when(unknown, "base_size_unknown").when(F.array_contains(tags, "base_size_small"), "base_size_small").when(F.array_contains(tags, "base_size_borderline"), "base_size_borderline")


def verdict_tier(caveats: Column, caution: Column) -> Column:
    """not_supported for what isn't significant or can't be tested, use_with_caution for weak bases, else robust."""
    weak = F.array_contains(caveats, "not_significant") | F.array_contains(caveats, "insufficient_n_for_test")
    return F.when(F.coalesce(weak, F.lit(False)), "not_supported").when(caution.isNotNull(), "use_with_caution").otherwise("robust")


def computed_verdicts(findings: DataFrame) -> DataFrame:
    """(finding_id, tier, basis_id) of findings that a computation settles.

    Generated findings are judged by their own caveats and bases (n1, n2), stated
    ones that point to a computed finding by that finding's bases alone.  Others
    need a judgement and don't appear; stated insights are left to theirs.
    """
    asked = findings.where("status <> 'rejected'")
    caution = base_caution(F.col("n1"), F.col("n2"))
    own = asked.where("origin = 'generated' AND has_stats").select("finding_id", verdict_tier(F.col("caveats"), caution).alias("tier"), F.col("finding_id").alias("basis_id"))
    ground = asked.where("has_stats").select(F.col("finding_id").alias("basis_id"), caution.alias("caution"))
    stated = asked.where("NOT (origin = 'generated' AND has_stats) AND grounded_by_finding_id IS NOT NULL AND coalesce(finding_kind, '') <> 'stated_insight'")
    grounded = stated.select("finding_id", F.col("grounded_by_finding_id").alias("basis_id")).join(ground, "basis_id")
    return own.union(grounded.select("finding_id", F.when(F.col("caution").isNotNull(), "use_with_caution").otherwise("robust"), "basis_id"))


def corroboration(findings: DataFrame) -> DataFrame:
    """(finding_id, level): findings whose duplicate group spans several sources or that a known finding grounds are corroborated."""
    live = findings.where("status <> 'rejected'")
    source = F.coalesce(F.col("source_document_id").cast("string"), F.concat(F.lit("t"), F.col("source_table_id").cast("string")), F.concat(F.lit("f"), F.col("finding_id").cast("string")))
    groups = live.where("duplicate_group_id IS NOT NULL").groupBy("duplicate_group_id").agg(F.count_distinct(source).alias("sources"))
    known = live.select(F.col("finding_id").alias("grounded_by_finding_id"), F.lit(True).alias("grounded"))
    both = live.join(groups, "duplicate_group_id", "left").join(known, "grounded_by_finding_id", "left")
    return both.select("finding_id", F.when((F.col("sources") > 1) | F.col("grounded"), "cross_source_corroborated").otherwise("single_source").alias("level"))


def discovery_class(origin: Column, corroborates: Column) -> Column:
    """validated for what the report says or a report claim rests on, else net_new."""
    return F.when(origin.isin("stated", "coded") | corroborates, "validated").otherwise("net_new")


def verification_basis(origin: Column, grounded: Column, relied: Column) -> Column:
    """data_backed for computed findings and those that rest on one, else report_only."""
    return F.when((origin == "generated") | grounded | relied, "data_backed").otherwise("report_only")


def input_completeness(runs: DataFrame, files: DataFrame, file_tables: DataFrame) -> DataFrame:
    """(run_id, state, sources): what was supplied to each run, and where net-new insight can come from."""
    report = files.where(F.col("kind").isin("report", "transcript")).select("run_id", F.lit(True).alias("report")).distinct()
    data = file_tables.select("run_id", F.lit(True).alias("data")).distinct()
    both = runs.select("run_id").join(report, "run_id", "left").join(data, "run_id", "left")
    r, d = F.col("report").isNotNull(), F.col("data").isNotNull()
    state = F.when(r & d, "report_and_data").when(r, "report_only").when(d, "data_only").otherwise("none")
    sources = F.filter(F.array(F.when(d, "raw_data_mining"), F.when(r | d, "synthesis")), lambda x: x.isNotNull())
    return both.select("run_id", state.alias("state"), F.array_join(sources, ",").alias("sources"))


def provenance_caption(validated: Column, net_new: Column) -> Column:
    """One sentence on what a synthesized insight is built from."""
    many = lambda n, noun: F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
    return (
        F.when((validated == 0) & (net_new == 0), "New: found by combining findings. No source findings are recorded for it.")
        .when(net_new == 0, F.concat(F.lit("New: combines "), many(validated, "claim"), F.lit(" the report itself made into something none of them said alone.")))
        .when(validated == 0, F.concat(F.lit("New: built entirely from "), many(net_new, "net-new finding"), F.lit(" the report did not contain.")))
        .otherwise(F.concat(F.lit("New: combines "), many(validated, "claim"), F.lit(" from the report with "), many(net_new, "net-new finding"), F.lit(" into something the report did not say.")))
    )


def token_sets(df: DataFrame, key: str, text: str, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(set, words) of the distinct word sets, and (id, set) of the statements; sets are known by a hash of their sorted words, empty ones left out.

    With ``group``, words carry the group's name, so that sets of two groups share none.
    """
    words = F.sort_array(statement_tokens(F.col(text)))
    if group:
        words = F.transform(words, lambda w: F.concat(F.col(group).cast("string"), F.lit(":"), w))
    each = cut(df.select(F.col(key).alias("id"), words.alias("words")).withColumn("set", F.xxhash64(F.array_join("words", " ")))).where(F.size("words") > 0)
    return cut(each.groupBy("set").agg(F.first("words").alias("words"))), each.select("id", "set")


#: Longs of 64 bits in a set's signature; with four, sets of 170 words and more pass for alike.
SIGNATURE_LONGS = 8
_SIGNATURE = [f"s{i}" for i in range(SIGNATURE_LONGS)]
#: Sets of one component that hold a word together and so needn't meet each other there.
FAMILY = 64


def _prefixes(sets: DataFrame, likeness: float, paired: bool = False) -> DataFrame:
    """(w, set, n, k, signature) of the words by which two alike sets can meet; ``paired`` adds a hash of the word and the set's next."""
    hashed = F.pmod(F.xxhash64("w"), F.lit(64 * SIGNATURE_LONGS))
    tokens = sets.select("set", F.size("words").alias("n"), F.explode("words").alias("w"))
    frequency = tokens.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    own = Window.partitionBy("set")
    signature = {s: F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, int(bit % 64))"))).over(own), F.lit(0).cast("long")) for i, s in enumerate(_SIGNATURE)}
    pair = {"pair": F.xxhash64("w", F.lead("w").over(own.orderBy("df", "w")))} if paired else {}
    ranked = tokens.join(frequency, "w").withColumn("bit", hashed).withColumns({"k": F.row_number().over(own.orderBy("df", "w")), **signature, **pair})
    return cut(ranked.where((F.col("k") <= F.col("n") - F.ceil(F.col("n") * likeness - 1e-9) + 1) & (F.col("df") > 1)).select("w", "set", "n", "k", *_SIGNATURE, *pair))


def _near(likeness: float) -> Column:
    """Whether the signatures of rows a and b differ in few enough bits."""
    unlike = F.lit(0)
    for s in _SIGNATURE:
        unlike = unlike + F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")))
    return unlike <= (F.col("a.n") + F.col("b.n")) * ((1 - likeness) / (1 + likeness)) + 1e-9


def _fits(likeness: float) -> Column:
    """Whether the sets of prefix rows a and b can be alike, if this word is the first that they share."""
    room = F.least(F.col("a.n") - F.col("a.k"), F.col("b.n") - F.col("b.k")) + 1
    return (room >= (F.col("a.n") + F.col("b.n")) * (likeness / (1 + likeness)) - 1e-9) & _near(likeness)


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Those of the pairs (a, b, ...) whose sets have the likeness, and that likeness as j."""
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("set").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    j = common / (F.size("wa") + F.size("wb") - common)
    return both.withColumn("j", j).where(F.col("j") >= likeness).select(*pairs.columns, "j")


def similar_sets(sets: DataFrame, likeness: float = DUPLICATE_LIKENESS) -> DataFrame:
    """Pairs (a, b, j) of different word sets with that Jaccard likeness; ``sets`` is read several times, so it should be stored.

    Words are ordered by how many sets hold them; two alike sets share a word of
    their prefixes of n - ceil(likeness n) + 1 rarest words, so only those are
    joined.  Words that only one set holds are dropped first, which leaves
    neither side of the join an aggregate: Spark can split a hot word.

    A row of the join must leave room for enough common words behind its places
    in both prefixes (true of the first word that two alike sets share), and the
    sets' signatures, a bit for each word, may differ in no more bits than alike
    sets differ in words.  Both only leave out pairs that can't be alike, inside
    the join, so hot words cost comparisons but no rows.
    """
    prefix = _prefixes(sets, likeness)
    a, b = prefix.alias("a"), prefix.alias("b")
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.set") < F.col("b.set")) & _fits(likeness)).select(F.col("a.set").alias("a"), F.col("b.set").alias("b")).distinct()
    return _alike(pairs, sets, likeness)


def linked_sets(sets: DataFrame, likeness: float = DUPLICATE_LIKENESS) -> DataFrame:
    """(node, component) of the sets that ``similar_sets`` pairs, as ``connected_components`` gives them, without making all pairs of a family.

    First each set meets one leader for each two words that follow each other in
    its order: the least set of those that have the two.  Then the join of
    ``similar_sets`` takes pairs of different components alone; the largest
    component of a word, from ``FAMILY`` sets on, doesn't meet itself there.  So
    every link lies in a component, found or proven by others.
    """
    prefix = _prefixes(sets, likeness, paired=True)
    leaders = cut(prefix.groupBy("pair").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    met = prefix.select("pair", F.col("set").alias("b")).join(leaders, "pair").where("a <> b").select("a", "b").distinct()
    sketch = prefix.groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", *_SIGNATURE)])
    a, b = sketch.alias("a"), sketch.alias("b")
    near = met.alias("m").join(a, F.col("m.a") == F.col("a.set")).join(b, F.col("m.b") == F.col("b.set")).where(_near(likeness)).select("m.a", "m.b")
    found = cut(connected_components(_alike(near, sets, likeness).select("a", "b")))
    placed = prefix.drop("pair").join(found.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    families = placed.groupBy("w", "component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= FAMILY)
    largest = cut(families.groupBy("w").agg(F.max_by("component", "m").alias("main")))
    rows = placed.join(largest, "w", "left").withColumn("main", F.coalesce(F.col("main") == F.col("component"), F.lit(False)))
    a, b = rows.where("NOT main").alias("a"), rows.alias("b")
    apart = (F.col("a.w") == F.col("b.w")) & (F.col("a.component") != F.col("b.component")) & (F.col("b.main") | (F.col("a.set") < F.col("b.set"))) & _fits(likeness)
    pairs = a.join(b, apart).select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.col("a.component").alias("pa"), F.col("b.component").alias("pb")).distinct()
    more = connected_components(_alike(pairs, sets, likeness).select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    nodes = found.union(more.select("node", F.col("node").alias("component"))).distinct()
    return nodes.join(more.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def similar_statements(df: DataFrame, key: str, text: str, likeness: float = DUPLICATE_LIKENESS) -> DataFrame:
    """Pairs (a, b, likeness) of least ids of word sets that are alike; statements of one set aren't paired with each other."""
    sets, members = token_sets(df, key, text)
    least = members.groupBy("set").agg(F.min("id").alias("id"))
    pairs = similar_sets(sets, likeness).join(least.select(F.col("set").alias("a"), F.col("id").alias("ia")), "a").join(least.select(F.col("set").alias("b"), F.col("id").alias("ib")), "b")
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), jround(F.col("j"), 3).alias("likeness"))


def duplicate_groups(df: DataFrame, key: str, text: str, likeness: float = DUPLICATE_LIKENESS, group: str | None = None) -> DataFrame:
    """(id, group_id): statements with a duplicate, and the least id of their group.  Sets are linked, not statements, so copies cost nothing more."""
    sets, members = token_sets(df, key, text, group)
    part = linked_sets(sets, likeness).withColumnRenamed("node", "set")
    placed = members.join(part, "set", "left").select("id", F.coalesce("component", "set").alias("part"))
    groups = placed.groupBy("part").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return placed.join(groups, "part").select("id", "group_id")


def refreshed_duplicates(findings: DataFrame) -> DataFrame:
    """(finding_id, group_id) of findings that aren't rejected: computed ones by table, cells and wording, others by likeness of wording, run by run."""
    live = findings.where("status <> 'rejected'")
    same = ["run_id", "source_table_id", "source_cells", "finding_text"]
    made = live.where("origin = 'generated'").withColumn("structure", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same]))
    groups = made.groupBy("structure").agg(F.min("finding_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = duplicate_groups(live.where("origin <> 'generated'"), "finding_id", "finding_text", group="run_id")
    return made.join(groups, "structure").select("finding_id", "group_id").union(told.select("id", "group_id"))


def structural_duplicates(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(group_id, n) of rows equal in all columns."""
    return df.groupBy(*columns).agg(F.min(key).alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id", "n")


def downgrade_contradicted(verdicts: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Latest verdict of each finding, set to not_supported where the first contradiction names it; ``previous_tier`` keeps what it was.

    A verdict that has a previous_tier was set before and stays as it is.
    """
    latest = latest_per_key(verdicts, ["finding_id"], F.desc("created_at"), F.desc("verdict_id"))
    first = latest_per_key(contradictions, ["original_id"], F.asc("created_at"), F.asc("contradicting_id")).select(F.col("original_id").alias("finding_id"), "contradicting_id")
    out = latest.join(first, "finding_id", "left")
    before = F.col("previous_tier") if "previous_tier" in verdicts.columns else F.lit(None).cast("string")
    due = F.col("contradicting_id").isNotNull() & before.isNull()
    return out.withColumn("previous_tier", F.when(due, F.col("tier")).otherwise(before)).withColumn("tier", F.when(due, "not_supported").otherwise(F.col("tier")))


def record_contradictions(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Contradictions with new ones added; one that is there already, by original and contradictor, is no news."""
    key = ["original_id", "contradicting_finding_id", "contradicting_synth_id"]
    known = recorded.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in key]).distinct()
    named = found.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k_{c}") for c in key]).dropDuplicates([f"k_{c}" for c in key])
    new = named.join(known.toDF(*[f"k_{c}" for c in key]), [f"k_{c}" for c in key], "left_anti")
    return recorded.unionByName(new.select(*recorded.columns))


def archive(rows: DataFrame, history: DataFrame, key: str, goes: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, history): rows that go are appended to the history unless it has them."""
    gone = rows.where(goes).select(*history.columns).join(history.select(key), key, "left_anti")
    return rows.where(~F.coalesce(goes, F.lit(False))), history.unionByName(gone)


def confidence_tier(members: Column, themes: Column) -> Column:
    """strong for three members and two themes, moderate for either, else exploratory."""
    return F.when((members >= 3) & (themes >= 2), "strong").when((members >= 3) | (themes >= 2), "moderate").otherwise("exploratory")


def insight_tier(*scores: Column) -> Column:
    """Of five scores: qualified from 15, partial from 12, else finding."""
    total = sum(scores[1:], scores[0])
    return F.when(total >= 15, "qualified").when(total >= 12, "partial").when(total.isNotNull(), "finding")


def rating(total: Column, strong: int, workable: int) -> Column:
    """strong, workable or weak; objectives are strong from 16 and workable from 12, recommendations from 12 and 9."""
    return F.when(total >= strong, "strong").when(total >= workable, "workable").when(total.isNotNull(), "weak")


def stability(pool: DataFrame, members: DataFrame, clusters: DataFrame, resamples: int = 5, drop: float = 0.25, cap: int = 60, seed: str = "stability") -> DataFrame:
    """(synth_id, testable, reappeared) over seeded resamples of each run's pool (run_id, insight_id).

    A resample leaves a quarter of the pool out and keeps sixty at most (the
    judge's limit); ``clusters`` (run_id, resample, cluster, insight_id) are the
    groups found in it.  An insight (synth_id, run_id, insight_id) is testable
    where two of its members survive and reappears where some cluster holds half
    of the survivors.
    """
    draws = pool.select("run_id", "insight_id", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), "resample", "insight_id")))
    w = Window.partitionBy("run_id", "resample")
    ranked = draws.withColumn("k", F.row_number().over(w.orderBy("place", "insight_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    dropped = F.floor(F.col("n") * drop)
    kept = ranked.where((F.col("k") > dropped) & (F.col("k") <= dropped + cap)).select("run_id", "resample", "insight_id")
    alive = members.join(kept, ["run_id", "insight_id"])
    testable = alive.groupBy("synth_id", "run_id", "resample").agg(F.count(F.lit(1)).alias("survivors")).where("survivors >= 2")
    overlap = alive.join(clusters, ["run_id", "resample", "insight_id"]).groupBy("synth_id", "resample", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("synth_id", "resample").agg(F.max("n").alias("best"))
    both = testable.join(overlap, ["synth_id", "resample"], "left")
    g = both.groupBy("synth_id").agg(F.count(F.lit(1)).alias("testable"), F.count_if(F.col("best") >= 0.5 * F.col("survivors")).alias("reappeared"))
    return members.select("synth_id").distinct().join(g, "synth_id", "left").na.fill(0, ["testable", "reappeared"])


def cost_usd(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT


def usage_batches(markers: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """(key, batch_at, events, tokens): usage from each marker up to the next, by key; markers without usage count none.

    Markers (key, at) and usage (key, at, tokens) are laid in one line of time
    for each key; the last marker at or before an event owns it.
    """
    both = markers.select(key, "at", F.col("at").alias("mark"), F.lit(None).cast("double").alias("tokens")).union(usage.select(key, "at", F.lit(None).cast(markers.schema["at"].dataType), F.col("tokens").cast("double")))
    w = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    owned = both.withColumn("batch_at", F.max("mark").over(w)).where("batch_at IS NOT NULL")
    return owned.groupBy(key, "batch_at").agg(F.count_if(F.col("mark").isNull()).alias("events"), jround(F.coalesce(F.sum("tokens"), F.lit(0.0)), 2).alias("tokens"))
