"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random lines.  On each line, sorted, every
query has a window of fixed half-width around its own place; a vector in it is
one collision.  Pairs with enough collisions are verified by cosine in double
precision.  The count needed is calibrated: it is the largest that a pair just
at the threshold reaches with the target recall.

Equal vectors are one class with a weight, so copies are never paired.  Work is
dealt by (label, cell of a leading line, sub-block): only equal or adjacent
cells can hold windows that meet, and sub-blocks bound what a task holds.  Tasks
return link counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.words import least_reachable
from tabulon.plans.components import connected_components
from tabulon.plans.lineage import cut

THRESHOLD = 0.93
LINES = 40
#: Half-width of a window, in distances of a pair just at the threshold.
WINDOW = 1.0
RECALL = 0.998
#: Width of a cell of the leading line, in the same unit: a pair at the threshold differs by more with odds of 1 to 1000.
CELL = 3.3
#: Vectors of a sub-block, about.
BLOCK = 1024
SEED = 7


def distance_at(threshold: float) -> float:
    """Distance of two unit vectors of that cosine."""
    return math.sqrt(2 - 2 * threshold)


def collisions_needed(lines: int, window: float, recall: float) -> int:
    """Largest count that a pair at the threshold distance reaches with probability ``recall``.

    The difference of two projections is normal with the distance as deviation,
    so a line collides with probability erf(window / sqrt 2).
    """
    p = math.erf(window / math.sqrt(2))
    tail, need = 1.0, 0
    while need < lines:
        tail -= math.comb(lines, need) * p**need * (1 - p) ** (lines - need)
        if tail < recall:
            break
        need += 1
    return need


def _unit(vecs: pd.Series) -> np.ndarray:
    """Unit vectors of one length, scaled first so that no square overflows."""
    v = np.stack([np.asarray(x, float) for x in vecs])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def projections(vectors: np.ndarray, lines: int, seed: int) -> np.ndarray:
    """One column a line; the lines depend on the dimension, number and seed only."""
    return vectors @ np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], lines))


def colliding_pairs(q: np.ndarray, x: np.ndarray, half: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, other) that share at least ``need`` windows; q and x hold one column a line, under 65,536 rows each.

    On a sorted line a window is a range of ranks, so a line takes three array steps for all pairs.
    """
    count = np.zeros((len(q), len(x)), np.uint8)
    rank = np.empty(len(x), np.uint16)
    for line in range(q.shape[1]):
        order = np.argsort(x[:, line], kind="stable")
        lined = x[order, line]
        low = np.searchsorted(lined, q[:, line] - half, "left").astype(np.uint16)
        high = np.searchsorted(lined, q[:, line] + half, "right").astype(np.uint16)
        rank[order] = np.arange(len(x), dtype=np.uint16)
        # Ranks below the window wrap around to large numbers.
        count += rank[None, :] - low[:, None] < (high - low)[:, None]
    return np.nonzero(count >= need)


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, lines: int = LINES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Two vectors link when their labels are equal and not null and their cosine
    is at least ``threshold``.  Null, empty and zero vectors, those with null or
    non-finite components, and null labels link with nothing; vectors of other
    lengths under the same label don't link either.  Each row is a vector of its
    own: repeated rows link as copies do, and different vectors under one id, or
    under none, have each their own links.  n_links counts other rows;
    component_id is the least id that isn't null among the rows reachable, null
    if there is none; kept marks the rows of that id.
    """
    vec = F.col("embedding").cast("array<double>")
    sound = F.coalesce(
        F.col("label").isNotNull()
        & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        & F.exists(vec, lambda c: c != 0),
        F.lit(False),
    )
    rows = embeddings.select("vec_id", "label", vec.alias("vec"), sound.alias("sound"))
    good = rows.where("sound")
    # A class is named by a hash of what makes it, as ids may repeat or be null.
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.xxhash64("label", "vec"))
    width = CELL * distance_at(threshold)

    @F.pandas_udf("int")
    def cell(vecs: pd.Series) -> pd.Series:
        lengths, out = vecs.map(len).to_numpy(), np.zeros(len(vecs), np.int32)
        for dim in np.unique(lengths):
            own = np.flatnonzero(lengths == dim)
            out[own] = np.floor(projections(_unit(vecs.iloc[own]), 1, seed + 1)[:, 0] / width)
        return pd.Series(out)

    placed = cut(classes.withColumn("cell", cell("vec")))
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("subs"))
    after = sizes.select("label", (F.col("cell") - 1).alias("cell"), F.col("subs").alias("subs_after"))
    before = sizes.select("label", (F.col("cell") + 1).alias("cell"), F.col("subs").alias("subs_before"))
    around = sizes.join(after, ["label", "cell"], "left").join(before, ["label", "cell"], "left").na.fill(0, ["subs_after", "subs_before"])
    sub = F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int")

    def to(cell_col, first, second, side):
        return F.struct(cell_col.alias("at"), first.cast("int").alias("i"), second.cast("int").alias("j"), F.lit(side).alias("side"))

    # Tasks of a cell: its own pairs of sub-blocks (i <= j, j < 2**20), and each of its sub-blocks with each of the next cell.
    shift = 1 << 20
    dealt = placed.join(around, ["label", "cell"]).withColumn("sub", sub)
    tasks = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("subs") - 1), lambda o: to(F.col("cell"), F.least(F.col("sub"), o), F.greatest(F.col("sub"), o), 2)),
        F.when(F.col("subs_after") > 0, F.transform(F.sequence(F.lit(0), F.col("subs_after") - 1), lambda o: to(F.col("cell"), F.col("sub"), o + shift, 0))).otherwise(F.array()),
        F.when(F.col("subs_before") > 0, F.transform(F.sequence(F.lit(0), F.col("subs_before") - 1), lambda o: to(F.col("cell") - 1, o, F.col("sub") + shift, 1))).otherwise(F.array()),
    )
    work_rows = dealt.select("label", "rep", "weight", "vec", "sub", F.explode(tasks).alias("t")).select(
        "label", "rep", "weight", "vec", F.col("t.at").alias("at"), F.col("t.i").alias("i"), F.col("t.j").alias("j"),
        # Which side of the task the row is on: 0 query, 1 other, 2 both (a sub-block with itself).
        F.when(F.col("t.side") < 2, F.col("t.side")).when(F.col("t.i") == F.col("t.j"), 2).when(F.col("sub") == F.col("t.i"), 0).otherwise(1).alias("side"),
    )
    half, need = WINDOW * distance_at(threshold), collisions_needed(lines, WINDOW, RECALL)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        reps, weights, sides = pdf["rep"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64), pdf["side"].to_numpy()
        lengths = pdf["vec"].map(len).to_numpy()
        links, edges_a, edges_b = np.zeros(len(pdf), np.int64), [], []
        for dim in np.unique(lengths):
            own = np.flatnonzero(lengths == dim)
            u = _unit(pdf["vec"].iloc[own])
            p = projections(u, lines, seed)
            qs, xs = np.flatnonzero(sides[own] != 1), np.flatnonzero(sides[own] != 0)
            if not len(qs) or not len(xs):
                continue
            a, b = colliding_pairs(p[qs], p[xs], half, need)
            a, b = qs[a], xs[b]
            keep = (a < b) | (sides[own[a]] != 2)
            a, b = a[keep], b[keep]
            near = [np.einsum("ij,ij->i", u[a[s : s + 65536]], u[b[s : s + 65536]]) >= threshold for s in range(0, len(a), 65536)]
            near = np.concatenate(near) if near else np.zeros(0, bool)
            a, b = own[a[near]], own[b[near]]
            np.add.at(links, a, weights[b])
            np.add.at(links, b, weights[a])
            edges_a.append(a)
            edges_b.append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges_a, edges_b))
        root = least_reachable(len(pdf), a, b)
        some = links > 0
        return pd.DataFrame({"rep": reps[some], "links": links[some], "other": reps[root[some]]})

    found = cut(work_rows.groupBy("label", "at", "i", "j").applyInPandas(link, "rep long, links long, other long"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = component.withColumnRenamed("node", "rep")
    least = placed.select("rep", "least").join(linked, "rep").groupBy("component").agg(F.min("least").alias("least_of_all"))
    known = (
        placed.select("label", "vec", "rep", "least", "weight")
        .join(totals, "rep", "left")
        .join(linked.join(least, "component"), "rep", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("least_of_all")).alias("c"))
    )
    # The cut lets Spark split the many rows of a very common vector: neither side of the join is an aggregate.
    known = cut(known)
    linked = good.join(known, ["label", "vec"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
