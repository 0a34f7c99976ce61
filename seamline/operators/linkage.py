"""Hierarchies of datasets of any size (C1-C3, A38, K10): no task has more than a block of a dataset.

A dataset of at most ``LEAVES`` groups is one block: a task merges it in a matrix of 128 MB at most, and many small datasets are as many tasks without
a round of jobs. Larger ones have no dense matrix anywhere:

* Single linkage is the minimum spanning tree. The tiles of all distances below 1 are gone through once: each passes on its own forest of them, and
  Boruvka's rounds find the tree's among those, until at most ``EDGES`` edges are left between components: one task takes the rest of the
  tree from them. Whatever is then still apart is 1 apart and hangs on the smallest set.
  The tree's edges in order become merges by halving their range of ranks: the lighter half's components are contracted for the
  heavier half, until a range has at most ``BLOCK`` edges and one task joins them one by one.
* Complete, average and weighted linkage merge all pairs of mutual nearest neighbours at once. That is exact, since a merged cluster is never nearer to
  a third one than both its parts were; the distances of the merged clusters are one aggregate over the table of pairs. That
  table has n^2 / 2 rows at first, spread over all tasks.

Ties have one order everywhere, by distance and then by the two clusters' smallest leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import discard, numbered, written
from . import kernels, tiles

#: Edges of a spanning tree that one task joins.
BLOCK = 1 << 17

#: Edges from which one task takes a dataset's spanning tree.
EDGES = 1 << 19

#: Groups of a dataset that one task merges.
LEAVES = 1 << 12

#: Rows of a block's matrix that are rounded or masked at once.
STRIP = 256

MERGES = ("merge_index", "left", "right", "distance", "count")


def leaves_of(groups: DataFrame, by: list[str]) -> DataFrame:
    """by, g (leaf number from 0 in order of group_index), columns and member_count of every group; written."""
    made = numbered(groups.select(*by, "group_index", F.array_distinct("columns").alias("columns"), "member_count"), [*by, "group_index"], "g")
    first = made.groupBy(*by).agg(F.min("g").alias("__first"))
    return written(made.join(first, by).withColumn("g", F.col("g") - F.col("__first")).drop("__first"), "leaves")


# ---- components

def roots_of(hooks: DataFrame, by: list[str]) -> DataFrame:
    """c and ``root`` of components (c) that each hook on to another one (p): pairs that hook on to each other are led by the smaller one, then
    every pointer is doubled until it has arrived. Written."""
    back = hooks.select(*by, F.col("c").alias("p"), F.col("p").alias("__pp"))
    first = hooks.join(back, [*by, "p"], "left").select(*by, "c", F.when((F.col("__pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    state = written(first, "hooks")
    while True:
        ahead = state.select(*by, F.col("c").alias("p"), F.col("p").alias("__p"))
        step = written(state.join(ahead, [*by, "p"]).select(*by, "c", F.col("__p").alias("p"), (F.col("__p") != F.col("p")).alias("moved")), "hooks")
        discard(state)
        if step.filter("moved").isEmpty():
            return step.select(*by, "c", F.col("p").alias("root"))
        state = step.drop("moved")


def moved(comps: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """``comps`` (by, g, comp) after their components have gone over to their roots; written."""
    new = comps.join(roots.withColumnRenamed("c", "comp"), [*by, "comp"], "left")
    return written(new.select(*by, "g", F.coalesce("root", "comp").alias("comp")), "components")


def forest_components(edges: DataFrame, by: list[str]) -> DataFrame:
    """g and comp of every end of ``edges`` (by, rank, u, v), a forest with ranks of its own for every dataset. Each round takes every component's edge of
    the smallest rank."""
    ends = edges.select(*by, F.explode(F.array("u", "v")).alias("g")).distinct()
    comps = written(ends.select(*by, "g", F.col("g").alias("comp")), "components")
    left = edges.select(*by, "rank", "u", "v")
    while not left.isEmpty():
        both = left.select(*by, F.col("u").alias("c"), "rank", F.col("v").alias("p")).unionByName(left.select(*by, F.col("v").alias("c"), "rank", F.col("u").alias("p")))
        hooks = both.groupBy(*by, "c").agg(F.min(F.struct("rank", "p")).alias("e")).select(*by, "c", "e.p")
        roots = roots_of(hooks, by)
        before, comps = comps, moved(comps, roots, by)
        u, v = (roots.select(*by, F.col("c").alias(x), F.col("root").alias(f"__{x}")) for x in "uv")
        left = written(left.join(u, [*by, "u"]).join(v, [*by, "v"]).select(*by, "rank", F.col("__u").alias("u"), F.col("__v").alias("v")).filter("u <> v"), "edges")
        discard(before, roots)
    return comps


# ---- single linkage

def spanning_tree(sets: DataFrame, by: list[str], metric: str, width: int | None = None) -> DataFrame:
    """by, i, j and distance of the edges of every dataset's minimum spanning tree. ``sets`` has by, g, columns and perhaps core. Written."""
    comps = written(sets.select(*by, "g", F.col("g").alias("comp")), "components")
    edges, found = written(tiles.forests(sets, by, metric, width), "edges"), []
    while True:
        u, v = (comps.select(*by, F.col("g").alias(x), F.col("comp").alias(f"__{x}")) for x in "ij")
        met = edges.select(*by, "i", "j", "distance").join(u, [*by, "i"]).join(v, [*by, "j"]).filter("__i <> __j")
        before, edges = edges, written(met, "edges")
        discard(before)
        most = edges.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if most <= EDGES:
            break
        ends = edges.select(*by, "i", "j", "distance", F.explode(F.array(F.struct(F.col("__i").alias("c"), F.col("__j").alias("p")), F.struct(F.col("__j").alias("c"), F.col("__i").alias("p")))).alias("e"))
        best = ends.groupBy(*by, F.col("e.c").alias("c")).agg(F.min(F.struct("distance", "i", "j", "e.p")).alias("e"))
        best = written(best.select(*by, "c", "e.*"), "nearest")
        found.append(best)
        roots = roots_of(best.select(*by, "c", "p"), by)
        before, comps = comps, moved(comps, roots, by)
        discard(before, roots)
    if most:
        last = written(edges.groupBy(*by).applyInPandas(lambda key, pdf: tiles.keyed(last_edges(pdf), by, key), tiles.schema_of(edges, by, "i long, j long, distance double")), "last-edges")
        roots = last.filter("distance IS NULL").select(*by, F.col("i").alias("c"), F.col("j").alias("root"))
        before, comps = comps, moved(comps, roots, by)
        discard(before)
        found.append(last.filter("distance IS NOT NULL"))
    # What is still apart is 1 apart, and the first such pairs in order are those of the smallest set.
    least = comps.groupBy(*by, "comp").agg(F.min("g").alias("j"))
    rest = least.join(least.groupBy(*by).agg(F.min("j").alias("i")), by).filter("i <> j").select(*by, "i", "j", F.lit(1.0).alias("distance"))
    for more in found:
        rest = rest.unionByName(more.select(*by, "i", "j", "distance").distinct())
    tree = written(rest.distinct(), "spanning-tree")
    discard(*found, edges, comps)
    return tree


def last_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """i, j and distance of the spanning forest's edges among i, j and distance between components __i and __j. Rows without a distance follow: component i
    is now part of j."""
    pdf = pdf.sort_values(["distance", "i", "j"])
    names, place = np.unique(pdf[["__i", "__j"]].to_numpy().ravel(), return_inverse=True)
    u, v = place.reshape(-1, 2).T
    kept, root = tiles.forest_and_roots(u, v, len(names))
    return pd.concat([pdf.iloc[kept][["i", "j", "distance"]], pd.DataFrame({"i": names, "j": names[root], "distance": np.nan})])


def joined_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of a range of ranks: edges between nodes (u, v) of known members (wu, wv), in order of rank. n + rank names a merge's node."""
    pdf = pdf.sort_values("rank")
    names, place = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    owner, node, size = list(range(len(names))), names.tolist(), [0] * len(names)
    for k, w in zip(place.tolist(), pdf[["wu", "wv"]].to_numpy().ravel().tolist()):
        size[k] = w

    def find(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    out = []
    for (a, b), rank, n, height in zip(place.reshape(-1, 2).tolist(), pdf["rank"].tolist(), pdf["n"].tolist(), pdf["distance"].tolist()):
        a, b = find(a), find(b)
        out.append((rank, min(node[a], node[b]), max(node[a], node[b]), height, size[a] + size[b]))
        owner[b], node[a], size[a] = a, n + rank, size[a] + size[b]
    return pd.DataFrame(out, columns=list(MERGES))


def merges_of_tree(tree: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """Merges of a spanning tree (by, i, j, distance): its edges in order of distance, i and j. ``leaves`` has by, g and member_count."""
    ranked = numbered(tree, [*by, "distance", "i", "j"], "rank")
    sizes = ranked.groupBy(*by).agg(F.min("rank").alias("__first"), (F.count("*") + 1).alias("n"))
    edges = ranked.join(sizes, by).withColumn("rank", F.col("rank") - F.col("__first"))
    u, v = (leaves.select(*by, F.col("g").alias(x), F.col("member_count").alias(w)) for x, w in (("i", "wu"), ("j", "wv")))
    columns = [*by, "rank", "distance", "n", "u", "v", "wu", "wv"]
    edges = edges.join(u, [*by, "i"]).join(v, [*by, "j"]).withColumnsRenamed({"i": "u", "j": "v"})
    edges = written(edges.select(*columns), "ranked-edges")
    most = edges.agg(F.coalesce(F.max("n") - 1, F.lit(0))).first()[0]
    bits = max(1, int(most)).bit_length()
    while (1 << bits) > BLOCK:
        bits -= 1
        # Ranges are named by the bits above; the next one tells the lighter half from the heavier.
        light = F.shiftright("rank", bits).bitwiseAND(F.lit(1).cast("long")) == 0
        low = written(edges.filter(light), "lighter")
        comps = forest_components(low, by)
        weights = low.select(*by, F.col("u").alias("g"), F.col("wu").alias("w")).unionByName(low.select(*by, F.col("v").alias("g"), F.col("wv").alias("w"))).distinct()
        sizes = comps.join(weights, [*by, "g"]).groupBy(*by, "comp").agg(F.sum("w").alias("w"))
        tops = low.join(comps.withColumnRenamed("g", "u"), [*by, "u"]).groupBy(*by, "comp").agg((F.max("rank") + F.first("n")).alias("node"))
        named = written(comps.join(tops, [*by, "comp"]).join(sizes, [*by, "comp"]).select(*by, "g", "node", "w"), "contracted")
        high = edges.filter(~light)
        for x in "uv":
            to = named.select(*by, F.col("g").alias(x), F.col("node").alias("__node"), F.col("w").alias("__w"))
            high = high.join(to, [*by, x], "left").withColumn(x, F.coalesce("__node", x)).withColumn(f"w{x}", F.coalesce("__w", f"w{x}")).drop("__node", "__w")
        before, edges = edges, written(low.unionByName(high.select(*columns)), "ranked-edges")
        discard(before, low, comps, named)
    rest = "merge_index long, left long, right long, distance double, count long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return tiles.keyed(joined_block(pdf), by, tuple(key[:-1]))

    made = edges.withColumn("__range", F.shiftright("rank", bits)).groupBy(*by, "__range").applyInPandas(run, tiles.schema_of(edges, by, rest))
    return typed(made, by)


def typed(merges: DataFrame, by: list[str]) -> DataFrame:
    whole = [F.col(c).cast("int").alias(c) for c in ("merge_index", "left", "right")]
    return merges.select(*by, *whole, "distance", "count")


# ---- complete, average and weighted linkage

#: Digits to which distances are compared, so that the order of additions does not decide ties.
DIGITS = 12

#: The distance of two clusters from those of their parts.
PARTS = {
    "complete": F.max,
    "weighted": F.avg,
    "average": None,
    "average_deduplicated": None,
}


def reciprocal(leaves: DataFrame, by: list[str], metric: str, method: str) -> DataFrame:
    """Merges by rounds of mutual nearest neighbours. A cluster is named by its smallest leaf.

    Merges are ordered by height, then by ``level`` - one more than that of a part of the same height - and by the clusters' names.
    """
    weigh = F.col("member_count") if method == "average" else F.lit(1).cast("long")
    state = written(leaves.select(*by, F.col("g").alias("c"), weigh.alias("w"), F.col("member_count").alias("n"), F.col("g").alias("node"), F.lit(-1.0).alias("height"), F.lit(0).alias("level")), "clusters")
    pairs = written(tiles.pairs(leaves, by, metric).select(*by, "i", "j", F.col("distance").alias("d")), "pairs")
    total = leaves.groupBy(*by).agg(F.count("*").alias("leaves"))
    most = leaves.count() + 1
    done, turn = [], 0
    while True:
        turn += 1
        key = F.struct(F.round("d", DIGITS).alias("r"), "i", "j")
        ends = pairs.select(*by, F.explode(F.array("i", "j")).alias("c"), key.alias("k"))
        chosen = ends.groupBy(*by, "c").agg(F.min("k").alias("k")).groupBy(*by, "k.r", "k.i", "k.j").agg(F.count("*").alias("votes")).filter("votes = 2")
        part = lambda x: state.select(*by, F.col("c").alias(x), *[F.col(v).alias(f"{v}_{x}") for v in ("w", "n", "node", "height", "level")])
        made = chosen.join(part("i"), [*by, "i"]).join(part("j"), [*by, "j"])
        higher = lambda x: F.when(F.col(f"height_{x}") >= F.col("r"), F.col(f"level_{x}") + 1).otherwise(0)
        # Rounding may put a part above its merge by a last digit; a merge is never below its parts.
        height = F.greatest("r", "height_i", "height_j")
        made = made.select(*by, F.col("i").alias("c"), F.col("j").alias("gone"), (F.col("w_i") + F.col("w_j")).alias("w"), (F.col("n_i") + F.col("n_j")).alias("n"), F.col("node_i").alias("x"), F.col("node_j").alias("y"), height.alias("height"), F.greatest(higher("i"), higher("j")).alias("level"))
        # Until all are numbered, a merge is named by its round and cluster.
        made = written(made.withColumn("node", F.col("c") + F.lit(turn).cast("long") * most), "merged")
        if made.isEmpty():
            break
        done.append(made)
        into = made.select(*by, F.col("gone").alias("c"), F.col("c").alias("to"))
        pairs, old_pairs = _merged_pairs(pairs, state, into, made, by, method), pairs
        kept = state.join(made.select(*by, F.explode(F.array("c", "gone")).alias("c")), [*by, "c"], "left_anti")
        state, old = written(kept.unionByName(made.select(*by, "c", "w", "n", "node", "height", "level")), "clusters"), state
        discard(old_pairs, old)
    if not done:
        return typed(made.select(*by, F.col("c").alias("merge_index"), F.col("x").alias("left"), F.col("y").alias("right"), F.col("height").alias("distance"), F.col("n").alias("count")), by)
    merges = done[0]
    for more in done[1:]:
        merges = merges.unionByName(more)
    placed = numbered(merges, [*by, "height", "level", "c", "gone"], "k")
    first = placed.groupBy(*by).agg(F.min("k").alias("__first"))
    placed = written(placed.join(first, by).join(total, by).select(*by, "node", "x", "y", "height", "n", (F.col("k") - F.col("__first")).alias("k"), "leaves"), "merges")
    names = placed.select(*by, "node", (F.col("leaves") + F.col("k")).alias("at"))
    for x in "xy":
        placed = placed.join(names.select(*by, F.col("node").alias(x), F.col("at").alias(f"at_{x}")), [*by, x], "left")
    a, b = F.coalesce("at_x", "x"), F.coalesce("at_y", "y")
    out = written(typed(placed.select(*by, F.col("k").alias("merge_index"), F.least(a, b).alias("left"), F.greatest(a, b).alias("right"), F.col("height").alias("distance"), F.col("n").alias("count")), by), "merges")
    discard(*done, state)
    return out


def _merged_pairs(pairs: DataFrame, state: DataFrame, into: DataFrame, made: DataFrame, by: list[str], method: str) -> DataFrame:
    """The pairs of the clusters after a round; written."""
    weights = state.select(*by, "c", "w").join(into, [*by, "c"], "left")
    for x in "ij":
        pairs = pairs.join(weights.select(*by, F.col("c").alias(x), F.col("w").alias(f"w_{x}"), F.coalesce("to", "c").alias(f"to_{x}")), [*by, x])
    pairs = pairs.filter("to_i <> to_j").select(*by, F.least("to_i", "to_j").alias("i"), F.greatest("to_i", "to_j").alias("j"), "d", (F.col("w_i") * F.col("w_j")).cast("double").alias("w"))
    whole = F.sum(F.col("w") * F.col("d")) / F.sum("w")
    return written(pairs.groupBy(*by, "i", "j").agg((PARTS[method]("d") if PARTS[method] else whole).alias("d")), "pairs")


# ---- one block

def block_distances(sets: list, metric: str) -> np.ndarray:
    """All distances of a block's sets; a set's distance to itself is infinite."""
    d = np.empty((len(sets), len(sets)))
    for a in range(0, len(sets), STRIP):
        d[a : a + STRIP] = kernels.cross_distances(sets[a : a + STRIP], sets, metric)
    np.fill_diagonal(d, np.inf)
    return d


def block_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spanning tree's i and j, in order of distance, i and j: Boruvka's rounds on a matrix."""
    n, comp, edges = len(d), np.arange(len(d)), set()
    while (comp != comp[0]).any():
        y, near = np.empty(n, np.int64), np.empty(n)
        for a in range(0, n, STRIP):
            part = np.where(comp[a : a + STRIP, None] == comp[None, :], np.inf, d[a : a + STRIP])
            y[a : a + STRIP] = part.argmin(axis=1)
            near[a : a + STRIP] = part.min(axis=1)
        i, j = np.minimum(np.arange(n), y), np.maximum(np.arange(n), y)
        order = np.lexsort((j, i, near, comp))
        first = order[np.r_[True, np.diff(comp[order]) != 0]]
        edges.update(zip(i[first].tolist(), j[first].tolist()))
        comp = tiles.led(comp[first], comp[y[first]], n)[comp]
    i, j = np.array(sorted(edges), np.int64).reshape(-1, 2).T
    order = np.lexsort((j, i, d[i, j]))
    return i[order], j[order]


def block_merges(d: np.ndarray, members: np.ndarray, method: str) -> pd.DataFrame:
    """Merges of a block by the rounds of ``reciprocal``. ``d`` is used up.

    A cluster keeps its nearest one. After a round only those look again whose nearest one was merged and is now farther away, so that many
    equal distances cost a row a merge and not a matrix.
    """
    n, every = len(d), np.arange(len(d))
    w = members.astype(float) if method == "average" else np.ones(n)
    size, node, height, level, alive = members.astype(np.int64), every.copy(), np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
    near, apart = np.zeros(n, np.int64), np.zeros(n)

    def look(rows: np.ndarray) -> None:
        for a in range(0, len(rows), STRIP):
            at = rows[a : a + STRIP]
            r = np.round(d[at], DIGITS)
            near[at] = r.argmin(axis=1)
            apart[at] = r[np.arange(len(at)), near[at]]

    def joined(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> np.ndarray:
        if method == "complete":
            return np.maximum(x, y)
        return (x + y) / 2 if method == "weighted" else (wx * x + wy * y) / (wx + wy)

    look(every)
    made = []
    while n - sum(map(len, (m[0] for m in made))) > 1:
        live = np.flatnonzero(alive)
        stay = live[(near[near[live]] == live) & (live < near[live])]
        gone = near[stay]
        r = apart[stay]
        above = lambda x: np.where(height[x] >= r, level[x] + 1, 0)  # noqa: B023, E731
        level[stay], height[stay] = np.maximum(above(stay), above(gone)), np.maximum(r, np.maximum(height[stay], height[gone]))
        size[stay] += size[gone]
        made.append((stay, gone, node[stay], node[gone], height[stay], level[stay], size[stay]))
        node[stay] = n * len(made) + stay
        new = joined(d[stay], d[gone], w[stay, None], w[gone, None])
        new[:, stay] = joined(new[:, stay], new[:, gone], w[stay], w[gone])
        new[:, gone] = np.inf
        new[np.arange(len(stay)), stay] = np.inf
        d[stay], d[:, stay] = new, new.T
        d[gone], d[:, gone] = np.inf, np.inf
        w[stay] += w[gone]
        alive[gone] = False
        touched = np.zeros(n, bool)
        touched[stay] = touched[gone] = True
        new = np.round(new, DIGITS)
        best = new.argmin(axis=0)
        at, to = new[best, every], stay[best]
        closer = alive & ~touched & ((at < apart) | ((at == apart) & (to <= near)))
        again = alive & (touched | touched[near]) & ~closer
        near[closer], apart[closer] = to[closer], at[closer]
        look(np.flatnonzero(again))
    stay, gone, x, y, h, rank, size = map(np.concatenate, zip(*made))
    order = np.lexsort((gone, stay, rank, h))
    round_ = np.repeat(np.arange(1, len(made) + 1), [len(m[0]) for m in made])
    names = dict(zip((n * round_ + stay)[order].tolist(), range(n, 2 * n)))
    a, b = (np.array([names.get(v, v) for v in side[order].tolist()]) for side in (x, y))
    return pd.DataFrame({"merge_index": np.arange(len(order)), "left": np.minimum(a, b), "right": np.maximum(a, b), "distance": h[order], "count": size[order]})


def blocks(leaves: DataFrame, by: list[str], metric: str, linkage: str) -> DataFrame:
    """Merges of datasets that are a block each."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        n, members = len(pdf), pdf["member_count"].to_numpy()
        if n < 2:
            return pd.DataFrame(columns=[*by, *MERGES])
        d = block_distances([list(c) for c in pdf["columns"]], metric)
        if linkage == "single":
            i, j = block_tree(d)
            made = joined_block(pd.DataFrame({"rank": np.arange(n - 1), "distance": d[i, j], "n": n, "u": i, "v": j, "wu": members[i], "wv": members[j]}))
        else:
            made = block_merges(d, members, linkage)
        return tiles.keyed(made, by, key)

    rest = "merge_index long, left long, right long, distance double, count long"
    return typed(leaves.groupBy(*by).applyInPandas(run, tiles.schema_of(leaves, by, rest)), by)


# ---- any linkage

def hierarchy(groups: DataFrame, metric: str, linkage: str, by: list[str], block: int = 0) -> DataFrame:
    """By, merge_index, left, right, distance and count of every dataset. Leaves are its groups in order of group_index, from 0. Datasets of
    at most ``block`` leaves are merged in one task each, with the same result."""
    leaves = leaves_of(groups, by)
    if leaves.filter("member_count <= 0").limit(1).count():
        raise ValueError("member counts must be positive")
    if block:
        size = leaves.groupBy(*by).agg(F.count("*").alias("__n"))
        small = size.filter(F.col("__n") <= block).drop("__n")
        made = blocks(leaves.join(small, by, "left_semi"), by, metric, linkage)
        if size.filter(F.col("__n") > block).isEmpty():
            return made
        return made.unionByName(_rounds(leaves.join(small, by, "left_anti"), metric, linkage, by))
    return _rounds(leaves, metric, linkage, by)


def _rounds(leaves: DataFrame, metric: str, linkage: str, by: list[str]) -> DataFrame:
    if linkage == "single":
        return merges_of_tree(spanning_tree(leaves.select(*by, "g", "columns"), by, metric), leaves, by)
    return reciprocal(leaves.select(*by, "g", "columns", "member_count"), by, metric, linkage)
