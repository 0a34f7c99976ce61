"""Trees of any shape and size as tables: sums to the root, sums of subtrees, best disjoint nodes.

Every function works in rounds that double the reach of each node's pointer, so a chain of n merges takes about log2(n) rounds; a round is one job
over one row a node (and label). Nothing is walked level by level, and no tree of more than ``BLOCK`` nodes is gathered in one place.

Ways to the root are first followed within ranges of ``BLOCK`` node numbers, a task each. Merges are numbered from the leaves up, so a way enters a range
once, and the rounds only double over ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import discard, written


#: Nodes that one task follows.
BLOCK = 1 << 17


def parents_of(merges: DataFrame, leaves: int) -> DataFrame:
    """node and up of every node but the root; merge k makes node ``leaves + k``."""
    up = (F.col("merge_index") + leaves).cast("long").alias("up")
    return merges.select(F.explode(F.array(F.col("left").cast("long"), F.col("right").cast("long"))).alias("node"), up)


def _moving(state: DataFrame) -> bool:
    return not state.filter(F.col("up").isNotNull()).isEmpty()


def _within_ranges(state: DataFrame, sums: tuple[str, ...], nearest: tuple[str, ...], topmost: tuple[str, ...]) -> DataFrame:
    """Rows of ``to_root``, each after the part of its way that is in its own range of nodes."""
    names = state.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.select(names).combine_chunks()
        node, known, m = t["node"].to_numpy(), t["up"].is_valid().to_numpy(), len(t)
        order = np.argsort(node)
        up = t["up"].fill_null(0).to_numpy()
        at = order[np.minimum(np.searchsorted(node[order], up), m - 1)]
        # Row m is the end of all ways: it has no value and leads to itself.
        ahead = np.append(np.where(known & (node[at] == up), at, m), m)
        own = np.append(np.arange(m), -1)
        held = {c: np.append(np.where(t[c].is_valid().to_numpy(), np.arange(m), -1), -1) for c in (*nearest, *topmost)}
        added = {c: np.append(t[c].to_numpy(), 0) for c in sums}
        while (ahead != m).any():
            own = np.where(own[ahead] >= 0, own[ahead], own)
            held |= {c: np.where(held[c] >= 0, held[c], held[c][ahead]) for c in nearest}
            held |= {c: np.where(held[c][ahead] >= 0, held[c][ahead], held[c]) for c in topmost}
            added = {c: x + x[ahead] for c, x in added.items()}
            ahead = ahead[ahead]
        taken = {c: t[c].take(pa.array(np.maximum(x, 0)[:m], mask=(x < 0)[:m])) for c, x in {**held, "up": own}.items()}
        whole = {c: pa.chunked_array([pa.array(x[:m], t[c].type)]) for c, x in added.items()}
        return pa.table([{**taken, **whole}.get(c, t[c]) for c in names], names)

    return state.groupBy(F.floor(F.col("node") / BLOCK).alias("__range")).applyInArrow(run, state.schema)


def to_root(nodes: DataFrame, parents: DataFrame, sums: tuple[str, ...] = (), nearest: tuple[str, ...] = (), topmost: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` (node and values) with the values of the way from each node, itself included, up to its root: ``sums`` are added, ``nearest`` is the
    first that is not null and ``topmost`` the last. ``parents`` has node and up. A node's row covers its way up to ``up``; joined with
    ``up``'s row it covers twice as much."""
    values = [*sums, *nearest, *topmost]
    state = nodes.select("node", *values).join(parents, "node", "left")
    state = written(_within_ranges(state, sums, nearest, topmost), "ways")
    while _moving(state):
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in values])
        met = state.filter(F.col("up").isNotNull()).join(ahead, "up")
        joined = [*[(F.col(c) + F.col(f"__{c}")).alias(c) for c in sums], *[F.coalesce(c, f"__{c}").alias(c) for c in nearest], *[F.coalesce(f"__{c}", c).alias(c) for c in topmost]]
        met = met.select("node", *joined, F.col("__up").alias("up"))
        before, state = state, written(state.filter(F.col("up").isNull()).unionByName(met), "ways")
        discard(before)
    return state.drop("up")


def subtree_sums(rows: DataFrame, parents: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Node, ``keys`` and n of every node: the sums of ``rows`` (node, keys, n) over its subtree. Nodes and keys without a row below have none.

    After round k a node has the sums of everything less than 2^k below it; those of the nodes just 2^k below complete twice the depth.
    """
    add = lambda df: df.groupBy("node", *keys).agg(F.sum("n").alias("n"))
    sums, ups = written(add(rows.select("node", *keys, "n")), "subtrees"), written(parents.select("node", "up"), "ups")
    while not ups.isEmpty():
        below = sums.join(ups, "node").select(F.col("up").alias("node"), *keys, "n")
        old, sums = sums, written(add(sums.unionByName(below)), "subtrees")
        twice = ups.join(ups.select(F.col("node").alias("up"), F.col("up").alias("__up")), "up").select("node", F.col("__up").alias("up"))
        gone, ups = ups, written(twice, "ups")
        discard(old, gone)
    return sums


def first_places(merges: DataFrame, leaves: int, sizes: DataFrame) -> DataFrame:
    """node and ``place``: where the node's first leaf stands when leaves are read from left to right. ``sizes`` has every node's leaves as n."""
    left = merges.select(F.col("left").cast("long").alias("node"), F.col("right").cast("long").alias("beside"))
    shift = left.join(sizes, "node").select(F.col("beside").alias("node"), F.col("n").alias("place"))
    every = sizes.select("node").join(shift, "node", "left").select("node", F.coalesce("place", F.lit(0)).cast("long").alias("place"))
    return to_root(every, parents_of(merges, leaves), sums=("place",))


def is_small(tree: DataFrame) -> bool:
    """Whether one task may have the whole tree."""
    return tree.limit(BLOCK + 1).count() <= BLOCK


def from_left(tree: DataFrame) -> DataFrame:
    """node, ``place`` (of nodes in the order of their first leaves, a node before those below it) and ``best`` (see ``best_disjoint``; null scores count as
    0) of a small tree (node, left, right, score), in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, score = pdf["node"].to_numpy(), pdf["score"].fillna(0.0).to_numpy(float)
        sides = {n: (int(a), int(b)) for n, a, b in zip(ids.tolist(), pdf["left"], pdf["right"]) if pd.notna(a)}
        best, order = dict(zip(ids.tolist(), score.tolist())), []
        stack = sorted(set(best) - {c for pair in sides.values() for c in pair})
        while stack:
            order.append(stack.pop())
            stack += sides.get(order[-1], ())[::-1]
        for n in reversed(order):
            if n in sides:
                best[n] = max(best[n], sum(best[c] for c in sides[n]))
        return pd.DataFrame({"node": order, "place": range(len(order)), "best": [best[n] for n in order]})

    return tree.select(F.lit(0).alias("__all"), "node", "left", "right", "score").groupBy("__all").applyInPandas(run, "node long, place long, best double")


def best_disjoint(tree: DataFrame) -> DataFrame:
    """node and ``best``: the largest total score of disjoint nodes in its subtree, max(score, best of left + best of right).

    ``tree`` has node, left, right (both null at leaves) and score, none below 0. Gibbons and Rytter's pebbles, all nodes at once in each round: a node
    with both children known is known; with one known it becomes the function x -> max(p, x + q) of the other, ``down``; such a function
    of a function is a function again; a function of a known node is known. Any tree takes a logarithmic number of rounds. A small
    tree is gone through in one task.
    """
    if is_small(tree):
        return from_left(tree).select("node", "best")
    no = F.lit(None).cast("double")
    state = tree.select("node", "left", "right", "score", F.when(F.col("left").isNull(), F.col("score")).otherwise(no).alias("best"), F.lit(None).cast("long").alias("down"), no.alias("p"), no.alias("q"))
    state = written(state, "pebbles")
    while not state.filter(F.col("best").isNull()).isEmpty():
        done, open_ = state.filter(F.col("best").isNotNull()), state.filter(F.col("best").isNull())
        known = done.select("node", "best")
        x, y = known.select(F.col("node").alias("left"), F.col("best").alias("x")), known.select(F.col("node").alias("right"), F.col("best").alias("y"))
        pair = open_.filter(F.col("down").isNull()).drop("best", "down", "p", "q").join(x, "left", "left").join(y, "right", "left")
        one = F.col("x").isNull() != F.col("y").isNull()
        pair = pair.select(
            "node", "left", "right", "score", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("score", F.col("x") + F.col("y"))).alias("best"),
            F.when(one, F.when(F.col("x").isNull(), F.col("left")).otherwise(F.col("right"))).alias("down"), F.when(one, F.col("score")).alias("p"), F.when(one, F.coalesce("x", "y")).alias("q"),
        )
        ahead = state.select(F.col("node").alias("down"), F.col("best").alias("b"), F.col("down").alias("d"), F.col("p").alias("p2"), F.col("q").alias("q2"))
        way = open_.filter(F.col("down").isNotNull()).join(ahead, "down")
        far = F.col("d").isNotNull()
        way = way.select(
            "node", "left", "right", "score", F.when(F.col("b").isNotNull(), F.greatest("p", F.col("b") + F.col("q"))).alias("best"), F.when(far, F.col("d")).otherwise(F.col("down")).alias("down"),
            F.when(far, F.greatest("p", F.col("p2") + F.col("q"))).otherwise(F.col("p")).alias("p"), F.when(far, F.col("q") + F.col("q2")).otherwise(F.col("q")).alias("q"),
        )
        before, state = state, written(done.unionByName(pair).unionByName(way), "pebbles")
        discard(before)
    return state.select("node", "best")

