"""Dendrogram nodes of a clustering."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered, written
from . import kernels, trees

NODES = (
    "node_id int, parent_id int, depth int, angle double, radius_depth double, radius_distance double, x_depth double, y_depth double, x_distance double, y_distance double, "
    "merge_distance double, collapsed boolean, is_leaf boolean, subtree_leaf_count int, raw_subtree_leaf_count int, member_count long, cluster_label int, cluster_purity double, "
    "cluster_counts map<string,long>, domain_label string, domain_purity double, domain_counts map<string,long>, leaf_count int, merge_depth int, max_merge_depth int, "
    "max_merge_distance double, frontier_count int, cutoff_distance double, cutoff_radius_distance double"
)


def leaf_counts(members: DataFrame, points: DataFrame) -> DataFrame:
    """group_index, cluster_label, partner_domain and n; members without a point are noise."""
    joined = members.join(points.select("row_key", "partner_domain", "cluster_label"), ["row_key", "partner_domain"], "left")
    return joined.groupBy("group_index", F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"), "partner_domain").agg(F.count("*").alias("n"))


def nodes(groups: DataFrame, merges: DataFrame, counts: DataFrame, merge_depth: int = 5, threshold: float | None = None, dense: int = kernels.MAX_LEAVES) -> DataFrame:
    """Visible nodes of one dataset's tree, with the header's values beside each. Leaves are groups by index. Trees of more than ``dense`` leaves
    go through ``nodes_at_scale``."""
    if groups.count() > dense:
        return nodes_at_scale(groups, merges, counts, merge_depth, threshold)
    lit = F.lit(0).alias("dataset")
    left = groups.select(lit, "group_index").join(counts, "group_index", "left").select("dataset", "group_index", "cluster_label", "partner_domain", "n")
    right = merges.select(lit, "merge_index", "left", "right", "distance")

    def run(leaves: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        order = sorted(leaves["group_index"].unique())
        at = {g: k for k, g in enumerate(order)}
        clusters, domains = [{} for _ in order], [{} for _ in order]
        for r in leaves.itertuples():
            if r.n == r.n:  # a group without members has no count
                for table, k in ((clusters, int(r.cluster_label)), (domains, r.partner_domain)):
                    if k is not None and k != "":
                        table[at[r.group_index]][k] = table[at[r.group_index]].get(k, 0) + int(r.n)
        steps = steps.sort_values("merge_index")
        header, out = kernels.dendrogram(steps[["left", "right"]].to_numpy().astype(int).reshape(-1, 2), steps["distance"].to_numpy(), clusters, domains, merge_depth, threshold)
        pdf = pd.DataFrame([n | header for n in out])
        pdf["parent_id"] = pdf["parent_id"].astype("Int32")
        return pdf[[c.split()[0] for c in NODES.replace("map<string,long>", "m").split(", ")]]

    return left.groupBy("dataset").cogroup(right.groupBy("dataset")).applyInPandas(run, NODES)


def edges(nodes_: DataFrame) -> DataFrame:
    """One edge per node with a parent."""
    pick = ["cluster_label", "cluster_purity", "cluster_counts", "domain_label", "domain_purity", "domain_counts"]
    return nodes_.filter("parent_id IS NOT NULL").select(F.concat(F.lit("n"), "parent_id").alias("source"), F.concat(F.lit("n"), "node_id").alias("target"), *pick)


def rollup(merges: DataFrame, counts: DataFrame, leaves: int) -> DataFrame:
    """A33 as a relation: node, cluster_label and n for every node. Rounds double their reach, so a chain of merges takes few (``trees``)."""
    rows = counts.select(F.col("group_index").cast("long").alias("node"), "cluster_label", "n")
    out = trees.subtree_sums(rows, trees.parents_of(merges, leaves), ("cluster_label",))
    return out.select(F.col("node").cast("int").alias("node"), "cluster_label", "n")


def nodes_at_scale(groups: DataFrame, merges: DataFrame, counts: DataFrame, merge_depth: int = 5, threshold: float | None = None) -> DataFrame:
    """T1 as relations, the same rows as ``nodes`` for trees of any shape and size.

    A node is shown if a leaf below it has members, and *forks* if both its children are shown. Its depth is the number of forks above it. Above the depth
    limit forks and shown leaves are displayed, at the limit the children of forks. Sums over subtrees and ways to the root go by doubling. An
    inner node's angle is the mean of its two children's, so a displayed end counts by a half for each fork between; that sum is kept
    in doubles, which hold a thousand forks.
    """
    leaves = written(numbered(groups.select("group_index").distinct(), ["group_index"], "node"), "leaves")
    n = leaves.count()
    parents = written(trees.parents_of(merges, n), "parents")
    held = counts.join(leaves, "group_index").filter("n IS NOT NULL")
    kind = lambda name, rows, label: rows.select("node", F.lit(name).alias("kind"), label.cast("string").alias("label"), "n")
    members = held.filter("cluster_label IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n")).filter("n > 0")
    one = F.lit(1).cast("long").alias("n")
    rows = kind("cluster", held.filter("cluster_label IS NOT NULL"), F.col("cluster_label"))
    rows = rows.unionByName(kind("domain", held.filter("partner_domain <> ''"), F.col("partner_domain")))
    rows = rows.unionByName(kind("raw", leaves.select("node", one), F.lit(""))).unionByName(kind("shown", members.select("node", one), F.lit("")))
    sums = written(trees.subtree_sums(rows, parents, ("kind", "label")), "sums")
    of = lambda name, to: F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).alias(to)
    plain = sums.groupBy("node").agg(of("cluster", "member_count"), of("raw", "raw_subtree_leaf_count"), of("shown", "subtree_leaf_count"))
    made = merges.select((F.col("merge_index") + n).cast("long").alias("node"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.when(F.abs("distance") < float("inf"), F.col("distance")).otherwise(0.0).alias("height"))
    seen = plain.select("node", (F.col("member_count") > 0).alias("seen"))
    side = lambda x: seen.select(F.col("node").alias(x), F.col("seen").alias(f"seen_{x}"))
    forks = made.join(side("left"), "left").join(side("right"), "right").select("node", "height", (F.col("seen_left") & F.col("seen_right")).alias("fork"))
    every = plain.join(forks, "node", "left").withColumns({"height": F.coalesce("height", F.lit(0.0)), "fork": F.coalesce("fork", F.lit(False))})
    every = written(every.join(parents, "node", "left"), "tree-nodes")
    marks = every.select("node", F.col("fork").cast("long").alias("forks"), F.when(F.col("fork"), F.col("node")).alias("near"))
    ways = written(trees.to_root(marks, parents, sums=("forks",), nearest=("near",)), "ways")
    above = ways.select(F.col("node").alias("up"), F.col("near").alias("parent"))
    at = every.join(ways.select("node", (F.col("forks")).alias("forks")), "node").join(above, "up", "left").filter("member_count > 0")
    at = at.join(every.select(F.col("node").alias("up"), F.col("fork").alias("of_fork")), "up", "left")
    at = written(at.withColumn("depth", (F.col("forks") - F.col("fork").cast("long")).cast("int")), "depths")
    deepest, top = at.agg(F.max(F.when(F.col("node") < n, F.col("depth"))), F.coalesce(F.max(F.when(F.col("node") >= n, F.col("height"))), F.lit(0.0))).first()
    if deepest is None:
        raise ValueError("no leaf of the hierarchy has a member")
    most = max(1, deepest)
    depth = max(1, min(merge_depth or 5, most))
    if depth > 1000:
        raise ValueError("more than a thousand forks above each other cannot be displayed")
    below = F.col("depth") < depth
    shown = at.filter((below & (F.col("fork") | (F.col("node") < n))) | ((F.col("depth") == depth) & F.col("of_fork")))
    shown = written(shown.withColumn("end", ~(F.col("fork") & below)), "displayed")
    places = trees.first_places(merges, n, sums.filter("kind = 'raw'").select("node", "n"))
    ends = written(numbered(shown.filter("end").join(places, "node").select("node", "depth", F.col("place").alias("first")), ["first"], "place"), "ends")
    frontier = ends.count()
    turn = 2 * math.pi * (F.col("place") + 0.5) / frontier
    weighed = trees.subtree_sums(ends.select("node", (turn * F.pow(F.lit(0.5), F.col("depth"))).alias("n")), parents)
    label = sums.filter("kind IN ('cluster', 'domain') AND n > 0").join(shown.select("node"), "node")
    whole = lambda c: F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("label", "n"))))
    modes = label.groupBy("node").agg(
        F.max_by(F.col("label").cast("int"), F.when(F.col("kind") == "cluster", F.struct("n", -F.col("label").try_cast("int")))).alias("cluster_label"), F.max(F.when(F.col("kind") == "cluster", F.col("n"))).alias("of_cluster"), F.map_from_entries(whole("cluster")).alias("cluster_counts"),
        F.max_by("label", F.when(F.col("kind") == "domain", F.struct("n", "label"))).alias("domain_label"), F.max(F.when(F.col("kind") == "domain", F.col("n"))).alias("of_domain"), F.sum(F.when(F.col("kind") == "domain", F.col("n"))).alias("domains"), F.map_from_entries(whole("domain")).alias("domain_counts"),
    )
    out = shown.join(weighed.withColumnRenamed("n", "weighed"), "node").join(modes, "node", "left")
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    angle = F.col("weighed") * F.pow(F.lit(2.0), F.col("depth"))
    by_depth = clip(F.col("depth") / depth)
    by_distance = clip(1 - F.col("height") / top) if top > 0 else by_depth
    out = out.withColumns({"angle": angle, "radius_depth": by_depth, "radius_distance": by_distance})
    cutoff = None if threshold is None else (min(1.0, max(0.0, 1 - threshold / top)) if top > 0 else 0.0)
    values = {
        "node_id": F.col("node"), "parent_id": F.col("parent"), "x_depth": F.cos("angle") * F.col("radius_depth"), "y_depth": F.sin("angle") * F.col("radius_depth"), "x_distance": F.cos("angle") * F.col("radius_distance"), "y_distance": F.sin("angle") * F.col("radius_distance"),
        "merge_distance": F.col("height"), "collapsed": F.col("fork") & ~below, "is_leaf": F.col("node") < n, "cluster_label": F.coalesce("cluster_label", F.lit(-1)), "cluster_purity": F.coalesce("of_cluster", F.lit(0)) / F.greatest(F.lit(1), "member_count"),
        "domain_label": F.coalesce("domain_label", F.lit("")), "domain_purity": F.coalesce("of_domain", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("domains", F.lit(0))), "leaf_count": F.lit(n), "merge_depth": F.lit(depth), "max_merge_depth": F.lit(most), "max_merge_distance": F.lit(float(top)),
        "frontier_count": F.lit(max(1, frontier)), "cutoff_distance": F.lit(threshold), "cutoff_radius_distance": F.lit(cutoff),
    }
    typed = [(c.split()[0], c.split()[1]) for c in NODES.replace("map<string,long>", "map").split(", ")]
    cells = [values.get(c, F.col(c)) if c in values or c in out.columns else F.lit(None) for c, _ in typed]
    return out.select(*[(x if kind_ == "map" else x.cast(kind_)).alias(c) for x, (c, kind_) in zip(cells, typed)])


def visible_mode(counts: DataFrame, shown: list[int] | None = None) -> DataFrame:
    """Of each node the most frequent shown label, ties to the smaller, and its share of the shown members."""
    use = counts if shown is None else counts.filter(F.col("cluster_label").isin(shown))
    return use.groupBy("node").agg(F.max_by("cluster_label", F.struct("n", -F.col("cluster_label"))).alias("cluster_label"), (F.max("n") / F.sum("n")).alias("share"))


def screen(nodes_: DataFrame, width: float, height: float, by_distance: bool = False, linear: bool = False) -> DataFrame:
    """Screen places, radial around the middle or linear from the left."""
    r = F.col("radius_distance" if by_distance else "radius_depth")
    if linear:
        return nodes_.withColumn("sx", r * width).withColumn("sy", F.col("angle") / (2 * F.pi()) * height)
    half = min(width, height) / 2
    return nodes_.withColumn("sx", width / 2 + F.cos("angle") * r * half).withColumn("sy", height / 2 + F.sin("angle") * r * half)


def cutoff_at(radius: float, max_distance: float) -> float:
    """The distance that a dragged cutoff circle stands for."""
    return (1 - min(1.0, max(0.0, radius))) * max_distance
