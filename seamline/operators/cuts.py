"""Labels of one dataset's hierarchy as relations: cuts (C4), persistence (C5) and density clusters (C7), for trees of any shape and size.

Nodes are leaves 0 .. n - 1 and n + k for merge k. Each step is a join or aggregate over nodes; ways up and subtrees are followed by doubling
(``trees``). No task has the whole tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import discard, numbered, written
from ..settings import ClusteringSettings
from . import linkage, tiles, trees


def node_table(leaves: DataFrame, merges: DataFrame, n: int) -> DataFrame:
    """node, left, right, low (its height), size (its members), up and high (its parent's height) of every node. ``leaves`` has g and member_count. Written."""
    no = F.lit(None).cast("long")
    own = leaves.select(F.col("g").alias("node"), no.alias("left"), no.alias("right"), F.lit(0.0).alias("low"), F.col("member_count").alias("size"))
    made = merges.select((F.col("merge_index") + n).cast("long").alias("node"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.col("distance").alias("low"), F.col("count").alias("size"))
    up = made.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("up"), F.col("low").alias("high"))
    return written(own.unionByName(made).join(up, "node", "left"), "nodes")


def in_order(tops: DataFrame, places: DataFrame) -> DataFrame:
    """top and ``label``, from 0 in the order of the tops' first leaves. ``tops`` has top."""
    return numbered(tops.join(places.withColumnRenamed("node", "top"), "top"), ["place", "top"], "label").select("top", F.col("label").cast("int").alias("label"))


def cut(merges: DataFrame, n: int, clusters: int | None = None, threshold: float | None = None) -> DataFrame:
    """C4: g and label of every leaf, numbered by each cluster's first leaf. ``threshold`` takes merges up to the first one above it."""
    if clusters is not None:
        take = n - min(max(1, clusters), n)
    elif threshold is not None:
        above = merges.filter(~(F.col("distance") <= threshold)).agg(F.min("merge_index")).first()[0]
        take = n - 1 if above is None else above
    else:
        raise ValueError("a cut needs a number of clusters or a threshold")
    parents = trees.parents_of(merges.filter(F.col("merge_index") < take), n)
    nodes = merges.sparkSession.range(n + take).select(F.col("id").alias("node"), F.col("id").alias("top"))
    tops = written(trees.to_root(nodes, parents, topmost=("top",)).filter(F.col("node") < n), "tops")
    label = in_order(tops.select("top").distinct(), tops.groupBy("top").agg(F.min("node").alias("place")).withColumnRenamed("top", "node"))
    return tops.join(label, "top").select(F.col("node").alias("g"), "label")


def places_of(merges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    leaves = nodes.filter(F.col("node") < n).select("node", F.lit(1).cast("long").alias("n"))
    return trees.first_places(merges, n, trees.subtree_sums(leaves, trees.parents_of(merges, n)))


def chosen_nodes(tree: DataFrame, allow: Column | None = None) -> DataFrame:
    """node and ``chosen`` of a tree (node, left, right, score): whether its score is above 0 (``allow``: another rule) and no less than the best of what is
    below. Sums are compared to twelve digits, as their order is not fixed."""
    best = trees.best_disjoint(tree)
    x, y = (best.select(F.col("node").alias(side), F.col("best").alias(to)) for side, to in (("left", "x"), ("right", "y")))
    met = tree.join(x, "left", "left").join(y, "right", "left")
    below = F.coalesce(F.col("x") + F.col("y"), F.lit(0.0))
    return met.select("node", ((F.col("score") > 0 if allow is None else allow) & (F.col("score") >= below * (1 - 1e-12))).alias("chosen"))


def persistence(leaves: DataFrame, merges: DataFrame, n: int, least: int, lifetime: float, weight: float, mode: str) -> DataFrame:
    """G and label of the disjoint nodes with the largest total of lifetime**a * share**b; -1 outside them. See ``kernels.cut_by_persistence``."""
    nodes = node_table(leaves, merges, n)
    whole = max(1, nodes.agg(F.max("size")).first()[0] or 1)
    span = F.when(F.col("high").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("high") - F.col("low")))
    own = nodes.select("node", span.alias("span"), (span * F.col("size") / whole).alias("area"))
    share = F.col("size") / whole
    if mode == "integral":
        size = lambda side: nodes.select(F.col("node").alias(side), (F.col("size") >= least).alias(f"{side}_large"))
        met = nodes.filter("left IS NOT NULL").select("node", "left", "right").join(size("left"), "left").join(size("right"), "right")
        large = met.filter("left_large <> right_large").select("node", F.when(F.col("left_large"), F.col("left")).otherwise(F.col("right")).alias("up"))
        own = trees.to_root(own, large, sums=("span", "area"))
        share = F.when(F.col("span") > 0, F.col("area") / F.col("span")).otherwise(0.0)
    a, b = min(1.0, 2 * weight), min(1.0, 2 * (1 - weight))
    raised = lambda x, power: F.lit(1.0) if power <= 0 else F.when(x > 0, F.pow(x, F.lit(power))).otherwise(0.0)
    fit = F.col("up").isNotNull() & (F.col("size") >= least) & (F.col("span") >= lifetime)
    scored = nodes.join(own, "node").select("node", "left", "right", F.when(fit, raised(F.col("span"), a) * raised(share, b)).otherwise(0.0).alias("score"))
    return labelled(written(scored, "scores"), None, merges, nodes, n)


def labelled(scored: DataFrame, allow: Column | None, merges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """g and label of every leaf: the topmost chosen node above it, numbered from left to right; -1 without one, all 0 if nothing is chosen."""
    marks = chosen_nodes(scored, allow).select("node", F.when(F.col("chosen"), F.col("node")).alias("top"))
    tops = written(trees.to_root(marks, nodes.filter("up IS NOT NULL").select("node", "up"), topmost=("top",)).filter(F.col("node") < n), "tops")
    label = written(in_order(tops.filter("top IS NOT NULL").select("top").distinct(), places_of(merges, nodes, n)), "labels")
    if label.isEmpty():
        return tops.select(F.col("node").alias("g"), F.lit(0).alias("label"))
    return tops.join(label, "top", "left").select(F.col("node").alias("g"), F.coalesce("label", F.lit(-1)).alias("label"))


def without_small(labels: DataFrame, leaves: DataFrame, least: int) -> DataFrame:
    """Labels of clusters with fewer than ``least`` members become noise."""
    sizes = labels.join(leaves.select("g", "member_count"), "g").groupBy("label").agg(F.sum("member_count").alias("size"))
    kept = F.when((F.col("label") >= 0) & (F.col("size") < least), -1).otherwise(F.col("label"))
    return labels.join(sizes, "label").select("g", kept.cast("int").alias("label"))


def leaf_labels(leaves: DataFrame, merges: DataFrame, s: ClusteringSettings) -> DataFrame:
    """g and label (not yet ranked) of every leaf by the settings' cut. ``leaves`` has g, from 0, and member_count."""
    n = leaves.count()
    if n == 1:
        labels = leaves.select("g", F.lit(0).alias("label"))
        return labels if s.hierarchical_target == "persistence" else without_small(labels, leaves, s.hierarchical_min_cluster_size)
    if s.hierarchical_target == "persistence":
        return persistence(leaves, merges, n, s.hierarchical_min_cluster_size, s.persistence_min_lifetime, s.persistence_lifetime_weight, s.persistence_score_mode)
    return without_small(cut(merges, n, s.n_clusters, s.distance_threshold), leaves, s.hierarchical_min_cluster_size)


# ---- density clusters

def density(leaves: DataFrame, metric: str, least: int, samples: int | None = None, epsilon: float = 0.0) -> DataFrame:
    """G and label of every set by HDBSCAN on its entries; -1 is noise. ``leaves`` has g, columns and member_count.

    Equal entries are one leaf of as many points: they reach each other at their core distance, and nothing else reaches them sooner. The tree of mutual
    reachability is condensed at nodes with two children of ``least`` points (*heads* are those children and the root); heads are picked by excess of mass,
    and a single cluster is allowed. Picked heads born below ``epsilon`` are lifted to the head that reaches it.
    """
    by = ["dataset"]
    sets = leaves.select(F.lit(0).alias("dataset"), "g", "columns", "member_count")
    points = sets.agg(F.coalesce(F.sum("member_count"), F.lit(0)), F.count("*")).first()
    n = points[1]
    if n == 0:
        return leaves.select("g", F.lit(-1).alias("label"))
    width = tiles.bucket_width(sets, by)
    core = written(tiles.core_distances(sets, by, metric, min(samples or least, points[0]), width), "core")
    tree = linkage.spanning_tree(sets.join(core, [*by, "g"]).select(*by, "g", "columns", "core"), by, metric, width)
    merges = written(linkage.merges_of_tree(tree, sets, by).drop("dataset"), "reach-merges")
    nodes = node_table(sets, merges, n)
    root = 2 * n - 2
    height = nodes.join(core.select(F.col("g").alias("node"), "core"), "node", "left").withColumn("low", F.coalesce("core", "low")).drop("core")
    large = F.col("size") >= least
    sides = nodes.select(F.col("node").alias("child"), large.alias("large"))
    split = nodes.filter("left IS NOT NULL").select(F.col("node").alias("up"), F.explode(F.array("left", "right")).alias("child")).join(sides, "child")
    split = split.groupBy("up").agg(F.count_if("large").alias("large_children"))
    rows = height.join(split, "up", "left").withColumn("head", F.when((F.col("node") == root) | (F.col("large_children") == 2), F.col("node")))
    rows = rows.withColumn("lowest", F.when(large | (F.col("node") == root), F.col("node")))
    ways = written(trees.to_root(rows.select("node", "head", "lowest"), nodes.filter("up IS NOT NULL").select("node", "up"), nearest=("head", "lowest")), "ways")
    pace = lambda h: F.when(h > 0, 1 / h).otherwise(F.lit(float("inf")))
    at = rows.select(F.col("node").alias("lowest"), pace(F.col("low")).alias("leaves_at"))
    own = ways.filter(F.col("node") < n).select("node", "lowest").join(ways.select(F.col("node").alias("lowest"), "head"), "lowest").join(at, "lowest")
    own = written(own.join(nodes.select("node", "size"), "node").select(F.col("node").alias("g"), "head", "leaves_at", "size"), "points")
    heads = rows.filter("head IS NOT NULL").select("node", "size", F.when(F.col("node") == root, F.lit(0.0)).otherwise(pace(F.col("high"))).alias("born"), "up")
    heads = heads.join(ways.select(F.col("node").alias("up"), F.col("head").alias("parent")), "up", "left").drop("up")
    heads = written(heads, "heads")
    finite = own.select(F.col("leaves_at").alias("x")).unionByName(heads.select(F.col("born").alias("x"))).filter(F.col("x") < float("inf")).agg(F.greatest(F.lit(1.0), F.coalesce(F.max("x"), F.lit(1.0)))).first()[0]
    cap = lambda c: F.least(c, F.lit(finite))
    masses = own.select("head", cap(F.col("leaves_at")).alias("x"), "size").unionByName(heads.filter("parent IS NOT NULL").select(F.col("parent").alias("head"), cap(F.col("born")).alias("x"), "size"))
    mass = masses.join(heads.select(F.col("node").alias("head"), cap(F.col("born")).alias("start")), "head").groupBy("head").agg(F.sum((F.col("x") - F.col("start")) * F.col("size")).alias("score"))
    pairs = heads.filter("parent IS NOT NULL").groupBy("parent").agg(F.min("node").alias("left"), F.max("node").alias("right"), F.max("born").alias("split_at"))
    tree_ = heads.join(mass.withColumnRenamed("head", "node"), "node", "left").join(pairs.withColumnRenamed("parent", "node"), "node", "left")
    tree_ = written(tree_.select("node", "left", "right", F.coalesce("score", F.lit(0.0)).alias("score"), "split_at", "born", "parent"), "condensed")
    ups = tree_.filter("parent IS NOT NULL").select("node", F.col("parent").alias("up"))
    picked = chosen_nodes(tree_.select("node", "left", "right", "score"), F.lit(True)).select("node", F.when(F.col("chosen"), F.col("node")).alias("top"))
    tops = written(trees.to_root(picked, ups, topmost=("top",)), "picked")
    if epsilon > 0:
        wide = (F.col("born") <= 0) | (1 / F.col("born") >= epsilon) | F.col("parent").isNull()
        lifts = trees.to_root(tree_.select("node", F.when(wide, F.col("node")).alias("lift")), ups, nearest=("lift",)).withColumnRenamed("node", "top")
        chosen = tops.select("top").distinct().join(lifts, "top").select(F.col("lift").alias("node")).distinct().withColumn("top", F.col("node"))
        tops = written(trees.to_root(tree_.select("node").join(chosen, "node", "left"), ups, topmost=("top",)), "picked")
    named = own.join(tops.withColumnRenamed("node", "head"), "head", "left")
    only = tops.filter("top IS NOT NULL").select("top").distinct().limit(2).collect()  # two rows at most
    if [r.top for r in only] == [root]:
        # Of the root alone, points that leave before the threshold are noise.
        last = tree_.filter(F.col("node") == root).first().split_at
        bound = 1 / epsilon if epsilon > 0 else last or 0.0
        named = named.withColumn("top", F.when((F.col("head") == root) & (F.col("leaves_at") < bound), F.lit(None)).otherwise(F.col("top")))
    # Where two picked heads part, heads part: the lesser node is left in both trees.
    places = trees.from_left(tree_).select("node", "place") if trees.is_small(tree_) else places_of(merges, nodes, n)
    label = in_order(named.filter("top IS NOT NULL").select("top").distinct(), places)
    out = written(named.join(label, "top", "left").select("g", F.coalesce("label", F.lit(-1)).alias("label")), "density")
    discard(core, tree, own, heads, tree_, ways)
    return out
