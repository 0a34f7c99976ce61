"""Clusterings of groups and their points (C1-C12, A17-A19, J5, J15, E1-E5 dispatch)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import discard, numbered, written
from ..settings import ClusteringSettings
from . import cuts, kernels
from . import linkage as at_scale
from .distance import near_pairs

MERGES = "merge_index int, left int, right int, distance double, count long"


def per_dataset(groups: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Groups with a dataset key; a constant column where the whole input is one dataset."""
    return (groups, by) if by else (groups.withColumn("dataset", F.lit(0)), ["dataset"])


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), rest])


def largest(data: DataFrame, keys: list[str], of: str | None = None) -> int:
    """Rows, or the sum of ``of``, of the largest dataset."""
    return data.groupBy(*keys).agg((F.sum(of) if of else F.count("*")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def hierarchy(groups: DataFrame, metric: str = "overlap", linkage: str = "average", by: list[str] | None = None, dense: int = kernels.MAX_LEAVES) -> DataFrame:
    """Merges of each dataset. Leaves are its groups in order of group_index, from 0.

    If no dataset has more than ``dense`` groups, each is one task's matrix; otherwise ``linkage.hierarchy`` spreads all of them. The two differ in
    the order of ties only.
    """
    data, keys = per_dataset(groups.select(*(by or []), "group_index", "columns", "member_count"), by or [])
    if largest(data, keys) > dense:
        out = at_scale.hierarchy(data, metric, linkage, keys, at_scale.LEAVES)
        return out if by else out.drop("dataset")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_index")
        d = kernels.distance_matrix([list(c) for c in pdf["columns"]], metric)
        children, heights, counts = kernels.linkage(d, pdf["member_count"].to_numpy(), linkage)
        out = pd.DataFrame({"merge_index": np.arange(len(heights)), "left": children[:, 0], "right": children[:, 1], "distance": heights, "count": counts})
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    out = data.groupBy(*keys).applyInPandas(run, _schema(data, keys, MERGES))
    return out if by else out.drop("dataset")


def as_leaves(groups: DataFrame, leaves: DataFrame, merges: DataFrame) -> DataFrame:
    """The leaves of one dataset's precomputed hierarchy in the place of its groups: group_index is the leaf's number and
    member_count the members of all its groups, 0 for a leaf without one."""
    every = merges.sparkSession.range(merges.count() + 1).select(F.col("id").alias("leaf"))
    held = leaves.join(groups.select("group_index", "member_count"), "group_index").groupBy("leaf").agg(F.sum("member_count").alias("member_count"))
    return every.join(held, "leaf", "left").select(F.col("leaf").alias("group_index"), F.coalesce("member_count", F.lit(0)).alias("member_count"))


def leaf_labels(groups: DataFrame, merges: DataFrame, settings: ClusteringSettings, by: list[str] | None = None, dense: int = kernels.MAX_LEAVES) -> DataFrame:
    """group_index and cluster_label (not yet ranked) of every group. The tree of one dataset of more than ``dense`` groups is cut as a
    relation (``cuts``); several datasets at once are cut a task each."""
    data, keys = per_dataset(groups.select(*(by or []), "group_index", "member_count"), by or [])
    if not by and largest(data, keys) > dense:
        leaves = written(numbered(groups.select("group_index", "member_count"), ["group_index"], "g"), "leaves")
        labels = cuts.leaf_labels(leaves, merges, settings)
        return leaves.join(labels, "g").select("group_index", F.col("label").cast("int").alias("cluster_label"))
    steps, _ = per_dataset(merges, by or [])
    s = settings

    def run(key: tuple, leaves: pd.DataFrame, steps_: pd.DataFrame) -> pd.DataFrame:
        leaves, steps_ = leaves.sort_values("group_index"), steps_.sort_values("merge_index")
        members = leaves["member_count"].to_numpy()
        children, heights = steps_[["left", "right"]].to_numpy().astype(int), steps_["distance"].to_numpy()
        if len(leaves) == 1:
            labels = np.zeros(1, np.int64)
        elif s.hierarchical_target == "persistence":
            labels = kernels.cut_by_persistence(children, heights, members, s.hierarchical_min_cluster_size, s.persistence_min_lifetime, s.persistence_lifetime_weight, s.persistence_score_mode)
        else:
            labels = kernels.cut(children, heights, s.n_clusters, s.distance_threshold)
        if s.hierarchical_target != "persistence":
            labels = kernels.drop_small(labels, members, s.hierarchical_min_cluster_size)
        out = pd.DataFrame({"group_index": leaves["group_index"].to_numpy(), "cluster_label": labels})
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    out = data.groupBy(*keys).cogroup(steps.groupBy(*keys)).applyInPandas(run, _schema(data, keys, "group_index long, cluster_label int"))
    return out if by else out.drop("dataset")


def rank_labels(points: DataFrame, by: list[str] | None = None, label: str = "cluster_label") -> DataFrame:
    """Labels renumbered from 0 by size, largest first, ties by label; noise stays -1.

    Clusters grow with the data: without ``by`` they are numbered by ranges and not in one window, and the optimizer decides
    whether the ranks are small enough to broadcast.
    """
    by = by or []
    sizes = points.filter(F.col(label) >= 0).groupBy(*by, label).agg((-F.count("*")).alias("__n"))
    if by:
        ranks = sizes.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("__n", label)) - 1)
    else:
        ranks = numbered(sizes, ["__n", label], "__rank")
    out = points.join(ranks.drop("__n"), [*by, label], "left")
    return out.withColumn(label, F.coalesce("__rank", F.lit(-1)).cast("int")).select(*points.columns)


def points(labels: DataFrame, members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """row_key, partner_domain and ranked cluster_label of every entry; groups without a label are noise."""
    joined = members.join(labels, [*(by or []), "group_index"], "left")
    joined = joined.select(*(by or []), "row_key", "partner_domain", F.coalesce("cluster_label", F.lit(-1)).cast("int").alias("cluster_label"))
    return rank_labels(joined, by)


def hierarchical(groups: DataFrame, members: DataFrame, settings: ClusteringSettings, by: list[str] | None = None, merges: DataFrame | None = None, leaves: DataFrame | None = None, dense: int = kernels.MAX_LEAVES) -> DataFrame:
    """Points of a hierarchical clustering. ``merges`` may be precomputed; ``leaves`` then names the leaf of every group of
    the one dataset, and a group gets its leaf's label."""
    merges = merges if merges is not None else hierarchy(groups, settings.distance, settings.linkage, by, dense)
    if leaves is None:
        return points(leaf_labels(groups, merges, settings, by, dense), members, by)
    if groups.count() == 1:
        return points(groups.select("group_index", F.lit(0).alias("cluster_label")), members)
    labels = leaf_labels(as_leaves(groups, leaves, merges), merges, settings, dense=dense).withColumnRenamed("group_index", "leaf")
    return points(leaves.join(labels, "leaf").select("group_index", "cluster_label"), members)


def density(groups: DataFrame, members: DataFrame, settings: ClusteringSettings, by: list[str] | None = None, dense: int = kernels.MAX_LEAVES) -> DataFrame:
    """Points by HDBSCAN on the entries (each group counts as often as it has members).

    Equal entries are told apart by nothing but the order of ties, so a group takes the label that most of its copies got. One dataset of more
    than ``dense`` entries goes through ``cuts.density``, where a group is one leaf of as many points.
    """
    data, keys = per_dataset(groups.select(*(by or []), "group_index", "columns", "member_count"), by or [])
    s = settings
    if not by and largest(data, keys, "member_count") > dense:
        leaves = written(numbered(groups.select("group_index", "columns", "member_count"), ["group_index"], "g"), "leaves")
        labels = cuts.density(leaves, s.distance, s.min_cluster_size, s.min_samples, s.cluster_selection_epsilon)
        return points(leaves.join(labels, "g").select("group_index", F.col("label").cast("int").alias("cluster_label")), members)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_index")
        times = pdf["member_count"].to_numpy()
        if times.sum() > kernels.MAX_LEAVES:
            raise ValueError("too many entries for a dense density clustering")
        d = kernels.distance_matrix([list(c) for c in pdf["columns"]], s.distance)
        at = np.repeat(np.arange(len(pdf)), times)
        labels = kernels.hdbscan(d[np.ix_(at, at)], s.min_cluster_size, s.min_samples, s.cluster_selection_epsilon)
        out = pd.DataFrame({"group_index": pdf["group_index"].to_numpy(), "cluster_label": kernels.voted(labels, at)})
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    out = data.groupBy(*keys).applyInPandas(run, _schema(data, keys, "group_index long, cluster_label int"))
    return points(out if by else out.drop("dataset"), members, by)


def single_linkage_components(groups: DataFrame, metric: str, threshold: float, most_rounds: int = 50) -> DataFrame:
    """C4 for single linkage without a hierarchy: group_index and the smallest group_index of its component.

    Near pairs come from the inverted index; components from repeatedly taking the smallest neighbour's root and
    its root again, so long chains shrink fast. No dense matrix, no limit on the number of groups.
    """
    pairs = written(near_pairs(groups, metric, threshold), "near-pairs")
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    root = written(groups.select(F.col("group_index").alias("g"), F.col("group_index").alias("r")), "roots")
    for _ in range(most_rounds):
        near = both.join(root, both["j"] == root["g"]).groupBy("i").agg(F.min("r").alias("m"))
        low = root.join(near, root["g"] == near["i"], "left").select("g", F.least("r", F.coalesce("m", "r")).alias("r2"))
        hop = root.select(F.col("g").alias("r2"), F.col("r").alias("r3"))
        step = written(low.join(hop, "r2").select("g", F.least("r2", "r3").alias("r")), "roots")
        moved = step.join(root.withColumnRenamed("r", "old"), "g").filter("r <> old").limit(1).count()
        discard(root)
        root = step
        if not moved:
            discard(pairs)
            return root.select(F.col("g").alias("group_index"), F.col("r").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def payload(points_: DataFrame) -> DataFrame:
    """One row of sample, cluster and noise counts of a clustering."""
    label = F.col("cluster_label")
    return points_.agg(
        F.count("*").alias("sample_count"),
        F.count_distinct(F.when(label >= 0, label)).alias("cluster_count"),
        F.count(F.when(label < 0, True)).alias("noise_count"),
    )


def matches_entries(points_: DataFrame, entries: DataFrame) -> bool:
    """Whether a stored clustering is of exactly these entries."""
    a, b = points_.select("row_key", "partner_domain"), entries.select("row_key", "partner_domain")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def cost_estimate(summaries: DataFrame, metric: str, linkage: str, leaves: int) -> DataFrame:
    """Time and memory of a run, scaled by pairs from the closest recorded run; no row without one."""
    n = F.col("leaf_count").cast("long")
    ok = summaries.filter((F.trim("status") == "ok") & (n > 1) & (F.col("total_seconds").isNotNull() | F.col("peak_rss_delta_bytes").isNotNull()))
    pairs_of = lambda c: F.greatest(F.lit(1), F.floor(c * (c - 1) / 2))
    scale = pairs_of(F.lit(leaves)) / pairs_of(n)
    closest = ok.orderBy(
        (F.col("linkage") != linkage).cast("int"), (F.col("metric") != metric).cast("int"), F.abs(F.log1p(n.cast("double")) - F.log1p(F.lit(float(max(1, leaves))))), "summary_file", "source_file", "leaf_count"
    ).limit(1)
    return closest.select(
        "summary_file", "source_file", "pfam_id", "metric", "linkage", n.alias("basis_leaf_count"), F.lit(leaves).alias("leaf_count"), scale.alias("scale"),
        (F.col("total_seconds") * scale).alias("estimated_total_seconds"), (F.col("peak_rss_delta_bytes") * scale).alias("estimated_peak_rss_delta_bytes"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
