"""Cluster contents: summaries, histograms, spread-out picks and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import discard, percent, written
from .cluster import union_all
from .distance import array_distance

SUPPORT = 0.04


def joined(points: DataFrame, rows: DataFrame) -> DataFrame:
    """Points with the columns of their rows; a point without a row keeps counting, with no columns."""
    cols = rows.select(F.col("interface_row_key").alias("row_key"), "partner_domain", "interface_msa_columns_a")
    return points.join(cols, ["row_key", "partner_domain"], "left")


def column_chart(points: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """cluster_label, col, count, relative (count by cluster size). Noise is a cluster; columns outside
    the alignment are ignored; a column that a list repeats counts as often."""
    sizes = points.groupBy("cluster_label").agg(F.count("*").alias("size"))
    counts = joined(points, rows).select("cluster_label", F.explode("interface_msa_columns_a").alias("col")).filter((F.col("col") >= 0) & (F.col("col") < length))
    counts = counts.groupBy("cluster_label", "col").agg(F.count("*").alias("count"))
    return counts.join(sizes, "cluster_label").select("cluster_label", "col", "count", "size", (F.col("count") / F.col("size")).alias("relative"))


def dense_chart(chart: DataFrame, length: int) -> DataFrame:
    """The chart with a row for every cluster and column, 0 where no member has it. Clusters are few; the grid is theirs by
    the alignment's columns."""
    clusters = chart.select("cluster_label", "size").distinct()
    grid = clusters.crossJoin(chart.sparkSession.range(length).select(F.col("id").cast("int").alias("col")))
    out = grid.join(chart.drop("size"), ["cluster_label", "col"], "left")
    return out.select("cluster_label", "col", F.coalesce("count", F.lit(0)).alias("count"), "size", F.coalesce("relative", F.lit(0.0)).alias("relative"))


def merged_counts(parts: list[DataFrame]) -> DataFrame:
    """Partner counts of several pages added up, and so the partners of all of them."""
    return union_all(parts).groupBy("partner_domain").agg(F.sum("row_count").alias("row_count")).orderBy("partner_domain")


def stack_maximum(chart: DataFrame) -> DataFrame:
    """The largest sum of relative counts over one column."""
    return chart.groupBy("col").agg(F.sum("relative").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("max_stack_value"))


def summaries(points: DataFrame) -> DataFrame:
    """member_count of each cluster, noise left out."""
    return points.filter("cluster_label >= 0").groupBy("cluster_label").agg(F.count("*").alias("member_count"))


def partner_shares(points: DataFrame) -> DataFrame:
    """cluster_label, partner_domain, count, total (with noise) and percent of the partner's rows in the cluster."""
    total = points.groupBy("partner_domain").agg(F.count("*").alias("total"))
    counts = points.filter("cluster_label >= 0").groupBy("cluster_label", "partner_domain").agg(F.count("*").alias("count"))
    out = counts.join(total, "partner_domain")
    return out.withColumn("percent", percent(F.col("count"), F.col("total"))).select("cluster_label", "partner_domain", "count", "total", "percent")


def column_counts(points: DataFrame, rows: DataFrame) -> DataFrame:
    """cluster_label, col and how many members have it; each member once, columns from 0."""
    inner = joined(points.filter("cluster_label >= 0"), rows).select("cluster_label", F.explode(F.array_distinct("interface_msa_columns_a")).alias("col"))
    return inner.filter("col >= 0").groupBy("cluster_label", "col").agg(F.count("*").alias("column_count"))


def compare_shares(points: DataFrame, partner: str | None = None, allowed: list[int] | None = None) -> DataFrame:
    """Clusters by members of a partner (or all), with their share of all compared members."""
    use = points.filter("cluster_label >= 0")
    use = use if partner is None else use.filter(F.col("partner_domain") == partner)
    use = use if not allowed else use.filter(F.col("cluster_label").isin(allowed))
    counts = use.groupBy("cluster_label").agg(F.count("*").alias("compare_member_count"))
    total = counts.agg(F.sum("compare_member_count").alias("total_member_count"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("coverage_fraction", F.col("compare_member_count") / F.col("total_member_count"))
    return out.orderBy(F.desc("compare_member_count"), "cluster_label")


def top_clusters(points: DataFrame, n: int = 9) -> DataFrame:
    """K4: the largest clusters."""
    return compare_shares(points).limit(n)


def supported_columns(counts: DataFrame, sizes: DataFrame, least: float = SUPPORT) -> DataFrame:
    """Columns of each cluster that at least this share of its members has."""
    out = counts.join(sizes, "cluster_label").withColumn("support", F.col("column_count") / F.col("member_count"))
    return out.filter(F.col("support") >= least)


def dominant_clusters(counts: DataFrame, sizes: DataFrame, least: float = SUPPORT) -> DataFrame:
    """Of each column the cluster with the largest support; ties: larger count, smaller label."""
    some = supported_columns(counts, sizes, least)
    best = F.max_by(F.struct("cluster_label", "column_count", "member_count", "support"), F.struct("support", "column_count", -F.col("cluster_label")))
    return some.groupBy("col").agg(best.alias("b")).select("col", "b.*")


def lens_residues(row_cells: DataFrame, dominant: DataFrame) -> DataFrame:
    """Residues of one row with the dominant cluster of their column; ``row_cells`` has col and residue_id."""
    return row_cells.filter("residue_id IS NOT NULL").join(dominant, "col").select("residue_id", "col", "cluster_label", "column_count", "member_count", "support")


def members_with_column(points: DataFrame, rows: DataFrame, cluster: int, col: int) -> DataFrame:
    """Members of a cluster that have a column, each once, in order."""
    inside = joined(points.filter(F.col("cluster_label") == cluster), rows).filter(F.array_contains("interface_msa_columns_a", col))
    return inside.select("row_key", "partner_domain").distinct().orderBy("row_key", "partner_domain")


def rows_of_cluster(rows: DataFrame, points: DataFrame, cluster: int) -> DataFrame:
    """The rows whose points are in a cluster."""
    inside = points.filter(F.col("cluster_label") == cluster).select(F.col("row_key").alias("interface_row_key"), "partner_domain")
    return rows.join(inside, ["interface_row_key", "partner_domain"], "left_semi")


def row_clusters(points: DataFrame) -> DataFrame:
    """Of each row key of a partner the label most of its points have: ties prefer clusters to noise, then smaller labels."""
    counts = points.groupBy("row_key", "partner_domain", "cluster_label").agg(F.count("*").alias("n"))
    best = F.min_by("cluster_label", F.struct(-F.col("n"), F.col("cluster_label") < 0, "cluster_label"))
    return counts.groupBy("row_key", "partner_domain").agg(best.alias("cluster_label"), F.array_sort(F.collect_set("cluster_label")).alias("memberships"))


def labels_of_partner(points: DataFrame, partner: str | None = None) -> DataFrame:
    """The clusters that a partner's rows are in."""
    use = points if partner is None else points.filter(F.col("partner_domain") == partner)
    return use.filter("cluster_label >= 0").select("cluster_label").distinct().orderBy("cluster_label")


def diverse_picks(items: DataFrame, metric: str, limit: int = 9, key: str = "cluster_label", weighted: bool = True) -> DataFrame:
    """Up to ``limit`` items of each cluster that spread out, and how much of the rest is nearest to each.

    ``items`` has the cluster key, row_key, partner_domain, columns and member_count. The first pick is the smallest key: the same on every run. The
    next ones have the largest (smallest, mean) distance to the picks, ties to the smaller key. All clusters pick at once, one item a round: the picks
    are one aggregate, and each item keeps its nearest pick and its sum of distances, so a round costs a row a join and no cluster is
    gathered anywhere.
    """
    item = ["row_key", "partner_domain", "columns"]
    weight = F.col("member_count") if weighted else F.lit(1).cast("long")
    start = items.select(key, *item, weight.cast("long").alias("weight"), F.lit(None).cast("double").alias("near"), F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("nearest"), F.lit(None).cast("int").alias("rank"))
    state, picks = written(start, "picking"), []
    for k in range(limit):
        spread = [(-F.col("near")).alias("near"), (-F.col("total") / k).alias("mean")] if k else []
        best = state.filter("rank IS NULL").groupBy(key).agg(F.min(F.struct(*spread, *item)).alias("p"))
        made = written(best.select(key, *[F.col(f"p.{c}").alias(c) for c in item]), "picks")
        if made.isEmpty():
            break
        picks.append(made.withColumn("rank", F.lit(k)))
        met = state.join(made.select(key, *[F.col(c).alias(f"__{c}") for c in item]), key, "left")
        there = F.col("__row_key").isNotNull()
        apart = array_distance(metric, F.col("columns"), F.col("__columns"))
        closer = there & (F.col("near").isNull() | (apart < F.col("near")))
        same = F.lit(True)
        for c in item:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        met = met.select(
            key, *item, "weight", F.when(closer, apart).otherwise(F.col("near")).alias("near"), F.when(there, F.col("total") + apart).otherwise(F.col("total")).alias("total"),
            F.when(closer, F.lit(k)).otherwise(F.col("nearest")).alias("nearest"), F.when(there & same & F.col("rank").isNull(), F.lit(k)).otherwise(F.col("rank")).alias("rank"),
        )
        before, state = state, written(met, "picking")
        discard(before)
    if not picks:
        picks = [made.withColumn("rank", F.lit(0))]
    whole = state.groupBy(key).agg(F.sum("weight").alias("entry_count"), F.coalesce(F.sum(F.when(F.col("rank").isNull(), F.col("weight"))), F.lit(0)).alias("remaining_count"))
    covered = state.filter("rank IS NULL").groupBy(key, F.col("nearest").alias("rank")).agg(F.sum("weight").alias("covered"))
    out = union_all(picks).join(whole, key).join(covered, [key, "rank"], "left")
    count, rest = F.coalesce("covered", F.lit(0)), F.col("remaining_count")
    part = lambda x: F.when(rest > 0, x / rest).otherwise(0.0)
    return out.select(key, "row_key", "partner_domain", F.col("rank").alias("selection_rank"), count.alias("coverage_count"), part(count).alias("coverage_fraction"), part(count * 100.0).alias("coverage_percent"), "entry_count", "remaining_count")


def nearest_point(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """K7: the point nearest to a place within a radius."""
    d = F.sqrt((F.col("px") - x) ** 2 + (F.col("py") - y) ** 2)
    return points.withColumn("hit_distance", d).filter(F.col("hit_distance") <= radius).orderBy("hit_distance", "group_index").limit(1)


def nearest_signal(chart: DataFrame, target: int) -> DataFrame:
    """K8: the column with a signal that is nearest to ``target``; ties go to the smaller."""
    return chart.filter("count > 0").agg(F.min_by("col", F.struct(F.abs(F.col("col") - target), "col")).alias("col"))


def signal_columns(chart: DataFrame, low: int, high: int) -> DataFrame:
    """K8: the columns with a signal between ``low`` and ``high``, each once, in order."""
    return chart.filter((F.col("count") > 0) & F.col("col").between(low, high)).select("col").distinct().orderBy("col")


def preload_order(items: DataFrame, active: int, position: str = "pos") -> DataFrame:
    """K9: items after the active one first, then around."""
    n = items.agg(F.count("*").alias("n"))
    return items.crossJoin(F.broadcast(n)).withColumn("turn", F.pmod(F.col(position) - active, F.col("n"))).orderBy("turn").drop("n")
