"""Layouts of groups in three dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import EmbeddingSettings
from . import kernels
from .cluster import _schema, per_dataset

POINTS = "group_index long, x double, y double, z double, share0 double, share1 double, share2 double"


def layout(groups: DataFrame, settings: EmbeddingSettings, by: list[str] | None = None) -> DataFrame:
    """group_index and coordinates in the unit ball, one task a dataset, and beside them the shares of variance that PCA
    explains (0 for t-SNE). PCA and t-SNE over the indicator matrix or, for a set metric, over the distances."""
    data, keys = per_dataset(groups.select(*(by or []), "group_index", "columns"), by or [])
    s = settings

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_index")
        sets = [list(c) for c in pdf["columns"]]
        x = indicator_matrix(sets) if s.distance == "binary" else kernels.distance_matrix(sets, s.distance)
        if s.method == "pca":
            coords, share = kernels.pca(x)
        else:
            share = np.zeros(3)
            coords = kernels.tsne(x, s.distance != "binary", s.perplexity, s.learning_rate, s.max_iter, s.early_exaggeration_iter, s.early_exaggeration, s.random_state)[0]
        coords = kernels.unit_ball(coords)
        out = pd.DataFrame({"group_index": pdf["group_index"].to_numpy(), "x": coords[:, 0], "y": coords[:, 1], "z": coords[:, 2], **{f"share{k}": share[k] for k in range(3)}})
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    out = data.groupBy(*keys).applyInPandas(run, _schema(data, keys, POINTS))
    return out if by else out.drop("dataset")


def indicator_matrix(sets: list) -> np.ndarray:
    columns = sorted({c for s in sets for c in s})
    x = np.zeros((len(sets), len(columns)))
    place = {c: k for k, c in enumerate(columns)}
    for i, s in enumerate(sets):
        x[i, [place[c] for c in s]] = 1
    return x


def gram(long: DataFrame, key: str = "group_index") -> DataFrame:
    """E1 at scale: a, b (a <= b) and n, how many groups have both columns: X'X from the long indicator form.

    Its size depends on the number of columns alone. One self-join on the group, aggregated before it is shuffled by
    column pair.
    """
    a, b = long.select(key, F.col("col").alias("a")), long.select(key, F.col("col").alias("b"))
    return a.join(b, key).filter("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"))


def pca_at_scale(groups: DataFrame, most_columns: int = 4096):
    """E1 for any number of groups: (coordinates, shares of variance).

    The centred Gram matrix of the columns is decomposed on the driver - ``most_columns`` bounds it - and groups are projected
    where they are. Signs: the largest loading of each component is positive.
    """
    long = groups.select("group_index", F.explode("columns").alias("col"))
    n = groups.count()
    columns = np.array(sorted(r["col"] for r in long.select("col").distinct().limit(most_columns + 1).collect()), int)
    if len(columns) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    pairs = gram(long).toPandas()
    at = {c: k for k, c in enumerate(columns.tolist())}
    g = np.zeros((len(columns), len(columns)))
    i, j = pairs["a"].map(at).to_numpy(int), pairs["b"].map(at).to_numpy(int)
    g[i, j] = g[j, i] = pairs["n"]
    mean = np.diag(g) / max(1, n)
    centred = g - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(centred) if len(columns) else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)[:3]
    v = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
    total = max(np.maximum(values, 0).sum(), 0)
    share = np.zeros(3)
    share[: len(order)] = np.maximum(values[order], 0) / total if total > 0 else 0
    loads = np.zeros((len(columns), 3))
    loads[:, : v.shape[1]] = v
    spark = groups.sparkSession
    table = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(columns, loads)], "col int, p0 double, p1 double, p2 double")
    base = mean @ loads if len(columns) else np.zeros(3)
    made = long.join(F.broadcast(table), "col").groupBy("group_index").agg(*[(F.sum(f"p{k}") - float(base[k])).alias(c) for k, c in enumerate("xyz")])
    return made, share


def normalised(points: DataFrame) -> DataFrame:
    """Centred coordinates divided by the largest radius; two small aggregations, no global window."""
    mean = points.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    at = points.crossJoin(F.broadcast(mean))
    for c in "xyz":
        at = at.withColumn(c, F.col(c) - F.col(f"m{c}"))
    at = at.drop(*[f"m{c}" for c in "xyz"])
    radius = at.agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("r"))
    at = at.crossJoin(F.broadcast(radius))
    scale = F.when(F.col("r") > 0, F.col("r")).otherwise(F.lit(1.0))
    for c in "xyz":
        at = at.withColumn(c, F.col(c) / scale)
    return at.drop("r")


def embedding_points(points: DataFrame, groups: DataFrame) -> DataFrame:
    """E4."""
    return points.join(groups, "group_index").select("group_id", "row_key", "partner_domain", F.size("columns").alias("interface_size"), "member_count", "x", "y", "z")


def projected(points: DataFrame, yaw: float, pitch: float) -> DataFrame:
    """Px, py and depth after turning by yaw and then pitch; radius grows with members, alpha with depth."""
    cy, sy, cp, sp = (F.lit(float(f(a))) for a in (yaw, pitch) for f in (np.cos, np.sin))
    x1, z1 = F.col("x") * cy + F.col("z") * sy, F.col("z") * cy - F.col("x") * sy
    depth = z1 * cp + F.col("y") * sp
    return points.select(
        "*", x1.alias("px"), (F.col("y") * cp - z1 * sp).alias("py"), depth.alias("depth"), F.log1p(F.col("member_count") - 1.0).alias("size_boost"), ((depth + 1) / 2).alias("nearness")
    )


def jittered(points: DataFrame) -> DataFrame:
    """Points that share their place to three decimals, spread evenly on a circle around it."""
    spot = [F.round(c, 3).alias(f"b{c}") for c in "xyz"]
    at = points.select("*", *spot)
    w = Window.partitionBy("bx", "by", "bz")
    at = at.withColumn("k", F.row_number().over(w.orderBy("group_index")) - 1).withColumn("n", F.count("*").over(w))
    radius = F.when(F.col("n") > 1, F.least(F.lit(10.0), 2.8 + 1.8 * F.log1p(F.col("n").cast("double")))).otherwise(F.lit(0.0))
    turn = 2 * F.pi() * F.col("k") / F.col("n")
    return at.select(*points.columns, (radius * F.cos(turn)).alias("dx"), (radius * F.sin(turn)).alias("dy"))


def with_majority(members: DataFrame, labels: DataFrame) -> DataFrame:
    """group_index and the label most of its members have; ties go to the smaller label."""
    joined = members.join(labels, ["row_key", "partner_domain"], "left").withColumn("l", F.coalesce("cluster_label", F.lit(-1)))
    counts = joined.groupBy("group_index", "l").agg(F.count("*").alias("n"))
    return counts.groupBy("group_index").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("cluster_label"))
