"""Distances of all sets of a dataset in tiles of a grid (J1, D1-D3), or of those that share a column in tiles of buckets of columns.

Sets are dealt to blocks of about ``TILE`` by a hash; a task gets two blocks and makes their distances by one matrix product. A set is sent once for each
block, its pairs never leave the task unless they are asked for, so n sets cost n^2 multiplications but no n^2 rows. Columns that most sets
have are no hot keys here: there are no keys.

Most sets of large datasets share no column and are 1 apart. Where only smaller distances are asked for, sets are first dealt to buckets, ranges of columns,
and every bucket has a grid of its own; a pair is looked at in the bucket of the smallest column that both have. Where that would be more
work than all pairs, as columns are shared by most sets, there is one bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

#: Sets of a block.
TILE = 2048

#: Sets that a bucket of columns has on average.
BUCKET = 512


def grid(sets: DataFrame, by: list[str]) -> DataFrame:
    """``sets`` (by, g and more) once for each tile they are part of: ``own`` is the set's block, a <= b are the tile's."""
    sizes = sets.groupBy(*by).agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    own = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
    rows = sets.join(sizes, by).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("blocks", "other")


def bucket_width(sets: DataFrame, by: list[str]) -> int:
    """Columns of a bucket; 0 if all pairs are less work, or if a set has no columns and so may be near to others without sharing one."""
    columns = sets.select(F.explode("columns").alias("c")).agg(F.count("*").alias("held"), F.count_distinct("c").alias("names")).first()
    if not columns.held or not sets.filter(F.size("columns") == 0).isEmpty():
        return 0
    width = max(1, BUCKET * columns.names // columns.held)
    cost = lambda rows, keys: rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    return width if cost(bucketed(sets.select(*by, "g", "columns"), width), [*by, "bucket"]) < cost(sets, by) else 0


def bucketed(sets: DataFrame, width: int) -> DataFrame:
    """``sets`` once for each ``bucket`` of ``width`` columns that they have a column of; in one bucket if ``width`` is 0."""
    names = F.array_distinct(F.transform("columns", lambda c: F.floor(c / width))) if width else F.array(F.lit(0).cast("long"))
    return sets.withColumn("bucket", F.explode(names))


def tile(pdf: pd.DataFrame, a: int, b: int, metric: str, span: tuple[int, int] | None = None) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Both blocks' sets in order of g, and their distances; a set's distance to itself is infinite, and so are those of pairs whose smallest common column
    is not in ``span``."""
    left, right = (pdf[pdf["own"] == k].sort_values("g") for k in (a, b))
    x, y = list(left["columns"]), list(right["columns"])
    if span is None:
        d = kernels.cross_distances(x, y, metric)
    else:
        low, high = span
        cut = lambda sets, keep: [c[keep(c)] for c in sets]
        before, here, after = (kernels.common_counts(cut(x, keep), cut(y, keep)) for keep in (lambda c: c < low, lambda c: (c >= low) & (c < high), lambda c: c >= high))
        d = kernels.distances_of(before + here + after, x, y, metric)
        d[(here == 0) | (before > 0)] = np.inf
    if a == b:
        np.fill_diagonal(d, np.inf)
    return left, right, d


def keyed(out: pd.DataFrame, by: list[str], key: tuple) -> pd.DataFrame:
    for name, value in reversed(list(zip(by, key))):
        out.insert(0, name, value)
    return out


def schema_of(df: DataFrame, by: list[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in by), rest])


def over(sets: DataFrame, by: list[str], made, rest: str, width: int = 0) -> DataFrame:
    """``made(pdf, a, b, span)`` of every tile: rows with the columns ``rest``, and the dataset's. With a ``width`` every bucket of as many columns, its
    ``span``, has its own tiles."""

    schema = schema_of(sets, by, rest)
    columns = [c.split()[0] for c in rest.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *names, bucket, a, b = key
        if pdf["own"].nunique() < len({a, b}):  # the hash may leave a block empty
            return pd.DataFrame(columns=[*by, *columns])
        return keyed(made(pdf, a, b, (bucket * width, (bucket + 1) * width) if width else None), by, tuple(names))

    # Tiles are more work than bytes: their number of tasks must not shrink with those.
    spark = sets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = [*by, "bucket", "a", "b"]
    return grid(bucketed(sets, width), [*by, "bucket"]).repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, schema)


def pairs(sets: DataFrame, by: list[str], metric: str, most: float = np.inf) -> DataFrame:
    """i < j and distance of all pairs at most ``most`` apart. Without that bound they are all pairs, one row each."""

    def made(pdf: pd.DataFrame, a: int, b: int, span: tuple[int, int] | None) -> pd.DataFrame:
        left, right, d = tile(pdf, a, b, metric, span)
        x, y = np.nonzero((d <= most) & np.isfinite(d))
        i, j = left["g"].to_numpy()[x], right["g"].to_numpy()[y]
        keep = i < j if a == b else slice(None)
        return pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "distance": d[x, y][keep]})

    return over(sets, by, made, "i long, j long, distance double")


def reach(d: np.ndarray, left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Mutual reachability where sets have a ``core`` distance; else the distances themselves."""
    if "core" not in left:
        return d
    return np.maximum(d, np.maximum(left["core"].to_numpy()[:, None], right["core"].to_numpy()[None, :]))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of the minimum spanning forest of n nodes; edges are in order."""
    return forest_and_roots(u, v, n)[0]


def forest_and_roots(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` and every node's root in it."""
    comp, left, taken = np.arange(n), np.arange(len(u)), []
    while True:
        left = left[comp[u[left]] != comp[v[left]]]
        if not len(left):
            return np.concatenate([np.empty(0, np.int64), *taken]), comp
        best = np.full(n, len(u))
        np.minimum.at(best, comp[u[left]], left)
        np.minimum.at(best, comp[v[left]], left)
        (c,) = np.nonzero(best < len(u))
        e = best[c]
        taken.append(np.unique(e))
        comp = led(c, comp[u[e]] + comp[v[e]] - c, n)[comp]


def led(c: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """The root of each of n components after those of ``c`` hooked on to ``to``: of two that hook on to each other the smaller leads."""
    own, root = np.arange(n), np.arange(n)
    root[c] = to
    root = np.where((root[root] == own) & (own < root), own, root)
    while (root[root] != root).any():
        root = root[root]
    return root


def forests(sets: DataFrame, by: list[str], metric: str, width: int | None = None) -> DataFrame:
    """i < j and distance of the edges below 1 of every tile's minimum spanning forest; those of the dataset's are among them. Edges are in order of distance,
    i and j. ``sets`` has by, g, columns and perhaps core. ``width`` is their ``bucket_width``, if known."""

    def made(pdf: pd.DataFrame, a: int, b: int, span: tuple[int, int] | None) -> pd.DataFrame:
        left, right, d = tile(pdf, a, b, metric, span)
        d = reach(d, left, right)
        x, y = np.nonzero(d < 1)
        if a == b:
            x, y = x[x < y], y[x < y]
        g, h, far = left["g"].to_numpy()[x], right["g"].to_numpy()[y], d[x, y]
        i, j = np.minimum(g, h), np.maximum(g, h)
        # In one block, pairs come in order of i and j.
        order = np.argsort(far, kind="stable") if a == b else np.lexsort((j, i, far))
        shift = 0 if a == b else len(left)
        kept = order[forest(x[order], y[order] + shift, shift + len(right))]
        return pd.DataFrame({"i": i[kept], "j": j[kept], "distance": far[kept]})

    return over(sets, by, made, "i long, j long, distance double", bucket_width(sets, by) if width is None else width)


def core_distances(sets: DataFrame, by: list[str], metric: str, samples: int, width: int | None = None) -> DataFrame:
    """G and ``core``, the smallest distance within which a set has ``samples`` entries, its own copies included. ``sets`` has by, g,
    columns and member_count, the entries of each set. A tile passes on at most ``samples`` distances of a set."""

    def made(pdf: pd.DataFrame, a: int, b: int, span: tuple[int, int] | None) -> pd.DataFrame:
        left, right, d = tile(pdf, a, b, metric, span)
        parts = []
        for sets_, near, times in ((left, d, right["member_count"].to_numpy()), (right, d.T, left["member_count"].to_numpy()))[: 1 if a == b else 2]:
            k = min(samples, near.shape[1])
            at = np.argpartition(near, k - 1, axis=1)[:, :k]
            part = pd.DataFrame({"g": np.repeat(sets_["g"].to_numpy(), k), "distance": np.take_along_axis(near, at, 1).ravel(), "n": times[at].ravel()})
            part = part[np.isfinite(part["distance"])]
            parts.append(part.groupby(["g", "distance"], as_index=False)["n"].sum())
        return pd.concat(parts)

    near = over(sets, by, made, "g long, distance double, n long", bucket_width(sets, by) if width is None else width).groupBy(*by, "g", "distance").agg(F.sum("n").alias("n"))
    own = sets.select(*by, "g", F.lit(0.0).alias("distance"), F.col("member_count").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "g").orderBy("distance"))
    ranked = near.unionByName(own).withColumn("upto", upto)
    found = ranked.groupBy(*by, "g").agg(F.min(F.when(F.col("upto") >= samples, F.col("distance"))).alias("core"), F.max("upto").alias("upto"), F.max("distance").alias("most"))
    # Entries that no tile has are 1 away. A dataset of fewer entries than asked for takes its farthest one.
    farthest = F.when(F.col("upto") < F.col("entries"), F.lit(1.0)).otherwise(F.col("most"))
    entries = sets.groupBy(*by).agg(F.sum("member_count").alias("entries"))
    return found.join(entries, by).select(*by, "g", F.coalesce("core", farthest).alias("core"))
