"""Set distances of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import tiles
from .compress import signature


def set_distance(metric: str, common: Column, a: Column, b: Column) -> Column:
    """Distance in [0, 1] from the intersection's size and both sizes; a zero denominator gives 0.

    Written as 1 - share, so that equal inputs give equal bits, and never rounded.
    """
    if metric == "jaccard":
        top, bottom = common, a + b - common
    elif metric == "overlap":
        top, bottom = common, F.least(a, b)
    elif metric == "dice":
        top, bottom = 2 * common, a + b
    else:
        raise ValueError(f"unknown metric {metric!r}")
    share = top.cast("double") / bottom.cast("double")
    return F.when(bottom <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - share)))


def array_distance(metric: str, a: Column, b: Column) -> Column:
    """The distance of two distinct integer arrays."""
    return set_distance(metric, F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def common_sizes(groups: DataFrame, key: str = "group_index", within: list[str] | None = None) -> DataFrame:
    """Inverted index: i, j (i < j) and ``common`` of the pairs that share a column. Only those pairs are made."""
    within = within or []
    long = groups.select(*within, F.col(key).alias("g"), F.explode("columns").alias("c"))
    a, b = long.withColumnRenamed("g", "i"), long.withColumnRenamed("g", "j")
    return a.join(b, [*within, "c"]).filter("i < j").groupBy(*within, "i", "j").agg(F.count("*").alias("common"))


#: Allowance for rounding in the filters of near pairs; the comparison itself is exact.
SLACK = 1e-9


def least_common(metric: str, threshold: float, a: Column, b: Column) -> Column:
    """The smallest intersection that sets of ``a`` and ``b`` columns can have and be at most ``threshold`` apart."""
    share = 1.0 - threshold
    need = (a + b) * (share / (1 + share) if metric == "jaccard" else share / 2)
    return F.greatest(F.lit(1), F.ceil(need - SLACK)).cast("int")


def near_pairs(groups: DataFrame, metric: str, threshold: float, key: str = "group_index", within: list[str] | None = None) -> DataFrame:
    """i, j and distance of pairs at most ``threshold`` (below 1) apart.

    Jaccard and Dice go by an inverted index: columns are ordered by how many sets have them, rare ones first. A set shares at least
    ``need`` columns with a partner, so one of its ``size - need + 1`` rarest, its prefix, is among them; columns that most sets have drop out of the index.
    Only ids, sizes and places are shuffled; the places of a shared column must leave room for enough common ones, and the sets join the pairs
    that are left. Overlap has no such prefix for the larger set, as sizes may differ in any way, so it is made in tiles (``tiles.pairs``).
    """
    if threshold >= 1:
        raise ValueError("pairs without a common column are 1 apart; use all_pairs")
    within, share = within or [], 1.0 - threshold
    sets = groups.select(*within, F.col(key).alias("g"), F.array_distinct("columns").alias("columns")).filter(F.size("columns") > 0)
    if metric == "overlap":
        by = within or ["dataset"]
        sets = sets if within else sets.withColumn("dataset", F.lit(0))
        return tiles.pairs(sets.withColumn("g", F.col("g").cast("long")), by, metric, threshold).select(*within, "i", "j", "distance")
    long = sets.select(*within, "g", F.explode("columns").alias("c"))
    counts = long.groupBy(*within, "c").agg(F.count("*").alias("f"))
    ranked = long.join(counts, [*within, "c"]).groupBy(*within, "g").agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("r"))
    size = F.col("n")
    need = {"jaccard": size * share, "dice": size * (share / (2 - share))}[metric]
    prefix = F.slice("columns", F.lit(1), (size - F.greatest(F.lit(1), F.ceil(need - SLACK)) + 1).cast("int"))
    sets = written(ranked.select(*within, "g", F.transform("r", lambda x: x["c"]).alias("columns"), F.size("r").alias("n")), "prefixes")
    index = sets.select(*within, "g", "n", F.posexplode(prefix).alias("pos", "c"))
    a, b = (index.select(*within, "c", *[F.col(x).alias(f"{x}_{side}") for x in ("g", "n", "pos")]) for side in "ab")
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    met = a.join(b, [*within, "c"]).filter((F.col("g_a") < F.col("g_b")) & (room >= least_common(metric, threshold, F.col("n_a"), F.col("n_b"))))
    met = met.select(*within, F.col("g_a").alias("i"), F.col("g_b").alias("j")).distinct()
    for x in "ij":
        met = met.join(sets.select(*within, F.col("g").alias(x), F.col("columns").alias(f"columns_{x}"), F.col("n").alias(f"n_{x}")), [*within, x])
    both = met.withColumn("distance", set_distance(metric, F.size(F.array_intersect("columns_i", "columns_j")), F.col("n_i"), F.col("n_j")))
    return both.filter(F.col("distance") <= threshold).select(*within, "i", "j", "distance")


def all_pairs(groups: DataFrame, metrics: list[str], key: str = "group_index", within: list[str] | None = None) -> DataFrame:
    """Every pair i < j (of equal ``within``) and its distances. Quadratic by definition: for one dataset
    of compressed groups, whose number the caller bounds."""
    within = within or []
    a = groups.select(*within, F.col(key).alias("i"), F.col("columns").alias("ca"))
    b = groups.select(*within, F.col(key).alias("j"), F.col("columns").alias("cb"))
    both = a.join(b, within) if within else a.crossJoin(b)
    both = both.filter("i < j").withColumn("common", F.size(F.array_intersect("ca", "cb")))
    made = [set_distance(m, F.col("common"), F.size("ca"), F.size("cb")).alias(m) for m in metrics]
    return both.select(*within, "i", "j", *made)


def condensed_index(i: Column, j: Column, n: Column) -> Column:
    """Place of the pair i < j in the condensed upper triangle."""
    return (n * i - F.floor(i * (i + 1) / 2) + j - i - 1).cast("long")


def square(pairs: DataFrame, value: str = "distance") -> DataFrame:
    """Both orders of every pair."""
    return pairs.select("i", "j", value).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def quantised(d: Column) -> Column:
    """Storage form of a distance, an unsigned 16-bit number. Never cluster on it: 0.5 comes back above 0.5."""
    return F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), d)) * 65535).cast("int")


def dequantised(q: Column) -> Column:
    return (q / 65535.0).cast("float").cast("double")


def expanded(pairs: DataFrame, members: DataFrame, value: str = "distance") -> DataFrame:
    """Distances of entries, from those of their groups; entries of one group are 0 apart.

    ``members`` has group_index and ``entry`` (a number). Result i < j by entry.
    """
    a = members.select(F.col("group_index").alias("gi"), F.col("entry").alias("x"))
    b = members.select(F.col("group_index").alias("gj"), F.col("entry").alias("y"))
    apart = pairs.select(F.col("i").alias("gi"), F.col("j").alias("gj"), value).join(a, "gi").join(b, "gj").select("x", "y", value)
    same = a.join(b, F.col("gi") == F.col("gj")).filter("x < y").select("x", "y", F.lit(0.0).alias(value))
    return apart.unionByName(same).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), value)


def indicator(groups: DataFrame, key: str = "group_index") -> DataFrame:
    """The indicator matrix in long form."""
    return groups.select(key, F.explode("columns").alias("col"))


#: Layout of a stored distance table; a change makes every older one invalid.
CACHE_VERSION = 1


def stored(store, groups: DataFrame, members: DataFrame, metric: str, **depends) -> DataFrame:
    """All pair distances of the groups from the result cache, unquantised.

    A stored table names its metric, its layout's version, the groups' signature and its numbers of groups and pairs; it is read only if
    all of them are those of the groups at hand, and made anew otherwise.
    """
    n = groups.count()
    pairs = n * (n - 1) // 2
    told = signature(groups, members).first()["signature"]
    depends = {"metric": metric, "version": CACHE_VERSION, "signature": told, "groups": n, **depends}

    def make() -> DataFrame:
        made = all_pairs(groups, [metric]).withColumnRenamed(metric, "distance")
        return made.select("*", *[F.lit(v).alias(f"of_{k}") for k, v in {"metric": metric, "version": CACHE_VERSION, "signature": told, "groups": n}.items()])

    got = store.result("distances", make, **depends)
    fits = (F.col("of_metric") == metric) & (F.col("of_version") == CACHE_VERSION) & (F.col("of_signature") == told) & (F.col("of_groups") == n) & F.col("distance").between(0, 1)
    whole, good = got.agg(F.count("*"), F.count(F.when(fits, 1))).first()
    if (whole, good) != (pairs, pairs):
        got = store.result("distances", make, anew=True, **depends)
    return got.select("i", "j", "distance")


def materialised(pairs: DataFrame) -> DataFrame:
    return written(pairs, "pairs")
