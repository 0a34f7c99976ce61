"""Counts, histograms, identity and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import letter_counts, masked

METRICS = ("interface_rows", "dataset_interfaces", "interaction_partners", "avg_interface_residues_per_row")


def partner_counts(rows: DataFrame) -> DataFrame:
    """A3."""
    return rows.groupBy("partner_domain").agg(F.count("*").alias("row_count")).orderBy("partner_domain")


def summary_columns() -> list[Column]:
    """Aggregates of one summary; ``dataset_interfaces`` counts all rows, and
    ``nonempty_interfaces`` those with columns."""
    cols = F.when(F.size("interface_msa_columns_a") > 0, F.struct("partner_domain", "interface_msa_columns_a"))
    return [
        F.count_distinct(F.struct("protein_id", "fragment_key")).alias("dataset_domains"),
        F.count("*").alias("dataset_interfaces"),
        F.count(cols).alias("nonempty_interfaces"),
        F.count_distinct(cols).alias("unique_interfaces"),
        F.coalesce(F.max(F.length("aligned_seq")), F.lit(0)).alias("alignment_length"),
    ]


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summary of all rows, or of each value of ``by``."""
    return (rows.groupBy(*by) if by else rows).agg(*summary_columns())


def size_histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows have each interface size above 0."""
    sized = rows.withColumn("size", F.size("interface_msa_columns_a")).filter("size > 0")
    return sized.groupBy(*(by or []), "size").agg(F.count("*").alias("count"))


def rebinned(histogram: DataFrame, most: int = 24) -> DataFrame:
    """Start, end and count of at most ``most`` bars; few entries stay as they are."""
    span = histogram.agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n"))
    at = histogram.crossJoin(F.broadcast(span))
    width = F.when(F.col("n") <= most, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / most)))
    at = at.withColumn("width", width.cast("int")).withColumn("start", F.expr("low + ((size - low) div width) * width").cast("int"))
    out = at.groupBy("start", "width", "high").agg(F.sum("count").alias("count"))
    return out.select("start", F.least("high", F.col("start") + F.col("width") - 1).cast("int").alias("end"), "count").orderBy("start")


def bin_member(rows: DataFrame, start: int, end: int, seed: int = 0) -> DataFrame:
    """One row of a histogram bin, the same for a seed."""
    inside = rows.filter(F.size("interface_msa_columns_a").between(start, end))
    return inside.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "interface_row_key", "partner_domain")), "interface_row_key", "partner_domain").limit(1)


def selector_stats(rows: DataFrame) -> DataFrame:
    """Statistics of each family over all its files. ``rows`` has family and path.

    The mean size per row key is of the union of its columns over files and partners: two levels of grouping.
    """
    cols = F.col("interface_msa_columns_a")
    some = F.size(cols) > 0
    unique = F.when(some, F.struct("path", "partner_domain", cols.alias("c")))
    main = rows.groupBy("family").agg(
        F.coalesce(F.max(F.length("aligned_seq")), F.lit(0)).alias("alignment_length"),
        F.count_distinct(F.struct("protein_id", "fragment_key")).alias("dataset_domains"),
        F.count_distinct("interface_row_key").alias("interface_rows"),
        F.count(F.when(some, True)).alias("dataset_interfaces"),
        F.count_distinct(unique).alias("unique_interfaces"),
        F.count_distinct("partner_domain").alias("interaction_partners"),
    )
    # One row a (row key, column) first: no list of a hot key is ever collected.
    long = rows.select("family", "interface_row_key", F.explode_outer(cols).alias("c")).distinct()
    per_key = long.groupBy("family", "interface_row_key").agg(F.count("c").alias("n"))
    mean = per_key.groupBy("family").agg(F.round(F.avg("n"), 2).alias("avg_interface_residues_per_row"))
    return main.join(mean, "family")


def z_category(z: Column) -> Column:
    """A standard score as one of five categories."""
    return F.when(z <= -3, "very_small").when(z <= -1, "small").when(z < 1, "normal").when(z < 3, "big").otherwise("very_big")


def with_categories(stats: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``<metric>_category`` by the standard score of log(1 + value), with the population's deviation.

    Mean and deviation come from one aggregation of all rows, which is joined back as one row.
    """
    logs = {m: F.log1p(F.col(m).cast("double")) for m in metrics}
    whole = stats.agg(F.count("*").alias("__n"), *[f(logs[m]).alias(f"__{k}_{m}") for m in metrics for k, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    out = stats.crossJoin(F.broadcast(whole))
    for m in metrics:
        dev = F.col(f"__dev_{m}")
        z = (logs[m] - F.col(f"__mean_{m}")) / dev
        out = out.withColumn(f"{m}_category", F.when((F.col("__n") < 2) | (dev < 1e-12), "normal").otherwise(z_category(z)))
    return out.select(*stats.columns, *[f"{m}_category" for m in metrics])


def clean_identity(rows: DataFrame, by: list[str] | None = None, length: int | None = None) -> DataFrame:
    """For each alignment column the share (0 to 100, cut to whole) of unique rows that have its
    most frequent letter, of letters inside the row's fragment only.

    A row key counts once, from its first partner. A letter's residue number is the fragment's start plus the
    letters before it. ``rows`` has partner_domain, interface_row_key, fragment_key and aligned_seq. Columns without a kept letter are
    0 if ``length`` is given, else left out.
    """
    by = by or []
    first = rows.groupBy(*by, "interface_row_key").agg(F.min_by(F.struct("fragment_key", "aligned_seq"), "partner_domain").alias("r")).select(*by, "interface_row_key", "r.*")
    n = first.groupBy(*by).agg(F.count("*").alias("unique_rows")) if by else first.agg(F.count("*").alias("unique_rows"))
    kept = first.select(*by, masked("aligned_seq", "fragment_key")["aligned_sequence"].alias("kept"))
    counts = letter_counts(kept, by, "kept")
    best = counts.groupBy(*by, "col").agg(F.max("n").alias("best"))
    shares = best.join(n, by) if by else best.crossJoin(F.broadcast(n))
    out = shares.select(*by, "col", F.expr("best * 100 div unique_rows").cast("int").alias("identity"))
    if length is not None:
        grid = rows.sparkSession.range(length).select(F.col("id").cast("int").alias("col"))
        grid = n.select(*by).crossJoin(grid) if by else grid
        out = grid.join(out, [*by, "col"], "left").withColumn("identity", F.coalesce("identity", F.lit(0)))
    return out


def letter_identity(rows: DataFrame) -> DataFrame:
    """Share (0 to 100) of rows with the column's most frequent letter, over unmasked sequences."""
    n = rows.agg(F.count("*").alias("total"))
    counts = letter_counts(rows, [], "aligned_seq")
    best = counts.groupBy("col").agg(F.max_by("letter", F.struct("n", -F.ascii("letter"))).alias("letter"), F.max("n").alias("n"))
    return best.crossJoin(F.broadcast(n)).select("col", "letter", F.expr("n * 100 div total").cast("int").alias("identity"))


def with_metadata(stats: DataFrame, metadata: DataFrame) -> DataFrame:
    """Stats with the family's display name, empty where it is unknown."""
    named = metadata.select(F.col("family"), "display_name").dropDuplicates(["family"])
    return stats.join(named, "family", "left").withColumn("display_name", F.coalesce("display_name", F.lit("")))


def dataset_options(files: DataFrame, stats: DataFrame) -> DataFrame:
    """Distinct (family, name) pairs with their family's stats."""
    return files.select("family", "name").distinct().join(stats, "family", "left")
