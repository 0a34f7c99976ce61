"""Filters, paging and projections of interface rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_matches
from ..settings import ALL_PARTNERS, PageSettings

BIG, SMALL = ("big", "very_big"), ("small", "very_small")


def by_size(rows: DataFrame, least: int) -> DataFrame:
    """both interfaces have ``least`` residues; 0 leaves the rows as they are. Partners left without rows
    vanish by themselves. A plain comparison, so it reaches the scan."""
    return rows if least <= 0 else rows.filter((F.col("interface_size_a") >= least) & (F.col("interface_size_b") >= least))


def of_partner(rows: DataFrame, partner: str = ALL_PARTNERS) -> DataFrame:
    """F11."""
    return rows if partner == ALL_PARTNERS else rows.filter(F.col("partner_domain") == partner)


def page(rows: DataFrame, settings: PageSettings, order: str = "row_order") -> DataFrame:
    """Rows of a page in order. ``order`` numbers the rows from 0 without holes, so a page is a range
    that the scan can skip by, not a sort of everything before it."""
    out = rows.filter(F.col(order) >= settings.offset)
    if settings.limit is not None:
        out = out.filter(F.col(order) < settings.offset + settings.limit)
    return out.orderBy(order)


def page_of_filtered(rows: DataFrame, settings: PageSettings, order: str = "row_order") -> DataFrame:
    """F5 after a filter, where the order has holes: a sort with limit and offset."""
    out = rows.orderBy(order)
    if settings.offset:
        out = out.offset(settings.offset)
    return out if settings.limit is None else out.limit(settings.limit)


def completeness(rows: DataFrame, settings: PageSettings) -> DataFrame:
    """row_count, row_offset, row_limit, rows_loaded and rows_complete of a page."""
    total = rows.agg(F.count("*").alias("row_count"))
    rest = F.greatest(F.col("row_count") - settings.offset, F.lit(0))
    loaded = rest if settings.limit is None else F.least(rest, F.lit(settings.limit))
    return total.select(
        "row_count",
        F.lit(settings.offset).cast("long").alias("row_offset"),
        F.lit(settings.limit).cast("long").alias("row_limit"),
        loaded.cast("long").alias("rows_loaded"),
        (F.lit(settings.offset) + loaded >= F.col("row_count")).alias("rows_complete"),
    )


def columns_only(rows: DataFrame) -> DataFrame:
    """what distances need; the other columns are never read."""
    return rows.select("partner_domain", "interface_row_key", "interface_msa_columns_a")


def row_of(rows: DataFrame, row_key: str, partner: str = ALL_PARTNERS) -> DataFrame:
    """F8: the rows of one key, of one partner or of all, in order of partner."""
    return of_partner(rows.filter(F.col("interface_row_key") == row_key), partner).orderBy("partner_domain")


def candidates(rows: DataFrame) -> DataFrame:
    """candidates for a representative, with the length of the longest sequence beside each."""
    length = rows.agg(F.coalesce(F.max(F.length("aligned_seq")), F.lit(0)).alias("alignment_length"))
    return rows.select("partner_domain", "interface_row_key", "aligned_seq", "interface_msa_columns_a").crossJoin(F.broadcast(length))


def with_badges(stats: DataFrame, wanted: dict[str, set[str]]) -> DataFrame:
    """every metric with wanted directions has a category in one of them."""
    out = stats
    for metric, directions in wanted.items():
        names = [n for d, group in (("big", BIG), ("small", SMALL)) if d in directions for n in group]
        if directions:
            out = out.filter(F.col(f"{metric}_category").isin(names))
    return out


def searched(rows: DataFrame, query: str, label: str = "display_row_key") -> DataFrame:
    """F14."""
    return rows.filter(fuzzy_matches(F.col(label), query))


def visible(rows: DataFrame, query: str = "", overlay: DataFrame | None = None, memberships: DataFrame | None = None, clusters: list[int] | None = None) -> DataFrame:
    """rows that match the search, have a non-empty overlay, and belong to a visible cluster.

    ``overlay`` has row_key for rows with columns; ``memberships`` has row_key and cluster_label.
    """
    out = searched(rows, query)
    if overlay is not None:
        out = out.join(overlay.select("row_key").distinct(), "row_key", "left_semi")
    if memberships is not None and clusters is not None:
        out = out.join(in_visible(memberships, "cluster_label", clusters).select("row_key").distinct(), "row_key", "left_semi")
    return out


def used_columns(cells: DataFrame) -> DataFrame:
    """F16: columns in which any row has a letter; all columns if none has."""
    seen = cells.groupBy("col").agg(F.bool_or("is_letter").alias("used"))
    any_used = seen.agg(F.bool_or("used").alias("any"))
    return seen.crossJoin(F.broadcast(any_used)).filter(F.col("used") | ~F.coalesce("any", F.lit(False))).select("col")


def in_visible(df: DataFrame, label: str, shown: list | None, reset_when_empty: bool = False) -> DataFrame:
    """rows whose label is shown; None shows everything, and so does an empty list if asked to reset."""
    if shown is None or (reset_when_empty and not shown):
        return df
    return df.filter(F.col(label).isin(list(shown)))
