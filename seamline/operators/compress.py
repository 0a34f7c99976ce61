"""Identical interfaces as groups (A16, A37, J5, C13, F3 entries)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered, written


def entries(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, partner_domain, row_key and columns of rows that have columns."""
    cols = F.array_sort(F.array_distinct("interface_msa_columns_a"))
    return rows.select(*(by or []), "partner_domain", F.col("interface_row_key").alias("row_key"), cols.alias("columns")).filter(F.size("columns") > 0)


def groups(entries_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per partner and column set: member_count and row_key, the smallest of its members.

    Numbered ``group_index`` from 0 in the order of partner and columns, by a range-partitioned sort. Members
    are not listed here; ``memberships`` has them as rows, so a hot group stays spread.
    """
    by = by or []
    made = entries_.groupBy(*by, "partner_domain", "columns").agg(F.count("*").alias("member_count"), F.min("row_key").alias("row_key"))
    return numbered(made, [*by, "partner_domain", "columns"], "group_index").withColumn("group_id", F.concat(F.lit("g"), F.col("group_index").cast("string")))


def memberships(entries_: DataFrame, groups_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """group_index, partner_domain and row_key of every entry."""
    keys = [*(by or []), "partner_domain", "columns"]
    return entries_.join(groups_.select(*keys, "group_index"), keys).select(*(by or []), "group_index", "partner_domain", "row_key")


def with_members(groups_: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with ``members``, a sorted array of partner and row key, for payloads of one dataset."""
    listed = members.groupBy("group_index").agg(F.array_sort(F.collect_list(F.struct("row_key", "partner_domain"))).alias("members"))
    return groups_.join(listed, "group_index")


def signature(groups_: DataFrame, members: DataFrame) -> DataFrame:
    """One hash of all groups and their members that does not depend on how rows are spread.

    Rows are hashed one by one; the ordered digest is a hash over per-group digests, each a sum and so mergeable.
    """
    one = lambda *c: F.conv(F.substring(F.sha1(F.to_json(F.struct(*c))), 1, 15), 16, 10).cast("decimal(38,0)")
    m = members.agg(F.sum(one("group_index", "partner_domain", "row_key")).alias("m"), F.count("*").alias("n"))
    g = groups_.agg(F.sum(one("group_index", "partner_domain", "columns", "member_count")).alias("g"))
    return m.crossJoin(g).select(F.sha1(F.concat_ws("|", F.col("n").cast("string"), F.col("m").cast("string"), F.col("g").cast("string"))).alias("signature"))


def materialised(entries_: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, memberships), written once so that every later step reads the same numbers."""
    kept = written(entries_, "entries")
    g = written(groups(kept, by), "groups")
    return g, memberships(kept, g, by)
