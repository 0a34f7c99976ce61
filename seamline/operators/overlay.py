"""Per-residue and per-column views of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import clamp, mix
from ..functions.sequences import cells
from ..functions.tables import js_round, percent


def marks(rows: DataFrame) -> DataFrame:
    """Long form of overlays: row_key, partner_domain, col and kind (interface or surface), each once. Rows of one key are united before they
    are taken apart, so that a key is shuffled once and not with each column."""
    key = [F.col("interface_row_key").alias("row_key"), "partner_domain"]
    each = lambda k: F.array_distinct(F.flatten(F.collect_list(f"{k}_msa_columns_a")))
    kinds = [rows.groupBy(*key).agg(each(k).alias("cols")).select("row_key", "partner_domain", F.explode("cols").alias("col"), F.lit(k).alias("kind")) for k in ("interface", "surface")]
    return kinds[0].unionByName(kinds[1])


def column_stats(marks_: DataFrame) -> DataFrame:
    """partner_domain, col, count and denominator (rows with any interface column); partner ``__all__`` unites
    each row's columns over its partners."""
    own = marks_.filter("kind = 'interface'").select("partner_domain", "row_key", "col")
    everyone = own.select(F.lit("__all__").alias("partner_domain"), "row_key", "col").distinct()
    both = own.unionByName(everyone)
    rows = both.select("partner_domain", "row_key").distinct().groupBy("partner_domain").agg(F.count("*").alias("denominator"))
    return both.groupBy("partner_domain", "col").agg(F.count("*").alias("count")).join(rows, "partner_domain")


def merged(seen: DataFrame, page: DataFrame) -> DataFrame:
    """Rows seen so far and the new rows of a page; a row that was seen stays as it was."""
    keys = ["interface_row_key", "partner_domain"]
    return seen.unionByName(page.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti"))


def row_sets(rows: DataFrame) -> DataFrame:
    """row_key with its interface and surface columns united over partners, for a page of rows."""
    return rows.groupBy(F.col("interface_row_key").alias("row_key")).agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{k}_msa_columns_a")))).alias(k) for k in ("interface", "surface")]
    )


def cell_states(cells_: DataFrame, marks_: DataFrame) -> DataFrame:
    """The state of every cell: gap, then interface, then surface, then core. ``cells_`` has row_key, partner_domain,
    col and is_letter; marks may come from elsewhere (for the rows' own, see ``row_states``)."""
    best = marks_.groupBy("row_key", "partner_domain", "col").agg(F.min("kind").alias("kind"))
    out = cells_.join(best, ["row_key", "partner_domain", "col"], "left")
    return out.withColumn("state", F.when(~F.col("is_letter"), "gap").otherwise(F.coalesce("kind", F.lit("core"))))


def row_states(rows: DataFrame) -> DataFrame:
    """A27, X22 for rows with their own overlays: the state of every cell (col from 0) from the row's two column lists. No join: a
    row carries all that its cells need."""
    kept = rows.select("aligned_seq", "interface_msa_columns_a", "surface_msa_columns_a")
    at = cells(kept, ["interface_msa_columns_a", "surface_msa_columns_a"])
    has = lambda c: F.coalesce(F.array_contains(c, F.col("col")), F.lit(False))
    state = F.when(~F.col("is_letter"), "gap").when(has("interface_msa_columns_a"), "interface").when(has("surface_msa_columns_a"), "surface").otherwise("core")
    return at.select("col", state.alias("state"))


def state_distribution(states: DataFrame, rows: DataFrame) -> DataFrame:
    """Col, state, count and percent of all ``rows``; rows too short for a column are gaps there. Cells are aggregated once."""
    at = lambda s: F.count(F.when(F.col("state") == s, 1))
    total = rows.agg(F.count("*").alias("total"))
    wide = states.groupBy("col").agg(*[at(s).alias(s) for s in ("interface", "surface", "core")]).crossJoin(F.broadcast(total))
    kinds = [F.struct(F.lit(s).alias("state"), F.col(s).alias("count")) for s in ("interface", "surface", "core")]
    gap = F.struct(F.lit("gap").alias("state"), (F.col("total") - F.col("interface") - F.col("surface") - F.col("core")).alias("count"))
    long = wide.select("col", "total", F.explode(F.array(*kinds, gap)).alias("s")).select("col", "s.state", "s.count", "total").filter("count > 0")
    return long.select("col", "state", "count", js_round(F.col("count") / F.col("total") * 100).alias("percent"))


def partner_distribution(stats: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """For each column the partners that use it, their share of their rows, and that as part of all shares."""
    use = stats.filter((F.col("partner_domain") != "__all__") & (F.col("count") > 0))
    use = use if enabled is None else use.filter(F.col("partner_domain").isin(enabled))
    use = use.withColumn("fraction", F.col("count") / F.col("denominator")).withColumn("percent", F.greatest(F.lit(1).cast("long"), percent(F.col("count"), F.col("denominator"))))
    order = Window.partitionBy("col").orderBy(F.desc("fraction"), F.desc("count"), "partner_domain")
    share = F.col("fraction") / F.sum("fraction").over(Window.partitionBy("col")) * 100
    return use.withColumn("rank", F.row_number().over(order)).withColumn("chart_percent", share)


def top_residues(cells_: DataFrame, rows: DataFrame, selected: str | None = None, n: int = 5) -> DataFrame:
    """K3: the most frequent letters of each column with their percent of all ``rows``; a selected letter that is not among them
    takes the last place."""
    counts = cells_.filter("is_letter").groupBy("col", F.upper("ch").alias("residue")).agg(F.count("*").alias("count"))
    order = Window.partitionBy("col").orderBy(F.desc("count"), "residue")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    chosen = F.lit(False) if not selected else F.col("residue") == selected.upper()
    rescued = F.max(F.when(chosen & (F.col("rank") > n), 1).otherwise(0)).over(Window.partitionBy("col"))
    out = ranked.withColumn("rescued", rescued).filter((F.col("rank") <= n - F.col("rescued")) | (chosen & (F.col("rescued") == 1)))
    out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    return out.select("col", "residue", "count", js_round(F.col("count") / F.col("total") * 100).alias("percent"), F.row_number().over(order).alias("rank"), chosen.alias("is_selected"))


def residue_lookup(row: DataFrame, identity: DataFrame) -> DataFrame:
    """residue_id, letter, column and conservation of the residues of alignment rows. ``identity`` has a row a column, so it is sent to the residues."""
    ids = row.select("row_key", F.posexplode("residue_ids").alias("col", "residue_id"), "aligned_sequence").filter("residue_id IS NOT NULL")
    letter = F.substring("aligned_sequence", F.col("col") + 1, F.lit(1)).alias("letter")
    return ids.select("row_key", "residue_id", "col", letter).join(F.broadcast(identity.select("col", "identity")), "col", "left")


#: Colours of a residue without a signal, with an interface column, and conserved.
PLAIN, INTERFACE, CONSERVED = (143, 138, 130), (188, 64, 45), (47, 125, 90)


def residue_styles(lookup: DataFrame, lens: str, values: DataFrame | None = None) -> DataFrame:
    """Intensity in [0, 1] of each residue by a lens, with the colour or the label that it is shown in.

    ``interface``: the share of rows that use the column, from ``column_stats`` of one partner. ``conservedness``: the column's identity.
    ``partners``: the share of the column's first partner, and its name, from ``partner_distribution``. ``column``: 1 and the column.
    ``cluster``: the support of the column's dominant cluster, and its label; residues without one are left out.
    All values have a row a column, so they are sent to the residues, which are not shuffled.
    """
    if lens == "conservedness":
        out = lookup.withColumn("intensity", clamp(F.coalesce(F.col("identity"), F.lit(0)) / 100))
        return out.withColumn("colour", mix(PLAIN, CONSERVED, F.col("intensity")))
    if lens == "column":
        return lookup.withColumn("intensity", F.lit(1.0)).withColumn("label", F.col("col").cast("string"))
    if lens == "interface":
        share = values.select("col", F.when(F.col("denominator") > 0, F.col("count") / F.col("denominator")).alias("share"))
        out = lookup.join(F.broadcast(share), "col", "left").withColumn("intensity", F.coalesce("share", F.lit(0.0))).drop("share")
        return out.withColumn("colour", mix(PLAIN, INTERFACE, F.col("intensity")))
    if lens == "partners":
        first = values.filter("rank = 1").select("col", F.col("partner_domain").alias("label"), F.col("fraction").alias("share"))
        return lookup.join(F.broadcast(first), "col", "left").withColumn("intensity", F.coalesce("share", F.lit(0.0))).drop("share")
    if lens == "cluster":
        return lookup.join(F.broadcast(values.select("col", F.col("support").alias("intensity"), F.col("cluster_label").cast("string").alias("label"))), "col")
    raise ValueError(f"unknown lens {lens!r}")
