"""Residue sets of one row for a structure view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import expand_ranges, fragment_ranges, key_part


def residue_sets(rows: DataFrame) -> DataFrame:
    """For each row key the united residue sets over its partners. A row has few partners, so lists are small.

    Partner fragments come from the payload, or from the row key where the payload has none.
    """
    own = fragment_ranges(key_part(F.col("interface_row_key"), 3))
    some = F.size("fragments_b") > 0
    ranges = F.when(some, F.col("fragments_b")).otherwise(own)
    use = rows.withColumn("ranges", ranges).withColumn("fragment_ids", expand_ranges(F.col("ranges")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    labels = F.transform("ranges", lambda r: F.concat_ws("-", r["s"], r["e"]))
    return use.withColumn("labels", labels).groupBy("interface_row_key").agg(
        union("interface_residues_a").alias("interface_residue_ids"),
        union("surface_residue_ids_a").alias("surface_residue_ids"),
        union("interface_residues_b").alias("partner_interface_residue_ids"),
        union("surface_residue_ids_b").alias("partner_surface_residue_ids"),
        union("fragment_ids").alias("partner_fragment_residue_ids"),
        union("labels").alias("partner_fragment_ranges"),
        union("residue_contacts").alias("residue_contacts"),
        F.array_sort(F.collect_set("partner_domain")).alias("matched_partners"),
    )


def fragment_residues(rows: DataFrame) -> DataFrame:
    """The residues of a row's own fragment."""
    return rows.select("interface_row_key", expand_ranges(fragment_ranges(key_part(F.col("interface_row_key"), 2))).alias("residue_ids"))


def contact_lines(contacts: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Contacts whose two ends have coordinates, each once, with its length. ``a`` and ``b`` have residue_id, x, y, z."""
    ends = [df.select(F.col("residue_id").alias(r), *[F.col(c).alias(f"{r}{c}") for c in "xyz"]) for df, r in ((a, "a"), (b, "b"))]
    both = contacts.select("a", "b").distinct().join(ends[0], "a").join(ends[1], "b")
    length = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"))
    return both.withColumn("length", length)


def contact_pdb(lines: DataFrame) -> DataFrame:
    """P5: fixed-width atom and bond lines of each contact, in order of (a, b)."""
    def atom(serial, chain: str, r: str):
        return F.format_string(
            "HETATM%5d  C   CON " + chain + "%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", serial, F.col(r).cast("int"), *[F.col(f"{r}{c}") for c in "xyz"]
        )

    from ..functions.tables import numbered

    at = numbered(lines, ["a", "b"], "n").withColumn("s", (F.col("n") * 2 + 1).cast("int"))
    bond = F.format_string("CONECT%5d%5d", F.col("s"), F.col("s") + 1)
    return at.select("n", F.array(atom(F.col("s"), "A", "a"), atom(F.col("s") + 1, "B", "b"), bond).alias("lines"))
