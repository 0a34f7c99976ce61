"""Row keys, fragments and interaction keys as column expressions.

A row key is ``protein_fragment_partnerFragment``; the third part keeps any further underscore. A fragment
is a comma list of ``start-end``; blank parts are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOINT = "@@"


def key_part(row_key: Column, part: int) -> Column:
    """Part 1, 2 or 3 of a row key (X1); the empty text where there is no such part."""
    return F.coalesce(F.try_element_at(F.split(row_key, "_", 3), F.lit(part)), F.lit(""))


def interaction_key(row_key: Column, partner: Column) -> Column:
    """One text for a row of a partner."""
    return F.concat(row_key, F.lit(JOINT), partner)


def split_interaction_key(key: Column) -> Column:
    """Struct of row_key and partner_domain, cut at the first joint."""
    parts = F.split(key, JOINT, 2)
    return F.struct(parts[0].alias("row_key"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("partner_domain"))


def fragment_ranges(fragment: Column) -> Column:
    """Array of struct<s, e>; a malformed part raises."""
    parts = F.filter(F.transform(F.split(fragment, ","), lambda p: F.trim(p)), lambda p: p != "")

    def parse(p: Column) -> Column:
        good = p.rlike(r"^\s*\d+\s*-\s*\d+\s*$")
        s, e = F.trim(F.split(p, "-", 2)[0]).cast("int"), F.trim(F.split(p, "-", 2)[1]).cast("int")
        bad = F.raise_error(F.concat(F.lit("fragment is not start-end: "), p)).cast("struct<s:int,e:int>")
        return F.when(good, F.struct(s.alias("s"), e.alias("e"))).otherwise(bad)

    return F.transform(parts, parse)


def fragment_start(fragment: Column) -> Column:
    """First range's start, 1 where there is none."""
    return F.coalesce(F.try_element_at(fragment_ranges(fragment), F.lit(1))["s"], F.lit(1))


def fragment_envelope(fragment: Column) -> Column:
    """``smallest start - largest end`` of all ranges; the fragment itself where there is none."""
    r = fragment_ranges(fragment)
    low, high = F.array_min(F.transform(r, lambda x: x["s"])), F.array_max(F.transform(r, lambda x: x["e"]))
    return F.when(F.size(r) > 0, F.concat_ws("-", low, high)).otherwise(fragment)


def range_labels(fragment: Column) -> Column:
    """The ranges as texts."""
    return F.transform(fragment_ranges(fragment), lambda x: F.concat_ws("-", x["s"], x["e"]))


def expand_ranges(ranges: Column) -> Column:
    """Sorted distinct residue ids of an array of struct<s, e>; a range that runs backwards is empty."""
    one = lambda x: F.when(x["s"] <= x["e"], F.sequence(x["s"], x["e"])).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, one))))


def number_list(items: Column) -> Column:
    """Distinct integers of an array of variants in the order of their first appearance; what is no integer is dropped."""
    whole = F.transform(items, lambda x: F.try_variant_get(x, "$", "int"))
    return F.array_distinct(F.filter(whole, lambda x: x.isNotNull()))


def file_stem(name: Column) -> Column:
    """S3: file name without directory and ``.json`` or ``.json.gz``."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?i)\.json(\.gz)?$", "")


def file_family(name: Column) -> Column:
    """S3: the stem up to its first underscore."""
    return F.split_part(file_stem(name), F.lit("_"), F.lit(1))
