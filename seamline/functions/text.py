"""Text clean-up, search and display helpers."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Three-letter residue codes and their letters.
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W",
    "TYR": "Y", "VAL": "V", "SEC": "U", "PYL": "O", "ASX": "B", "GLX": "Z", "XLE": "J", "UNK": "X",
}


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def accession(text: Column) -> Column:
    """``PF`` and digits in upper case, else the empty text."""
    up = F.upper(squeeze(text))
    return F.when(up.rlike(r"^PF\d+$"), up).otherwise(F.lit(""))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Entities have no built-in; only texts that hold an ampersand pay for it."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def strip_html(text: Column) -> Column:
    """Text without tags and citation marks, entities resolved, no space before punctuation."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    plain = unescape(F.regexp_replace(plain, r"\[\[cite:[^\]]+\]\]", " "))
    return squeeze(F.regexp_replace(plain, r"\s+([.,;:!?])", "$1"))


def joined_paragraphs(texts: Column) -> Column:
    """The non-empty texts of an array with a blank line between."""
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def family_links(text: Column) -> Column:
    """Accessions in ``[pfam: PF...]`` marks, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[pfam:\s*(PF\d+)\s*\]"), 1), F.upper))


def count_value(v: Column) -> Column:
    """A JSON number of a variant: booleans as 0 or 1, whole floats as integers, all else null."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    whole = F.when(number == F.floor(number), number.cast("long"))
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long"))
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "long"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), whole)
    )


def variant_text(v: Column, path: str) -> Column:
    """The normalised text at a path; empty where it is missing or not a text."""
    return squeeze(F.try_variant_get(v, path, "string"))


def named_reference(v: Column, path: str) -> Column:
    """struct<accession, name> at a path, null if both are empty."""
    acc, name = variant_text(v, path + ".accession"), variant_text(v, path + ".name")
    return F.when((acc != "") | (name != ""), F.struct(acc.alias("accession"), name.alias("name")))


def residue_letter(code: Column) -> Column:
    """One letter for a three-letter code, X where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in RESIDUE_LETTERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(code))), F.lit("X"))


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes or hours; ``unknown time`` for what is not positive."""
    at_least_1 = lambda x: F.greatest(F.lit(1), F.floor(x + 0.5)).cast("string")
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "unknown time")
        .when(seconds < 60, F.concat(at_least_1(seconds), F.lit(" s")))
        .when(seconds < 3600, F.concat(at_least_1(seconds / 60), F.lit(" min")))
        .when(seconds < 36000, F.concat(F.format_string("%.1f", seconds / 3600), F.lit(" h")))
        .otherwise(F.concat(F.format_string("%.0f", seconds / 3600), F.lit(" h")))
    )


def bytes_text(size: Column) -> Column:
    """MiB or GiB; ``unknown RAM`` for what is not positive."""
    gib, mib = size / 2**30, size / 2**20
    return (
        F.when(size.isNull() | (size <= 0), "unknown RAM")
        .when(gib >= 10, F.concat(F.format_string("%.0f", gib), F.lit(" GiB RAM")))
        .when(gib >= 1, F.concat(F.format_string("%.1f", gib), F.lit(" GiB RAM")))
        .otherwise(F.concat(F.greatest(F.lit(1), F.floor(mib + 0.5)).cast("string"), F.lit(" MiB RAM")))
    )


def cluster_name(label: Column) -> Column:
    """``Noise`` below zero, else ``Cluster`` and the label counted from 1."""
    return F.when(label < 0, "Noise").otherwise(F.concat(F.lit("Cluster "), (label + 1).cast("string")))


def escape_html(text: Column) -> Column:
    """The five special characters as entities."""
    out = F.coalesce(text, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def option_matches(query: str, *fields: Column) -> Column:
    """case-insensitive substring of the fields joined by spaces."""
    wanted = query.strip().lower()
    return F.lit(True) if not wanted else F.lower(F.concat_ws(" ", *fields)).contains(wanted)


def fuzzy_matches(label: Column, query: str) -> Column:
    """substring, or substring of letters and digits only, or those as an ordered subsequence."""
    raw = (query or "").strip().lower()
    short = re.sub(r"[^a-z0-9]+", "", raw)
    if not raw or not short:
        return F.lit(True)
    low = F.lower(F.coalesce(label, F.lit("")))
    condensed = F.regexp_replace(low, "[^a-z0-9]+", "")
    return low.contains(raw) | condensed.contains(short) | condensed.rlike("(?s)" + ".*?".join(short))


def model_text(text: Column) -> Column:
    """Structure text without byte order mark, with plain line ends; null if it holds a NUL or no ATOM line and END."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    usable = ~plain.contains("\x00") & plain.rlike(r"(?m)^ATOM") & plain.rlike(r"(?m)^END")
    return F.when(usable, F.concat(F.regexp_replace(plain, r"\s+$", ""), F.lit("\n")))
