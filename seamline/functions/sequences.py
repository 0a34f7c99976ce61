"""Aligned sequences: masking to fragments, residue ids, padding, exploding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import fragment_envelope, fragment_ranges, fragment_start, interaction_key, key_part

GAP = "-"


def _fragment(text: str | None) -> list[tuple[int, int]]:
    return [tuple(int(x) for x in p.split("-")) for p in (text or "").split(",") if p.strip()]


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a column as numbers, and the n + 1 offsets of its texts; null counts as empty."""
    texts = [t or "" for t in texts]
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(list(map(len, texts)), dtype=np.int64)]).astype(np.int64)


#: Characters that are counted or masked at once.
COUNTED = 1 << 20


def _masked(sequences: pa.Array, fragments: pa.Array) -> pa.Array:
    """``masked`` of some rows.

    A running count along a string has no built-in that is linear in the string's length (a fold that
    appends to an array copies it at every step). Here all rows are one vector: letters are counted through it, and
    each range of a fragment is one run of the letters of its row.
    """
    chars, offsets = _code_points(sequences.to_pylist())
    low = chars | 32
    letter = (low >= ord("a")) & (low <= ord("z"))
    (at,) = np.nonzero(letter)
    bounds = np.searchsorted(at, offsets)
    ranges = list(map(_fragment, fragments.to_pylist()))
    starts = np.array([r[0][0] if r else 1 for r in ranges], np.int64)
    row = np.repeat(np.arange(len(ranges)), list(map(len, ranges)))
    s, e = np.array([x for r in ranges for x in r], np.int64).reshape(-1, 2).T
    first, end = bounds[row], bounds[row + 1]
    a = np.clip(first + s - starts[row], first, end)
    z = np.maximum(a, np.clip(first + e - starts[row] + 1, first, end))
    edge = np.zeros(len(at) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, z, -1)
    inside = np.cumsum(edge[:-1]) > 0
    chars = chars.copy()
    chars[at[~inside]] = ord(GAP)
    owner = np.repeat(np.arange(len(ranges)), np.diff(bounds))
    number = np.zeros(len(chars), np.int32)
    number[at] = starts[owner] + np.arange(len(at)) - bounds[owner]
    none = np.ones(len(chars), bool)
    none[at[inside]] = False
    text, cuts = chars.tobytes().decode("utf-32-le"), offsets.tolist()
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(number, pa.int32(), mask=none))
    return pa.StructArray.from_arrays([pa.array([text[x:y] for x, y in zip(cuts, cuts[1:])], pa.string()), ids], names=["aligned_sequence", "residue_ids"])


@F.arrow_udf(T.StructType([T.StructField("aligned_sequence", T.StringType()), T.StructField("residue_ids", T.ArrayType(T.IntegerType()))]))
def masked(sequences: pa.Array, fragments: pa.Array) -> pa.Array:
    """M2: ASCII letters count residues up from the fragment's start, and those outside its ranges become
    gaps without an id. Other characters stay, without an id. A batch is masked in pieces, so that only its result grows with its texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(sequences), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, a = [], 0
    while a < len(sequences):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COUNTED, side="right")))
        parts.append(_masked(sequences.slice(a, z - a), fragments.slice(a, z - a)))
        a = z
    return pa.concat_arrays(parts) if parts else _masked(sequences, fragments)


def alignment_rows(rows: DataFrame, alignment_length: int) -> DataFrame:
    """The eleven fields of an alignment row, padded with gaps and null ids to ``alignment_length``. A row has an
    alignment if it has a sequence, unless its own ``has_alignment`` says that it has none."""
    key = F.col("interface_row_key")
    said = F.coalesce(F.col("has_alignment"), F.lit(True)) if "has_alignment" in rows.columns else F.lit(True)
    length = F.greatest(F.lit(alignment_length), F.length("aligned_seq"))
    padded = F.rpad(F.coalesce("aligned_seq", F.lit("")), length, GAP)
    out = rows.withColumn("__m", masked(padded, key_part(key, 2)))
    return out.select(
        key_part(key, 1).alias("protein_id"),
        key_part(key, 2).alias("fragment_key"),
        fragment_envelope(key_part(key, 2)).alias("alignment_fragment_key"),
        key_part(key, 3).alias("partner_fragment_key"),
        "interface_row_key",
        "partner_domain",
        interaction_key(key, F.col("partner_domain")).alias("row_key"),
        F.concat_ws(" | ", key, F.col("partner_domain")).alias("display_row_key"),
        F.col("__m.aligned_sequence").alias("aligned_sequence"),
        F.col("__m.residue_ids").alias("residue_ids"),
        (said & (F.length(F.coalesce("aligned_seq", F.lit(""))) > 0)).alias("has_alignment"),
    )


def cells(rows: DataFrame, keys: list[str], sequence: str = "aligned_seq") -> DataFrame:
    """One row per character: ``keys``, ``col`` (from 0), ``ch`` and ``is_letter``."""
    chars = F.filter(F.split(F.coalesce(F.col(sequence), F.lit("")), ""), lambda c: c != "")
    out = rows.select(*keys, F.posexplode(chars).alias("col", "ch"))
    return out.withColumn("is_letter", F.col("ch").rlike("^[A-Za-z]$"))


def letter_counts(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """``keys``, col (from 0), letter (in upper case) and n of the ASCII letters of all sequences, counted in batches and then added up: a batch passes on a
    row for each column and letter, not for each character."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "col int, letter string, n long"])

    def run(batches):
        for b in batches:
            texts, names = b.column(len(keys)).to_pylist(), [b.column(i) for i in range(len(keys))]
            codes: dict[tuple, int] = {}
            group = np.array([codes.setdefault(k, len(codes)) for k in zip(*(c.to_pylist() for c in names))] if keys else [0] * len(texts), np.int64)
            first = {g: i for i, g in reversed(list(enumerate(group.tolist())))}
            a = 0
            while a < len(texts):
                z, held = a, 0
                while z < len(texts) and (z == a or held + len(texts[z] or "") <= COUNTED):
                    held += len(texts[z] or "")
                    z += 1
                chars, offsets = _code_points(texts[a:z])
                low = chars | 32
                (at,) = np.nonzero((low >= ord("a")) & (low <= ord("z")))
                row = np.searchsorted(offsets, at, side="right") - 1
                width = int(np.diff(offsets).max(initial=1))
                found, n = np.unique((group[a + row] * width + at - offsets[row]) * 26 + low[at] - ord("a"), return_counts=True)
                place, letter = np.divmod(found, 26)
                owner, col = np.divmod(place, width)
                taken = pa.array([first[g] for g in owner.tolist()], pa.int64())
                cells_ = [c.take(taken) for c in names] + [pa.array(col, pa.int32()), pa.array([chr(65 + x) for x in letter.tolist()], pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cells_, names=[*keys, "col", "letter", "n"])
                a = z

    counts = rows.select(*keys, F.col(sequence).alias("__sequence")).mapInArrow(run, schema)
    return counts.groupBy(*keys, "col", "letter").agg(F.sum("n").alias("n"))


def padded_ids(ids: Column, length: Column) -> Column:
    """Array cut or filled with nulls to ``length``."""
    fill = F.array_repeat(F.lit(None).cast("int"), F.greatest(length - F.size(ids), F.lit(0)))
    return F.slice(F.concat(ids, fill), F.lit(1), length)
