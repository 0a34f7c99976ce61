"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after each run of ASCII white space became one space.
Three scans, each of fewer rows than the one before: all rows are counted by the length of their text; rows whose length is held
twice are counted by the hash of their first characters too; and only rows whose length and prefix are held twice have their
whole text hashed. What a scan hands to the next is a bitmap of fixed size that can only let too much through; the full hash decides.
Texts themselves are never shuffled for the decisions.

Edge cases: a null text is the empty text, so all null and empty texts form one group; repeated
rows (same id and text) are equal texts like any other, so ``kept`` holds for each row that bears the
group's smallest id, while ``keep_first`` leaves just one of them; null ids come after all
others, and a group of null ids only has a null ``keep_id`` and ``kept`` true; an empty table gives an
empty result; extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged_by, fresh, id_and_text, key_filter, quoted, with_group, written

PREFIX_CHARS = 64


def normalised(text):
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; only runs that differ from one space are rewritten."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


class Refinement:
    """The bitmaps of lengths, and of lengths with prefixes, that two rows or more hold."""

    def __init__(self, docs: DataFrame, text_col: str = "text"):
        self.text_col = text_col
        norm = docs.select(normalised(F.coalesce(F.col(quoted(text_col)), F.lit(""))).alias("norm"))
        lengths = norm.groupBy(F.octet_length("norm").alias("n")).count().filter("count > 1").select("n")
        self.lengths = written(key_filter(lengths, "n"), "dedup-lengths")
        some = flagged_by(norm.withColumn("n", F.octet_length("norm")), self.lengths, "n", "again").filter("again")
        prefixes = some.groupBy("n", self.prefix("norm").alias("prefix")).count().filter("count > 1")
        self.prefixes = written(key_filter(prefixes.select(F.struct("n", "prefix").alias("k")), "k"), "dedup-prefixes")

    @staticmethod
    def prefix(norm):
        return F.xxhash64(F.substring(norm, 1, PREFIX_CHARS))

    def open_rows(self, docs: DataFrame, norm: str, again: str) -> DataFrame:
        """``docs`` with the normalised text ``norm``, and ``again`` where only a full hash can tell whether another row is equal."""
        n, key, length = fresh(docs.withColumn(norm, F.lit(1)).withColumn(again, F.lit(1)), "text_length", "text_key", "same_length")
        out = docs.withColumn(norm, normalised(F.coalesce(F.col(quoted(self.text_col)), F.lit("")))).withColumn(n, F.octet_length(norm))
        out = flagged_by(out, self.lengths, n, length)
        out = out.withColumn(key, F.when(F.col(length), F.struct(F.col(n).alias("n"), self.prefix(norm).alias("prefix"))))
        return flagged_by(out, self.prefixes, key, again).withColumn(again, F.col(length) & F.col(again)).drop(n, key, length)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, refinement: Refinement | None = None):
    """(rows, groups): one row per document with its full hash, and one per group of two or more.

    ``rows`` has doc_id, again and ``full``, the SHA-256 of the normalised text, null where earlier steps
    already proved the text unique (with ``digests`` it is filled in there too, as an output).
    ``groups`` has full, keep_id and group_size.
    """
    plain = id_and_text(docs, id_col, text_col)
    flagged = (refinement or Refinement(plain)).open_rows(plain, "norm", "again")
    full = F.sha2("norm", 256)
    rows = written(flagged.select("doc_id", "again", (full if digests else F.when(F.col("again"), full)).alias("full")), "dedup-rows")
    groups = rows.filter("again").groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return rows, written(groups, "dedup-groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept (and full, the text's digest, if asked for)."""
    rows, groups = duplicate_groups(docs, id_col, text_col, digests)
    # Rows of a written table keep their order, so their numbers are the same if a task is run again.
    open_rows = with_group(rows.filter("again"), groups, "full", "group_size", F.monotonically_increasing_id()).select("doc_id", "full", "keep_id", "group_size")
    alone = rows.filter("NOT again").select("doc_id", "full", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    out = alone.unionByName(open_rows)
    return out.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("group_size").isNull() | F.col("keep_id").isNull()).alias("kept"),
        "full",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts: the one with the smallest id.

    Of rows with equal id and equal text one stays. Decisions are taken on ids and digests. Rows that length or prefix
    prove unique pass without a full hash and without a shuffle, and only texts of dropped or repeated rows are moved.
    """
    refinement = Refinement(id_and_text(docs, id_col, text_col))
    rows, groups = duplicate_groups(docs, id_col, text_col, refinement=refinement)
    members = rows.filter("again").groupBy("full", "doc_id").agg(F.count("*").alias("times"))
    members = with_group(members, groups, "full", "group_size", F.xxhash64("doc_id")).filter("group_size IS NOT NULL")
    dropped = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    acts = members.select(F.col("doc_id").alias("of_id"), F.col("full").alias("of_digest"), dropped.alias("dropped"), "times")
    acts = written(acts.filter("dropped OR times > 1").drop("times"), "dedup-acts")
    cols = [F.col(quoted(c)) for c in docs.columns]
    names = ["norm", "again", "digest", "row_key", "named", "of_id", "of_digest", "dropped"]
    norm, again, digest, key, named, of_id, of_digest, drop = fresh(docs, *names)
    refinement.text_col = text_col
    tagged = refinement.open_rows(docs, norm, again)
    tagged = tagged.withColumn(digest, F.when(F.col(again), F.sha2(norm, 256))).drop(norm)
    tagged = tagged.withColumn(key, F.when(F.col(again), F.struct(F.col(quoted(id_col)).cast("long"), F.col(digest))))
    tagged = flagged_by(tagged, key_filter(acts.select(F.struct("of_id", "of_digest").alias("k")), "k"), key, named).withColumn(named, F.col(again) & F.col(named))
    acts = acts.toDF(of_id, of_digest, drop)
    met = tagged.filter(named).join(acts, F.col(quoted(id_col)).eqNullSafe(F.col(of_id)) & (F.col(digest) == F.col(of_digest)), "left")
    stay = met.filter(f"NOT coalesce({drop}, false)").dropDuplicates([key])
    return tagged.filter(f"NOT {named}").select(*cols).unionByName(stay.select(*cols))
