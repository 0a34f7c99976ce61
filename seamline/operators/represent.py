"""Representative rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import interaction_key
from ..functions.sequences import alignment_rows
from ..functions.tables import written

GAP = "-"


def encoded(candidates: DataFrame, by: list[str], length: int | None = None) -> DataFrame:
    """``by``, key, n_columns, len and ``code`` of candidates that have columns: one character a column of the alignment.

    Upper-case ASCII letters stay and all else is a gap; characters beyond ASCII are dropped first, which moves what follows.
    Sequences are cut or filled with gaps to the alignment's length: ``length``, or the longest of each ``by``.
    """
    some = candidates.filter(F.size("interface_msa_columns_a") > 0)
    plain = F.upper(F.regexp_replace(F.coalesce("aligned_seq", F.lit("")), r"[^\x00-\x7F]", ""))
    rows = some.select(*by, interaction_key(F.col("interface_row_key"), F.col("partner_domain")).alias("key"), F.size(F.array_distinct("interface_msa_columns_a")).alias("n_columns"), plain.alias("seq"))
    if length is not None:
        rows = rows.withColumn("len", F.lit(length))
    elif by:
        rows = rows.join(some.groupBy(*by).agg(F.max(F.length("aligned_seq")).alias("len")), by)
    else:
        rows = rows.crossJoin(F.broadcast(some.agg(F.max(F.length("aligned_seq")).alias("len"))))
    code = F.regexp_replace(F.substring(F.rpad("seq", F.col("len"), GAP), F.lit(1), F.col("len")), "[^A-Z]", GAP)
    return rows.filter("len > 0").select(*by, "key", "n_columns", "len", code.alias("code"))


def consensus(rows: DataFrame, by: list[str], with_gaps: bool) -> DataFrame:
    """``by`` and ``best``, the most frequent character of each column as an array (null for a column without a letter, if gaps do not
    count); ties go to the first letter, so letters come before the gap.

    Cells are counted where they are; what is gathered is one character a column.
    """
    cells = rows.select(*by, F.posexplode(F.split("code", "")).alias("col", "ch")).filter("ch <> ''")
    counts = cells.groupBy(*by, "col", "ch").agg(F.count("*").alias("n"))
    counted = F.lit(True) if with_gaps else F.col("ch") != GAP
    late = F.when(F.col("ch") == GAP, 26).otherwise(F.ascii("ch") - 65)
    best = counts.groupBy(*by, "col").agg(F.max_by(F.when(counted, F.col("ch")), F.when(counted, F.struct("n", -late))).alias("ch"))
    whole = F.array_sort(F.collect_list(F.struct("col", "ch")))
    best = best.groupBy(*by).agg(whole.alias("cells")) if by else best.agg(whole.alias("cells"))
    return best.select(*by, F.transform("cells", lambda x: x["ch"]).alias("best"))


def _scored(rows: DataFrame, by: list[str], with_gaps: bool) -> DataFrame:
    """Rows beside their consensus as arrays ``own`` and ``best`` of the same length: no cell is ever shuffled."""
    best = consensus(rows, by, with_gaps)
    both = rows.join(best, by) if by else rows.crossJoin(F.broadcast(best))
    return both.withColumn("own", F.filter(F.split("code", ""), lambda c: c != "")).withColumn("coverage", F.length(F.translate("code", GAP, "")).cast("long"))


def _agreeing(test) -> Column:
    """In how many columns ``test(own, best)`` holds."""
    return F.size(F.filter(F.zip_with("own", "best", test), lambda x: F.coalesce(x, F.lit(False)))).cast("long")


def balanced(candidates: DataFrame, by: list[str] | None = None, length: int | None = None) -> DataFrame:
    """R2: the row that matches most of the consensus (gaps included), less 0.05 per share of the alignment that its
    coverage is off the median. Ties: match share, nearness to the median, more columns, smaller key."""
    by = by or []
    rows = _scored(written(encoded(candidates, by, length), "encoded"), by, True)
    gaps = _agreeing(lambda a, b: (a == b) & (b == GAP)).alias("gap_matches")
    rows = rows.select(*by, "key", "n_columns", "len", "coverage", _agreeing(lambda a, b: a == b).alias("matches"), gaps)
    middle = F.median("coverage").alias("median_coverage")
    rows = rows.join(rows.groupBy(*by).agg(middle), by) if by else rows.crossJoin(F.broadcast(rows.agg(middle)))
    rows = rows.withColumn("coverage_distance", F.abs(F.col("coverage") - F.col("median_coverage"))).withColumn("match_fraction", F.col("matches") / F.col("len"))
    rows = rows.withColumn("score", F.col("match_fraction") - 0.05 * (F.col("coverage_distance") / F.greatest(F.lit(1), "len")))
    order = F.struct(-F.col("score"), -F.col("match_fraction"), "coverage_distance", -F.col("n_columns"), "key")
    return _best(rows, by, order, ["key", "score", "match_fraction", "matches", "gap_matches", "coverage", "median_coverage", "coverage_distance", "n_columns"])


def residue_consensus(candidates: DataFrame, by: list[str] | None = None, length: int | None = None) -> DataFrame:
    """The row that matches most letters of the consensus; ties: coverage of consensus columns, smaller key."""
    by = by or []
    rows = _scored(written(encoded(candidates, by, length), "encoded"), by, False)
    total = F.size(F.filter("best", lambda b: b.isNotNull())).cast("long").alias("consensus_columns")
    covered = _agreeing(lambda a, b: b.isNotNull() & (a != GAP)).alias("coverage")
    rows = rows.select(*by, "key", "n_columns", _agreeing(lambda a, b: a == b).alias("matches"), covered, total)
    rows = rows.withColumn("score", F.col("matches") / F.greatest(F.lit(1), "consensus_columns"))
    order = F.struct(-F.col("matches"), -F.col("coverage"), "key")
    return _best(rows, by, order, ["key", "score", "matches", "coverage", "consensus_columns", "n_columns"])


def _best(rows: DataFrame, by: list[str], order, fields: list[str]) -> DataFrame:
    pick = [F.min_by(F.struct(*fields), order).alias("b"), F.count("*").alias("candidate_count")]
    out = rows.groupBy(*by).agg(*pick) if by else rows.agg(*pick)
    return out.select(*by, "candidate_count", "b.*")


def select(candidates: DataFrame, method: str = "balanced", by: list[str] | None = None, length: int | None = None) -> DataFrame:
    """The representative by ``balanced`` or ``residue``."""
    if method not in ("balanced", "residue"):
        raise ValueError("the representative method is balanced or residue")
    return (balanced if method == "balanced" else residue_consensus)(candidates, by, length)


def rows_of(best: DataFrame, candidates: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    """Representatives beside the alignment rows that they stand for; without a candidate, one row of nulls."""
    by = by or []
    found = alignment_rows(candidates, length).withColumnRenamed("row_key", "key")
    return best.join(found, [*by, "key"], "left")
