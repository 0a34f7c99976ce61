"""Source divergence audit: how far the word use of each source is from the language's other sources and from the whole language.

Groups are the (lang, source) pairs that occur. Of a language's terms those in at least ``least_docs`` of its documents are kept, V in number.
A group gives a kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being its count of all kept terms; ``absent`` is that of a count of 0.

The distance of two groups, the sum of |p - p'| over all kept terms, is split by terms:

* Heavy terms, which more than ``LIGHT`` groups of the language have, are dense. Groups and terms are numbered and cut in tiles of ``TILE_GROUPS`` by
  ``TILE_TERMS``; a task fills two matrices of a tile and adds up their differences.
* Light terms are absent from most groups. Were all absent, two groups would differ by |absent - absent'| in each. What a group's own
  light terms change against another group's ``absent`` follows from sorted p and their running sums, in the same tiles. A term that
  both groups have corrects that by four differences; only such pairs of a term's postings are made, at most LIGHT (LIGHT - 1) / 2 a term.

All of it is whole numbers of 64 bits: p is found by long division in steps of 1000, which is exact for counts up to 9 * 10^15, and the p
of a group add up to at most 10^9 + V.

Null text, lang and source are empty. Rows are documents; ids play no part, so repeated rows count as often as they occur. A language without
kept terms has distances of 0 and no terms; a group without terms counts 0 of each. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .common import discard, written

#: Terms are stretches of ASCII letters and of anything beyond ASCII: bytes of UTF-8 in lower case, everything else a blank.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Groups that a light term may have.
LIGHT = 8

TILE_GROUPS, TILE_TERMS = 128, 1024

#: Entries of a task's table of counts before it is passed on, and bytes of a text that are split at once.
TABLE, SPAN = 800_000, 1 << 20


# ---- counts

def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text, a part of it at a time; parts are cut between terms."""
    a = 0
    while a < len(text):
        z = a + SPAN
        part = text[a:z].translate(TERMS)
        if z < len(text):
            cut = part.rfind(b" ") + 1
            while not cut and z < len(text):  # a term of more than a part
                z += SPAN
                part = text[a:z].translate(TERMS)
                cut = part.rfind(b" ") + 1 if z < len(text) else len(part)
            part = part[:cut] if cut else part
        yield part.split()
        a += len(part)


def counted(batches):
    """(lang, source, term, n, n_docs): a task's counts, added up before they are passed on."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def emit():
        for (lang, source), (times, docs) in groups.items():
            terms = list(times)
            named = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            numbers = [pa.array(x, pa.int64()) for x in (list(times.values()), list(map(docs.__getitem__, terms)))]
            yield pa.RecordBatch.from_arrays([*named, pa.array(terms, pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "n", "n_docs"])

    held = 0
    for b in batches:
        for k in range(0, b.num_rows, 64):
            texts = b.column(2).slice(k, 64).cast(pa.large_binary()).to_pylist()
            for lang, source, text in zip(*(b.column(i).slice(k, 64).to_pylist() for i in range(2)), texts):
                times, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, here = len(times), set()
                for found in terms_of(text):
                    times.update(found)
                    here.update(found)
                docs.update(here)
                held += len(times) - before
                if held >= TABLE:
                    yield from emit()
                    groups.clear()
                    held = 0
    yield from emit()


def share(count: Column, total: Column) -> Column:
    """floor(10^9 * count / total) for 0 < count <= total, three decimal digits at a time."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return out


def of_count(n: Column, total: Column, kinds: Column) -> Column:
    """p of a term that occurs ``n`` times of ``total``, with ``kinds`` kept terms; null without kept terms."""
    bottom = F.when(kinds > 0, total + 5 * kinds)
    return 1 + share(n + 5, bottom)


def kept_counts(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, terms, postings), written: g (a number), lang, source, absent, kinds; lang, term, q, held (groups that have it), t (a number);
    g, lang, term, n, p of the kept terms that a group has."""
    narrow = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in (("lang", "lang"), ("source", "source"), ("text", "text"))))
    names = written(narrow.select("lang", "source").distinct(), "sources")
    counts = narrow.mapInArrow(counted, "lang string, source string, term string, n long, n_docs long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("n_docs").alias("n_docs"), F.count("*").alias("held"))
    kept = written(numbered(kept.filter(F.col("n_docs") >= least_docs).drop("n_docs"), ["lang", "term"], "t"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("of_lang").alias("whole"))
    posted = written(counts.drop("n_docs").join(kept.select("lang", "term", "t"), ["lang", "term"]), "kept-counts")
    totals = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = names.join(totals, ["lang", "source"], "left").join(langs.select("lang", "kinds"), "lang", "left")
    sized = sized.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"))
    groups = written(numbered(sized.withColumn("absent", of_count(F.lit(0), F.col("total"), F.col("kinds"))), ["lang", "source"], "g"), "groups")
    terms = written(kept.join(langs, "lang").select("lang", "term", "t", "held", of_count(F.col("of_lang"), F.col("whole"), F.col("kinds")).alias("q")), "terms")
    postings = posted.join(groups, ["lang", "source"]).select("g", "lang", "term", "t", "n", of_count(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), "absent")
    postings = written(postings, "postings")
    discard(names, counts, kept, posted)
    return groups, terms, postings


# ---- distances

def block(g: Column) -> Column:
    return F.floor(g / TILE_GROUPS).cast("long")


def tiles_of(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """Rows with g and lang, once for each tile of their language that their block is part of: a <= b are its blocks."""
    own = block(F.col("g"))
    out = rows.join(spread, "lang").select("*", F.explode(F.sequence("low", "high")).alias("other"))
    return out.select(*rows.columns, own.alias("own"), F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"))


PAIRS = "i long, j long, value long"


def pair_rows(sums: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """The pairs i < j of a tile with their sums."""
    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    keep = i < j
    return pd.DataFrame({"i": i[keep], "j": j[keep], "value": sums.reshape(-1)[keep]})


def sides(pdf: pd.DataFrame, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """Numbers and ``absent`` of both blocks' groups in a tile, and their rows of terms."""
    out = []
    for which in (a, b):
        here = pdf[pdf["own"] == which]
        groups = here[here["t"] < 0].sort_values("g")
        out.append((groups["g"].to_numpy(), groups["absent"].to_numpy(), here[here["t"] >= 0]))
    return out


def heavy_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - p'| over a tile's terms, dense. A group's own row has t = -1 and, as p, the tile's number of terms; those that no group of
    either block has are one column, times their number."""
    _, a, b, _ = key
    terms, place = np.unique(pdf["t"].to_numpy(), return_inverse=True)
    pdf = pdf.assign(c=place - 1)  # every group has a row, so -1 is the first
    nobodys = int(pdf["p"][pdf["t"] < 0].max()) - (len(terms) - 1)
    full = []
    for numbers, absent, rows in sides(pdf, a, b):
        x = np.repeat(absent[:, None], len(terms) - 1, axis=1)
        x[np.searchsorted(numbers, rows["g"].to_numpy()), rows["c"].to_numpy()] = rows["p"].to_numpy()
        full.append((numbers, absent, x))
    (left, ours, x), (right, theirs, y) = full
    sums = nobodys * np.abs(ours[:, None] - theirs[None, :])
    sums = sums + np.array([np.abs(y - row).sum(axis=1) for row in x], np.int64).reshape(sums.shape)
    return pair_rows(sums, left, right)


def against(rows: pd.DataFrame, numbers: np.ndarray, absent: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each group (row) and each asked value (column): the sum of |p - asked| over the group's light terms, minus their number
    times |absent - asked|. ``rows`` has each p of a group once, with its number of terms."""
    out = np.zeros((len(numbers), len(asked)), np.int64)
    for g, mine in rows.groupby("g"):
        k = int(np.searchsorted(numbers, g))
        order = np.argsort(mine["p"].to_numpy(), kind="stable")
        p, n = mine["p"].to_numpy()[order], mine["t"].to_numpy()[order]
        many, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(p * n)]
        at = np.searchsorted(p, asked)
        below, above = asked * many[at] - total[at], (total[-1] - total[at]) - asked * (many[-1] - many[at])
        out[k] = below + above - many[-1] * np.abs(absent[k] - asked)
    return out


def light_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """What light terms add to a tile's pairs, as if no two groups shared one. ``t`` counts the terms of a p, and ``light`` is their number in the language."""
    _, a, b = key
    (left, ours, mine), (right, theirs, others) = sides(pdf, a, b)
    sums = int(pdf["light"].max()) * np.abs(ours[:, None] - theirs[None, :])
    sums = sums + against(mine, left, ours, theirs) + against(others, right, theirs, ours).T
    return pair_rows(sums.astype(np.int64), left, right)


def shared_light(light: DataFrame) -> DataFrame:
    """Corrections of pairs of groups that share a light term: i, j and value."""
    lists = light.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("g", "p", "absent"))).alias("held")).filter(F.size("held") > 1)
    one = lists.select("held", F.posexplode("held").alias("at", "x"))
    two = one.select("x", F.explode(F.expr("slice(held, at + 2, size(held))")).alias("y"))
    apart = lambda u, v: F.abs(F.col(u) - F.col(v))
    value = apart("x.p", "y.p") - apart("x.p", "y.absent") - apart("y.p", "x.absent") + apart("x.absent", "y.absent")
    return two.select(F.col("x.g").alias("i"), F.col("y.g").alias("j"), value.alias("value")).groupBy("i", "j").agg(F.sum("value").alias("value"))


def distances(groups: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """i < j (groups of one language) and value, the sum of |p - p'| over all kept terms."""
    spread = groups.groupBy("lang").agg(block(F.min("g")).alias("low"), block(F.max("g")).alias("high"))
    no = lambda c: F.lit(0).cast("long").alias(c)
    met = postings.join(terms.select("t", "held"), "t")
    heavy = met.filter(F.col("held") > LIGHT).select("g", "lang", "t", "p")
    light = met.filter(F.col("held") <= LIGHT)
    absent = groups.select("g", "lang", F.lit(-1).cast("long").alias("t"), no("p"), F.coalesce("absent", F.lit(0)).cast("long").alias("absent"))
    # Tiles of heavy terms: each has its groups' rows besides, as a group may have none of its terms.
    chunk = F.floor(F.col("t") / TILE_TERMS).cast("long").alias("chunk")
    chunks = terms.filter(F.col("held") > LIGHT).groupBy("lang", chunk).agg(F.count("*").alias("in_chunk"))
    there = absent.join(chunks, "lang").withColumn("p", F.col("in_chunk")).drop("in_chunk")
    tiles = tiles_of(heavy.select("g", "lang", "t", "p", no("absent"), chunk).unionByName(there), spread)
    dense = tiles.groupBy("lang", "a", "b", "chunk").applyInPandas(heavy_tile, PAIRS)
    # Tiles of light terms: how many terms of a group have each p.
    number = terms.filter(F.col("held") <= LIGHT).groupBy("lang").agg(F.count("*").alias("light"))
    times = light.groupBy("g", "lang", "p").agg(F.count("*").alias("t")).withColumn("absent", F.lit(0).cast("long"))
    rows = times.unionByName(absent).join(number, "lang", "left").withColumn("light", F.coalesce("light", F.lit(0)))
    rare = tiles_of(rows, spread).groupBy("lang", "a", "b").applyInPandas(light_tile, PAIRS)
    parts = dense.unionByName(rare).unionByName(shared_light(light))
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank. Part ``pair``: the group's distance to every other source of its language. Part ``term``: its
    ``top_terms`` kept terms with the largest p above q, the language's p of the term, by p - q. ``docs`` has text, lang and source."""
    groups, terms, postings = kept_counts(docs, least_docs)
    pairs = written(distances(groups, terms, postings), "distances")
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = groups.select("g", "lang", "source")
    named = both.join(name.select(F.col("g").alias("i"), "lang", "source"), "i").join(name.select(F.col("g").alias("j"), F.col("source").alias("item")), "j")
    pair = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = postings.join(terms.select("t", "q"), "t").filter("p > q").select("g", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    top = above.withColumn("rank", rank("g")).filter(F.col("rank") <= top_terms)
    term = top.join(name, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair.withColumn("rank", rank("lang", "source")).unionByName(term)
