"""Line dedup: of lines that several documents share, only the first document keeps its own.

1. Every line of enough characters is hashed, once a document. Tasks fold their hashes into two Bloom filters: bits of hashes seen
   once, and bits of hashes seen twice. A filter is a table of 64-bit words, of which only the set ones are rows, and a line's two bits
   lie in one word; so filters of any size are merged by a partial aggregate on the word, and a bit that two tasks have in their
   once-seen filters is set in the twice-seen one. The number of words follows the number of lines.
2. Lines are looked up in the twice-seen filter. It is broadcast if it has at most ``BROADCAST_WORDS`` rows, and met in a shuffle
   join otherwise. Lines without a partner end here, but for a few false alarms.
3. Suspected lines alone are shuffled: grouped by their whole text they give the repeated keys and each key's first document.
4. Places of lines to drop go back to the documents that have any; the other documents' texts are never shuffled.

Rows that share a ``doc_id`` are one document's, and rows without an id make up one further document, after all others. A null
text is empty, which is one empty line. A repeated row loses the same lines in every copy. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, flag_keys, id_and_text, with_group, written

#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of the filters for each line.
BITS_A_LINE = 16

#: Hashes that a task folds at once.
FOLD = 1 << 21

#: Rows of the twice-seen filter up to which it is broadcast: 16 MB of numbers.
BROADCAST_WORDS = 1 << 20


def line_keys(text: Column) -> Column:
    """The key of every line of a text, in order."""
    return F.transform(F.split(text, "\n"), lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER))


def word_of(h: Column, words: int) -> Column:
    """The word of a hash in a filter of ``words`` words, a power of two."""
    return h.bitwiseAND(F.lit(words - 1))


def mask_of(h: Column) -> Column:
    """The two bits of a hash in its word, from the hash's top twelve bits."""
    bit = lambda k: F.shiftright(h, k).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit(52)).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(58)))


def folded(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, once, twice) of a block of hashes: the set words of its two filters."""
    kinds, times = np.unique(hashes, return_counts=True)
    one = np.uint64(1)
    mask = (one << ((kinds >> 52) & 63).astype(np.uint64)) | (one << ((kinds >> 58) & 63).astype(np.uint64))
    word = kinds & (words - 1)
    order = np.argsort(word, kind="stable")
    word, mask, times = word[order], mask[order], times[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    if not len(first):
        return word, mask.view(np.int64), mask.view(np.int64)
    once = np.bitwise_or.reduceat(mask, first)
    twice = np.bitwise_or.reduceat(np.where(times > 1, mask, np.uint64(0)), first)
    return word[first], once.view(np.int64), twice.view(np.int64)


def partial_filters(words: int):
    def run(batches):
        waiting, held = [], 0

        def emit():
            parts = folded(np.concatenate(waiting), words)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["word", "once", "twice"])

        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held >= FOLD:
                yield emit()
                waiting, held = [], 0
        if held:
            yield emit()

    return run


def twice_seen(hashes: DataFrame, words: int) -> DataFrame:
    """(word, bits) of the twice-seen filter of the rows of ``hashes``. A word has a row a task at most before it is merged."""
    parts = hashes.mapInArrow(partial_filters(words), "word long, once long, twice long")
    merged = parts.groupBy("word").agg(F.collect_list(F.struct("once", "twice")).alias("parts"))
    both = F.expr(
        "aggregate(parts, named_struct('once', 0L, 'twice', 0L),"
        " (acc, x) -> named_struct('once', acc.once | x.once, 'twice', acc.twice | x.twice | (acc.once & x.once))).twice"
    )
    return merged.select("word", both.alias("bits")).filter("bits <> 0")


def suspected(lines: DataFrame, twice: DataFrame, words: int) -> DataFrame:
    """``lines`` (with a hash ``h``) whose two bits are set in the twice-seen filter, a written table."""
    small = twice.count() <= BROADCAST_WORDS
    hit = lines.withColumn("word", word_of(F.col("h"), words)).join(F.broadcast(twice) if small else twice, "word")
    return hit.filter(F.col("bits").bitwiseAND(mask_of(F.col("h"))) == mask_of(F.col("h"))).drop("word", "bits")


def dropped_lines(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """doc_id, th (the text's hash) and ``places``, the places from 0 of the lines to drop; only rows that lose any. ``docs`` has doc_id and text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), line_keys(F.col("text")).alias("keys"))
    long_keys = F.filter("keys", lambda x: F.char_length(x) >= least_chars)
    hashes = written(rows.select(F.explode(F.array_distinct(F.transform(long_keys, lambda x: F.xxhash64(x)))).alias("h")), "line-hashes")
    words = 1 << max(0, (hashes.count() * BITS_A_LINE // 64).bit_length())
    twice = written(twice_seen(hashes, words), "twice-seen")
    lines = rows.select("doc_id", "th", F.posexplode("keys").alias("place", "key")).filter(F.char_length("key") >= least_chars)
    lines = lines.withColumn("h", F.xxhash64("key"))
    found = written(suspected(lines, twice, words).drop("h"), "suspects")
    discard(hashes, twice)
    firsts = found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("n_null"))
    shared = (F.col("first") < F.col("last")) | ((F.col("n_null") > 0) & F.col("first").isNotNull())
    repeated = written(firsts.filter(shared).select("key", "first", "n"), "repeated-keys")
    named = with_group(found, repeated, "key", "n", F.xxhash64("doc_id", "th", "place"))
    gone = named.filter(F.col("n").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))
    out = written(gone.groupBy("doc_id", "th").agg(F.collect_set("place").alias("places")), "dropped-lines")
    discard(found, repeated)
    return out


def without_lines(texts: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, places):
        gone = set(gone)
        out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone))
    return pd.Series(out, dtype=object)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10) -> DataFrame:
    """doc_id, text without its dropped lines, n_lines (before dropping) and n_dropped of every row.

    A line's key is the line without blanks at both ends, A-Z in lower case. Keys of at least ``least_chars`` code points that at least two
    documents have lose all their lines but those of the smallest doc_id among them. The other lines stay as they are.
    """
    rows = id_and_text(docs, id_col, text_col)
    drops = dropped_lines(rows, least_chars)
    marked = flag_keys(rows.withColumn("th", F.xxhash64("text")), drops)
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = marked.filter(~F.col("named")).select("doc_id", "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    a, b = marked.filter("named").alias("a"), drops.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    met = a.join(b, on, "left").select("a.doc_id", "text", n_lines.alias("n_lines"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    cut = met.select("doc_id", F.pandas_udf(without_lines, "string")("text", "places").alias("text"), "n_lines", F.size("places").cast("long").alias("n_dropped"))
    return whole.unionByName(cut)
