"""Shared plumbing of the training-data operators.

Conventions that every operator here follows:

* a null text counts as the empty text; whole texts are processed, never prefixes;
* inputs are narrowed to the id and text columns first, or helper columns get names that the input does not have (``fresh``),
  so extra columns of any name cannot clash;
* rows are never identified by ``doc_id`` alone where repeated ids would matter;
* intermediate tables go to the folder named by ``spark.checkpoint.dir`` and are read back, so
  a lost executor costs a re-read and not a re-computation of the lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import discard, run_dir, written  # noqa: F401  shared with the rest of the package

#: Bits of the fixed-size key filter: 2**26 bits are 2**20 words of 64 bits, 16 MiB as (word, bits) rows.
FILTER_BITS = 1 << 26

#: Text bytes that numpy code works on at once; bounds a Python worker's temporaries.
BLOCK_BYTES = 1 << 20

#: Rows and bytes of an Arrow batch where many stages share their executors.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes; smaller settings stay.

    By default a batch is 10,000 whole texts. It grows by doubling on both sides of the pipe, in buffers of tens of MB that an executor's
    threads and Python workers do not give back, so an executor that goes through one stage after another only grows.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        # A size that was given with another unit than bytes is a choice of the session's, too.
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, in any case of letters: the given ones, lengthened where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def key_filter(keys: DataFrame, col: str) -> DataFrame:
    """A bitmap of the hashes of ``keys[col]`` as at most ``FILTER_BITS / 64`` rows (word, bits).

    Its size does not depend on the number of keys, so it is safe to broadcast. It only ever lets
    too much through; whoever uses it still joins exactly afterwards.
    """
    h = F.pmod(F.xxhash64(F.col(col)), F.lit(FILTER_BITS))
    return keys.select(F.shiftright(h, 6).alias("word"), F.pmod(h, F.lit(64)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def flagged_by(df: DataFrame, bitmap: DataFrame, col: str, flag: str) -> DataFrame:
    """``df`` with a boolean column ``flag``: false only where ``col`` is certainly not among the keys. No column of ``df`` is touched."""
    h, word, bits = fresh(df, "key_hash", "key_word", "key_bits")
    out = df.withColumn(h, F.pmod(F.xxhash64(F.col(col)), F.lit(FILTER_BITS))).withColumn(word, F.shiftright(h, 6))
    out = out.join(F.broadcast(bitmap.select(F.col("word").alias(word), F.col("bits").alias(bits))), word, "left")
    hit = F.expr(f"coalesce(shiftright({bits}, cast(pmod({h}, 64) as int)) & 1L, 0L) = 1L")
    return out.withColumn(flag, hit).drop(h, word, bits)


def flag_keys(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and th, the text's hash) flagged ``named`` by the (doc_id, th) pairs of ``keyed``."""
    bitmap = key_filter(keyed.select(F.struct("doc_id", "th").alias("k")), "k")
    (key,) = fresh(rows, "key")
    return flagged_by(rows.withColumn(key, F.struct("doc_id", "th")), bitmap, key, "named").drop(key)


#: Groups with more than this share of all members are dealt to several tasks; there are at most as many of them as it goes into 1.
HOT_SHARE = 1 / 512


def with_group(members: DataFrame, groups: DataFrame, key: str, size: str, spread) -> DataFrame:
    """``members`` joined with their group's row on ``key``; members without a group stay, with nulls.

    ``groups`` is a written table with ``size`` members each, one row a group. A group that holds more than ``HOT_SHARE`` of all members is cut
    in parts of that share: its row is repeated for each, and its members are dealt over them, so no task has a whole hot group. The
    list of hot groups is bounded by ``1 / HOT_SHARE`` rows and is broadcast. ``spread`` deals the members: a number that differs among
    a group's members and is the same if a task is run again.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    part = max(1, int(total * HOT_SHARE))
    parts, turn = fresh(members.select("*", *[F.lit(1).alias(c) for c in groups.columns if c not in members.columns]), "parts", "turn")
    number = F.ceil(F.col(size) / part).cast("int")
    hot = groups.filter(F.col(size) > part).select(key, number.alias(parts))
    dealt = members.join(F.broadcast(hot), key, "left").withColumn(turn, F.when(F.col(parts) > 1, F.pmod(spread, F.col(parts)).cast("int")).otherwise(0)).drop(parts)
    cut = groups.withColumn(turn, F.explode(F.when(F.col(size) > part, F.sequence(F.lit(0), number - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(cut, [key, turn], "left").drop(turn)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and the n + 1 offsets of the texts in it."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    if len(a) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def crc_mod(col: str, n: int):
    """crc32 of an id's decimal text, modulo ``n``; a null id has the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(n))
