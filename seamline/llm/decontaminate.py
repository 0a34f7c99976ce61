"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is inside a document when at least ``threshold`` of the item's distinct word shingles occur in the
document. Items are partitioned by their number of shingles, each partition reaching up to twice its smallest
size. All items of a partition have signatures of one length, the k smallest shingle hashes, and k comes from the partition's
upper size: ``k = floor((1 - threshold) * size) + 1``, more than a contained item can miss. So every contained item
has a signature hash inside the document, however long that is. A document is looked up in each partition whose
smallest item could be contained in its shingles, and needs as many signature hashes of an item as the item's size
leaves; exact shingle containment then decides. The search misses nothing. Documents are hashed in one pass without a shuffle.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a shingle is ``words`` of them,
space-joined; a text with fewer words is one shingle of all of them.

Edge cases: null, empty and blank items have no shingle and are in no document; a null, empty or blank
document has no shingle; an item of fewer words than a shingle is found only in a document of just those words; repeated documents or
items give repeated pairs; an empty table on either side gives
an empty result; items are worked through in blocks of bounded size, one after the other, so a large benchmark means more passes
and never a larger broadcast; extra columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat_bytes, id_and_text, text_blocks, written

WORDS = 5
THRESHOLD = 0.8
#: Bounds of what one pass broadcasts.
BLOCK_ITEMS = 20_000
BLOCK_ITEM_BYTES = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_TURN = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of ``data``; hashes only find candidates, equality is checked on bytes."""
    gap = _SPACE[data]
    edge = np.empty(len(data), bool)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    edge[0] = not gap[0]
    np.greater(gap[:-1], gap[1:], out=edge[1:])
    (starts,) = np.nonzero(edge)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    value = _BYTE[_LOWER[data]]
    value[gap] = 0
    nth = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if nth is None:
        nth = np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    value *= _PLACE[nth & 63]
    return starts, _mix(np.add.reduceat(value, starts))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of one text's word hashes."""
    n = min(size, len(words))
    if n == 0:
        return np.empty(0, np.uint64)
    out = sum(words[j : len(words) - n + 1 + j] * _TURN[j] for j in range(n))
    return _mix(out + np.uint64(n))


def shingles(text: bytes, size: int = WORDS) -> set[bytes]:
    words = text.lower().split()
    n = min(size, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class SizePartition:
    """Signatures of items with ``low`` to ``2 * low - 1`` shingles: sorted hashes, the item of each, and how many of an item's a
    document needs (by item)."""

    low: int
    hashes: np.ndarray
    owners: np.ndarray
    need: dict[int, int]

    @classmethod
    def of(cls, low: int, threshold: float, items: dict[int, tuple[int, np.ndarray]]) -> SizePartition:
        """``items``: number of shingles and sorted distinct shingle hashes of each."""
        spare = lambda n: math.floor((1 - threshold) * n + 1e-9)
        k = spare(2 * low - 1) + 1
        signatures = {i: h[:k] for i, (_, h) in items.items()}
        hashes = np.concatenate(list(signatures.values()))
        owners = np.repeat(np.array(list(signatures)), list(map(len, signatures.values())))
        order = np.argsort(hashes, kind="stable")
        # A contained item misses at most its spare shingles, in its signature as well.
        return cls(low, hashes[order], owners[order], {i: max(1, len(signatures[i]) - spare(n)) for i, (n, _) in items.items()})

    def candidates(self, mine: np.ndarray) -> list[int]:
        """Items of which a document with these distinct signature hashes has enough."""
        lo, hi = np.searchsorted(self.hashes, mine, "left"), np.searchsorted(self.hashes, mine, "right")
        some = lo < hi
        if not some.any():
            return []
        items, times = np.unique(np.concatenate([self.owners[x:y] for x, y in zip(lo[some], hi[some])]), return_counts=True)
        return [k for k, t in zip(items.tolist(), times.tolist()) if t >= self.need[k]]


@dataclass
class ContainmentIndex:
    """Size partitions of a bounded block of items."""

    size: int
    threshold: float
    ids: list = field(default_factory=list)
    texts: list = field(default_factory=list)

    def build(self) -> ContainmentIndex:
        self.sets = [shingles(t, self.size) for t in self.texts]
        by_low: dict[int, dict] = {}
        for i, s in enumerate(self.sets):
            if s:
                h = np.unique(shingle_hashes(word_hashes(np.frombuffer(self.texts[i], np.uint8))[1], self.size))
                by_low.setdefault(1 << (len(s).bit_length() - 1), {})[i] = (len(s), h)
        self.partitions = [SizePartition.of(low, self.threshold, items) for low, items in sorted(by_low.items())]
        self.hashes = np.unique(np.concatenate([p.hashes for p in self.partitions])) if self.partitions else np.empty(0, np.uint64)
        self.marks = np.zeros(1 << 22, bool)
        self.marks[self.hashes >> np.uint64(42)] = True
        return self

    def found(self, block: pa.Array):
        """(text, item, shingles, found) of every contained item, for each text of an Arrow column."""
        data, offsets = flat_bytes(block)
        for a, b in text_blocks(offsets):
            base = offsets[a]
            starts, words = word_hashes(np.ascontiguousarray(_apart(data, offsets[a : b + 1])))
            bounds = np.searchsorted(starts, offsets[a : b + 1] - base + np.arange(b - a + 1))
            counts = np.diff(bounds)
            hits = []
            n = self.size
            if len(words) >= n:
                h = shingle_hashes(words, n)
                (at,) = np.nonzero(self.marks[h >> np.uint64(42)])
                at = at[np.isin(h[at], self.hashes)] if len(at) else at
                owner = np.searchsorted(bounds, at, side="right") - 1
                inside = at + n <= bounds[owner + 1]
                hits.append((owner[inside], h[at[inside]]))
            for i in np.nonzero((counts > 0) & (counts < n))[0]:
                hits.append((np.array([i]), shingle_hashes(words[bounds[i] : bounds[i + 1]], n)))
            if not hits:
                continue
            owner, h = np.concatenate([x[0] for x in hits]), np.concatenate([x[1] for x in hits])
            order = np.argsort(owner, kind="stable")
            owner, h = owner[order], h[order]
            docs, heads = np.unique(owner, return_index=True)
            for i, mine in zip(docs.tolist(), np.split(h, heads[1:])):
                most = max(1, int(counts[i]) - n + 1)
                mine, items = np.unique(mine), []
                for p in self.partitions:
                    if most >= self.threshold * p.low - 1e-9:
                        items += p.candidates(mine)
                if not items:
                    continue
                have = shingles(data[offsets[a + i] : offsets[a + i + 1]].tobytes(), n)
                for k in items:
                    both = len(self.sets[k] & have)
                    if both >= self.threshold * len(self.sets[k]) - 1e-9:
                        yield a + i, k, len(self.sets[k]), both


def _apart(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts between ``offsets`` with a space after each, so that no word spans two of them."""
    out = np.full(int(offsets[-1] - offsets[0]) + len(offsets) - 1, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - offsets[0] + np.arange(len(offsets) - 1)] = False
    out[keep] = data[offsets[0] : offsets[-1]]
    return out


def item_blocks(items: DataFrame, item_col: str, text_col: str, size: int, threshold: float):
    """Indexes over the items, each of at most about ``BLOCK_ITEMS`` items and ``BLOCK_ITEM_BYTES`` of text, with whether it is the only one."""
    rows = items.select(F.col(item_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, size_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil((size_bytes or 0) / BLOCK_ITEM_BYTES))
    if blocks > 1:
        rows = written(rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition("block"), "benchmark")
    for k in range(blocks):
        mine = (rows.filter(F.col("block") == k) if blocks > 1 else rows).select("id", "text").collect() if n else []
        mine.sort(key=lambda r: (r["id"] is None, r["id"], r["text"]))
        yield ContainmentIndex(size, threshold, [r["id"] for r in mine], [r["text"].encode() for r in mine]).build(), blocks == 1


PAIRS = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def contained_items(docs: DataFrame, items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every pair at or above the threshold."""
    parts = []
    for index, only in item_blocks(items, "item_id", "text", size, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                got = list(shared.value.found(b.column(1)))
                rows = pa.array([x[0] for x in got], pa.int64())
                arrays = [b.column(0).take(rows), pa.array([shared.value.ids[x[1]] for x in got], pa.int64())]
                arrays += [pa.array([x[2] for x in got], pa.int64()), pa.array([x[3] for x in got], pa.int64())]
                arrays.append(pa.array([x[3] / x[2] for x in got], pa.float64()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        found = id_and_text(docs).mapInArrow(run, PAIRS)
        if not only:  # this block is done with before the next one is sent out
            found = written(found, "contained")
            shared.unpersist()
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that contain an item. No shuffle. Of several blocks of items each leaves its
    documents in a table that the next one reads, so one block is live at a time."""
    at = docs.columns.index(text_col)
    before = None
    for index, only in item_blocks(items, "item_id", "text", size, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in shared.value.found(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = written(docs, "clean")
            shared.unpersist()
            if before is not None:
                discard(before)
            before = docs
    return docs
