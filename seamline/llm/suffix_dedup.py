"""Removal of long repeated byte strings by bucket-pointer refinement of suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere is to go. Sorting all suffixes of a corpus
is neither needed nor affordable; only equality of ``LENGTH``-byte prefixes matters, so suffixes are
bucketed first and refined only where a bucket has more than one:

1. *Anchors.* For each window of ``LENGTH`` bytes, the place with the smallest mixed 8-gram (leftmost of ties) that leaves room for a
   ``GRAM``-byte string. Equal windows have equal anchors at equal distances, so the hash of the anchor's gram is a
   bucket that no equal pair straddles. Runs of windows with one anchor are *segments*, about one per 140 bytes.
2. *Whole segments.* In buckets with two segments or more, segments with identical bytes settle each other:
   all their windows repeat.
3. *Mixed buckets.* Buckets with different segments send one copy of each to be refined. There, each position's bucket of
   ``q`` bytes is refined by sorting on the bucket of the position ``q`` bytes later, and the updated buckets serve
   as later offsets again: ``q`` doubles up to ``LENGTH``. Positions alone in their bucket are left out on the way.
   Buckets with more than ``HOT`` different segments are not sorted in one task: they are refined by 128-bit hashes,
   first of what pieces of ``PIECE`` windows have in common, then of each window in pieces where that repeats.
4. Spans are merged per document and cut out.

Texts move twice at most, and only those with mixed or repeated segments (a fixed-size key filter lets the
others pass). Equality of segments and of hot windows rests on 128-bit XXH3; the first refinement step
numbers 64-byte buckets by 64-bit mixes of their eight 8-grams, all later ones are exact.

Edge cases: null and empty texts have nothing to remove, nor have texts shorter than ``LENGTH``; matches never cross documents, but
may overlap within one; repeated rows repeat each other wholly; null ids are matched to their texts like others; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flag_keys, flat_bytes, id_and_text, key_filter, flagged_by, written

LENGTH = 400
GRAM = 128
#: Different segments in a bucket beyond which its windows are spread by hash.
HOT = 32
#: Windows of a hot bucket's segment that are told apart by one hash before each is hashed for itself.
PIECE = 8
#: Bytes of segments refined at once in a task.
REFINE_BYTES = 2 << 20
#: Windows of a long text that are worked on at once.
CHUNK = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams8(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    x = t.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    return x


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by block-wise running minima from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).reshape(-1)
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(t: np.ndarray, length: int, gram: int):
    """(anchor, first window, last window) of each segment of a text chunk."""
    width = length - gram + 1
    g = grams8(t)[: len(t) - gram + 1]
    h = (g ^ (g >> np.uint64(31))) * _ODD
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (window_minima(packed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    last = np.append(first[1:], len(at)) - 1
    return at[first], first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def segments(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per segment: bucket (hash of the anchor's gram), lead (anchor minus first window), span (windows minus 1),
    e1 and e2 (hash of its bytes), doc_id, th and first (the first window's place)."""
    schema = "doc_id long, th long, bucket long, lead int, span int, e1 long, e2 long, first long"

    def run(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

        low = (1 << 64) - 1
        for b in batches:
            data, offsets = flat_bytes(b.column(2))
            out: list[list] = [[] for _ in range(7)]
            for i in np.nonzero(np.diff(offsets) >= length)[0]:
                text = data[offsets[i] : offsets[i + 1]]
                for c in range(0, len(text) - length + 1, CHUNK):
                    part = text[c : c + CHUNK + length - 1]
                    at, first, last = anchors(part, length, gram)
                    raw = part.tobytes()
                    whole = [xxh3_128_intdigest(raw[x : y + length]) for x, y in zip(first.tolist(), last.tolist())]
                    for column, values in zip(out, (np.full(len(at), i), [xxh3_64_intdigest(raw[x : x + gram]) for x in at.tolist()], at - first, last - first, [w >> 64 for w in whole], [w & low for w in whole], first + c)):
                        column.append(np.asarray(values, np.uint64) if values.__class__ is list else values)
                if sum(map(len, out[0])) > 50_000 or i == len(offsets) - 2:
                    yield batch(b, out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield batch(b, out)

    def batch(b, out):
        row, bucket, lead, span, e1, e2, first = (np.concatenate(x) for x in out)
        take = pa.array(row)
        arrays = [b.column(0).take(take), b.column(1).take(take), pa.array(_signed(bucket)), pa.array(lead.astype(np.int32)), pa.array(span.astype(np.int32))]
        arrays += [pa.array(_signed(e1)), pa.array(_signed(e2)), pa.array(first)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "bucket", "lead", "span", "e1", "e2", "first"])

    return rows.select("doc_id", "th", "text").mapInArrow(run, schema)


def refined(parts: list[bytes], spans: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Of each part, which of its windows 0..span equals another window of these parts, by bucket-pointer refinement."""
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    t = np.frombuffer(b"".join(parts), np.uint8)
    within = np.arange(len(t)) - np.repeat(starts[:-1], sizes)
    window = within <= np.repeat(np.array(spans), sizes)
    # Depths 64 (by mixing), then doubling, the last step overlapping: bucket(length) = (bucket(q), bucket(length - q later)).
    x = np.concatenate([grams8(t), np.zeros(7, np.uint64)])
    q = 8
    while q < 64 and 2 * q <= length:
        later = np.concatenate([x[q:], np.zeros(q, np.uint64)])
        x = (x ^ (x >> np.uint64(32))) * _ODD + (later ^ (later >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        q *= 2
    steps, depth = [], q
    while depth < length:
        step = min(depth, length - depth)
        steps.append(step)
        depth += step
    # Which positions each depth is needed at: windows, and what later steps look up from them.
    needed = [window]
    for step in reversed(steps):
        before = needed[-1].copy()
        before[step:] |= needed[-1][:-step]
        needed.append(before)
    needed.reverse()
    bucket = np.full(len(t), -1, np.int64)
    (at,) = np.nonzero(needed[0])
    order = np.argsort(x[at], kind="stable")
    bucket[at[order]] = _numbered(x[at[order]])
    alive = _shared(bucket, window)
    for k, step in enumerate(steps):
        # Singletons among the windows are done; what they would look up is no longer needed.
        want = needed[k + 1] if k + 1 < len(steps) else alive
        (at,) = np.nonzero(want)
        if not len(at):
            break
        key = (bucket[at] << 32) | bucket[at + step]
        order = np.argsort(key, kind="stable")
        bucket = np.full(len(t), -1, np.int64)
        bucket[at[order]] = _numbered(key[order])
        alive = _shared(bucket, window & alive)
    return [alive[a : a + s + 1] for a, s in zip(starts[:-1], spans)]


def _numbered(ordered: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]).astype(np.int64))


def _shared(bucket: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Windows whose bucket holds another window."""
    count = np.bincount(bucket[window], minlength=1)
    out = window.copy()
    out[window] = count[bucket[window]] > 1
    return out


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()))


RANGES = "doc_id long, th long, lo long, hi long"


def _bit_runs(batches):
    """Runs of set bits: (doc_id, th, word, bits) to ranges of places."""
    for b in batches:
        word, bits = (b.column(k).to_numpy() for k in (2, 3))
        marks = np.unpackbits(bits.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        base, take = word[row] * 64, pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(base + lo), pa.array(base + hi - 1)], names=["doc_id", "th", "lo", "hi"])


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, th, lo, hi: ranges of window starts whose ``length`` bytes also start elsewhere. ``rows`` has doc_id, th, text."""
    found = written(segments(rows, length, gram), "segments")
    buckets = found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    shared = flagged_by(found, key_filter(buckets, "bucket"), "bucket", "again").filter("again").drop("again")
    same = ["bucket", "lead", "span", "e1", "e2"]
    kinds = shared.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "first")).alias("rep"))
    kinds = written(kinds, "segment-kinds")
    twice = kinds.filter("n > 1").select(*same)
    whole = flagged_by(shared.withColumn("k", F.struct("e1", "e2")), key_filter(twice.select(F.struct("e1", "e2").alias("k")), "k"), "k", "again")
    whole = whole.filter("again").join(twice, same, "left_semi").select("doc_id", "th", F.col("first").alias("lo"), (F.col("first") + F.col("span")).alias("hi"))

    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("m"), F.min("n").alias("fewest")).filter("m > 1 AND fewest = 1").select("bucket", "m")
    asked = kinds.join(mixed, "bucket").select("bucket", "m", "n", "span", "lead", "rep.doc_id", "rep.th", "rep.first")
    by_doc = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("bucket", "m", "n", "span", "lead", "first")).alias("asked"))
    by_doc = written(by_doc, "segments-asked")
    texts = flag_keys(rows, by_doc).filter("named").join(
        by_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "asked"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    )

    def fetch(batches):
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2).slice(i, 1).cast(pa.binary())[0].as_py()
                got = b.column(3)[i].as_py()
                for k in range(0, len(got), 1024):
                    part = got[k : k + 1024]
                    cols = {c: [x[c] for x in part] for c in ("bucket", "m", "n", "span", "lead", "first")}
                    bytes_of = [text[x["first"] : x["first"] + x["span"] + length] for x in part]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols["bucket"], pa.int64()), pa.array(cols["m"], pa.int64()), pa.array(cols["n"], pa.int64()), pa.array(cols["span"], pa.int32()), pa.array(cols["lead"], pa.int32()), pa.array(cols["first"], pa.int64())]
                        + [b.column(j).slice(i, 1).take(pa.array([0] * n)) for j in (0, 1)]
                        + [pa.array(bytes_of, pa.binary())],
                        names=["bucket", "m", "n", "span", "lead", "first", "doc_id", "th", "bytes"],
                    )

    slices = texts.select("doc_id", "th", "text", "asked").mapInArrow(fetch, "bucket long, m long, n long, span int, lead int, first long, doc_id long, th long, bytes binary")
    slices = written(slices, "segment-bytes")

    def refine(batches):
        held: list = []
        size, last = 0, None

        def settle(rows_):
            out = []
            for (doc, th, first, n, _, _), marks in zip(rows_, refined([r[5] for r in rows_], [r[4] for r in rows_], length)):
                if n == 1:
                    out += [(doc, th, first + a, first + z) for a, z in _runs(marks)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), (), ()))], names=["doc_id", "th", "lo", "hi"])

        for b in batches:
            for bucket, n, span, first, doc, th, data in zip(*(b.column(i).to_pylist() for i in range(7))):
                if bucket != last and size >= REFINE_BYTES:
                    yield settle(held)
                    held, size = [], 0
                held.append((doc, th, first, n, span, data))
                size, last = size + len(data), bucket
        if held:
            yield settle(held)

    cold = slices.filter(F.col("m") <= hot).select("bucket", "n", "span", "first", "doc_id", "th", "bytes")
    cold = cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(refine, RANGES)

    hottest = slices.filter(F.col("m") > hot).select("doc_id", "th", "n", "span", "first", "lead", "bytes")
    cores = hottest.mapInArrow(_pieces(length, False), "c1 long, c2 long").groupBy("c1", "c2").agg(F.count("*").alias("c")).filter("c > 1")
    pieces = hottest.mapInArrow(_pieces(length, True), PIECES).withColumn("k", F.struct("c1", "c2"))
    pieces = flagged_by(pieces, key_filter(cores.select(F.struct("c1", "c2").alias("k")), "k"), "k", "again").filter("again")
    spread = written(pieces.select("doc_id", "th", "n", "at", "bytes").mapInArrow(_windows(length), WINDOWS), "hot-windows")
    often = written(spread.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").select("w1", "w2"), "often")
    # Windows as bits of words, so that a long hot text has a 64th of the rows, and then as runs.
    warm = spread.filter("n = 1").join(often, ["w1", "w2"], "left_semi").select("doc_id", "th", F.shiftright("at", 6).alias("word"), F.pmod("at", F.lit(64)).cast("int").alias("bit"))
    warm = warm.groupBy("doc_id", "th", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).mapInArrow(_bit_runs, RANGES)
    return whole.unionByName(cold).unionByName(warm)


PIECES = "doc_id long, th long, n long, at long, bytes binary, c1 long, c2 long"
WINDOWS = "doc_id long, th long, n long, at long, w1 long, w2 long"


def _pieces(length: int, whole: bool):
    """Segments to pieces of at most ``PIECE`` windows, on a grid of distances to the anchor, each with the 128-bit hash of its core:
    the bytes that all windows of its grid cell share, whatever the segment. Equal windows lie in cells with equal cores.
    """

    def run(batches):
        from xxhash import xxh3_128_intdigest

        low = (1 << 64) - 1
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, th, n, span, first, lead, data in zip(*(b.column(i).to_pylist() for i in range(7))):
                for j in range((lead - span) // PIECE, lead // PIECE + 1):
                    last = lead - PIECE * j
                    h = xxh3_128_intdigest(data[last : last - PIECE + 1 + length], j)
                    a, z = max(0, last - PIECE + 1), min(span, last)
                    for column, value in zip(out, (doc, th, n, first + a, data[a : z + length] if whole else None, h >> 64, h & low)):
                        column.append(value)
            keys = [pa.array(_signed(np.array(x, np.uint64))) for x in out[5:]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            rows = [pa.array(x, t) for x, t in zip(out, kinds)] if whole else []
            yield pa.RecordBatch.from_arrays(rows + keys, names=["doc_id", "th", "n", "at", "bytes"][: len(rows)] + ["c1", "c2"])

    return run


def _windows(length: int):
    """The 128-bit hash of each window of a piece."""

    def run(batches):
        from xxhash import xxh3_128_intdigest

        low = (1 << 64) - 1
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, th, n, at, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                for k in range(len(data) - length + 1):
                    h = xxh3_128_intdigest(data[k : k + length])
                    for column, value in zip(out, (doc, th, n, at + k, h >> 64, h & low)):
                        column.append(value)
            arrays = [pa.array(x, pa.int64()) for x in out[:4]] + [pa.array(_signed(np.array(x, np.uint64))) for x in out[4:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "n", "at", "w1", "w2"])

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (array of start and stop of each removed run) of every document."""
    rows = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    windows = repeated_windows(rows, length, gram, hot)
    ranges = windows.distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    ranges = written(ranges, "ranges")
    flagged = flag_keys(rows, ranges)
    spans = "array<struct<start:long,stop:long>>"
    data = F.to_binary("text", F.lit("utf-8"))
    same = flagged.filter("NOT named").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), data.alias("kept"), F.lit(None).cast(spans).alias("spans"))
    named = flagged.filter("named").join(
        ranges.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "ranges"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left"
    )

    def cut(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                sizes, kept, spans = [], [], []
                for text, ranges in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                    runs: list[list[int]] = []
                    for r in ranges or []:
                        if runs and r["lo"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], r["hi"] + length)
                        else:
                            runs.append([r["lo"], r["hi"] + length])
                    at, pieces = 0, []
                    for a, z in runs:
                        pieces.append(text[at:a])
                        at = z
                    sizes.append(len(text)), kept.append(b"".join([*pieces, text[at:]])), spans.append([{"start": a, "stop": z} for a, z in runs])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    cuts = named.select("doc_id", "text", "ranges").mapInArrow(cut, f"doc_id long, n_bytes long, kept binary, spans {spans}")
    none = F.array().cast(spans)
    return same.withColumn("spans", none).unionByName(cuts)
