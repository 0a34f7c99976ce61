"""Phrase collocation mining on vertical positional inverted lists.

Texts become shards of at most ``SHARD_WORDS`` words. A shard keeps its words by position and the frequent phrase of k words that starts
at each. Round k extends these by one word: positions with frequent phrases at them and right behind them fall apart, by phrase and
adjacent word, into the lists of the phrases of k + 1 words; a list's length is the phrase's exact frequency there. Lists follow from words
and phrases and are made anew where they are needed, not stored; only their lengths leave a shard. Equal ranges of a phrase's hash are
buckets, which a shard's phrases are ordered by: Spark brings all shards' slices of a bucket together, where phrases are compared by their words and their lengths added up, and takes
back which of a slice's phrases are frequent, in the slice's order. A slice is packed columns, a few bytes a phrase. The others'
positions, and words that no frequent phrase covers, go before the next round. That loses nothing: both parts of a frequent phrase are at least as frequent.

A shard ends anywhere, with as many words of the next one behind it as the longest phrase reaches over; they are read but not
counted. Words are numbered across all shards, a language's apart from any other's, so phrases are known by numbers and never by hashes.

A null text is empty and a null language is ``und``; repeated rows count as often as they occur; ids play no part. An empty table, or
one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import release
from .common import discard, flat_bytes, text_blocks, written

#: Words of a shard; bounds a task's memory.
SHARD_WORDS = 3 << 18
#: Phrases of all shards' slices that meet in a bucket; bounds a task's memory.
BUCKET = 1 << 20

#: Classes of bytes: 0 of words, 1 of blanks between them, 2 of ends of pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A shard before its phrases of k words are counted: words by position, frequent phrases of k - 1 words by position (from k = 3 on), the words'
#: numbers (from k = 2 on), how many phrases it has, and for k = 1 these with their counts in the order of their hashes and the languages' names.
SHARD = "shard long, owned int, n int, tokens binary, gram binary, numbers binary, entries binary, langs array<string>"
FOUND = "shard long, bucket long, reply binary, words array<long>, f long, lang string, word string"

_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- packed columns and hashes

def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, as planes of bytes, compressed."""
    head, planes = [len(columns)], []
    for x in columns:
        width = (int(x.max(initial=0)).bit_length() + 7) // 8
        head += [len(x), width]
        planes.append(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = b"".join([np.array(head, "<i8").tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    count = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, "<i8", 2 * count, 8).reshape(-1, 2).tolist()
    out, at = [], 8 + 16 * count
    for length, width in sizes:
        x = np.zeros((length, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length).T
        out.append(x.view("<i8").reshape(-1))
        at += length * width
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes; no word is empty."""
    starts = np.cumsum(lengths) - lengths
    powers = np.full(int(lengths.max()), _ODD)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, lengths)], starts))


def in_language(hashes: np.ndarray, codes: np.ndarray, langs: list[str]) -> np.ndarray:
    return mixed(hashes + np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)[codes] * _ODD)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` equal ranges a hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = mixed(h * _ODD + w.astype(np.uint64))
    return h


# ---- words by position

class Reader:
    """Cuts texts into lower-cased words, and collects them until a shard is full."""

    def __init__(self):
        self.bytes: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.opens: list[np.ndarray] = []  # whether a piece starts with the word
        self.langs: list[np.ndarray] = []
        self.held = 0
        self.codes: dict[str, int] = {}
        self.fresh = True

    def add(self, data: np.ndarray, lang: str) -> None:
        """Words of one text's bytes, or of a part of it that is cut between words; ``fresh`` says that a new piece starts."""
        kind = KIND[data]
        inside = kind == 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        at = np.flatnonzero(start)
        if len(at):
            before = np.cumsum(kind == 2)
            words = np.cumsum(inside)
            ends = before[at]
            opens = np.r_[self.fresh or ends[0] > 0, ends[1:] > ends[:-1]]
            self.bytes.append(LOWER[data[inside]])
            self.lengths.append(np.diff(np.r_[words[at] - 1, words[-1]]))
            self.opens.append(opens)
            self.langs.append(np.full(len(at), self.codes.setdefault(lang, len(self.codes)), np.int32))
            self.held += len(at)
            self.fresh = bool(before[-1] > ends[-1])
        elif (kind == 2).any():
            self.fresh = True

    def take(self, most: int, reach: int, last: bool) -> Iterator[tuple]:
        """Shards of ``most`` words of what is held: (owned positions, tokens, words' languages, lengths, bytes and owned counts, names of
        languages), words in the order of their hashes. ``reach`` words stay for the next one."""
        if not self.held:
            return
        lengths, opens, langs = (np.concatenate(x) for x in (self.lengths, self.opens, self.langs))
        data, places = np.concatenate(self.bytes), np.r_[0, np.cumsum(lengths)]
        names = list(self.codes)
        a = 0
        while a < self.held and (last or self.held - a >= most + reach):
            b = min(self.held, a + most)
            z = min(self.held, b + reach)
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(places[a : z + 1] - places[a]), pa.py_buffer(data[places[a] : places[z]])])
            coded = text.dictionary_encode()
            kinds, ids = np.unique(coded.indices.to_numpy().astype(np.int64) * len(names) + langs[a:z], return_inverse=True)
            listed = coded.dictionary.take(pa.array(kinds // len(names)))
            word_data, word_lengths = bytes_of(listed)
            h = in_language(word_hashes(word_data, word_lengths), kinds % len(names), names)
            order = np.argsort(h, kind="stable")
            kinds, ids = kinds[order], np.argsort(order)[ids]
            word_data, word_lengths = bytes_of(listed.take(pa.array(order)))
            gaps = opens[a:z].copy()
            gaps[0] = False
            at = np.arange(z - a) + np.cumsum(gaps)
            tokens = np.full(at[-1] + 1, -1, np.int32)
            tokens[at] = ids
            owned = int(at[b - a - 1]) + 1
            yield owned, tokens, (kinds % len(names), word_lengths, word_data, np.bincount(ids[: b - a], minlength=len(kinds))), names
            a = b
        keep = [x[a:] for x in (lengths, opens, langs)]
        self.bytes, self.lengths, self.opens, self.langs = [data[places[min(a, self.held)] :]], [keep[0]], [keep[1]], [keep[2]]
        self.held -= min(a, self.held)


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow column of large binaries, and the length of each."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def parts_of(data: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """A long text in parts that are cut between words."""
    a = 0
    while a < len(data):
        z = min(len(data), a + most)
        while z < len(data):
            gap = np.flatnonzero(KIND[data[a:z]])
            if len(gap):
                z = a + int(gap[-1]) + 1
                break
            z = min(len(data), z + most)
        yield data[a:z]
        a = z


def shard_row(shard: int, owned: int, n: int, tokens: np.ndarray, gram: np.ndarray | None = None, numbers: np.ndarray | None = None, entries: tuple = (), langs: list[str] | None = None) -> pa.RecordBatch:
    packed = [squeezed(tokens + 1), None if gram is None else squeezed(gram + 1), None if numbers is None else squeezed(numbers), squeezed(*entries) if entries else None]
    cells = [pa.array([shard]), pa.array([owned], pa.int32()), pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in packed), pa.array([langs], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cells, names=["shard", "owned", "n", "tokens", "gram", "numbers", "entries", "langs"])


def shards(docs: DataFrame, lang_col: str, text_col: str, most: int, reach: int) -> DataFrame:
    """Shards with their words: tokens are places among the words, -1 where a piece ends."""

    def run(batches):
        reader, made, task = Reader(), 0, TaskContext.get().partitionId()

        def rows(last: bool):
            nonlocal made
            for owned, tokens, entries, langs in reader.take(most, reach, last):
                yield shard_row((task << 20) + made, owned, len(entries[-1]), tokens, entries=entries, langs=langs)
                made += 1

        for b in batches:
            langs = b.column(0).to_pylist()
            data, offsets = flat_bytes(b.column(1))
            for i, j in text_blocks(offsets):
                for k in range(i, j):
                    reader.fresh = True
                    for part in parts_of(data[offsets[k] : offsets[k + 1]]):
                        reader.add(part, langs[k])
                if reader.held >= most + reach:
                    yield from rows(False)
        yield from rows(True)

    narrow = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, SHARD)


# ---- lists of a shard

def narrowed(tokens: np.ndarray, owned: int, keep: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Tokens where ``keep`` holds, with one -1 for each stretch of others; the owned positions, and each old position's new one."""
    kept = np.where(keep, tokens, -1)
    stay = kept >= 0
    stay[1:] |= kept[:-1] >= 0
    return kept[stay], int(np.count_nonzero(stay[:owned])), np.cumsum(stay) - 1


def compact(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` with its values renumbered, the most frequent first, and their old values; -1 stays."""
    times = np.bincount(x + 1)[1:]
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    new = np.full(len(times) + 1, -1, np.int64)  # the last one is of -1
    new[order] = np.arange(len(order))
    return new[x], order


def keyed(tokens: np.ndarray, gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions where phrases of k words start both there and at the next one, the phrase and the adjacent word as one number)."""
    at = np.flatnonzero((gram[:-1] >= 0) & (gram[1:] >= 0))
    return at, gram[at] * (int(tokens.max(initial=0)) + 1) + tokens[at + k]


def candidates(tokens: np.ndarray, gram: np.ndarray, numbers: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(place of the phrase of k + 1 words at each position, -1 for none; its words' numbers, by column; its bucket) for all phrases whose first
    and last k words are phrases; ``gram`` has the phrase of k words at each position. Phrases are in the order of their buckets and,
    within one, of their first k words, which packs well."""
    at, key = keyed(tokens, gram, k)
    _, head, ids = np.unique(key, return_index=True, return_inverse=True)
    words = [numbers[tokens[at[head] + i]] for i in range(k + 1)]
    bucket = bucket_of(phrase_hashes(words), buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = np.full(len(tokens), -1, np.int64)
    out[at] = place[ids]
    return out, [w[order] for w in words], bucket[order]


def listed(shard: int, owned: int, tokens: np.ndarray, gram: np.ndarray | None, numbers: np.ndarray, k: int) -> pa.RecordBatch:
    """A shard's row with its number of phrases of k + 1 words; ``gram`` is None for k = 1, where phrases are words."""
    _, key = keyed(tokens, tokens if gram is None else gram, k)
    return shard_row(shard, owned, len(np.unique(key)), tokens, gram, numbers)


def replies(told: pa.Scalar, buckets: int) -> np.ndarray:
    """The numbers of a shard's phrases, -1 for those that are not frequent, from its slices' replies. A number is a phrase's place among its
    bucket's frequent ones times the number of buckets, plus the bucket."""
    parts = [(bucket, unsqueezed(x)[0]) for bucket, x in sorted((x["bucket"], x["reply"]) for x in told.as_py())]
    return np.concatenate([np.where(x > 0, (x - 1) * buckets + bucket, -1) for bucket, x in parts])


def first_lists(rows: DataFrame, buckets: int) -> DataFrame:
    """Shards with phrases of two words, from those that were told the numbers of their frequent words."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                number = np.append(replies(b.column(3)[r], buckets), -1)  # the last one is of token -1
                tokens, owned = unsqueezed(b.column(2)[r].as_py())[0] - 1, b.column(1)[r].as_py()
                tokens, owned, _ = narrowed(tokens, owned, number[tokens] >= 0)
                tokens, old = compact(tokens)
                yield listed(b.column(0)[r].as_py(), owned, tokens, None, number[old], 1)

    return rows.select("shard", "owned", "tokens", "told").mapInArrow(run, SHARD)


def next_lists(rows: DataFrame, k: int, buckets: int) -> DataFrame:
    """Shards with phrases of k + 1 words from those that were told which of their phrases of k words are frequent."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                owned = b.column(1)[r].as_py()
                tokens, numbers = unsqueezed(b.column(2)[r].as_py())[0] - 1, unsqueezed(b.column(4)[r].as_py())[0]
                gram = tokens if k == 2 else unsqueezed(b.column(3)[r].as_py())[0] - 1
                found, _, _ = candidates(tokens, gram, numbers, k - 1, buckets)
                mine = np.append(replies(b.column(5)[r], buckets) >= 0, False)  # the last one is of place -1
                alive = np.flatnonzero(mine[found])
                covered = np.zeros(len(tokens) + 1, np.int32)
                covered[alive] += 1  # a position has one phrase of k words at most
                covered[alive + k] -= 1
                tokens, owned, at = narrowed(tokens, owned, np.cumsum(covered[:-1]) > 0)
                tokens, old = compact(tokens)
                gram = np.full(len(tokens), -1, np.int64)
                gram[at[alive]] = found[alive]
                yield listed(b.column(0)[r].as_py(), owned, tokens, compact(gram)[0], numbers[old], k)

    return rows.select("shard", "owned", "tokens", "gram", "numbers", "told").mapInArrow(run, SHARD)


# ---- frequencies over all shards

def slices(state: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, shard, entries, langs): the shards' phrases of k words and their counts, cut by buckets."""

    def phrases(b: pa.RecordBatch, r: int):
        if k == 1:
            columns, langs = unsqueezed(b.column(1)[r].as_py()), b.column(2)[r].as_py()
            return columns, langs, bucket_of(in_language(word_hashes(columns[2], columns[1]), columns[0], langs), buckets)
        tokens, numbers = unsqueezed(b.column(2)[r].as_py())[0] - 1, unsqueezed(b.column(4)[r].as_py())[0]
        gram = tokens if k == 2 else unsqueezed(b.column(3)[r].as_py())[0] - 1
        found, words, bucket = candidates(tokens, gram, numbers, k - 1, buckets)
        return [*words, np.bincount(found[: b.column(1)[r].as_py()] + 1, minlength=len(bucket) + 1)[1:]], None, bucket

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                columns, langs, bucket = phrases(b, r)
                if not len(bucket):
                    continue
                heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[heads[1:], len(bucket)]
                places = None if langs is None else np.r_[0, np.cumsum(columns[1])]
                for i in range(0, len(heads), 256):
                    out = []
                    for a, z in zip(heads[i : i + 256].tolist(), ends[i : i + 256].tolist()):
                        cut = [c[a:z] for c in columns]
                        if langs is not None:
                            cut[2] = columns[2][places[a] : places[z]]
                        out.append(squeezed(*cut))
                    n = len(out)
                    cells = [pa.array(bucket[heads[i : i + n]]), b.column(0).take(pa.array([r] * n)), pa.array(out, pa.binary()), pa.array([langs] * n, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cells, names=["bucket", "shard", "entries", "langs"])

    needed = ["shard", "entries", "langs"] if k == 1 else ["shard", "owned", "tokens", "gram", "numbers"]
    return state.select(*needed).mapInArrow(run, "bucket long, shard long, entries binary, langs array<string>")


def added_words(parts: list[list[np.ndarray]], langs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str], pa.Array]:
    """(which word each entry is, frequency of each word, its language, its text) of slices of words."""
    names: dict[str, int] = {}
    codes = np.concatenate([np.array([names.setdefault(x, len(names)) for x in own])[p[0]] for p, own in zip(parts, langs)])
    lengths, counts = (np.concatenate([p[c] for p in parts]) for c in (1, 3))
    data = np.concatenate([p[2].astype(np.uint8) for p in parts])
    places = np.r_[0, np.cumsum(lengths)]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
    kinds, ids = np.unique(coded.indices.to_numpy().astype(np.int64) * len(names) + codes, return_inverse=True)
    words = coded.dictionary.take(pa.array(kinds // len(names))).cast(pa.large_string()).cast(pa.string())
    every = list(names)
    return ids, np.bincount(ids, counts).astype(np.int64), [every[k] for k in (kinds % len(names)).tolist()], words


def added_phrases(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which phrase each entry is, frequency of each phrase, its words as a row) of slices of phrases."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    ids = np.zeros(len(columns[0]), np.int64)
    for c in columns[:-1]:
        _, head, ids = np.unique(ids * (int(c.max()) + 1) + c, return_index=True, return_inverse=True)
    return ids, np.bincount(ids, columns[-1]).astype(np.int64), np.stack([c[head] for c in columns[:-1]], axis=1)


def frequent(state: DataFrame, k: int, least: int) -> tuple[DataFrame, int]:
    """A written table, and the number of buckets. The table has rows of two kinds: (shard, bucket, reply), the place of each phrase of a slice among the
    bucket's frequent ones from 1 on (1 for all of two words or more), 0 for those below ``least``; and words and f of each frequent phrase. Of single
    words also lang and word, and a row without ``words`` with a language's number of words in a bucket."""
    entries = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-entries // BUCKET))
    columns = ["shard", "bucket", "reply", "words", "f", "lang", "word"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()]

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, t)) for c, t in zip(columns, kinds)], names=columns)

    def settle(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [unsqueezed(x) for _, x, _ in held]
        single = held[0][2] is not None
        if single:
            ids, totals, langs, texts = added_words(parts, [x for _, _, x in held])
        else:
            ids, totals, phrases = added_phrases(parts)
        (often,) = np.nonzero(totals >= least)
        number = np.zeros(len(totals), np.int64)
        number[often] = np.arange(len(often)) + 1 if single else 1
        if single:
            phrases = (number[:, None] - 1) * buckets + bucket
        cuts = np.cumsum([len(p[-1]) for p in parts])[:-1]
        replied = [squeezed(x) for x in np.split(number[ids], cuts)]
        yield rows(len(held), shard=pa.array([s for s, _, _ in held], pa.int64()), bucket=pa.array([bucket] * len(held), pa.int64()), reply=pa.array(replied, pa.binary()))
        width = phrases.shape[1]
        words = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(often) + 1, width), pa.int32()), pa.array(phrases[often].reshape(-1)))
        if single:
            yield rows(len(often), words=words, f=pa.array(totals[often]), lang=pa.array([langs[k] for k in often.tolist()], pa.string()), word=texts.take(pa.array(often)))
            sizes: dict[str, int] = {}
            for lang, n in zip(langs, totals.tolist()):
                sizes[lang] = sizes.get(lang, 0) + n
            yield rows(len(sizes), lang=pa.array(list(sizes), pa.string()), f=pa.array(list(sizes.values()), pa.int64()))
        else:
            yield rows(len(often), words=words, f=pa.array(totals[often]))

    def run(batches):
        now, held = None, []
        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in range(4))):
                if bucket != now and held:
                    yield from settle(now, held)
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield from settle(now, held)

    met = slices(state, k, buckets).repartition("bucket").sortWithinPartitions("bucket", "shard")
    return written(met.mapInArrow(run, FOUND), f"frequent-{k}"), buckets


def frequent_phrases(docs: DataFrame, least: int, longest: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, sizes): words (their numbers) and f of all frequent phrases of 1 to ``longest`` words; no, lang and word of
    the frequent words; lang and n, all word occurrences of every language. All are written tables."""
    spark = docs.sparkSession
    state = written(shards(docs, lang_col, text_col, SHARD_WORDS, longest - 1), "shards")
    every = None
    for k in range(1, longest + 1):
        release(spark)
        found, buckets = frequent(state, k, least)
        release(spark)
        if k == 1:
            vocabulary = found.filter("words IS NOT NULL").select(F.element_at("words", 1).alias("no"), "lang", "word", "f")
            sizes = found.filter("words IS NULL AND lang IS NOT NULL").groupBy("lang").agg(F.sum("f").alias("n"))
        phrases = found.filter("words IS NOT NULL").select("words", "f")
        every = phrases if every is None else every.unionByName(phrases)
        if k < longest:
            told = found.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("bucket", "reply")).alias("told"))
            rows = state.join(told, "shard")
            before, state = state, written(first_lists(rows, buckets) if k == 1 else next_lists(rows, k, buckets), f"lists-{k + 1}")
            discard(before)
    discard(state)
    release(spark)
    return every, vocabulary, sizes


# ---- scores

def exact(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def cut_scores(phrases: DataFrame, sizes: DataFrame, vocabulary: DataFrame, scale: int = 1000) -> DataFrame:
    """lang, words, a, l, r, n and score of every phrase of two words or more, by its lowest-scoring cut, ties to the earliest.

    ``scale * a * n`` may pass 64 bits and is a decimal of 38 digits, enough for 10^13 words; its quotient is cut to a whole number without rounding.
    """
    f = phrases.select(F.col("words").alias("part"), F.col("f").alias("of_part"))
    long = phrases.filter(F.size("words") > 1).select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    long = long.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.expr("slice(words, k + 1, size(words) - k)"))
    long = long.join(f.select(F.col("part").alias("left"), F.col("of_part").alias("l")), "left").join(f.select(F.col("part").alias("right"), F.col("of_part").alias("r")), "right")
    named = long.withColumn("no", F.element_at("words", 1)).join(vocabulary.select("no", "lang"), "no").join(sizes, "lang")
    top, bottom = F.lit(scale).cast("decimal(5,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(15,0)"), F.col("l").cast("decimal(15,0)") * F.col("r").cast("decimal(15,0)")
    scored = named.withColumn("score", F.call_function("div", top, bottom))
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    return best.select("lang", "words", "a", "s.l", "s.r", "n", "s.score")


def not_covered(scored: DataFrame, percent: int = 100) -> DataFrame:
    """``scored`` without phrases that lie in a longer one of at least ``percent`` percent of their frequency."""
    long = scored.filter(F.size("words") > 2).select("words", F.col("a").alias("longer"))
    ranges = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    inner = long.select("longer", F.explode(ranges).alias("words")).groupBy("words").agg(F.max("longer").alias("longer"))
    met = scored.join(inner, "words", "left")
    return met.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` collocations.

    A collocation is a phrase of 2 to ``longest`` words within a piece, at least ``least`` times, that no longer phrase explains; its score is
    the whole part of 1000 a n / (l r) at its worst cut, l and r being its parts' frequencies and n the language's number of words.
    """
    phrases, vocabulary, sizes = frequent_phrases(docs, least, longest, lang_col, text_col)
    left = not_covered(written(cut_scores(phrases, sizes, vocabulary), "scored-phrases"))
    # Ties of a language's last place stay in until texts decide.
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    left = left.withColumn("place", place).filter(F.col("place") <= top).drop("place")
    spelt = left.select("*", F.posexplode("words").alias("at", "no")).join(vocabulary.select("no", "word"), "no")
    spelt = spelt.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    named = spelt.withColumn("phrase", F.array_join(F.transform("spelt", lambda x: x["word"]), " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
