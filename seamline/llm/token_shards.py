"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are range-partitioned by id; the task of each range encodes its texts with the
tokenizers library, appends an end id to each, and writes shard files of whole documents. Each shard has one grammar: again and again,
frequent adjacent id pairs become nonterminals, until no pair occurs often enough to pay for its rule. A shard
stores its rules as pairs, the expansion length of every rule, and the number of symbols of each document, so any stretch of one
document is found and decoded without the rest: no pair crosses a document's end.

Shard file, little-endian: ``SLRP`` and a version byte; rules (uint32 pairs), expansion lengths (uint32), rules of each round (uint32),
symbols a document (uint32), document ids (int64, with a null byte each), symbols (3 bytes each); then a JSON footer with the
numbers of documents, tokens, rules, rounds and symbols and the first nonterminal; then the footer's length as uint32 and ``SLRP``.

A shard is written under a name of the task attempt and moved into place, so a retried task leaves whole
files. Files go to the shared folder through Arrow's file systems.

Edge cases: a null or empty text is the end id alone; null ids come first, and rows with equal ids are ordered by
their texts' hash; a text longer than a shard has a shard of its own; an empty table writes no document.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from codecs import charmap_decode
from functools import cached_property, lru_cache
from itertools import chain, islice, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_bytes, id_and_text, scratch_path, text_blocks, written

MAGIC = b"SLRP"
VERSION = 2
#: Tokens of a shard; bounds what a task holds.
SHARD_TOKENS = 1 << 22
#: A pair must save more than its rule costs: 12 bytes of rule and length against 3 a place, with room for what it takes from other pairs.
LEAST_COUNT = 8

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+"
_WORD = re.compile(_LETTERS)
#: A word of Latin letters, perhaps marks, one line's end and the next line's first word, and perhaps a short tail that begins with an ASCII character other than a letter.
_LINE = re.compile(f"([!-/:-@\\[-`{{-~]*\\n)({_LETTERS})")
_TAILED = re.compile(f"({_LETTERS})([!-/:-@\\[-`{{-~]*\\n{_LETTERS})?([\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f].{{0,3}})?", re.DOTALL)
#: The characters that stand for bytes in a byte-level vocabulary: bytes that are no visible Latin-1 character are counted on from U+0100.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_UNSEEN = sorted(set(range(0x100)).difference(_SEEN))
_BYTE_CHARS = "".join(chr(b if b in _SEEN else 0x100 + _UNSEEN.index(b)) for b in range(0x100))
_SPACE = _BYTE_CHARS[0x20]
_TOKEN_ID = attrgetter("id")
MEMORY_TAILS = 1 << 16
#: Parts whose ids a worker remembers (some 170 bytes each).
MEMORY_PARTS = 1 << 20
MEMORY_CHARS = 48
#: Places below which counting pairs' hashes first does not pay.
SIFTED_PLACES = 1 << 14
#: Text bytes that are split and looked up at once.
CALL_BYTES = 8 << 20
#: New parts that the library is given at once.
CALL_PARTS = 256
#: New words that the model is given one after another before their ids are gathered.
CALL_WORDS = 4096


_ODD = np.uint64(0x9E3779B97F4A7C15)


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class DocumentEncoder:
    """The library's ids of whole texts.

    A byte-level pre-tokenizer never joins across one space between two characters that are not white space. So a text is split
    at spaces, and the ids of a space with the part after it are asked for once and remembered, in one array. New parts go to the
    library many in one text; their ids come apart at tokens that begin with a space, as no part has another one. A text
    with a part that is empty or has white space at an end is encoded in the plain way, part by safe part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        #: A part's number, given in the order of learning: its ids are ``flat[starts[k] : starts[k + 1]]``.
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, self.kind), np.zeros(1, np.int64)
        self.tails: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, parts: list[str]) -> None:
        """Remember the ids of parts; those with white space at an end are not learnt.

        Letters end a match where an ASCII character that is no letter follows, so a word with a short tail of such
        is put together from the word and the tail. So is a word with the line's end and the next line's first word: marks, a
        single line feed before a letter and that word are matches of their own.
        """
        parts = [p for p in parts if p and p == p.strip()]
        match, tails = _TAILED.fullmatch, self.tails
        tailed = [(p, m[1], m[2] or "", m[3] or "") for p, m in zip(parts, map(match, parts)) if m and len(m[1]) < len(p)]
        if tailed:
            rest = set(parts).difference(p for p, *_ in tailed)
            rest.update(w for _, w, *_ in tailed)
            parts = list(rest.difference(self.known))
        self._ask(parts)
        if not tailed:
            return
        if len(tails) > MEMORY_TAILS:
            tails.clear()
        mine = {t: k for k, t in enumerate({t for _, _, *both in tailed for t in both})}
        self._ask_tails([t for t in mine if t not in tails])
        flat, starts = self._with([tails[t] for t in mine])
        at = np.empty((len(tailed), 3), np.int64)
        at[:, 0] = [self.known[w] for _, w, _, _ in tailed]
        at[:, 1] = [mine[line] for _, _, line, _ in tailed]
        at[:, 2] = [mine[t] for _, _, _, t in tailed]
        at[:, 1:] += len(self.known)
        ids, n = gathered(flat, starts, at.ravel())
        self._add([p for p, *_ in tailed], ids, n.reshape(-1, 3).sum(axis=1))

    def _ask_tails(self, tails: list[str]) -> None:
        lines = [(t, m[1], m[2]) for t, m in zip(tails, map(_LINE.fullmatch, tails)) if m]
        marks = {m: self.plain(m) for m in {m for _, m, _ in lines}}
        words = charmap_decode(" ".join(w for _, _, w in lines).encode(), "strict", _BYTE_CHARS)[0].split(_SPACE)
        for (t, m, _), made in zip(lines, map(self.model.tokenize, words)):
            self.tails[t] = marks[m] + np.array(list(map(_TOKEN_ID, made)), self.kind).tobytes()
        for t in tails:
            if t not in self.tails:
                self.tails[t] = self.plain(t)

    def _with(self, more: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat, starts) with the ids of other things behind those of the parts."""
        ends = np.cumsum(np.fromiter(map(len, more), np.int64, len(more))) // self.kind.itemsize
        return np.concatenate([self.flat, np.frombuffer(b"".join(more), self.kind)]), np.concatenate([self.starts, self.starts[-1] + ends])

    def _add(self, parts: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])

    def _keep(self, n: int) -> None:
        """Forget all parts but the first ``n``."""
        if len(self.known) - n < n:
            while len(self.known) > n:
                self.known.popitem()
        else:
            self.known = dict(islice(self.known.items(), n))
        self.flat, self.starts = self.flat[: self.starts[n]].copy(), self.starts[: n + 1].copy()

    def _ask(self, parts: list[str]) -> None:
        """Words of Latin letters are one match of the pattern each, so the model is asked for them directly; others go the library's whole way."""
        plain = _WORD.fullmatch
        words = [p for p in parts if plain(p)]
        found, sizes = [self.flat[:0]], [self.starts[:0]]
        for k in range(0, len(words), CALL_WORDS):
            # The model reads a character a byte, as the file's pre-tokenizer would give them, each word with its space before it.
            some = charmap_decode((" " + " ".join(words[k : k + CALL_WORDS])).encode(), "strict", _BYTE_CHARS)[0].replace(_SPACE, " " + _SPACE).split(" ")[1:]
            made = list(map(self.model.tokenize, some))
            sizes.append(np.fromiter(map(len, made), np.int64, len(made)))
            found.append(np.fromiter(map(_TOKEN_ID, chain.from_iterable(made)), self.kind))
        if len(words) < len(parts):
            asked = set(words)
            parts = [p for p in parts if p not in asked]
            words += parts
        else:
            parts = []
        for k in range(0, len(parts), CALL_PARTS):
            some = parts[k : k + CALL_PARTS]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            (at,) = np.nonzero(self.opens[ids])
            if len(at) == len(some) and at[0] == 0:
                found.append(ids), sizes.append(np.diff(at, append=len(ids)))
            else:
                each = [self.plain(" " + p) for p in some]
                found.append(np.frombuffer(b"".join(each), self.kind)), sizes.append(np.array([len(x) // self.kind.itemsize for x in each]))
        self._add(words, np.concatenate(found), np.concatenate(sizes))

    def fallback(self, text: str) -> bytes:
        cuts = [0, *(m.start() for m in _SAFE.finditer(text)), len(text)]
        return b"".join(self.plain(text[a:z]) for a, z in zip(cuts, cuts[1:]) if z > a)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text). Splitting and telling the parts apart are Arrow's work; Python sees each
        different part of the column once."""
        if len(self.known) >= MEMORY_PARTS:
            # What came first is what comes often; the later half goes.
            self._keep(MEMORY_PARTS // 2)
        # All texts in one, a space behind each: the spaces end the parts, which are told apart in place.
        _, offsets = flat_bytes(texts)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts) + 1], pa.int32()), pa.concat_arrays([texts.cast(pa.string()), pa.array([""])])), " ")[0].as_buffer()
        ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(whole, np.uint8) == 0x20) + 1]).astype(np.int32)
        starts = np.searchsorted(ends, offsets[:-1] + np.arange(len(texts)))
        coded = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), whole).dictionary_encode()
        at = coded.indices.to_numpy()
        parts = flat_bytes(coded.dictionary)[0].tobytes().decode().split(" ")[:-1]
        known = self.known
        table = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(table < 0)
        names = [parts[k] for k in missing.tolist()]
        self.learn([p for p in names if len(p) <= MEMORY_CHARS])
        short = len(known)
        self.learn([p for p in names if len(p) > MEMORY_CHARS])
        table[missing] = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        # The first part of a text has no space before it; texts with a part that was not learnt go the plain way.
        first = [parts[k] for k in at[starts].tolist()]
        at = table[at]
        lost = at < 0
        lost[starts] = False
        plain_way = np.logical_or.reduceat(lost, starts) | np.array([f != f.rstrip() for f in first], bool)
        here = [self.fallback(t.as_py()) if p else (self.plain(f) if f else b"") for f, p, t in zip(first, plain_way, texts)]
        if plain_way.any():
            at[np.repeat(plain_way, np.diff(starts, append=len(at)))] = len(known) + len(here)
        at[starts] = len(known) + np.arange(len(here))
        ids, n = gathered(*self._with([*here, b""]), at)
        if len(known) > short:
            self._keep(short)
        return ids, np.add.reduceat(n, starts)

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text]))[0].tolist()


def gathered(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches ``at`` of ``flat`` one behind another, the length of each); stretch k is ``flat[starts[k] : starts[k + 1]]``."""
    begin = starts[at]
    n = starts[at + 1] - begin
    take = np.repeat(begin - np.cumsum(n) + n, n)
    take += np.arange(len(take))
    return flat[take], n


@lru_cache(maxsize=2)
def encoder(path: str) -> DocumentEncoder:
    return DocumentEncoder(path)


def grouped(pairs: np.ndarray, at: np.ndarray, size: int):
    """(distinct pairs, their counts, the places ``at`` ordered by pair and place). Exact: pair and place are sorted as one number
    where they fit into one."""
    bits = max(1, (size - 1).bit_length())
    if int(pairs.max()).bit_length() + bits <= 64:
        key = (pairs << np.uint64(bits)) | at.astype(np.uint64)
        key.sort()
        codes, places = key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(at.dtype)
    else:
        order = np.argsort(pairs, kind="stable")
        codes, places = pairs[order], at[order]
    first = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    (heads,) = np.nonzero(first)
    return codes[heads], np.diff(np.append(heads, len(codes))), places


def sifted(pairs: np.ndarray, least: int) -> np.ndarray:
    """Where a pair may occur ``least`` times: hashes are counted, so that rare pairs need not be sorted. None that does is left out."""
    bits = max(1, (len(pairs) // 4).bit_length())
    cell = pairs * _ODD
    cell >>= np.uint64(64 - bits)
    cell = cell.view(np.int64)
    return (np.bincount(cell, minlength=1 << bits) >= least)[cell]


def disjoint(at: np.ndarray, after: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate places in order (each covers itself and ``after``), places and ranks of some that do not overlap.

    Of a run of one pair with itself every other place is taken; where different pairs overlap, the better rank. What is
    passed over can be taken when the pairs are next counted.
    """
    same = np.flatnonzero((at[1:] == after[:-1]) & (rank[1:] == rank[:-1])) + 1
    if len(same):
        place = np.arange(len(same))
        first = np.concatenate([[True], np.diff(same) != 1])
        keep = np.ones(len(at), bool)
        keep[same[(place - np.maximum.accumulate(np.where(first, place, 0))) & 1 == 0]] = False
        at, after, rank = at[keep], after[keep], rank[keep]
    taken = []
    for _ in range(2):
        touch, better = np.zeros(len(at) + 1, bool), np.zeros(len(at) + 1, bool)
        touch[1:-1] = at[1:] == after[:-1]
        better[1:-1] = rank[:-1] < rank[1:]
        ok = ~((touch[:-1] & better[:-1]) | (touch[1:] & ~better[1:]))
        taken.append((at[ok], rank[ok]))
        beside = np.concatenate(([False], ok, [False]))
        rest = ~(ok | (touch[:-1] & beside[:-2]) | (touch[1:] & beside[2:]))
        if not rest.any():
            break
        at, after, rank = at[rest], after[rest], rank[rest]
    return np.concatenate([a for a, _ in taken]), np.concatenate([r for _, r in taken])


def repair(tokens: np.ndarray, lengths: np.ndarray, least: int = LEAST_COUNT):
    """(symbols, symbols of each document, rules, rules of each round, base) of a shard.

    Nonterminals are numbered on from ``base = max id + 1``, round by round. All pairs are counted, those that occur ``least`` times
    or more are replaced, best first; then only pairs beside a replaced one are counted again, as no other can have
    become more frequent. Once that finds nothing the sequence is closed up and all pairs are counted anew, until no pair is left that
    occurs ``least`` times without overlapping itself. Places are linked to the next and last one, so a round costs what it touches.
    """
    seq = tokens.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(lengths) - 1] = True
    symbol = base = int(seq.max()) + 1 if len(seq) else 1
    rules, per_round = [], []
    known, names = np.empty(0, np.uint64), np.empty(0, np.uint32)
    found = len(seq)
    while found:
        found, n = 0, len(seq)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[last] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[1:][last[:-1]] = -1
        gone = np.zeros(n, bool)
        at = np.nonzero(~last)[0].astype(np.int32)
        whole = True
        while len(at):
            width = np.uint64(symbol)
            if whole:
                pairs = seq[:-1] * width
                pairs += seq[1:]
                pairs = pairs[~last[:-1]]
            else:
                pairs = seq[at] * width + seq[after[at]]
            whole = False
            # Nearly all places of the first count have frequent pairs, few of the later ones.
            if rules and len(at) > SIFTED_PLACES:
                may = sifted(pairs, least)
                pairs, at = pairs[may], at[may]
                if not len(at):
                    break
            pairs, counts, places = grouped(pairs, at, n)
            often = counts >= least
            pairs, counts, places = pairs[often], counts[often], places[np.repeat(often, counts)]
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(pairs), np.int32)
            rank[order] = np.arange(len(pairs), dtype=np.int32)
            if 8 * len(places) > n:
                dense = np.full(n, -1, np.int32)
                dense[places] = np.repeat(rank, counts)
                at = np.flatnonzero(dense >= 0).astype(np.int32)
                of = dense[at]
            else:
                both = (places.astype(np.uint64) << np.uint64(32)) | np.repeat(rank, counts).astype(np.uint64)
                both.sort()
                at, of = (both >> np.uint64(32)).astype(np.int32), (both & np.uint64(0xFFFFFFFF)).astype(np.int32)
            at, of = disjoint(at, after[at], of)
            left, right = pairs[order] // width, pairs[order] % width
            pair = (left << np.uint64(32)) | right
            name = np.zeros(len(pair), np.uint32)
            if len(known):
                k = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                name = np.where(known[k] == pair, names[k], name)
            new = (name == 0) & (np.bincount(of, minlength=len(pair)) >= least)
            name[new] = symbol + np.arange(int(new.sum()), dtype=np.uint32)
            use = name[of] > 0
            at, of = at[use], of[use]
            if not len(at):
                break
            found += len(at)
            if new.any():
                rules.append(np.stack([left[new], right[new]], axis=1).astype(np.uint32))
                per_round.append(int(new.sum()))
                symbol += per_round[-1]
                known, names = np.concatenate([known, pair[new]]), np.concatenate([names, name[new]])
                order = np.argsort(known)
                known, names = known[order], names[order]
            second = after[at]
            third = after[second]
            seq[at] = name[of]
            gone[second] = True
            after[at] = third
            before[third[third >= 0]] = at[third >= 0]
            at = np.concatenate([at, before[at]])
            at.sort()
            at = at[np.concatenate([[True], at[1:] != at[:-1]]) & (at >= 0)]
            at = at[after[at] >= 0]
        last, seq = (after < 0)[~gone], seq[~gone]
    per_doc = np.diff(np.concatenate(([-1], np.nonzero(last)[0])))
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return seq, per_doc.astype(np.uint32), table, np.array(per_round, np.uint32), base


def expansion_lengths(rules: np.ndarray, per_round: np.ndarray, base: int) -> np.ndarray:
    """Tokens under each rule; a rule only uses symbols of earlier rounds."""
    out = np.ones(base + len(rules), np.uint32)
    at = 0
    for n in per_round.tolist():
        part = rules[at : at + n]
        out[base + at : base + at + n] = out[part[:, 0]] + out[part[:, 1]]
        at += n
    return out[base:]


def expand(seq: np.ndarray, rules: np.ndarray, per_round: np.ndarray, base: int) -> np.ndarray:
    """Token ids of a sequence of symbols, undoing the rounds from the last to the first."""
    at = len(rules)
    for n in per_round.tolist()[::-1]:
        at -= n
        low = base + at
        is_rule = seq >= low
        if not is_rule.any():
            continue
        place = np.arange(len(seq)) + np.cumsum(is_rule) - is_rule
        out = np.empty(len(seq) + int(is_rule.sum()), np.uint32)
        which = seq[is_rule] - low + at
        out[place[~is_rule]] = seq[~is_rule]
        out[place[is_rule]] = rules[which, 0]
        out[place[is_rule] + 1] = rules[which, 1]
        seq = out
    return seq


def expand_flat(seq: np.ndarray, rules: np.ndarray, spans: np.ndarray, per_round: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, ends): the sequence expanded in one step from a table of all rules' expansions, and where each
    symbol's tokens end, by the stored lengths."""
    table = np.concatenate([np.arange(base, dtype=np.uint32), expand(base + np.arange(len(rules), dtype=np.uint32), rules, per_round, base)])
    size = np.concatenate([np.ones(base, np.int64), spans])
    start = np.cumsum(size) - size
    ends = np.cumsum(size[seq])
    shift = start[seq] - ends + size[seq]
    at = np.repeat(shift, size[seq])
    at += np.arange(len(at))
    return table[at], ends


def pack24(x: np.ndarray) -> bytes:
    if len(x) and int(x.max()) >= 1 << 24:
        raise ValueError("symbols of 2**24 and more do not fit the format")
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack24(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").reshape(-1)


def shard_bytes(ids: list[int | None], tokens: np.ndarray, lengths: np.ndarray, least: int = LEAST_COUNT) -> bytes:
    """A shard file of these documents."""
    seq, per_doc, rules, per_round, base = repair(tokens, lengths, least)
    parts = [MAGIC + bytes([VERSION]), rules.astype("<u4").tobytes(), expansion_lengths(rules, per_round, base).astype("<u4").tobytes()]
    parts += [per_round.astype("<u4").tobytes(), per_doc.astype("<u4").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids), pack24(seq)]
    footer = json.dumps({"docs": len(ids), "tokens": len(tokens), "rules": len(rules), "rounds": len(per_round), "symbols": len(seq), "base": base}).encode()
    return b"".join([*parts, footer, len(footer).to_bytes(4, "little"), MAGIC])


class ShardReader:
    """Reads a whole shard file, or stretches of single documents."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(8, size - 8)
        if bytes(tail[4:]) != MAGIC:
            raise ValueError("not a whole shard file")
        n = int.from_bytes(tail[:4], "little")
        self.footer = f = json.loads(bytes(file.read_at(n, size - 8 - n)))
        sizes = {"rules": 8 * f["rules"], "spans": 4 * f["rules"], "rounds": 4 * f["rounds"], "per_doc": 4 * f["docs"], "ids": 8 * f["docs"], "nulls": f["docs"], "symbols": 3 * f["symbols"]}
        self.places, at = {}, len(MAGIC) + 1
        for name, length in sizes.items():
            self.places[name] = (at, length)
            at += length

    def _part(self, name: str, kind: str) -> np.ndarray:
        at, length = self.places[name]
        return np.frombuffer(bytes(self.file.read_at(length, at)), kind)

    @cached_property
    def grammar(self):
        """(rules, expansion lengths, rules a round, base)."""
        return self._part("rules", "<u4").reshape(-1, 2), self._part("spans", "<u4"), self._part("rounds", "<u4"), self.footer["base"]

    @cached_property
    def ends(self) -> np.ndarray:
        """Where each document's symbols begin, and the last one's end."""
        return np.concatenate(([0], np.cumsum(self._part("per_doc", "<u4"), dtype=np.int64)))

    def ids(self) -> list[int | None]:
        return [None if x else int(i) for i, x in zip(self._part("ids", "<i8"), self._part("nulls", "u1"))]

    def documents(self):
        """(id, token ids) of every document."""
        rules, spans, per_round, base = self.grammar
        flat, symbol_ends = expand_flat(unpack24(self._part("symbols", "u1").tobytes()), rules, spans, per_round, base)
        cuts = np.concatenate(([0], symbol_ends))[self.ends].tolist()
        for doc, a, z in zip(self.ids(), cuts, cuts[1:]):
            yield doc, flat[a:z]

    def tokens(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids ``start`` to ``stop`` of document ``i``. Only its symbols are read, and of those only the ones over the
        stretch, found by the stored lengths, are expanded."""
        rules, spans, per_round, base = self.grammar
        first, end = int(self.ends[i]), int(self.ends[i + 1])
        seq = unpack24(bytes(self.file.read_at(3 * (end - first), self.places["symbols"][0] + 3 * first)))
        size = np.ones(len(seq), np.int64)
        size[seq >= base] = spans[seq[seq >= base] - base]
        ends = np.cumsum(size)
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        a, z = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        offset = int(ends[a] - size[a])
        return expand(seq[a:z].copy(), rules, per_round, base)[start - offset : stop - offset]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, uri: str | None = None, least: int = LEAST_COUNT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shards in ascending id order; the manifest has task, the names' stem, shards, docs and tokens of each task."""
    spark: SparkSession = docs.sparkSession
    uri = uri or scratch_path(spark, "token-shards")
    rows = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        files, folder = open_fs(uri)
        encode = encoder(tokenizer_path).encode_column
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = shards = documents = tokens = 0

        def put() -> None:
            nonlocal held, size, shards
            ids = [i for part, _, _ in held for i in part]
            data = shard_bytes(ids, np.concatenate([t for _, t, _ in held]), np.concatenate([n for _, _, n in held]), least)
            files.create_dir(folder, recursive=True)
            path = f"{folder}/{shard_name(task, shards)}"
            with files.open_output_stream(f"{path}.{attempt}") as stream:
                stream.write(data)
            files.move(f"{path}.{attempt}", path)
            held, size, shards = [], 0, shards + 1

        # The many strings and ids that are remembered make no cycles, but the collector goes through them again and again.
        gc.disable()
        for b in batches:
            _, offsets = flat_bytes(b.column(1))
            for i, j in text_blocks(offsets, CALL_BYTES):
                ids, sizes = encode(b.column(1).slice(i, j - i))
                ends = np.cumsum(sizes)
                ids = np.insert(ids.astype(np.uint32), ends, end_id)
                names, sizes = b.column(0).slice(i, j - i).to_pylist(), sizes + 1
                ends += np.arange(1, len(ends) + 1)
                documents, tokens = documents + len(names), tokens + len(ids)
                first = 0
                while first < len(names):
                    begin = int(ends[first] - sizes[first])
                    fit = max(int(np.searchsorted(ends, begin + shard_tokens - size, "right")), first + (not held))
                    if fit > first:
                        held.append((names[first:fit], ids[begin : int(ends[fit - 1])], sizes[first:fit]))
                        size += int(ends[fit - 1]) - begin
                    if fit < len(names):
                        put()
                    first = fit
        if held:
            put()
        gc.enable()
        if shards:
            yield pa.RecordBatch.from_pydict({"task": [task], "shards": [shards], "docs": [documents], "tokens": [tokens]})

    manifest = rows.mapInArrow(run, "task long, shards long, docs long, tokens long")
    return written(manifest, "token-manifest").withColumn("uri", F.lit(uri))


def shard_name(task: int, k: int) -> str:
    return f"shard-{task:06d}-{k:05d}"


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files of a manifest.

    The manifest has one row per writing task; their token counts alone are summed on the driver.
    """
    spark = manifest.sparkSession
    rows = sorted(manifest.select("task", "shards", "uri", "tokens").collect())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    starts = np.concatenate(([0], np.cumsum([r["tokens"] for r in rows])))[:-1]
    files = spark.createDataFrame([(r["uri"], r["task"], r["shards"], int(s)) for r, s in zip(rows, starts)], "uri string, task long, shards long, start long")

    def run(batches):
        for b in batches:
            for uri, task, shards, start in zip(*(b.column(i).to_pylist() for i in range(4))):
                system, folder = open_fs(uri)
                for k in range(shards):
                    with system.open_input_file(f"{folder}/{shard_name(task, k)}") as file:
                        ids, begin, size, crc = [], [], [], []
                        for doc, tokens in ShardReader(file).documents():
                            ids.append(doc), begin.append(start), size.append(len(tokens))
                            crc.append(zlib.crc32(tokens.astype("<u4")))
                            start += len(tokens)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (begin, size, crc))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.repartitionByRange(len(rows), "start").mapInArrow(run, schema)
