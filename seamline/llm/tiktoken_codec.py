"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at boundaries where the splitting pattern always ends a match - one space between
two characters that are not white space - so each part encodes to exactly the ids it has in the whole. The library's pattern engine
fails on runs of about a million white-space characters; the pattern takes such a run, but for its last
character if more text follows, as one match, so a long run is cut out and handed over as that one match.
Ids are decoded to raw bytes, because a cut of ids need not be valid UTF-8.

Edge cases: a null text is empty and has no ids; texts that contain the strings of special tokens
are ordinary text; runs of white space may be of any length, and so may texts without a boundary; repeated rows give repeated rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

#: Characters of a text that are handed to the library at once, up to the next safe boundary.
PART_CHARS = 1 << 18

_SAFE = re.compile(r"(?<=\S) (?=\S)")

#: White-space characters in a row that are taken out of the pattern's hands.
LONG_RUN = 1 << 15
#: The characters that the pattern's white-space class matches (Unicode's White_Space).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Only where a run starts: a shorter run is looked at once, not from each of its characters.
_RUN = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of at least ``size`` characters (but for the last)."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, rank_path: str, pattern: str) -> list[int]:
    enc = encoding(rank_path, pattern)
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _RUN.finditer(text):
        # The run is one match; its last character is left to what follows, if anything does.
        stop = run.end() if run.end() == len(text) else run.end() - 1
        ids += _plain(text[start : run.start()], enc)
        ids += enc._encode_single_piece(text[run.start() : stop])
        start = stop
    return ids + _plain(text[start:], enc)


def _plain(text: str, enc) -> list[int]:
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text):
        ids += enc.encode_ordinary(part)
    return ids


def decode(ids: list[int], rank_path: str, pattern: str) -> bytes:
    return encoding(rank_path, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of each whole text (array of int)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            for ids, texts in _slices(b):
                got = [encode(t, rank_path, pattern) for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array(got, pa.list_(pa.int32()))], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The inverse of ``encode_documents``: doc_id and ``data``, the raw bytes; null ids give null bytes."""

    def run(batches):
        for b in batches:
            data = [None if x is None else decode(x, rank_path, pattern) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids again, in one pass: digests of both for every document, and the ids if asked for."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        decimal = [str(i) for i in range(encoding(rank_path, pattern).n_vocab)]
        for b in batches:
            for doc_ids, texts in _slices(b):
                n, a, d, kept = [], [], [], []
                for t in texts:
                    ids = encode(t, rank_path, pattern)
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    d.append(hashlib.sha256(decode(ids, rank_path, pattern)).hexdigest())
                    kept.append(ids if with_ids else None)
                arrays = [doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256):
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part.column(0), part.column(1).to_pylist()
