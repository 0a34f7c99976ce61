"""Word-piece token counts by a linear longest-match automaton.

A word is matched greedily, longest piece first, from its start. Instead of restarting after every piece,
the trie of the vocabulary gets failure links: where a trie node has no child for the next
byte, its pieces that are certain by then are popped at once and the match goes on at the failure node, which
stands for what was read after the popped pieces. Only the *number* of popped pieces is stored, so
lengths come out in one pass over the word and no piece is ever built.

The vocabulary is a rank file of byte strings. A piece that begins with a space starts a word,
any other continues one: the automaton reads each word as a space and the word's UTF-8 bytes. Words are
runs of bytes other than ``[\\x20\\x09-\\x0D]``. A word that the vocabulary cannot cover counts
as one unknown token.

Edge cases: null and empty texts have 0 words and 0 tokens; a word may be as long as the text, as the automaton
is linear; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

#: Counts of words that a worker remembers; the memory is emptied when full, so it is bounded.
MEMORY_WORDS = 1 << 18
MEMORY_BYTES_A_WORD = 48


class Automaton:
    """Trie with failure links and popped-token counts; ``count(word)`` is linear in the word."""

    def __init__(self, vocabulary):
        child: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                following = child[node].get(byte)
                if following is None:
                    following = child[node][byte] = len(child)
                    child.append({})
                    ends.append(False)
                node = following
            if piece:
                ends[node] = True
        fail: list[int] = [-1] * len(child)
        pops: list[int] = [0] * len(child)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, below in child[node].items():
                queue.append(below)
                if ends[below]:
                    # The whole path is one piece: pop it and go on from the root.
                    fail[below], pops[below] = 0, 1
                    continue
                at, popped = fail[node], pops[node]
                while at >= 0 and byte not in child[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[below], pops[below] = child[at][byte], popped
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split of ``word``; 1 if there is none (unknown), 0 if empty."""
        if not word:
            return 0
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for byte in word:
            following = child[node].get(byte)
            while following is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                following = child[node].get(byte)
            node = following
        while node > 0:
            total += pops[node]
            node = fail[node]
        return 1 if node < 0 else total


class _Counts(dict):
    """Word -> count; a miss runs the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= MEMORY_BYTES_A_WORD:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def automaton(rank_path: str) -> Automaton:
    with open(rank_path, "rb") as lines:
        return Automaton([base64.b64decode(line.split()[0]) for line in lines])


def token_counts(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text."""

    def run(batches):
        counts = _Counts(automaton(rank_path))
        for b in batches:
            words, tokens = [], []
            for k in range(0, b.num_rows, 256):
                for text in b.column(1).slice(k, 256).cast(pa.binary()).to_pylist():
                    split = text.split()
                    words.append(len(split))
                    tokens.append(sum(map(counts.__getitem__, split)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
