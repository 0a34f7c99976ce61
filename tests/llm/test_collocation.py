"""Phrase collocations against counting all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from seamline.llm import collocation

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang in f:
        many = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(a, inner.get(p[i : i + m], 0))
        rows_ = []
        for p, a in many.items():
            if p in inner and 100 * inner[p] >= 100 * a:
                continue
            cuts = [(1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for place, (score, a, p, left, right) in enumerate(sorted(rows_)[:top]):
            out.append((lang, place + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, n int")


def got(docs, least, longest, top):
    out = collocation.collocations(docs, least, longest, top)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, docs, vocabulary=12):
    r = random.Random(seed)
    words = ["of", "The", "é", "ÀB", "x1", "a-b", "œ", "in", "on", "zz", "\x1c", "to"][:vocabulary]
    def text():
        return "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " : "]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "en", "en", "fr", None]), text()) for _ in range(docs)]
    return rows + [("en", None), ("en", ""), ("de", "..\n,"), (None, "a"), ("en", "New York is big"), ("en", "new york IS big")] + [("fr", "un deux trois quatre cinq six")] * 40


@pytest.mark.parametrize("words", [7, 1000, 1 << 22])
@pytest.mark.parametrize("tasks", [1, 5])
def test_equals_counting_with_shards_of_any_size(spark, monkeypatch, words, tasks):
    monkeypatch.setattr(collocation, "SHARD_WORDS", words)
    rows = corpus(3, 60 if words < 100 else 400)
    least = 5 if words < 100 else 12
    assert got(table(spark, rows).repartition(tasks), least, 5, 2000) == plain(rows, least, 5, 2000)


def test_the_last_place_of_a_language_is_decided_by_the_text(spark):
    rows = [("en", f"{a} {b}. " * 6) for a, b in [("a", "b"), ("c", "d"), ("e", "f"), ("é", "z"), ("g", "h")]] + corpus(4, 30)
    for top in (1, 2, 3, 4):
        assert got(table(spark, rows), 5, 3, top) == plain(rows, 5, 3, top)


def test_a_long_text_is_read_in_parts(spark, prose):
    long = prose(400_000, 9)
    rows = [("en", long), ("en", "x" * 3_000_000 + " y z"), ("fr", "y z " * 1000)]
    assert got(table(spark, rows), 100, 4, 300) == plain(rows, 100, 4, 300)


def test_tables_without_phrases(spark):
    assert got(table(spark, [("en", "a b")]).filter("false"), 1, 5, 10) == []
    assert got(table(spark, [("en", "a b"), ("en", None)]), 2, 5, 10) == []


def test_products_beyond_64_bits_are_exact(spark):
    phrases = spark.createDataFrame([([1, 2], 9 * 10**12), ([1], 10**13 - 1), ([2], 9 * 10**12 + 7)], "words array<long>, f long")
    sizes = spark.createDataFrame([("en", 3 * 10**13)], "lang string, n long")
    vocabulary = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], "no long, lang string, word string")
    (r,) = collocation.cut_scores(phrases, sizes, vocabulary).collect()
    assert r.score == 1000 * 9 * 10**12 * 3 * 10**13 // ((10**13 - 1) * (9 * 10**12 + 7))


@pytest.mark.parametrize("bucket", [40, 700])
def test_phrases_of_a_shard_meet_those_of_others_in_many_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(collocation, "SHARD_WORDS", 1000)
    monkeypatch.setattr(collocation, "BUCKET", bucket)
    rows = corpus(5, 300)
    assert got(table(spark, rows).repartition(3), 8, 5, 2000) == plain(rows, 8, 5, 2000)


def test_what_leaves_a_shard_is_one_row_a_bucket_and_a_few_bytes_a_phrase(spark, prose):
    docs = spark.createDataFrame([(prose(60_000, 3), "en")], "text string, lang string")
    state = collocation.shards(docs, "lang", "text", 1 << 20, 4).cache()
    (words,) = [r.n for r in state.collect()]
    sent = collocation.slices(state, 1, BUCKETS).collect()
    assert len(sent) <= BUCKETS and words > 1000
    assert sum(len(r.entries) for r in sent) < 12 * words


BUCKETS = 3


@pytest.mark.parametrize("columns", [[[0, 1, 255, 256, 2**40]], [[], []], [[7] * 5, [0] * 5]])
def test_packed_columns_come_back(columns):
    import numpy as np

    assert [c.tolist() for c in collocation.unsqueezed(collocation.squeezed(*(np.array(c, np.int64) for c in columns)))] == columns
