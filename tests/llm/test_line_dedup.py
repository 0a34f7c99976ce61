"""Line dedup against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(doc_id, kept text, lines, dropped lines) of every row, sorted; rows without an id are one document after the others."""
    order = lambda i: (i is None, i or 0)
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(i))
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), order(i)) == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(docs):
    return sorted((tuple(r) for r in line_dedup.drop_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


EDGES = [
    (7, "a shared line\nown line of seven\n"), (3, "  A SHARED line\t\nshort\n\n"), (3, "a shared line\na shared line"), (5, None), (6, ""), (None, "a shared line\nof nobody at all"),
    (None, "of nobody at all"), (8, "of nobody at all"), (9, "ÄÄÄÄÄÄÄÄÄÄ\nääääääääää"), (10, "ÄÄÄÄÄÄÄÄÄÄ\r\nninechars\nninechars"), (11, "ninechars"), (12, " a shared line"),
    (13, "twice in one\ntwice in one"), (14, "a shared line\n" * 5 + "x"), (14, "a shared line\n" * 5 + "x"), (15, "\x0b\x0ca shared line\x0c"), (-1, "zz\nof nobody at all"),
]


def test_edges(make):
    assert got(make(EDGES)) == plain(EDGES)


def test_an_empty_table(make):
    assert got(make([(1, "x")]).filter("false")) == []


def test_random_texts_of_common_lines_and_a_hot_line(make, prose):
    r = random.Random(5)
    pool = [prose(r.randint(1, 12), 100 + k) for k in range(300)]
    rows = [(r.randrange(400), "\n".join(r.choices(pool, k=r.randint(0, 9)) + ["the line of every page"] * r.randint(0, 2))) for _ in range(600)]
    rows.append((999, "\n".join(r.choices(pool, k=50_000))))
    assert got(make(rows).repartition(16)) == plain(rows)


def test_a_filter_that_is_not_broadcast_gives_the_same(make, prose, monkeypatch):
    rows = [(k, "\n".join(prose(6, s) for s in (k, k // 2, 7))) for k in range(300)]
    monkeypatch.setattr(line_dedup, "BROADCAST_WORDS", 0)
    assert got(make(rows).repartition(5)) == plain(rows)


@pytest.mark.parametrize("tasks", [1, 7])
def test_the_twice_seen_filter_misses_no_repeat_and_lets_few_others_through(spark, tasks):
    rng = np.random.default_rng(1)
    once = rng.integers(-(2**63), 2**63 - 1, 20_000)
    twice = rng.integers(-(2**63), 2**63 - 1, 500)
    words = 1 << (20_500 * 16 // 64).bit_length()
    seen = spark.createDataFrame([(int(h),) for h in [*once, *twice, *twice]], "h long").repartition(tasks)
    bits = line_dedup.twice_seen(seen, words)
    asked = spark.createDataFrame([(int(h), True) for h in twice] + [(int(h), False) for h in once], "h long, again boolean")
    found = {r.again: r.n for r in line_dedup.suspected(asked, bits, words).groupBy("again").agg(F.count("*").alias("n")).collect()}
    assert found[True] == 500 and found.get(False, 0) < 100
