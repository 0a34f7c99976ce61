"""Source divergence against tables of all groups and terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from seamline.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        mine = sorted(s for g, s in groups if g == lang)
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        def ps(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}
        q = ps(sum((counts[lang, s] for s in mine), Counter()))
        p = {s: ps(counts[lang, s]) for s in mine}
        for s in mine:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(1, t, lang, s, "x", 2) for lang, s, t in rows], "doc_id long, text string, lang string, source string, term string, p int")


def got(docs, least, top):
    out = divergence.divergence(docs, least, top)
    assert out.columns == COLUMNS and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, sources, docs):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcDEéß漢", k=r.randint(1, 4))) for _ in range(120)]
    rows = []
    for _ in range(docs):
        lang, s = r.choice(["en", "en", "fr"]), r.randrange(sources)
        own = vocabulary[s % 7 * 10 : s % 7 * 10 + 12] + vocabulary[80:]
        rows.append((lang, f"s{s}", " 1,".join(r.choices(own, k=r.randint(0, 20)))))
    return rows + [("en", "nothing", ""), ("en", None, None), (None, "s1", "word word"), (None, None, "word"), ("de", "one", "x y z"), ("xx", "a", "1 2"), ("xx", "b", None)]


@pytest.mark.parametrize("light", [0, 3, 1000])
@pytest.mark.parametrize("tile", [3, 128])
def test_equals_the_whole_table_whatever_is_dense(spark, monkeypatch, light, tile):
    for name, value in (("LIGHT", light), ("TILE_GROUPS", tile), ("TILE_TERMS", 5 if tile == 3 else 4096)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(light + tile, 11, 250)
    assert got(table(spark, rows).repartition(4), 4, 6) == plain(rows, 4, 6)


def test_repeated_rows_and_a_hot_group(spark):
    rows = corpus(8, 6, 80) * 2 + [("en", "s0", "hot hot Hot a b")] * 500
    assert got(table(spark, rows).repartition(6), 5, 50) == plain(rows, 5, 50)


def test_empty_tables_and_no_kept_terms(spark):
    rows = [("en", "a", "x"), ("en", "b", "y"), ("en", "c", None)]
    assert got(table(spark, rows).filter("false"), 1, 5) == []
    assert got(table(spark, rows), 30, 5) == plain(rows, 30, 5)


@pytest.mark.parametrize("span", [1, 3, 5, 1000])
def test_long_texts_are_cut_between_terms(monkeypatch, span):
    monkeypatch.setattr(divergence, "SPAN", span)
    for text in ("", "ab", "ab cdefghijk, é" + "z" * 30 + " ab", "  x", "abcdefgh", "漢字ÀB[\\]c`d{e}\x7ff "):
        want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        assert [t.decode() for part in divergence.terms_of(text.encode()) for t in part] == want


def test_shares_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(int(10 ** r.uniform(0, 15)), int(10 ** r.uniform(0, 14)), r.randint(1, 10**7)) for _ in range(300)]
    rows = [(n, n + rest, kinds) for n, rest, kinds in rows]
    made = spark.createDataFrame(rows, "n long, total long, kinds long").select("n", "total", "kinds", divergence.of_count(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))
    assert all(x.p == 1 + 10**9 * (x.n + 5) // (x.total + 5 * x.kinds) for x in made.collect())


def test_light_terms_against_absent_ones():
    rng = np.random.default_rng(0)
    numbers, absent, asked = np.array([4, 7]), np.array([10, 30]), rng.integers(0, 200, 9)
    rows = pd.DataFrame({"g": rng.choice(numbers, 50), "p": rng.integers(5, 150, 50), "t": rng.integers(1, 4, 50)}).drop_duplicates(["g", "p"])
    want = [[sum(n * (abs(p - x) - abs(absent[k] - x)) for p, n in rows[rows.g == g][["p", "t"]].to_numpy()) for x in asked] for k, g in enumerate(numbers)]
    assert (divergence.against(rows, numbers, absent, asked) == np.array(want)).all()
