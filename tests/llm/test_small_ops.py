"""Every map-like operator against a plain version, with nulls, empties, repeats and long texts."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seamline.llm import decontaminate, exact_dedup, langid, quality, queries, simhash, tiktoken_codec, wordpiece_count


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- exact dedup

def test_exact_dedup_matches_grouping(make, prose):
    long = prose(30_000, 3)
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (8, ""), (7, " "), (1, long), (2, long), (6, long + "x"), (3, "a\tb"), (None, "a b"), (10, "a b ")]
    got = {}
    for r in exact_dedup.exact_duplicates(make(rows), digests=True).collect():
        got.setdefault((r.doc_id, r.full), []).append(r)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        sha = hashlib.sha256(norm(t).encode()).hexdigest()
        same = [j for j, u in rows if norm(u) == norm(t)]
        r = got[(i, sha)].pop()
        low = min(j for j in same if j is not None)
        assert (r.keep_id, r.group_size, r.kept) == (low, len(same), i == low)


def test_exact_dedup_keeps_first_rows_whole(make):
    docs = make([(3, "x y"), (1, "x  y"), (2, "z"), (1, "x  y"), (None, "q"), (5, None), (4, "")])
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None) == [(1, "x  y"), (2, "z"), (4, "")]
    assert out.filter("doc_id IS NULL").count() == 1
    assert exact_dedup.keep_first(docs.filter("false")).count() == 0


#: Every helper column of the operators that keep all columns, and some that earlier forms had.
HELPERS = "norm again digest row_key named of_id of_digest dropped text_length text_key same_length key_hash key_word key_bits own_id own_hash of_hash key k h th n node sig sketch root who __h __word __id __drop __named __full __key".split()


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, lambda d: simhash.keep_representatives(d), lambda d: d])
def test_helper_columns_never_touch_the_tables_own(make, prose, keep):
    from pyspark.sql import functions as F

    a, b = prose(80, 1), prose(80, 2)
    docs = make([(1, a), (2, a), (2, a), (3, b), (4, None), (5, "")]).drop("full", "key", "kept")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS}).withColumn("with.dot `and` tick", F.col("doc_id") * 2)
    out = keep(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in HELPERS) and r["with.dot `and` tick"] == 2 * r["doc_id"]
    assert {r["doc_id"] for r in out.collect()} >= {1, 3, 4}


def test_exact_dedup_refines_step_by_step(spark, make):
    """Only texts whose length and first characters are held twice are hashed whole."""
    head = "h" * 70
    rows = [(1, "alone"), (2, "same length A"), (3, "same length B"), (4, head + "x"), (5, head + "y"), (6, "twice"), (7, "twice"), (8, "tw  ice")]
    out, groups = exact_dedup.duplicate_groups(make(rows))
    assert {r.doc_id for r in out.collect() if r.full is not None} == {4, 5, 6, 7}
    assert [(r.keep_id, r.group_size) for r in groups.collect()] == [(6, 2)]


def test_a_hot_group_is_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    from seamline.llm import common

    members = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("full"))
    groups = common.written(members.groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1 OR full = '3'"), "groups")
    joined = common.with_group(members, groups, "full", "n", F.xxhash64("doc_id"))
    assert joined.columns == ["full", "doc_id", "keep_id", "n"] or set(joined.columns) == {"full", "doc_id", "keep_id", "n"}
    assert joined.count() == 3000 and joined.filter("full = 'hot'").select("keep_id").distinct().collect() == [(1,)]
    assert joined.filter("keep_id IS NULL").count() == 999


# ---- quality

def test_quality_separates_junk_and_keeps_empty_defined(spark, make, prose):
    good = [(i, prose(80, i)) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(80, 1000 + i).split())) for i in range(30)]
    docs = make(good + bad + [(900, None), (901, ""), (902, "a")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (900, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert all(got[i].predicted == 1 for i, _ in good) and all(got[i].predicted == 0 for i, _ in bad)
    assert got[900].score == got[901].score == got[902].score == pytest.approx(model.prior)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}
    assert quality.score_documents(docs.filter("false"), model).count() == 0
    none = quality.fit(docs, labels.filter("false"))
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}


def test_quality_cosines_are_exact(prose):
    texts = pa.array([prose(30, i) for i in range(40)])
    rng = np.random.default_rng(0)
    vocabulary = np.arange(quality.TERMS, dtype=np.int32) % 50
    model = quality.QualityModel(vocabulary, np.ones(50 + quality.SHAPES, np.float32), rng.normal(size=(50 + quality.SHAPES, 8)).astype(np.float32), np.zeros((0, 8), np.float32), np.zeros(0), 0.5)
    z = model.project(texts)
    model.vectors, model.labels = z[:35], rng.integers(0, 2, 35).astype(float)
    s = z @ z[:35].T
    for i, got in enumerate(model.score(texts)):
        near = s[i] >= np.sort(s[i])[-quality.NEIGHBOURS]
        w = np.maximum(s[i], 0).astype(float)[near] ** quality.SHARPNESS
        assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-5)


def test_quality_ties_at_the_last_neighbour_all_vote():
    s = np.array([[0.9, 0.5, 0.5, 0.5, 0.1, -0.2]], np.float32)
    for n in (2, 3, 4):
        assert quality.votes_of(s, n)[0].tolist() == pytest.approx([0.9**8, 0.5**8, 0.5**8, 0.5**8, 0, 0], rel=1e-5)
    order = [3, 5, 0, 2, 4, 1]
    assert quality.votes_of(s[:, order], 2)[0].tolist() == quality.votes_of(s, 2)[0][order].tolist()
    assert quality.votes_of(s, 9)[0].tolist() == pytest.approx([0.9**8, 0.5**8, 0.5**8, 0.5**8, 0.1**8, 0], rel=1e-5)


def test_quality_terms_and_space_equal_plain_ones(spark, make, prose):
    """Trigrams, weights, projection and vote of a fitted model against plain versions."""
    rows = [(k, prose(20, k) if k % 2 else prose(9, k).upper() + "!!! 123") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    model = quality.fit(make(rows), labels, max_labelled=1000)
    text = dict(rows)
    known = [k for k in range(50) if zlib.crc32(str(k).encode()) % 5]
    assert len(model.labels) == len(known) and model.labels.tolist() == [k % 2 for k in known]

    def trigrams(t):
        c = [int(quality._CLASS[b]) for b in t.encode()]
        return [(a * quality.CLASSES + b) * quality.CLASSES + d for a, b, d in zip(c, c[1:], c[2:])]

    used = sorted({g for k in known for g in trigrams(text[k])})
    plain = {k: [math.sqrt(trigrams(t).count(g) / len(trigrams(t))) for g in used] for k, t in text.items()}
    weights = [math.log((1 + len(known)) / (1 + sum(plain[k][j] > 0 for k in known))) + 1 for j in range(len(used))]
    assert model.weights[: len(used)].tolist() == pytest.approx(weights, rel=1e-5)
    x = np.array([[v * w for v, w in zip(plain[k], weights)] for k in known])
    shapes = np.array([[math.sqrt(v) for v in (lambda r: (r[0], 1 - r[0], r[1], 1 - r[1]))(quality._repeats(text[k].encode()))] for k in known])
    whole = np.hstack([x, np.zeros((len(x), 1)), shapes * model.weights[len(used) + 1 :]])
    # The space holds as much of the sample as the best one of its dimensions.
    held = np.linalg.norm(whole @ model.projection) ** 2
    assert held == pytest.approx((np.linalg.svd(whole, compute_uv=False)[: quality.DIMENSIONS] ** 2).sum(), rel=1e-3)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op2_quality(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, n = out.selectExpr("sum(int(predicted = quality))", "count(*)").first()
    assert n > 50 and right / n > 0.95


# ---- token counts

def greedy(word, vocabulary):
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy_matching():
    r = np.random.default_rng(1)
    for trial in range(60):
        vocabulary = {bytes(r.integers(97, 100, r.integers(1, 6)).tolist()) for _ in range(r.integers(1, 25))}
        a = wordpiece_count.Automaton(vocabulary)
        for _ in range(60):
            word = bytes(r.integers(97, 100, r.integers(1, 12)).tolist())
            assert a.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_token_counts_on_documents(make, prose):
    path = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    vocabulary = {base64.b64decode(x.split()[0]) for x in open(path, "rb")}
    rows = [(1, None), (2, ""), (3, "  \n"), (4, prose(300, 5)), (5, "Élan ñandú 漢字 🙂"), (6, "x" * 5000), (4, prose(300, 5)), (None, "a b")]
    got = rows_of(wordpiece_count.token_counts(make(rows), path))
    want = [(i, len((t or "").encode().split()), sum(greedy(b" " + w, vocabulary) for w in (t or "").encode().split())) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---- language

def test_language_windows_and_fused_tables():
    data = np.frombuffer("ÀÉé ABC xyz".encode(), np.uint8)
    assert langid.folded(data).tobytes().decode() == "àéé abc xyz"
    r = np.random.default_rng(2)
    x = r.integers(97, 110, (30, langid.WINDOW)).astype(np.uint8)
    net = langid.train(x, r.integers(0, 3, 30), ["a", "b", "c"], epochs=1)
    assert np.allclose(net.softmax(net.pooled(x)[0]), net.window_probabilities(x, net.fused()), atol=1e-4)


def test_language_gradient_is_the_numeric_one():
    r = np.random.default_rng(4)
    x, y = r.integers(97, 105, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    trained = langid.train(np.tile(x, (20, 1)), np.tile(y, 20), ["a", "b"], epochs=20)
    assert (trained.softmax(trained.pooled(x)[0]).argmax(axis=1) == y).all()


def test_language_held_out_accuracy_and_edges(spark, make):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.op6_language(spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 100 and right / n > 0.98
    net = langid.fit(docs)
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the and of tion er in " * 20_000), (4, "a"), (None, "the of")]
    got = rows_of(langid.predict(make(rows), net))
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3 and len(got) == 6
    assert next(g[1] for g in got if g[0] == 4 and g[2] > 0.9) == "en"
    assert langid.fit(make([])) is None
    assert {g[1] for g in rows_of(langid.predict(make(rows), None))} == {"und"}


def test_language_prediction_equals_a_plain_forward_pass(make, prose):
    """Whole texts against a plain network: filters slid byte by byte, the mean over windows weighted by their bytes."""
    r = np.random.default_rng(5)
    net = langid.train(r.integers(97, 123, (40, langid.WINDOW)).astype(np.uint8), r.integers(0, 3, 40), ["a", "b", "c"], epochs=1)
    rows = [(1, "short"), (2, prose(400, 1)), (3, "É" * 300 + " ÀB"), (4, prose(60, 2).upper())]

    def plain(text):
        data = langid.folded(np.frombuffer(text.encode(), np.uint8))
        total = np.zeros(3)
        for at in range(0, len(data), langid.WINDOW):
            w = data[at : at + langid.WINDOW]
            x = np.pad(w, (0, langid.WINDOW - len(w)))
            pooled = []
            for width, taps in zip(langid.WIDTHS, net.taps):
                pooled.append(np.max([sum(taps[j][x[i + j]] for j in range(width)) for i in range(langid.WINDOW - width + 1)], axis=0))
            z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.dense + net.dense_bias
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(w)
        return total / len(data)

    got = {r.doc_id: r for r in langid.predict(make(rows), net).collect()}
    for i, text in rows:
        p = plain(text)
        assert got[i].lang_pred == net.languages[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-4)


def test_language_gradient_of_one_step_is_the_numeric_one():
    r = np.random.default_rng(6)
    x, y = r.integers(97, 105, (8, langid.WINDOW)).astype(np.uint8), r.integers(0, 2, 8)
    loss = lambda net: -np.log(net.softmax(net.pooled(x)[0])[np.arange(8), y]).mean()
    still, moved = langid.train(x, y, ["a", "b"], epochs=0), langid.train(x, y, ["a", "b"], epochs=1)
    # Adam's first step goes the full rate against the sign of each gradient.
    for name in ("dense", "bias"):
        a, b = getattr(still, name), getattr(moved, name)
        for at in list(np.ndindex(a.shape))[:20]:
            keep = a[at]
            a[at] = keep + 1e-2
            up = loss(still)
            a[at] = keep - 1e-2
            slope = up - loss(still)
            a[at] = keep
            if abs(slope) > 1e-4:
                assert np.sign(b[at] - keep) == -np.sign(slope)


def test_every_language_is_learnt_however_many(make):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " * 40) for k in range(400)]
    docs = make(rows[:1]).sparkSession.createDataFrame([(i, t, f"l{i:03d}") for i, t in rows], "doc_id long, text string, lang string")
    got = langid.sampled_windows(docs)
    assert len({lang for lang, _ in got}) == 400 and langid.quota(400) == 256 and langid.quota(10**7) == 1 and langid.quota(4) == 1600


def test_language_sample_is_drawn_from_whole_texts_and_bounded(make):
    text = "".join(f"{k:08d}" for k in range(64_000))
    docs = make([(1, text), (2, "b" * 300), (3, "")])
    got = [w for _, w in langid.sampled_windows(docs, 100)]
    assert len(got) == 100 and max(int(w[:8]) for w in got if w[:1] != b"b") > 50_000
    again = [w for _, w in langid.sampled_windows(docs.repartition(5), 100)]
    assert got == again


# ---- contamination

def test_containment_equals_brute_force(spark, make, prose):
    items = [(k, prose(n, 50 + k)) for k, n in enumerate([5, 9, 14, 30, 59, 3, 200])] + [(90, None), (91, "  "), (92, prose(30, 53))]
    docs = []
    for k, t in items[:7]:
        w = t.split()
        docs += [(10 * k, f"{prose(400, k)} {t} {prose(500, k + 1)}"), (10 * k + 1, " ".join(w[: max(5, int(len(w) * 0.87))]))]
        docs += [(10 * k + 2, " ".join(x if j % 9 else x + "q" for j, x in enumerate(w))), (10 * k + 3, t.upper().replace(" ", " \n\t"))]
    docs += [(500, None), (501, ""), (502, "a b"), (503, items[5][1]), (10, docs[4][1]), (None, items[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(rows_of(decontaminate.contained_items(make(docs), table)), key=str)
    sh = lambda t: decontaminate.shingles((t or "").encode())
    want = []
    for d, t in docs:
        for k, u in items:
            n, both = len(sh(u)), len(sh(u) & sh(t))
            if n and both >= 0.8 * n - 1e-9:
                want.append((d, k, n, both, both / n))
    assert got == sorted(want, key=str) and len(got) > 20
    kept = decontaminate.keep_clean(make(docs), table)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in docs if not any(sh(u) and len(sh(u) & sh(t)) >= 0.8 * len(sh(u)) - 1e-9 for _, u in items))
    assert decontaminate.contained_items(make(docs), table.filter("false")).count() == 0


def test_containment_works_in_blocks(spark, make, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    items = [(k, prose(20, k)) for k in range(10)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.contained_items(make(items), table).collect()) == list(range(10))
    docs = make(items + [(100, prose(30, 999))])
    assert [r.doc_id for r in decontaminate.keep_clean(docs, table).collect()] == [100]


def test_partitions_hold_their_sizes():
    texts = [" ".join(f"w{k}x{j}" for j in range(n)).encode() for k, n in enumerate([3, 5, 6, 8, 11, 12, 40, 41, 300])] + [b""]
    index = decontaminate.ContainmentIndex(5, 0.8, list(range(len(texts))), texts).build()
    sizes = [max(1, len(t.split()) - 4) for t in texts[:-1]]
    assert [p.low for p in index.partitions] == sorted({1 << (n.bit_length() - 1) for n in sizes})
    for p in index.partitions:
        for i, need in p.need.items():
            assert p.low <= sizes[i] < 2 * p.low
            k = int((p.owners == i).sum())
            assert k == min(sizes[i], math.floor(0.2 * (2 * p.low - 1) + 1e-9) + 1) and need == max(1, k - math.floor(0.2 * sizes[i] + 1e-9))


# ---- tiktoken

def test_codec_equals_the_library_and_round_trips(make, prose, monkeypatch):
    path, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    enc = tiktoken_codec.encoding(path, pattern)
    monkeypatch.setattr(tiktoken_codec, "PART_CHARS", 1000)
    texts = [None, "", " ", "a  b   c \n d", "<|endoftext|> it's", prose(3000, 9), "x" * 4000, ("ab  \t cd " * 900), "é🙂漢 " * 700]
    for t in texts:
        ids = [i for p in tiktoken_codec.safe_parts(t or "", 1000) for i in enc.encode_ordinary(p)]
        assert ids == enc.encode_ordinary(t or "")
    docs = make(list(enumerate(texts)) + [(0, None)])
    encoded = tiktoken_codec.encode_documents(docs, path, pattern)
    back = {r.doc_id: bytes(r.data) for r in tiktoken_codec.decode_documents(encoded, path, pattern).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in tiktoken_codec.round_trip(docs, path, pattern).collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def by_single_matches(text, enc):
    """Ids of a text by the pattern's matches, found by another engine and encoded one by one."""
    import regex

    return [i for m in regex.finditer(queries.split_pattern(), text) for i in enc._encode_single_piece(m.group())]


def test_runs_of_white_space_of_any_length(make, monkeypatch):
    path, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    enc = tiktoken_codec.encoding(path, pattern)
    monkeypatch.setattr(tiktoken_codec, "LONG_RUN", 20)
    monkeypatch.setattr(tiktoken_codec, "_RUN", re.compile(tiktoken_codec._RUN.pattern.replace(str(1 << 15), "20")))
    for run in (" " * 50, "\n" * 50, " \n\t" * 20, "\u3000\x85 " * 20, "\x1c" * 60):
        for text in (run, "a" + run, run + "b", f"it's{run}é{run}!", f"a {run}\n12", f"{run[:10]}x{run[:30]}"):
            assert tiktoken_codec.encode(text, path, pattern) == enc.encode_ordinary(text) == by_single_matches(text, enc), repr(text[:5])


@pytest.mark.parametrize("run", [1000, 10_000, 32_767, 32_768])
def test_many_runs_of_white_space_take_linear_time(run):
    import time

    path, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    tiktoken_codec.encode("a", path, pattern)
    text = ("word" + " " * run) * (1_000_000 // run) + "x"
    began = time.process_time()
    ids = tiktoken_codec.encode(text, path, pattern)
    assert time.process_time() - began < 3  # of the quadratic pattern it took over ten
    assert tiktoken_codec.decode(ids, path, pattern) == text.encode()


def test_a_million_white_space_characters(make):
    path, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    enc = tiktoken_codec.encoding(path, pattern)
    texts = [" " * 10**6, "\n" * 10**6, "x" + " \n" * 600_000 + "y", "a" * 10**6, "no " + " " * 10**6]
    for r in tiktoken_codec.round_trip(make(list(enumerate(texts))), path, pattern, with_ids=True).collect():
        t = texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and list(r.ids) == by_single_matches(t, enc)


# ---- simhash

def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, fps, radius=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(rows))]


def test_covering_masks_miss_no_pair():
    from itertools import combinations

    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a, b in combinations(range(64), 2))


def test_simhash_documents_and_components(make, prose):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "One"), (5, "one"), (4, "A b"), (3, prose(70_000, 8)), (3, prose(70_000, 8))]
    for k in range(40):
        w = prose(120, k % 10).split()
        w[k % 120] += "z" * (k // 10)
        rows.append((100 + k, " ".join(w)))
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, brute_components(rows, fps)))
    docs = make(rows)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(docs.filter("false")).count() == 0


def test_parity_sketches_lose_no_similar_pair(spark):
    r = np.random.default_rng(9)
    rows, truth = [], []
    for k in range(400):
        n = int(r.choice([1, 5, 31, 33, 64, 65, 500, 1023, 1030]))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        drop, add = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 5 + 1))
        b = np.concatenate([a[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64)]) if k % 4 else r.integers(0, 1 << 63, n, dtype=np.uint64)
        if not len(b):
            continue
        sketch = lambda h: simhash.parity_sketch(h, simhash.parity_words(len(h))).tolist()
        rows.append((len(rows), len(a), sketch(a), len(b), sketch(b)))
        truth.append(len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())))
    pairs = spark.createDataFrame(rows, "k long, n_a int, sketch_a array<long>, n_b int, sketch_b array<long>")
    left = {x.k for x in simhash.sketches_agree(pairs, 0.8).collect()}
    assert {k for k, j in enumerate(truth) if j >= 0.8} <= left and sum(truth[k] < 0.5 for k in left) < 12
    assert [simhash.parity_words(n) for n in (0, 1, 32, 33, 64, 65, 10**6)] == [1, 1, 1, 2, 2, 4, 512]


def test_verified_near_duplicates(make, prose, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 6)
    monkeypatch.setattr(simhash, "VERIFIED_FIRST", 1)
    rows = [(1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "One  two"), (None, prose(200, 0)), (None, prose(200, 0))]
    for k in range(6):
        w = prose(400, k).split()
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join([*w[:200], "changed", *w[201:]])), (10 * k + 2, " ".join(w) + " a tail of words"), (10 * k + 3, " ".join(x + "z" * (j % 7 == 0) for j, x in enumerate(w)))]
    hot = prose(300, 77).split()
    rows += [(2000 + k, " ".join([*hot[:k], f"edit{k}", *hot[k + 1 :]])) for k in range(60)]
    docs = make(rows)
    got = {r.doc_id: r.kept_by for r in simhash.redundant(docs).collect()}
    text = {i: (t or "").encode() for i, t in rows}
    assert all(a < b and simhash.jaccard_of(text[a], text[b], 5) >= 0.8 for b, a in got.items())
    assert set(got) == {1001, 1002, 1004} | {10 * k + j for k in range(6) for j in (1, 2)} | set(range(2001, 2060))
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in got)
    assert simhash.redundant(docs.filter("false")).count() == 0


def test_simhash_links_find_every_close_pair(spark):
    r = np.random.default_rng(3)
    fps = set()
    for base in r.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        x = base
        for _ in range(12):
            fps.add(x)
            x ^= (1 << int(r.integers(64))) ^ ((1 << int(r.integers(64))) if r.random() < 0.7 else 0)
            if r.random() < 0.15:
                x ^= 0b111 << int(r.integers(60))
    hot = int(r.integers(1 << 62))
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    signed = [simhash._signed(x) for x in fps]
    rows = list(zip(range(len(fps)), fps))
    want = brute_components(rows, fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert all(((l.a ^ l.b) & (2**64 - 1)).bit_count() <= 2 for l in links.collect())
    got = {r.node: r.root for r in simhash.components(links).collect()}
    classes = {}
    for x, c in zip(signed, want):
        classes.setdefault(c, set()).add(x)
    for members in classes.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_components_on_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {2000: 1000}
