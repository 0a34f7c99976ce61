"""Suffix dedup, token shards and WARC audits against plain versions."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import common, queries, suffix_dedup, token_shards, warc


# ---- repeated byte strings

def brute_removed(texts, length):
    """Texts' remaining bytes and removed runs by counting every window."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))))
    return out


def check_removed(make, rows, length, gram, hot):
    df = suffix_dedup.removed_spans(make(rows), length, gram, hot)
    got = sorted(((r.doc_id, bytes(r.kept), [(s.start, s.stop) for s in r.spans], r.n_bytes) for r in df.collect()), key=str)
    texts = [(t or "").encode() for _, t in rows]
    want = sorted(((i, k, s, len(t)) for (i, _), t, (k, s) in zip(rows, texts, brute_removed(texts, length))), key=str)
    assert got == want


@pytest.mark.parametrize("hot", [2, 1000])
def test_removed_spans_equal_brute_force(make, prose, hot):
    r = random.Random(5)
    passages = [prose(40, 900 + k) for k in range(4)]
    rows = [(1, None), (2, ""), (3, "é" * 300), (4, "ab" * 400), (5, prose(10, 1)), (6, "x" * 399), (None, passages[0]), (7, "ñ")]
    for k in range(60):
        parts = [prose(r.randint(1, 60), 10 * k + j) for j in range(3)]
        parts.insert(r.randint(0, 3), r.choice(passages))
        if k % 3 == 0:
            parts.insert(r.randint(0, 4), " ".join(r.choice(passages).split()[r.randint(0, 9) :]))
        rows.append((100 + k, " ".join(parts)))
    rows += [(900, rows[20][1]), (20, rows[20][1] + "!"), (901, rows[20][1][5:]), (902, rows[21][1]), (902, rows[21][1])]
    check_removed(make, rows, 100, 32, hot)


def test_removed_spans_at_production_length(make, prose):
    base = prose(400, 77)
    w = base.split()
    edited = [" ".join(x if j % 90 != k else x + "Q" for j, x in enumerate(w)) for k in (10, 11, 50)]
    line = "All rights are reserved by the invented owners of this text. "
    rows = [(1, base), (2, edited[0]), (3, edited[1]), (4, prose(80, 1) + edited[2]), (5, line * 9), (6, line * 7 + "end"), (7, "a" * 900), (8, prose(6000, 5) + base[100:900])]
    check_removed(make, rows, 400, 128, 32)
    assert suffix_dedup.removed_spans(make([])).count() == 0


def test_passages_of_more_than_fifty_words_above_and_below_the_length(spark, make, prose):
    """Passages that two documents share are removed where they have 400 bytes, whatever their words; documents without one are left alone."""
    rows, shared = [], {}
    for k in range(40):
        words = 52 + 2 * k
        passage = prose(words, 5000 + k)
        for j in range(2):
            rows.append((100 + 2 * k + j, f"{prose(90, 10 * k + j)} {passage} {prose(60, 7000 + 2 * k + j)}"))
            shared[100 + 2 * k + j] = len(passage.encode()) + 2  # with the spaces around it
    rows += [(k, prose(200, 9000 + k)) for k in range(40)]
    out = suffix_dedup.removed_spans(make(rows))
    got = {r.doc_id: sum(s.stop - s.start for s in r.spans) for r in out.collect()}
    long, short = [i for i, n in shared.items() if n >= 400], [i for i, n in shared.items() if n < 390]
    assert len(long) > 20 and len(short) > 10
    assert all(got[i] >= shared[i] for i in long) and not any(got[i] for i in short) and not any(got[k] for k in range(40))


def test_long_hot_texts_are_merged_into_few_runs(make, prose):
    # More different segments than a task may sort, all windows of which repeat in a long text of the same passages.
    passage = prose(60, 1)
    rows = [(k, f"{prose(8, 100 + k)} {passage} {prose(8, 300 + k)}") for k in range(40)] + [(900, " ".join(f"{passage} {prose(3, 600 + k)}" for k in range(60)))]
    check_removed(make, rows, 100, 32, 4)


def test_chunks_of_a_long_text_agree_with_the_whole(make, prose, monkeypatch):
    rows = [(1, prose(900, 1) + prose(300, 2)), (2, prose(50, 3) + prose(300, 2)), (3, prose(300, 2)[7:])]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)  # kept by local workers through the function's module only
    check_removed(make, rows, 100, 32, 96)


def test_refinement_equals_grouping():
    r = np.random.default_rng(3)
    for length in (65, 100, 128, 400):
        core = r.integers(97, 99, 700).astype(np.uint8).tobytes()
        parts, spans = [], []
        for _ in range(30):
            a, s = int(r.integers(0, 250)), int(r.integers(0, 40))
            p = bytearray(core[a : a + length + s])
            if r.random() < 0.5:
                p[int(r.integers(len(p)))] ^= 1
            parts.append(bytes(p)), spans.append(s)
        windows = [[p[k : k + length] for k in range(s + 1)] for p, s in zip(parts, spans)]
        flat = [w for x in windows for w in x]
        for got, x in zip(suffix_dedup.refined(parts, spans, length), windows):
            assert got.tolist() == [flat.count(w) > 1 for w in x]


def test_window_minima():
    x = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64)
    for width in (1, 7, 273, 1000):
        assert (suffix_dedup.window_minima(x, width) == [x[i : i + width].min() for i in range(1001 - width)]).all()


# ---- token shards

def test_repair_round_trips_and_keeps_documents_apart():
    r = np.random.default_rng(2)
    for trial in range(20):
        lengths = r.integers(1, 60, 40)
        tokens = r.integers(0, 5 if trial % 2 else 40_000, int(lengths.sum()))
        if trial % 3 == 0:
            tokens = np.tile([1, 1, 2, 1, 1], len(tokens) // 5 + 1)[: len(tokens)]
        seq, per_doc, rules, per_round, base = token_shards.repair(tokens, lengths)
        assert token_shards.expand(seq, rules, per_round, base).tolist() == tokens.tolist()
        assert len(per_doc) == len(lengths) and per_doc.sum() == len(seq)
        at = np.concatenate([[0], np.cumsum(per_doc, dtype=np.int64)])
        for i in range(len(lengths)):
            assert len(token_shards.expand(seq[at[i] : at[i + 1]].copy(), rules, per_round, base)) == lengths[i]
        spans = token_shards.expansion_lengths(rules, per_round, base)
        for k, n in enumerate(spans.tolist()):
            assert len(token_shards.expand(np.array([base + k], np.uint32), rules, per_round, base)) == n
    same = np.tile(np.arange(10), 500)
    assert len(token_shards.repair(same, np.array([5000]))[0]) < 60


def pairs_left(seq, per_doc):
    """How often each pair could still be replaced: occurrences that do not overlap, within documents."""
    counts, at = {}, 0
    for n in per_doc.tolist():
        part, last = seq[at : at + n].tolist(), {}
        for k, pair in enumerate(zip(part, part[1:])):
            if last.get(pair) != k - 1:
                counts[pair], last[pair] = counts.get(pair, 0) + 1, k
        at += n
    return counts


def test_repair_goes_on_until_no_pair_pays():
    r = np.random.default_rng(8)
    for trial in range(12):
        words = [r.integers(0, 30, r.integers(2, 9)) for _ in range(20)]
        docs = [np.concatenate([words[k] for k in r.integers(0, 20, r.integers(1, 80))]) for _ in range(60)]
        docs += [docs[0]] * 30 + [np.zeros(1000, int), np.tile([3, 4], 400)]
        lengths = np.array(list(map(len, docs)))
        seq, per_doc, rules, per_round, base = token_shards.repair(np.concatenate(docs), lengths)
        assert token_shards.expand(seq.copy(), rules, per_round, base).tolist() == np.concatenate(docs).tolist()
        assert max(pairs_left(seq, per_doc).values()) < token_shards.LEAST_COUNT
        assert len({tuple(x) for x in rules.tolist()}) == len(rules) and (per_round > 0).all()


def test_pairs_are_grouped_exactly_whatever_their_size():
    r = np.random.default_rng(1)
    at = np.sort(r.choice(10_000, 3000, replace=False)).astype(np.int32)
    for high in (50, 1 << 60):  # one fits beside the place in 64 bits, the other does not
        pairs = r.integers(0, 20, 3000).astype(np.uint64) * np.uint64(high // 20)
        codes, counts, places = token_shards.grouped(pairs, at, 10_000)
        want = {}
        for p, x in zip(pairs.tolist(), at.tolist()):
            want.setdefault(p, []).append(x)
        assert {c: places[a : a + n].tolist() for c, n, a in zip(codes.tolist(), counts.tolist(), np.cumsum(counts) - counts)} == want


def test_encoder_equals_the_library(prose):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), token_shards.DocumentEncoder(path)
    r = random.Random(4)
    bits = [" ", "  ", "\n", "\t ", " \n", " ", " ", "\x1c", "a", "it's", "Élan", "漢字", "12", "...", "<|endoftext|>", "word", "!!"]
    texts = ["", " ", "  a", "a ", prose(500, 1)] + ["".join(r.choices(bits, k=r.randint(1, 30))) for _ in range(1500)]
    for t in texts:
        assert mine.encode(t) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_of_letters_go_to_the_model_alone():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), token_shards.DocumentEncoder(path)

    class Counting:
        asked = 0

        def __getattr__(self, name):
            self.asked += name == "encode_batch_fast"
            return getattr(library, name)

    mine.tokenizer = Counting()
    letters = [chr(c) for c in range(0x41, 0x2B0) if chr(c).isalpha() and (c < 0x5B or 0x60 < c < 0x7B or c > 0xBF)]
    words = letters + [a + b + "e" for a, b in zip(letters, letters[7:])] + ["x" * 60, "word", "word.", "Wörter", "Wörter?!"]
    text = "first " + " ".join(words)
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert mine.tokenizer.asked == 0


def test_words_around_a_line_end_go_to_the_model_alone():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), token_shards.DocumentEncoder(path)
    asked = []

    class Counting:
        def __getattr__(self, name):
            if name in ("encode", "encode_batch_fast"):
                asked.append(name)
            return getattr(library, name)

    mine.tokenizer = Counting()
    ends = ["\n", ".\n", "?!\n", "'\n", "</>|\n"]
    text = "first " + " ".join(f"a{'b' * k}{end}{w}{tail}" for k in range(50) for end in ends for w in ("Next", "s", "Über") for tail in ("", ".", "'s", ",\n2"))
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(asked) <= 1 + len(ends) + 4 and "encode_batch_fast" not in asked
    # What does not come apart so is left to the library.
    r = random.Random(5)
    bits = ["\n", "\n\n", "\r\n", "\t", ".", "'", "'s", "<|endoftext|>", "<|", "endoftext", "|>", "Word", "é", "漢", "7", "\u0301", "\xa0", " "]
    for _ in range(3000):
        t = "x " + "".join(r.choices(bits, k=r.randint(2, 12)))
        assert mine.encode(t) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_forgets_and_stays_right(prose, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), token_shards.DocumentEncoder(path)
    monkeypatch.setattr(token_shards, "MEMORY_PARTS", 60)
    monkeypatch.setattr(token_shards, "MEMORY_CHARS", 6)
    for k in range(40):
        text = f"{prose(30, k)} w{k}, {'long' * 5}{k} 漢字{k} é{'a' * k}"
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert list(mine.known.values()) == list(range(len(mine.known))) and len(mine.starts) == len(mine.known) + 1 and len(mine.flat) == mine.starts[-1]
        assert all(len(p) <= 6 for p in mine.known)


def test_shards_hold_documents_in_order(spark, make, prose, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(k * 7 % 101, prose(30 + k, k)) for k in range(101)] + [(None, "n"), (200, None), (201, ""), (5, "again"), (202, prose(20_000, 3))]
    uri = str(tmp_path / "shards")
    manifest = token_shards.write_shards(make(rows), path, 2, uri, shard_tokens=2000)
    want, start = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(token_shards.read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=key)]
    left = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        left.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == start
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert not any(left.values()) and not want
    files, folder = token_shards.open_fs(uri)
    assert not [f for f in os.listdir(uri) if "." in f]
    one = manifest.orderBy("task").first()
    assert one["shards"] > 1 and len(os.listdir(uri)) == sum(r["shards"] for r in manifest.collect())
    for k in range(one["shards"]):
        reader = token_shards.ShardReader(files.open_input_file(f"{folder}/{token_shards.shard_name(one['task'], k)}"))
        for i, (_, tokens) in enumerate(reader.documents()):
            n = len(tokens)
            assert reader.tokens(i).tolist() == tokens.tolist()
            for x, y in ((0, 1), (n // 3, n // 2 + 1), (n - 1, n), (n // 2, n + 9), (2, 2)):
                assert reader.tokens(i, x, y).tolist() == tokens[x:y].tolist()
    empty = token_shards.write_shards(make([]), path, 2, str(tmp_path / "none"))
    assert token_shards.read_shards(empty).count() == 0


# ---- WARC

@pytest.fixture
def pages(spark):
    rows = [(k, f"http://x.example/{k}", f"<p>{k} é " + "w " * k) for k in range(60)] + [(7, None, None), (None, "u", ""), (7, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("leaf", F.lit(1)).repartition(3)


def test_warc_records_read_back(spark, pages, tmp_path):
    uris = [str(tmp_path / "a"), str(tmp_path / "b")]
    index = warc.write_replicas(pages, uris)
    for uri in uris:
        got = sorted((tuple(r) for r in warc.read_records(index, uri).collect()), key=str)
        assert got == sorted(((r.page_id, r.url, r.html or "") for r in pages.collect()), key=str)
    assert warc.damaged_records(index, uris).count() == 0
    by_shard = {}
    for r in index.collect():
        by_shard.setdefault(r.shard, []).append(r)
    for shard, rows in by_shard.items():
        data = open(f"{uris[0]}/{shard:06d}.warc.gz", "rb").read()
        assert sum(r.length for r in rows) == len(data)
        assert all(hashlib.sha256(data[r.offset : r.offset + r.length]).hexdigest() == r.sha256 for r in rows)
    empty = warc.write_replicas(pages.filter("false"), uris)
    assert warc.fixity_report(empty, uris, warc.damaged_records(empty, uris)).count() == 0


def test_audit_locates_damage(spark, pages, tmp_path):
    uris = [str(tmp_path / "a"), str(tmp_path / "b")]
    index = warc.write_replicas(pages, uris)
    rows = sorted(index.collect(), key=lambda r: (r.shard, r.record))
    path = lambda u, r: f"{u}/{r.shard:06d}.warc.gz"
    flip = rows[5]
    with open(path(uris[0], flip), "r+b") as f:
        f.seek(flip.offset + flip.length // 2)
        b = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([b[0] ^ 1]))
    last = max((r for r in rows if r.shard == rows[-1].shard), key=lambda r: r.record)
    os.truncate(path(uris[1], last), last.offset + 3)
    gone = [r for r in rows if r.shard == rows[len(rows) // 2].shard and r.shard not in (flip.shard, last.shard)]
    if gone:
        os.remove(path(uris[1], gone[0]))
    with open(path(uris[0], last), "ab") as f:
        f.write(b"more")
    want = {(uris[0], flip.shard, flip.record), (uris[1], last.shard, last.record)} | {(uris[1], r.shard, r.record) for r in gone}
    damaged = warc.damaged_records(index, uris)
    assert {(r.side, r.shard, r.record) for r in damaged.filter("record IS NOT NULL").collect()} == want
    end = last.offset + last.length
    assert [(r.side, r.shard, r.page_id, r.offset, r.length) for r in damaged.filter("record IS NULL").collect()] == [(uris[0], last.shard, None, end, 4)]
    report = warc.fixity_report(index, uris, damaged)
    assert report.count() == 63 and report.filter("replicas_whole < 2").count() == len({w[1:] for w in want})


def test_the_same_damage_in_all_replicas_is_found(spark, pages, tmp_path):
    uris = [str(tmp_path / x) for x in "abc"]
    index = warc.write_replicas(pages, uris)
    r = index.orderBy("shard", "record").collect()[3]
    for u in uris[:2]:
        with open(f"{u}/{r.shard:06d}.warc.gz", "r+b") as f:
            f.seek(r.offset + 20)
            f.write(b"zzz")
    assert {(x.side, x.shard, x.record) for x in warc.damaged_records(index, uris).collect()} == {(u, r.shard, r.record) for u in uris[:2]}


def test_descent_visits_only_ways_to_damage(spark, tmp_path):
    uris = [str(tmp_path / x) for x in "ab"]
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("w").alias("html")).coalesce(1)
    index = warc.write_replicas(pages, uris, fault=lambda side, page: side == 1 and page in (3, 4, 400))
    trees = warc.build_trees(index, uris)
    steps = [sorted((r.level, r.pos) for r in s.collect()) for s in warc.differing_nodes(trees)]
    assert steps == [sorted({(level, k >> level) for k in (3, 4, 400)}) for level in range(9, -1, -1)]
    assert [len(s.collect()) for s in warc.differing_nodes(warc.build_trees(index, uris[:1]))] == [0]


def test_whole_records_come_from_whole_replicas(spark, pages, tmp_path):
    uris = [str(tmp_path / x) for x in "ab"]
    index = warc.write_replicas(pages, uris, fault=lambda side, page: page == 9 or (page is None or page % 10 == side))
    os.remove(f"{uris[1]}/{index.filter('page_id = 30').first().shard:06d}.warc.gz")
    report = warc.fixity_report(index, uris, warc.damaged_records(index, uris))
    gone = {r.page_id for r in index.filter(F.col("shard") == index.filter("page_id = 30").first().shard).collect()}
    want = []
    for r in pages.filter("page_id IS NULL OR page_id <> 7").collect():  # the three pages 7 may lie in several files
        k = r.page_id
        bad = [side for side in (0, 1) if k == 9 or k is None or k % 10 == side or (side == 1 and k in gone)]
        want.append((k, None if len(bad) == 2 else r.html or "", 2 - len(bad), bad))
    rows = warc.whole_records(report, uris).collect()
    got = [tuple(r) for r in rows if r.page_id != 7]
    assert len(rows) == 63 and all(r.replicas_whole == 2 - len(r.damaged_in) and r.html is not None for r in rows if r.page_id == 7)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_tree_shape():
    h = lambda *x: hashlib.sha256(b"".join(x)).digest()
    a, b, c = (h(b"\0", x) for x in (b"a", b"b", b"c"))
    assert warc.tree_levels([a, b, c]) == [[a, b, c], [h(b"\1", a, b), c], [h(b"\1", h(b"\1", a, b), c)]]
    assert warc.tree_levels([a]) == [[a]]


# ---- the key filter

def test_key_filter_never_loses_a_key(spark):
    keys = spark.range(0, 5000, 3).withColumnRenamed("id", "k")
    out = common.flagged_by(spark.range(5000).withColumnRenamed("id", "k"), common.key_filter(keys, "k"), "k", "hit")
    assert out.filter("k % 3 = 0 AND NOT hit").count() == 0 and out.filter("k % 3 > 0 AND hit").count() < 20
