"""Near duplicates against brute-force components of exact Jaccard similarity."""

import math

from seamline.llm import simhash


def kept_by_brute_force(rows, words=5, similarity=0.8):
    """(id, text) of the document that stays of each component of similar pairs."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [simhash.shingles(t.encode(), words) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if group[i] != group[j] and (not union or len(sets[i] & sets[j]) >= 0.8 * union):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted((docs[g] for g in set(group)), key=str)


def similar_pairs(texts, words=5):
    """All pairs of places with Jaccard similarity 0.8 or more. Similar sets share one of the first ``n - ceil(0.8 n) + 1`` members in
    any one order; here it is that of the members' hashes."""
    sets = [simhash.shingles(t.encode(), words) for t in texts]
    met, pairs = {}, set()
    for i, own in enumerate(sets):
        order = sorted(own, key=hash)
        for shingle in order[: len(order) - math.ceil(0.8 * len(order) - 1e-9) + 1]:
            for j in met.setdefault(shingle, []):
                if (j, i) not in pairs and 0.8 * len(sets[j]) <= len(own) * 1.0000001 and 0.8 * len(own) <= len(sets[j]) * 1.0000001 and len(own & sets[j]) >= 0.8 * len(own | sets[j]) - 1e-9:
                    pairs.add((j, i))
            met[shingle].append(i)
    return pairs


def test_no_pair_of_a_whole_table_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text IS NOT NULL").dropDuplicates(["text"])
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    pairs = similar_pairs([t for _, t in rows])
    assert len(pairs) > 30
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in sorted(pairs):
        a, b = sorted((top(a), top(b)))
        group[b] = a
    want = {rows[i][0] for i in range(len(rows)) if top(i) != i}
    shared = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.redundant(shared).collect()} == want


def kept(docs):
    return sorted(((r.doc_id, r.text) for r in simhash.keep_representatives(docs).collect()), key=str)


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] += "q"
    return " ".join(words)


def test_pairs_in_crowded_buckets_are_found(make, prose, monkeypatch):
    # 60 texts that share a passage but are unlike each other, each with a copy of its own that is far from the pivots.
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(simhash, "VERIFIED_FIRST", 1)
    line = prose(60, 1)
    rows = []
    for k in range(60):
        text = f"{line} {prose(40, 100 + k)}"
        rows += [(k, text), (100 + k, edited(text, [3, 80]))]
    # Near copies further apart in the order of edits than any one pivot reaches.
    base = prose(200, 7)
    rows += [(300 + k, edited(base, range(k, 200, 40))) for k in range(40)]
    assert kept(make(rows)) == kept_by_brute_force(rows)


def test_covering_tables_propose_close_copies(spark, prose):
    texts = [prose(1500, 40 + k) for k in range(30)]
    texts += [edited(t, [1499]) for t in texts]
    nodes = [(k, simhash.set_fingerprint(simhash._hashes(sorted(simhash.shingles(t.encode(), 5))))) for k, t in enumerate(texts)]
    nodes += [(100 + k, nodes[0][1]) for k in range(3)]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.covered_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()}
    close = {(k, 30 + k) for k in range(30) if ((nodes[k][1] ^ nodes[30 + k][1]) & (2**64 - 1)).bit_count() <= 2}
    assert got >= close | {(0, 100 + k) for k in range(3)} and len(close) >= 20
    fp = dict(nodes)
    assert all(((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 2 for a, b in got)
    assert simhash.set_fingerprint(simhash._hashes([])) == 0


def test_similar_texts_with_distant_fingerprints_are_found(make, prose):
    rows = []
    for k in range(60):
        text = prose(60, 500 + k)
        rows += [(2 * k, text), (2 * k + 1, edited(text, [30]) if k % 2 else text + " " + prose(9, 900 + k))]
    fps = {i: simhash.fingerprint(t.encode(), 2) for i, t in rows}
    assert any((fps[2 * k] ^ fps[2 * k + 1]).bit_count() > 6 for k in range(60))
    assert kept(make(rows)) == kept_by_brute_force(rows) == sorted(((i, t) for i, t in rows if i % 2 == 0), key=str)


def test_members_of_a_fingerprint_class_are_compared_with_each_other(make, prose):
    line, body = " ".join(["one common line"] * 200), prose(150, 3)
    rows = [(1, f"{line} {prose(150, 2)}"), (2, f"{line} {body}"), (3, f"{line} {edited(body, [149])}")]
    assert len({simhash.fingerprint(t.encode(), 2) for _, t in rows}) == 1
    assert [i for i, _ in kept(make(rows))] == [1, 2] and kept(make(rows)) == kept_by_brute_force(rows)


def test_one_document_of_a_chain_stays(make, prose):
    text = prose(200, 4)
    rows = [(1, edited(text, [20, 60])), (2, edited(text, [100, 140, 180])), (3, text)]
    sets = {i: t.encode() for i, t in rows}
    assert simhash.jaccard_of(sets[1], sets[2], 5) < 0.8 <= min(simhash.jaccard_of(sets[k], sets[3], 5) for k in (1, 2))
    assert [i for i, _ in kept(make(rows))] == [1] and kept(make(rows)) == kept_by_brute_force(rows)


def test_null_and_repeated_ids(make, prose):
    a, b, c = prose(80, 5), prose(80, 6), prose(80, 8)
    rows = [(None, a), (None, edited(a, [79])), (4, b), (9, edited(b, [79])), (9, c), (None, edited(c, [79]))]
    got = kept(make(rows))
    assert (4, b) in got and (9, c) in got and len(got) == 3
