"""Numpy kernels against plain versions written from the definitions."""

import itertools
import math

import numpy as np
import pytest

from seamline.operators import kernels as k


def random_sets(r, n, columns=14):
    return [sorted(r.choice(columns, r.integers(1, 7), replace=False).tolist()) for _ in range(n)]


def test_distances_of_the_golden_sets():
    d = lambda m: k.distance_matrix([[1, 2, 3], [2, 3, 4], [9], [1, 2]], m)
    assert d("jaccard")[0, 1] == 0.5 and d("jaccard")[0, 3] == pytest.approx(1 / 3) and d("jaccard")[0, 2] == 1
    assert d("overlap")[0, 1] == pytest.approx(1 / 3) and d("overlap")[0, 3] == 0
    assert d("dice")[0, 1] == pytest.approx(1 / 3) and d("dice")[0, 3] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        d("cosine")


def test_distances_are_the_definition():
    r = np.random.default_rng(0)
    sets = random_sets(r, 30)
    for m in ("jaccard", "overlap", "dice"):
        d = k.distance_matrix(sets, m)
        for i, j in itertools.combinations(range(30), 2):
            a, b = set(sets[i]), set(sets[j])
            n = len(a & b)
            want = {"jaccard": 1 - n / len(a | b), "overlap": 1 - n / min(len(a), len(b)), "dice": 1 - 2 * n / (len(a) + len(b))}[m]
            assert d[i, j] == d[j, i] == pytest.approx(want, abs=1e-12)


def test_weighted_average_linkage_golden():
    d = np.array([[0, 0.2, 0.8], [0.2, 0, 0.4], [0.8, 0.4, 0]])
    children, heights, counts = k.linkage(d, [2, 1, 1], "average")
    assert children.tolist() == [[0, 1], [2, 3]] and heights.tolist() == pytest.approx([0.2, 2 / 3]) and counts.tolist() == [3, 4]
    assert k.linkage(d, [2, 1, 1], "average_deduplicated")[1].tolist() == pytest.approx([0.2, 0.6])
    assert k.cut(children, heights, threshold=0.5).tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        k.linkage(d, [1, 0, 1])


def plain_linkage(d, members, method):
    """Merge the closest two clusters, again and again, with distances from all their leaves."""
    n = len(d)
    clusters = {i: [i] for i in range(n)}
    dist = {(i, j): d[i, j] for i, j in itertools.combinations(range(n), 2)}
    weight = {i: float(members[i]) if method == "average" else 1.0 for i in range(n)}
    heights, parts = [], []
    for step in range(n - 1):
        (a, b), h = min(dist.items(), key=lambda x: (x[1], x[0]))
        new = n + step
        for c in clusters:
            if c not in (a, b):
                p, q = dist[tuple(sorted((a, c)))], dist[tuple(sorted((b, c)))]
                dist[(c, new)] = {"single": min(p, q), "complete": max(p, q), "weighted": (p + q) / 2}.get(method, (weight[a] * p + weight[b] * q) / (weight[a] + weight[b]))
        clusters[new] = clusters.pop(a) + clusters.pop(b)
        weight[new] = weight[a] + weight[b]
        dist = {x: v for x, v in dist.items() if a not in x and b not in x}
        heights.append(h)
        parts.append({frozenset(c) for c in clusters.values()})
    return heights, parts


@pytest.mark.parametrize("method", list(k.UPDATES))
def test_linkages_equal_plain_merging(method):
    r = np.random.default_rng(3)
    for n in (2, 5, 17):
        x = r.random((n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        members = r.integers(1, 6, n)
        children, heights, counts = k.linkage(d, members, method)
        want, parts = plain_linkage(d, members, method)
        assert heights.tolist() == pytest.approx(want) and (np.diff(heights) >= 0).all() and counts[-1] == members.sum()
        for m in range(1, n):
            labels = k.cut(children, heights, clusters=m)
            assert {frozenset(np.nonzero(labels == c)[0].tolist()) for c in set(labels)} == (parts[n - m - 1])
        t = float(np.median(heights))
        assert len(set(k.cut(children, heights, threshold=t))) == n - int((heights <= t).sum())


def test_linkage_with_ties_is_a_tree_in_order():
    r = np.random.default_rng(5)
    for _ in range(20):
        sets = random_sets(r, 25, 6)
        children, heights, counts = k.linkage(k.distance_matrix(sets, "overlap"), np.ones(25, int), "average")
        assert sorted(children.ravel().tolist()) == list(range(48)) and (np.diff(heights) >= 0).all() and counts[-1] == 25
        assert all(max(c) < 25 + i for i, c in enumerate(children.tolist()))


def test_cut_edges():
    none = np.zeros((0, 2), int)
    assert k.cut(none, np.zeros(0), clusters=3).tolist() == [0]
    children, heights = np.array([[0, 1], [2, 3]]), np.array([0.5, 0.5])
    assert k.cut(children, heights, threshold=0.5).tolist() == [0, 0, 0] and k.cut(children, heights, clusters=9).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        k.cut(children, heights)


def test_persistence_golden():
    children, heights = np.array([[0, 1], [2, 3]]), np.array([0.1, 0.9])
    labels = k.cut_by_persistence(children, heights, [10, 10, 10], 10, 0.05, 0.5)
    assert labels[0] == labels[1] != labels[2]
    assert k.ranked(labels, [10, 10, 10]).tolist() == [0, 0, 1]
    assert k.cut_by_persistence(children, heights, [1, 1, 1], 10, 0.05, 0.5).tolist() == [0, 0, 0]


@pytest.mark.parametrize("mode", ["rectangle", "integral"])
def test_persistence_selects_the_best_antichain(mode):
    r = np.random.default_rng(7)
    for _ in range(15):
        n = 7
        x = r.random((n, 2))
        children, heights, _ = k.linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), members := r.integers(1, 9, n), "average")
        leaves = [[i] for i in range(n)]
        for a, b in children:
            leaves.append(leaves[a] + leaves[b])
        size = [sum(members[i] for i in x) for x in leaves]
        birth = [0.0] * n + heights.tolist()
        parent = {int(c): n + i for i, row in enumerate(children) for c in row}

        def score(v):
            if v == 2 * n - 2 or size[v] < 4:
                return 0.0
            high = birth[parent[v]]
            if mode == "rectangle":
                life, share = high - birth[v], size[v] / size[-1]
            else:
                life = area = 0.0
                while True:
                    life, area = life + high - birth[v], area + (high - birth[v]) * size[v] / size[-1]
                    big = [int(c) for c in children[v - n] if size[c] >= 4] if v >= n else []
                    if len(big) != 1:
                        break
                    high, v = birth[v], big[0]
                share = area / life if life else 0
            return math.sqrt(0) if life < 0.05 else life**0.6 * share**1.0

        nodes = [v for v in range(2 * n - 2) if score(v) > 0]
        best = 0.0
        for m in range(len(nodes) + 1):
            for pick in itertools.combinations(nodes, m):
                if sum(len(leaves[v]) for v in pick) == len({i for v in pick for i in leaves[v]}):
                    best = max(best, sum(map(score, pick)))
        labels = k.cut_by_persistence(children, heights, members, 4, 0.05, 0.3, mode)
        chosen = [v for v in range(2 * n - 1) for c in set(labels[labels >= 0]) if leaves[v] and set(leaves[v]) == set(np.nonzero(labels == c)[0])]
        got = sum({tuple(sorted(leaves[v])): score(v) for v in chosen}.values())
        assert got == pytest.approx(best) or best == 0


def test_persistence_with_merges_under_their_children():
    # Inverted: the second merge lies below the first. Lifetimes count as 0 there, also where only the size weighs.
    children, heights = np.array([[0, 1], [2, 3]]), np.array([0.5, 0.2])
    for mode, of_size in (("rectangle", [1, 1, 0]), ("integral", [1, 2, 0])):
        assert k.cut_by_persistence(children, heights, [5, 5, 5], 5, 0.0, 0.0, mode).tolist() == of_size
        assert k.cut_by_persistence(children, heights, [5, 5, 5], 5, 0.3, 0.5, mode).tolist() == [0, 1, -1]


def test_votes():
    assert k.voted(np.array([0, 1, 1, -1, 2, -1, 0]), np.array([0, 0, 0, 1, 1, 2, 2])).tolist() == [1, 2, 0]


def test_label_ranking_and_small_clusters():
    assert k.ranked([5, 5, -1, 2, 2, 2, 9]).tolist() == [1, 1, -1, 0, 0, 0, 2]
    assert k.drop_small(np.array([0, 0, 1, -1]), [3, 4, 6, 9], 7).tolist() == [0, 0, -1, -1]


def test_hdbscan_finds_blobs_noise_and_a_single_cluster():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.05, (30, 2)) for c in ((0, 0), (2, 0), (0, 2))] + [[[9, 9]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    labels = k.hdbscan(d, 10)
    assert all(len(set(labels[i : i + 30])) == 1 for i in (0, 30, 60)) and len(set(labels[:90])) == 3 and labels[90] == -1
    order = r.permutation(91)
    again = k.hdbscan(d[np.ix_(order, order)], 10)
    assert {frozenset(order[again == c]) for c in set(again)} == {frozenset(np.nonzero(labels == c)[0]) for c in set(labels)}
    one = k.hdbscan(d[:30, :30], 10)
    assert (one == 0).sum() >= 25
    assert len(set(k.hdbscan(d[:90, :90], 10, epsilon=5.0))) == 1
    assert k.hdbscan(np.zeros((0, 0))).tolist() == [] and set(k.hdbscan(np.zeros((12, 12)), 5)) == {0}


def test_layouts():
    r = np.random.default_rng(2)
    x = r.random((40, 9))
    coords, share = k.pca(x)
    c = x - x.mean(0)
    assert share == pytest.approx(np.sort(np.linalg.eigvalsh(c.T @ c))[::-1][:3] / np.trace(c.T @ c))
    assert (coords**2).sum() == pytest.approx(np.sort(np.linalg.eigvalsh(c.T @ c))[::-1][:3].sum())
    ball = k.unit_ball(coords)
    assert np.linalg.norm(ball, axis=1).max() == pytest.approx(1) and ball.mean(0) == pytest.approx([0, 0, 0])
    assert k.pca(x[:1])[1].tolist() == [0, 0, 0] and k.unit_ball(np.ones((3, 2))).tolist() == np.zeros((3, 3)).tolist()
    blobs = np.concatenate([r.normal(m, 0.1, (20, 5)) for m in (0, 5)])
    y, perplexity = k.tsne(blobs, False, steps=250)
    assert perplexity == pytest.approx(13.0) and np.linalg.norm(y[:20].mean(0) - y[20:].mean(0)) > 2 * y[:20].std()
    with pytest.raises(ValueError):
        k.tsne(blobs, False, perplexity=40)


def test_spread_out_picks_and_coverage():
    d = np.abs(np.subtract.outer([0, 1, 10, 11, 5], [0, 1, 10, 11, 5])).astype(float)
    assert k.farthest_first(d, list("abcde"), 3) == [0, 3, 4]
    assert k.coverage(d, [0, 3, 4], np.array([1, 2, 3, 1, 1])).tolist() == [2, 3, 0]
    assert k.farthest_first(d[:1, :1], ["a"], 9) == [0] and k.coverage(d, [0, 1, 2, 3, 4], np.ones(5)).tolist() == [0] * 5
    same = np.zeros((3, 3))
    assert k.farthest_first(same, ["c", "a", "b"], 2) == [1, 2]


def test_dendrogram_layout():
    children, heights = np.array([[0, 1], [2, 3], [4, 5]]), np.array([0.2, 0.4, 0.8])
    clusters, domains = [{0: 2}, {0: 1}, {1: 3}, {}], [{"P": 2}, {"Q": 1}, {"P": 3}, {}]
    header, nodes = k.dendrogram(children, heights, clusters, domains, 5, 0.4)
    assert header["max_merge_depth"] == header["merge_depth"] == 2 and header["frontier_count"] == 3 and header["cutoff_radius_distance"] == pytest.approx(0.5)
    by = {n["node_id"]: n for n in nodes}
    assert [n["node_id"] for n in nodes] == [0, 1, 4, 2, 6] and 5 not in by  # node 5 has one visible child and is passed over
    assert by[2]["parent_id"] == 6 and by[0]["angle"] == pytest.approx(math.pi / 3) and by[4]["angle"] == pytest.approx(2 * math.pi / 3)
    assert by[6]["angle"] == pytest.approx((by[4]["angle"] + by[2]["angle"]) / 2)
    assert by[6]["cluster_label"] == 0 and by[6]["domain_label"] == "P" and by[6]["cluster_purity"] == 0.5 and by[6]["raw_subtree_leaf_count"] == 4
    assert by[4]["domain_label"] == "P" and by[4]["radius_distance"] == pytest.approx(0.75)
    header, nodes = k.dendrogram(children, heights, clusters, domains, 1)
    assert header["frontier_count"] == 2 and {n["node_id"]: n["collapsed"] for n in nodes} == {4: True, 5: False, 6: False}
    with pytest.raises(ValueError):
        k.dendrogram(children, heights, [{}] * 4, [{}] * 4, 3)
    deep = 3000
    chain = np.array([[0, 1]] + [[i + 1, deep + i - 1] for i in range(1, deep - 1)])
    assert len(k.dendrogram(chain, np.arange(deep - 1) / deep, [{0: 1}] * deep, [{"P": 1}] * deep, 10**6)[1]) == 2 * deep - 1
