"""Numpy kernels for what has no relational form: linkage, cuts, density clusters, layouts.

They see one dataset of compressed groups at a time - one row per group, not per pair - and build the distance matrix
themselves by one matrix product. ``MAX_LEAVES`` guards the quadratic memory.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

MAX_LEAVES = 20_000


def common_counts(left: list, right: list) -> np.ndarray:
    """Columns that every left and every right set have in common."""
    def long(sets: list) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), list(map(len, sets))), np.array([c for s in sets for c in s], np.int64)

    (x, p), (y, q) = long(left), long(right)
    names, place = np.unique(np.r_[p, q], return_inverse=True)
    p, q = place[: len(p)], place[len(p) :]
    # Columns that many sets have are a matrix product; the pairs of the others are few and are counted one by one.
    hot = np.bincount(q, minlength=len(names)) > max(1, len(right) // 16)
    at = np.cumsum(hot) - 1

    def indicator(n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((n, max(1, int(hot.sum()))), np.float32)
        held = hot[columns]
        out[rows[held], at[columns[held]]] = 1
        return out

    common = np.rint(indicator(len(left), x, p) @ indicator(len(right), y, q).T).astype(np.float64)
    x_, p_, y_, q_ = x[~hot[p]], p[~hot[p]], y[~hot[q]], q[~hot[q]]
    order = np.argsort(q_, kind="stable")
    y_, q_ = y_[order], q_[order]
    low, high = np.searchsorted(q_, p_), np.searchsorted(q_, p_, side="right")
    times = high - low
    partner = y_[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
    np.add.at(common, (np.repeat(x_, times), partner), 1)
    return common


def cross_distances(left: list, right: list, metric: str) -> np.ndarray:
    """Set distances of every left to every right set; the same formula and bits as the column expressions."""
    return distances_of(common_counts(left, right), left, right, metric)


def distances_of(common: np.ndarray, left: list, right: list, metric: str) -> np.ndarray:
    """Set distances from the counts of common columns."""
    a, b = (np.array(list(map(len, sets)), np.float64) for sets in (left, right))
    a, b = a[:, None], b[None, :]
    if metric == "jaccard":
        top, bottom = common, a + b - common
    elif metric == "overlap":
        top, bottom = common, np.minimum(a, b)
    elif metric == "dice":
        top, bottom = 2 * common, a + b
    else:
        raise ValueError(f"unknown metric {metric!r}")
    d = np.where(bottom > 0, 1.0 - top / np.where(bottom > 0, bottom, 1), 0.0)
    return np.clip(d, 0.0, 1.0)


def distance_matrix(sets: list, metric: str) -> np.ndarray:
    """Square matrix of set distances."""
    if len(sets) > MAX_LEAVES:
        raise ValueError(f"{len(sets)} groups are more than the {MAX_LEAVES} that a dense matrix is made for")
    d = cross_distances(sets, sets, metric)
    np.fill_diagonal(d, 0.0)
    return d


# ---- hierarchies

#: Lance-Williams updates: distance of a merged pair (p, q) to the rest.
UPDATES = {
    "single": lambda p, q, wp, wq: np.minimum(p, q),
    "complete": lambda p, q, wp, wq: np.maximum(p, q),
    "weighted": lambda p, q, wp, wq: (p + q) / 2,
    "average": lambda p, q, wp, wq: (wp * p + wq * q) / (wp + wq),
    "average_deduplicated": lambda p, q, wp, wq: (wp * p + wq * q) / (wp + wq),
}


def linkage(d: np.ndarray, members: np.ndarray, method: str = "average"):
    """(children, heights, counts) of a hierarchy, scipy-like: leaves 0..n-1, merge k makes node n + k.

    ``average`` weighs leaves by their members, ``average_deduplicated`` by one each; counts are always members.
    A chain of nearest neighbours starts at the smallest node; ties go to the smaller node. Merges are then put
    in order of height, each after the merges below it.
    """
    n = len(d)
    members = np.asarray(members, np.int64)
    if (members <= 0).any():
        raise ValueError("member counts must be positive")
    d = d.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    node = np.arange(n)
    active = np.ones(n, bool)
    weight = (members if method == "average" else np.ones(n)).astype(np.float64)
    count = members.copy()
    update = UPDATES[method]
    merges = []
    for k in range(n - 1):
        slots = np.nonzero(active)[0]
        chain = [int(slots[np.argmin(node[slots])])]
        while True:
            row = d[chain[-1]]
            near = row[slots].min()
            ties = slots[row[slots] == near]
            following = int(ties[np.argmin(node[ties])])
            if len(chain) > 1 and following == chain[-2]:
                break
            if len(chain) > 1 and row[chain[-2]] == near and node[chain[-2]] <= node[following]:
                break
            chain.append(following)
        stay, gone = chain[-1], chain[-2]
        height = d[stay, gone]
        merges.append((height, *sorted((int(node[stay]), int(node[gone]))), int(count[stay] + count[gone])))
        active[gone] = False
        others = np.nonzero(active)[0]
        others = others[others != stay]
        new = update(d[stay, others], d[gone, others], weight[stay], weight[gone])
        d[stay, others] = d[others, stay] = new
        d[gone, :] = d[:, gone] = np.inf
        node[stay] = n + k
        weight[stay] += weight[gone]
        count[stay] += count[gone]
    return ordered_merges(n, merges)


def ordered_merges(n: int, merges: list[tuple]):
    """Merges by (height, old place), none before the merges that it joins; nodes renumbered."""
    waiting = [sum(c >= n for c in m[1:3]) for m in merges]
    above: dict[int, int] = {c - n: k for k, m in enumerate(merges) for c in m[1:3] if c >= n}
    heap = [(m[0], k) for k, m in enumerate(merges) if not waiting[k]]
    heapq.heapify(heap)
    new_of = list(range(n)) + [0] * len(merges)
    children, heights, counts = [], [], []
    while heap:
        height, k = heapq.heappop(heap)
        children.append(sorted(new_of[c] for c in merges[k][1:3]))
        heights.append(height)
        counts.append(merges[k][3])
        new_of[n + k] = n + len(children) - 1
        up = above.get(k)
        if up is not None:
            waiting[up] -= 1
            if not waiting[up]:
                heapq.heappush(heap, (merges[up][0], up))
    if len(children) != len(merges):
        raise ValueError("merges depend on each other in a circle")
    return np.array(children, np.int64).reshape(-1, 2), np.array(heights, np.float64), np.array(counts, np.int64)


# ---- cuts

def cut(children: np.ndarray, heights: np.ndarray, clusters: int | None = None, threshold: float | None = None) -> np.ndarray:
    """C4: leaf labels from 0 in order of each cluster's first leaf.

    ``threshold`` takes merges up to the first one above it; ``clusters`` takes all but the last ones.
    """
    n = len(children) + 1
    if clusters is not None:
        take = n - min(max(1, clusters), n)
    elif threshold is not None:
        above = np.nonzero(~(heights <= threshold))[0]
        take = int(above[0]) if len(above) else len(heights)
    else:
        raise ValueError("a cut needs a number of clusters or a threshold")
    top = np.arange(n + take)
    for k in range(take - 1, -1, -1):
        top[children[k]] = top[n + k]
    _, first, inverse = np.unique(top[:n], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]


def cut_by_persistence(children, heights, members, min_size: int, min_lifetime: float, weight: float, mode: str = "rectangle") -> np.ndarray:
    """Leaf labels of the set of disjoint nodes with the largest total of lifetime**a * share**b; -1 outside it.

    ``a = min(1, 2 weight)`` and ``b = min(1, 2 (1 - weight))``. *rectangle* takes a node's own height and size; *integral*
    goes on into its only large child, as far as there is one, and averages the size over the way. Lifetimes below 0, of
    merges under their children, count as 0. Nothing selected means one cluster. All nodes are scored at once from the
    ways that end in them; every way is one addition to its child's.
    """
    children = np.asarray(children, np.int64).reshape(-1, 2)
    n = len(children) + 1
    total, root = 2 * n - 1, 2 * n - 2
    size = np.concatenate([np.asarray(members, np.int64), np.zeros(n - 1, np.int64)])
    low = np.concatenate([np.zeros(n), heights])
    high = np.full(total, np.nan)
    for k, pair in enumerate(children):
        size[n + k] = size[pair].sum()
        high[pair] = low[n + k]
    length = np.where(np.isnan(high), 0.0, np.maximum(0.0, high - low))
    whole = max(1, size[root])
    duration, area = length.copy(), length * size / whole
    if mode == "integral":
        for k, pair in enumerate(children):
            (large,) = np.nonzero(size[pair] >= min_size)
            if len(large) == 1:
                duration[n + k] += duration[pair[large[0]]]
                area[n + k] += area[pair[large[0]]]
        share = np.divide(area, duration, out=np.zeros(total), where=duration > 0)
    else:
        share = size / whole
    a, b = min(1.0, 2 * weight), min(1.0, 2 * (1 - weight))
    raised = lambda x, power: np.ones(total) if power <= 0 else np.where(x > 0, np.maximum(x, 0.0) ** power, 0.0)
    # The root has no lifetime of its own.
    fit = (np.arange(total) != root) & (size >= min_size) & (duration >= min_lifetime)
    score = np.where(fit, raised(duration, a) * raised(share, b), 0.0)
    best, chosen = score.copy(), score > 0
    for k, pair in enumerate(children):
        below = best[pair].sum()
        if not chosen[n + k] or score[n + k] < below:
            chosen[n + k], best[n + k] = False, below
    labels = np.full(n, -1)
    label, stack = 0, [(root, -1)]
    while stack:
        v, own = stack.pop()
        if own < 0 and chosen[v]:
            own, label = label, label + 1
        if v < n:
            labels[v] = own
        else:
            stack += [(int(children[v - n][1]), own), (int(children[v - n][0]), own)]
    return labels if label else np.zeros(n, np.int64)


def drop_small(labels: np.ndarray, members: np.ndarray, least: int) -> np.ndarray:
    """Labels whose clusters have fewer than ``least`` members become noise."""
    sums = np.bincount(labels[labels >= 0], np.asarray(members)[labels >= 0], minlength=1) if (labels >= 0).any() else np.zeros(1)
    return np.where((labels >= 0) & (sums[np.maximum(labels, 0)] < least), -1, labels)


def voted(labels: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each owner 0, 1, ... the label that most of its items have; ties go to a cluster before noise, then to the smaller label."""
    names, place = np.unique(labels, return_inverse=True)
    votes = np.zeros((owner.max() + 1, len(names)), np.int64)
    np.add.at(votes, (owner, place), 1)
    order = np.lexsort((names, names < 0))
    return names[order][votes[:, order].argmax(axis=1)]


def ranked(labels: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Clusters renumbered by size, largest first, ties by the old label; noise stays."""
    labels = np.asarray(labels)
    w = np.ones(len(labels)) if weights is None else np.asarray(weights, float)
    names = np.unique(labels[labels >= 0])
    order = sorted(names.tolist(), key=lambda c: (-w[labels == c].sum(), c))
    rank = {c: k for k, c in enumerate(order)}
    return np.array([rank.get(int(c), -1) for c in labels], np.int64)


# ---- density clusters

def hdbscan(d: np.ndarray, min_size: int = 25, min_samples: int | None = None, epsilon: float = 0.0) -> np.ndarray:
    """Labels by excess of mass on the condensed tree of mutual reachability; a single cluster is allowed.

    Core distances count the point itself as its first neighbour. Selected clusters born below ``epsilon`` are merged
    into the ancestor that reaches it.
    """
    n = len(d)
    if n == 0:
        return np.zeros(0, np.int64)
    k = min(min_samples or min_size, n)
    core = np.sort(d, axis=1)[:, k - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    # Prim's minimum spanning tree, then single linkage by ascending edges.
    inside = np.zeros(n, bool)
    dist, source = np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < dist)
        dist[closer], source[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, dist)))
        edges.append((dist[at], int(source[at]), at))
    top, size, children, heights = list(range(n)), [1] * n, [], []
    owner = list(range(n))

    def find(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    for w, a, b in sorted(edges):
        a, b = find(a), find(b)
        children.append((top[a], top[b]))
        heights.append(w)
        size.append(size[top[a]] + size[top[b]])
        owner[b] = a
        top[a] = n + len(children) - 1
    # Condense: a split counts only if both sides have min_size points.
    up: dict[int, int | None] = {0: None}
    born = {0: 0.0}
    leaves_at: list[tuple[int, int, float]] = []
    splits: dict[int, list[int]] = {0: []}
    stack = [(2 * n - 2, 0)]
    lam = lambda w: 1.0 / w if w > 0 else math.inf

    def points(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += children[x - n]
        return out

    while stack:
        v, cluster = stack.pop()
        if v < n:
            leaves_at.append((v, cluster, born[cluster]))
            continue
        a, b = children[v - n]
        where = lam(heights[v - n])
        big = [c for c in (a, b) if size[c] >= min_size]
        if len(big) == 2:
            for c in big:
                name = len(up)
                up[name], born[name], splits[name] = cluster, where, []
                splits[cluster].append(name)
                stack.append((c, name))
        else:
            for c in (a, b):
                if c in big:
                    stack.append((c, cluster))
                else:
                    leaves_at += [(p, cluster, where) for p in points(c)]
    mass = dict.fromkeys(up, 0.0)
    held = dict.fromkeys(up, 0)
    finite = max([x for _, _, x in leaves_at if math.isfinite(x)] + [x for x in born.values() if math.isfinite(x)] + [1.0])
    cap = lambda x: x if math.isfinite(x) else finite
    for _, c, x in leaves_at:
        mass[c] += cap(x) - cap(born[c])
        held[c] += 1
    for c in sorted(up, reverse=True):
        for child in splits[c]:
            mass[c] += (cap(born[child]) - cap(born[c])) * held[child]
            held[c] += held[child]
    picked, value = {}, {}
    for c in sorted(up, reverse=True):
        below = sum(value[x] for x in splits[c])
        picked[c] = mass[c] >= below
        value[c] = max(mass[c], below)
    chosen, todo = [], [0]
    while todo:
        c = todo.pop()
        if picked[c]:
            chosen.append(c)
        else:
            todo += splits[c]
    if epsilon > 0:
        lifted = set()
        for c in chosen:
            while up[c] is not None and born[c] > 0 and 1.0 / born[c] < epsilon:
                c = up[c]
            lifted.add(c)
        chosen = [c for c in lifted if not any(a in lifted for a in _ancestors(c, up))]
    name = {c: k for k, c in enumerate(sorted(chosen))}
    labels = np.full(n, -1, np.int64)
    least = {c: (1.0 / epsilon if epsilon > 0 else 0.0) for c in chosen}
    only_root = chosen == [0]
    for p, c, x in leaves_at:
        at = c
        while at is not None and at not in name:
            at = up[at]
        if at is None:
            continue
        # Of the root alone, points that leave before the threshold are noise.
        if only_root and c == 0 and x < (least[0] if epsilon > 0 else max(born[s] for s in splits[0]) if splits[0] else 0.0):
            continue
        labels[p] = name[at]
    return labels


def _ancestors(c: int, up: dict) -> list[int]:
    out = []
    while up[c] is not None:
        c = up[c]
        out.append(c)
    return out


# ---- layouts

def unit_ball(x: np.ndarray) -> np.ndarray:
    """Three coordinates, centred, divided by the largest radius if that is above 0."""
    out = np.zeros((len(x), 3))
    out[:, : min(3, x.shape[1])] = x[:, :3]
    if len(out):
        out -= out.mean(axis=0)
        radius = np.sqrt((out**2).sum(axis=1)).max()
        if radius > 0:
            out /= radius
    return out


def pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three principal coordinates and their shares of the variance; the largest loading of each is positive."""
    n = len(x)
    if n < 2:
        return np.zeros((n, 3)), np.zeros(3)
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    coords, power = u * s * sign, s**2
    share = np.zeros(3)
    if power.sum() > 0:
        share[: min(3, len(power))] = (power / power.sum())[:3]
    out = np.zeros((n, 3))
    out[:, : min(3, coords.shape[1])] = coords[:, :3]
    return out, share


def tsne(x: np.ndarray, precomputed: bool, perplexity: float | None = None, rate: float | None = None, steps: int = 1000, early: int = 250, exaggeration: float = 12.0, seed: int = 42) -> tuple[np.ndarray, float]:
    """Exact t-SNE in three dimensions and the perplexity used; automatic is (n - 1) / 3 within 1 and 30."""
    n = len(x)
    if n < 2:
        return np.zeros((n, 3)), 0.0
    perplexity = perplexity or min(30.0, max(1.0, (n - 1) / 3))
    if perplexity >= n:
        raise ValueError("the perplexity must be below the number of points")
    sq = x**2 if precomputed else np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T)
    p = np.zeros((n, n))
    low, high, beta = np.full(n, 0.0), np.full(n, np.inf), np.ones(n)
    off = ~np.eye(n, dtype=bool)
    for _ in range(60):
        e = np.exp(-(sq - np.where(off, sq, np.inf).min(axis=1, keepdims=True)) * beta[:, None]) * off
        p = e / e.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > math.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y = rng.normal(0, 1e-4, (n, 3)) if precomputed else pca(x)[0] / max(1e-12, pca(x)[0][:, 0].std()) * 1e-4
    speed, gains = np.zeros_like(y), np.ones_like(y)
    rate = rate or max(200.0, n / exaggeration)
    for step in range(early + steps):
        q = 1 / (1 + np.maximum(0, (y**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * y @ y.T)) * off
        force = (p * (exaggeration if step < early else 1) - q / q.sum()) * q
        grad = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
        gains = np.maximum(0.01, np.where(np.sign(grad) != np.sign(speed), gains + 0.2, gains * 0.8))
        speed = (0.5 if step < early else 0.8) * speed - rate * gains * grad
        y = y + speed
    return y, perplexity


def farthest_first(d: np.ndarray, order: list, limit: int) -> list[int]:
    """C14: picks that spread out: first the smallest ``order`` key, then the largest (smallest, mean) distance to the
    picks, ties to the smaller key."""
    left = sorted(range(len(d)), key=lambda i: order[i])
    picks = left[:1]
    while len(picks) < min(limit, len(left)):
        rest = [i for i in left if i not in picks]
        near = d[np.ix_(rest, picks)]
        picks.append(max(zip(near.min(axis=1), near.mean(axis=1), range(0, -len(rest), -1), rest))[3])
    return picks


def coverage(d: np.ndarray, picks: list[int], weights: np.ndarray) -> np.ndarray:
    """Weight of the other items nearest to each pick, ties to the earlier pick."""
    rest = np.array([i for i in range(len(d)) if i not in set(picks)], int)
    if not len(rest):
        return np.zeros(len(picks))
    return np.bincount(d[np.ix_(rest, picks)].argmin(axis=1), np.asarray(weights, float)[rest], minlength=len(picks))


def dendrogram(children: np.ndarray, heights: np.ndarray, clusters: list[dict], domains: list[dict], depth: int, threshold: float | None = None):
    """(header, nodes) of the visible tree down to ``depth`` merges.

    ``clusters`` and ``domains`` count members by label at every leaf; leaves without members are not visible. A node with one
    visible child is passed over. Leaves and collapsed nodes share the circle evenly, left to right; a parent stands
    at the mean of its children. Nodes come in post-order. No recursion, so the tree may be as deep as it likes.
    """
    n = len(children) + 1
    total = 2 * n - 1
    by_cluster, by_domain = list(clusters) + [{}] * (n - 1), list(domains) + [{}] * (n - 1)
    member = np.array([sum(c.values()) for c in clusters] + [0] * (n - 1))
    raw, shown = np.ones(total, int), (member > 0).astype(int)
    height = np.concatenate([np.zeros(n), np.where(np.isfinite(heights), heights, 0.0)])
    deep = np.zeros(total, int)

    def added(a: dict, b: dict) -> dict:
        out = dict(a)
        for k, v in b.items():
            out[k] = out.get(k, 0) + v
        return out

    for k, (a, b) in enumerate(children):
        v = n + k
        if a >= v or b >= v:
            raise ValueError("children must come before their parent")
        by_cluster[v], by_domain[v] = added(by_cluster[a], by_cluster[b]), added(by_domain[a], by_domain[b])
        member[v], raw[v], shown[v] = member[a] + member[b], raw[a] + raw[b], shown[a] + shown[b]
        deep[v] = max(deep[a] if shown[a] else 0, deep[b] if shown[b] else 0) + bool(shown[a] and shown[b])
    root = total - 1
    if not shown[root]:
        raise ValueError("no leaf of the hierarchy has a member")
    most = max(1, int(deep[root]))
    depth = max(1, min(depth or 5, most))
    inner = [v for v in range(n, total) if member[v] > 0]
    top = float(height[inner].max()) if inner else 0.0
    far = (lambda h: min(1.0, max(0.0, 1 - h / top))) if top > 0 else None

    def visible_children(v: int) -> list[int]:
        return [int(c) for c in children[v - n] if member[c] > 0] if v >= n else []

    # Post-order over (node, depth, parent), skipping single visible children above the depth limit.
    order, stack = [], [(root, 0, None, False)]
    kids_of: dict[int, list[int]] = {}
    while stack:
        v, at, parent, done = stack.pop()
        kids = visible_children(v)
        while len(kids) == 1 and at < depth:
            v = kids[0]
            kids = visible_children(v)
        if done:
            order.append((v, at, parent))
            continue
        terminal = len(kids) < 2 or at >= depth
        kids_of[v] = []
        stack.append((v, at, parent, True))
        if parent is not None:
            kids_of[parent].append(v)
        if not terminal:
            stack += [(c, at + 1, v, False) for c in reversed(kids)]
    frontier = sum(not kids_of[v] for v, _, _ in order)
    angle: dict[int, float] = {}
    nodes, place = [], 0
    for v, at, parent in order:
        kids = kids_of[v]
        if kids:
            angle[v] = sum(angle[c] for c in kids) / len(kids)
        else:
            angle[v] = 2 * math.pi * (place + 0.5) / frontier
            place += 1
        radius = min(1.0, at / depth)
        reach = far(height[v]) if far else radius
        label = min(by_cluster[v], key=lambda c: (-by_cluster[v][c], c)) if by_cluster[v] else -1
        domain = max(by_domain[v], key=lambda c: (by_domain[v][c], c)) if by_domain[v] else ""
        nodes.append(
            {
                "node_id": v, "parent_id": parent, "depth": at, "angle": angle[v], "radius_depth": radius, "radius_distance": reach,
                "x_depth": math.cos(angle[v]) * radius, "y_depth": math.sin(angle[v]) * radius,
                "x_distance": math.cos(angle[v]) * reach, "y_distance": math.sin(angle[v]) * reach,
                "merge_distance": float(height[v]), "collapsed": v >= n and len(visible_children(v)) >= 2 and at >= depth, "is_leaf": v < n,
                "subtree_leaf_count": int(shown[v]), "raw_subtree_leaf_count": int(raw[v]), "member_count": int(member[v]),
                "cluster_label": int(label), "cluster_purity": by_cluster[v].get(label, 0) / max(1, sum(by_cluster[v].values())),
                "cluster_counts": {str(k): int(x) for k, x in sorted(by_cluster[v].items())},
                "domain_label": domain, "domain_purity": by_domain[v].get(domain, 0) / max(1, sum(by_domain[v].values())),
                "domain_counts": {k: int(x) for k, x in sorted(by_domain[v].items())},
            }
        )
    header = {
        "leaf_count": n, "merge_depth": depth, "max_merge_depth": most, "max_merge_distance": top, "frontier_count": max(1, frontier),
        "cutoff_distance": threshold, "cutoff_radius_distance": None if threshold is None else (min(1.0, max(0.0, 1 - threshold / top)) if top > 0 else 0.0),
    }
    return header, nodes
