"""Hierarchies and trees of any size against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import tables
from seamline.operators import cluster, kernels, linkage, tiles, trees


def random_sets(n, width, seed, most=None):
    r = random.Random(seed)
    return [sorted(r.sample(range(width), r.randint(1, most or width))) for _ in range(n)]


def groups(spark, datasets):
    """A table of groups with a dataset's name; numbers have gaps."""
    rows = [(name, 3 * k + 5, s, k % 4 + 1) for name, sets in datasets.items() for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, "family string, group_index long, columns array<int>, member_count long").repartition(5)


def kruskal(sets, metric, core=None):
    d = kernels.distance_matrix(sets, metric)
    if core is not None:
        d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    n = len(sets)
    comp, node, count = list(range(n)), list(range(n)), [k % 4 + 1 for k in range(n)]
    out = []
    for h, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = comp[i], comp[j]
        if a != b:
            out.append((len(out), min(node[a], node[b]), max(node[a], node[b]), round(float(h), 9), count[a] + count[b]))
            node[a], count[a] = n + len(out) - 1, count[a] + count[b]
            comp = [a if c == b else c for c in comp]
    return out


def greedy(sets, metric, method):
    """The nearest pair of clusters at a time, by distance and then by smallest leaves; merges by height, level and leaves."""
    n = len(sets)
    d = kernels.distance_matrix(sets, metric)
    members = [k % 4 + 1 for k in range(n)]
    w = list(members) if method == "average" else [1] * n
    alive, top, level, node, count = list(range(n)), [-1.0] * n, [0] * n, list(range(n)), list(members)
    made = []
    while len(alive) > 1:
        h, i, j = min((round(d[i, j], 12), i, j) for i in alive for j in alive if i < j)
        rank = max([level[x] + 1 if top[x] >= h else 0 for x in (i, j)])
        made.append((h, rank, i, j, node[i], node[j], count[i] + count[j]))
        for k in alive:
            if k not in (i, j):
                d[i, k] = d[k, i] = kernels.UPDATES[method](d[i, k], d[j, k], w[i], w[j])
        w[i], count[i], top[i], level[i], node[i] = w[i] + w[j], count[i] + count[j], h, rank, n + len(made) - 1
        alive.remove(j)
    order = sorted(range(len(made)), key=lambda k: made[k][:4])
    new = {n + k: n + at for at, k in enumerate(order)}
    return [(at, *sorted(new.get(x, x) for x in made[k][4:6]), round(made[k][0], 9), made[k][6]) for at, k in enumerate(order)]


def got(df, name=None):
    if name is not None:
        df = df.filter(F.col("family") == name)
    return sorted((r.merge_index, r.left, r.right, round(r.distance, 9), r["count"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["overlap"])
def test_single_linkage_of_several_datasets(spark, monkeypatch, metric):
    monkeypatch.setattr(tiles, "TILE", 7)
    monkeypatch.setattr(linkage, "BLOCK", 4)
    data = {"a": random_sets(60, 9, 1), "b": random_sets(35, 40, 2, 3), "one": [[1]], "two": [[1], [2]]}
    made = tables.written(linkage.hierarchy(groups(spark, data), metric, "single", ["family"]), "m")
    for name, sets in data.items():
        assert got(made, name) == kruskal(sets, metric)


@pytest.mark.parametrize("method", ["average", "complete"])
def test_mutual_neighbours_give_the_merges_of_one_pair_at_a_time(spark, monkeypatch, method):
    monkeypatch.setattr(tiles, "TILE", 9)
    data = {"a": random_sets(30, 7, 3), "b": random_sets(18, 60, 4), "one": [[1]], "two": [[1], [2]]}
    made = tables.written(linkage.hierarchy(groups(spark, data), "jaccard", method, ["family"]), "m")
    for name, sets in data.items():
        assert got(made, name) == greedy(sets, "jaccard", method)


@pytest.mark.parametrize("method", ["single", "average", "complete", "weighted"])
def test_blocks_give_the_merges_of_the_rounds(spark, monkeypatch, method):
    monkeypatch.setattr(linkage, "STRIP", 16)
    data = {"a": random_sets(70, 7, 3), "b": random_sets(45, 60, 4), "apart": [[k] for k in range(25)], "one": [[1]], "two": [[1], [2]]}
    made = tables.written(linkage.hierarchy(groups(spark, data), "jaccard", method, ["family"], 80), "m")
    for name, sets in data.items():
        assert got(made, name) == (kruskal(sets, "jaccard") if method == "single" else greedy(sets, "jaccard", method))


def test_datasets_beyond_a_block_go_through_the_rounds(spark):
    data = {"small": random_sets(12, 9, 5), "large": random_sets(21, 9, 6)}
    made = tables.written(linkage.hierarchy(groups(spark, data), "jaccard", "complete", ["family"], 20), "m")
    for name, sets in data.items():
        assert got(made, name) == greedy(sets, "jaccard", "complete")


def test_equal_distances_take_no_job_each(spark):
    """A pair a round would be 39 rounds of jobs."""
    g = groups(spark, {"a": [[k] for k in range(40)]})
    spark.sparkContext.setJobGroup("equal-distances", "")
    assert len(cluster.hierarchy(g, "jaccard", "complete", ["family"], dense=0).collect()) == 39
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("equal-distances")
    spark.sparkContext.setJobGroup("", "")
    assert 0 < len(jobs) < 30


def test_forest_of_a_tile_is_kruskals():
    r = random.Random(5)
    edges = sorted((r.randint(0, 3), *sorted(r.sample(range(30), 2))) for _ in range(60))
    comp, want = list(range(33)), []
    for k, (_, i, j) in enumerate(edges):
        if comp[i] != comp[j]:
            want.append(k)
            comp = [comp[i] if c == comp[j] else c for c in comp]
    assert sorted(tiles.forest(np.array([e[1] for e in edges]), np.array([e[2] for e in edges]), 33).tolist()) == want
    assert len(tiles.forest(np.empty(0, np.int64), np.empty(0, np.int64), 3)) == 0


def test_without_ties_they_are_the_merges_of_the_chain(spark):
    for seed in range(99):
        r = random.Random(seed)
        sets = [sorted(r.sample(range(9001), r.randint(900, 6900))) for _ in range(20)]
        d = kernels.distance_matrix(sets, "dice")
        if len(set(d[np.triu_indices(20, 1)].round(12))) == 20 * 19 // 2:
            break
    children, heights, counts = kernels.linkage(d, np.arange(20) % 4 + 1, "average")
    made = got(linkage.hierarchy(groups(spark, {"a": sets}).drop("family").withColumn("family", F.lit("a")), "dice", "average", ["family"]))
    assert [(m[1], m[2], m[4]) for m in made] == [(a, b, c) for (a, b), c in zip(children.tolist(), counts.tolist())]
    assert np.allclose([m[3] for m in made], heights)


def test_a_member_count_must_be_positive(spark):
    with pytest.raises(ValueError):
        linkage.hierarchy(groups(spark, {"a": [[1], [2]]}).withColumn("member_count", F.lit(0).cast("long")), "jaccard", "single", ["family"])


def test_tiles_have_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 5)
    sets = random_sets(33, 12, 8)
    leaves = linkage.leaves_of(groups(spark, {"a": sets}), ["family"])
    want = kernels.distance_matrix(sets, "overlap")
    for most in (0.5, np.inf):
        made = {(r.i, r.j): r.distance for r in tiles.pairs(leaves, ["family"], "overlap", most).collect()}
        assert made == {(i, j): want[i, j] for i in range(33) for j in range(i + 1, 33) if want[i, j] <= most}


@pytest.mark.parametrize("metric", ["jaccard", "overlap"])
def test_buckets_of_columns_give_the_distances_of_the_grid(spark, monkeypatch, metric):
    """Sets around one column of many and such that share hardly any; some sets have all their near ones in another block."""
    monkeypatch.setattr(tiles, "TILE", 7)
    monkeypatch.setattr(tiles, "BUCKET", 4)
    r = random.Random(3)
    sets = [sorted(r.sample(range(k * 9, k * 9 + 14), r.randint(1, 5))) for k in range(12) for _ in range(6)] + [[400, 500 + k] for k in range(9)] + [[900]]
    leaves = tables.written(linkage.leaves_of(groups(spark, {"a": sets, "b": sets[:3]}), ["family"]), "leaves")
    cored = leaves.withColumn("core", (F.col("g") % 4) / 5)
    made = {}
    width = tiles.bucket_width(leaves, ["family"])
    for w in (width, 0):
        monkeypatch.setattr(tiles, "bucket_width", lambda sets, by, w=w: w)
        made[w] = sorted(tiles.core_distances(leaves, ["family"], metric, 9).collect()), sorted(linkage.spanning_tree(cored, ["family"], metric).collect())
    assert width > 0 and made[width] == made[0] and any(x.core == 1 for x in made[0][0])


def test_sets_without_columns_or_with_the_same_ones_have_one_bucket(spark):
    for sets in ([[], [1], [2]], [[1, 2, 3]] * 9):
        assert tiles.bucket_width(linkage.leaves_of(groups(spark, {"a": sets}), ["family"]), ["family"]) == 0


# ---- trees

def random_tree(n, seed, chain=False):
    """Merges of a random tree of n leaves as (left, right); a chain adds one leaf at a time."""
    r = random.Random(seed)
    alive, out = list(range(n)), []
    top = None
    for k in range(n - 1):
        if chain:
            a, b = (alive.pop(), alive.pop()) if top is None else (alive.pop(), top)
            top = n + k
        else:
            a, b = (alive.pop(r.randrange(len(alive))) for _ in range(2))
            alive.append(n + k)
        out.append((min(a, b), max(a, b)))
    return out


def merges_df(spark, pairs):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "merge_index int, left int, right int")


@pytest.mark.parametrize("chain", [False, True])
def test_sums_of_trees(spark, chain):
    n = 90
    pairs = random_tree(n, 4, chain)
    merges = merges_df(spark, pairs)
    parents = trees.parents_of(merges, n)
    sums = {x: {x % 3: 1} for x in range(n)}
    for k, (a, b) in enumerate(pairs):
        sums[n + k] = {c: sums[a].get(c, 0) + sums[b].get(c, 0) for c in {*sums[a], *sums[b]}}
    rows = spark.createDataFrame([(x, x % 3, 1) for x in range(n)], "node long, label int, n long")
    made = {}
    for r in trees.subtree_sums(rows, parents, ("label",)).collect():
        made.setdefault(r.node, {})[r.label] = r.n
    assert made == sums
    size = trees.subtree_sums(rows.select("node", "n"), parents)
    order, stack = [], [2 * n - 2]
    while stack:
        x = stack.pop()
        if x < n:
            order.append(x)
        else:
            stack += [pairs[x - n][1], pairs[x - n][0]]
    places = {r.node: r.place for r in trees.first_places(merges, n, size).collect()}
    assert [x for x in sorted(range(n), key=places.get)] == order
    nodes = spark.range(2 * n - 1).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("depth"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("near"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("far"))
    up = {c: n + k for k, p in enumerate(pairs) for c in p}
    for r in trees.to_root(nodes, parents, ("depth",), ("near",), ("far",)).collect():
        way = [r.node]
        while way[-1] in up:
            way.append(up[way[-1]])
        marked = [x for x in way if x % 7 == 0]
        assert (r.depth, r.near, r.far) == (len(way), marked[0] if marked else None, marked[-1] if marked else None)


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_ways_through_ranges_take_rounds_for_ranges_only(spark, monkeypatch, block):
    monkeypatch.setattr(trees, "BLOCK", block)
    n = 60
    pairs = random_tree(n, 4, True)
    up = {c: n + k for k, p in enumerate(pairs) for c in p}
    nodes = spark.range(2 * n - 1).select(F.col("id").alias("node"), (F.col("id") / 2).alias("half"), F.when(F.col("id") % 7 == 0, F.col("id").cast("string")).alias("near"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("far"))
    out, made = rounds_of(monkeypatch, lambda: trees.to_root(nodes, trees.parents_of(merges_df(spark, pairs), n), ("half",), ("near",), ("far",)))
    for r in out:
        way = [r.node]
        while way[-1] in up:
            way.append(up[way[-1]])
        marked = [str(x) for x in way if x % 7 == 0], [x for x in way if x % 5 == 0]
        assert (r.half, r.near, r.far) == (sum(way) / 2, marked[0][0] if marked[0] else None, marked[1][-1] if marked[1] else None)
    assert len(out) == 2 * n - 1 and made.count("ways") <= (1 if block > n else 5)


def rounds_of(monkeypatch, f):
    made = []
    keep = trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: made.append(name) or keep(df, name))
    out = f().collect()
    return out, made


def test_a_chain_of_ten_thousand_merges_takes_under_twenty_rounds(spark, monkeypatch):
    n = 10_001
    pairs = random_tree(n, 0, chain=True)
    parents = trees.parents_of(merges_df(spark, pairs), n)
    rows = spark.range(n).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("n"))
    out, made = rounds_of(monkeypatch, lambda: trees.subtree_sums(rows, parents))
    assert made.count("subtrees") < 20 and {r.node: r.n for r in out}[2 * n - 2] == n and len(out) == 2 * n - 1


@pytest.mark.parametrize("shape", ["random", "chain"])
def test_best_disjoint_nodes(spark, monkeypatch, shape):
    n = 128
    pairs = random_tree(n, 5, shape == "chain")
    r = random.Random(1)
    score = [float(r.choice([0, 0, 1, 2, 5, 9, 30])) for _ in range(2 * n - 1)]
    best = score[:n]
    for k, (a, b) in enumerate(pairs):
        best.append(max(score[n + k], best[a] + best[b]))
    rows = [(x, *(pairs[x - n] if x >= n else (None, None)), score[x]) for x in range(2 * n - 1)]
    out, made = rounds_of(monkeypatch, lambda: trees.best_disjoint(spark.createDataFrame(rows, "node long, left long, right long, score double")))
    assert [x.best for x in sorted(out)] == best and made.count("pebbles") <= 18


# ---- labels

def same_partition(a, b):
    """Equal but for the names of clusters; -1 is noise."""
    pairs = set(zip(a, b))
    return len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}) and all((x == -1) == (y == -1) for x, y in pairs)


def tree_of(spark, sets, metric, method):
    g = groups(spark, {"a": sets})
    leaves = linkage.leaves_of(g, ["family"])
    made = tables.written(linkage.hierarchy(g, metric, method, ["family"]).drop("family"), "m")
    steps = sorted(made.collect())
    return leaves.drop("family"), made, np.array([[r.left, r.right] for r in steps]), np.array([r.distance for r in steps])


def labels_of(df):
    return [r.label for r in sorted(df.select("g", "label").collect())]


def test_cuts_and_persistence_equal_the_kernels(spark):
    from seamline.operators import cuts

    sets = random_sets(45, 14, 21)
    members = np.arange(45) % 4 + 1
    leaves, merges, children, heights = tree_of(spark, sets, "jaccard", "single")
    for how in ({"threshold": 0.4}, {"threshold": 2.0}, {"threshold": -1.0}, {"clusters": 6}):
        assert labels_of(cuts.cut(merges, 45, **how)) == kernels.cut(children, heights, **how).tolist()
    for least, lifetime, weight, mode in ((3, 0.0, 0.5, "rectangle"), (4, 0.02, 0.3, "integral"), (1000, 0.0, 0.5, "rectangle")):
        want = kernels.cut_by_persistence(children, heights, members, least, lifetime, weight, mode)
        assert labels_of(cuts.persistence(leaves, merges, 45, least, lifetime, weight, mode)) == want.tolist()


def dense_sets(seed, blobs=3, each=22, noise=14):
    """Blobs of different densities far apart, and sets near nothing."""
    r = random.Random(seed)
    out = []
    for b in range(blobs):
        core = list(range(b * 100, b * 100 + 12))
        out += [sorted({*r.sample(core, 12 - b * 2), *(b * 100 + 20 + r.randrange(12) for _ in range(1 + b))}) for _ in range(each)]
    return out + [sorted(r.sample(range(1000, 3000), 9)) for _ in range(noise)]


@pytest.mark.parametrize("least,samples,epsilon", [(8, None, 0.0), (12, 4, 0.5)])
def test_density_equals_the_kernel_on_entries(spark, monkeypatch, least, samples, epsilon):
    from seamline.operators import cuts

    monkeypatch.setattr(tiles, "TILE", 31)
    sets = dense_sets(least)
    times = np.arange(len(sets)) % 4 + 1
    at = np.repeat(np.arange(len(sets)), times)
    want = kernels.hdbscan(kernels.distance_matrix(sets, "jaccard")[np.ix_(at, at)], least, samples, epsilon)
    leaves = linkage.leaves_of(groups(spark, {"a": sets}), ["family"]).drop("family")
    made = labels_of(cuts.density(leaves, "jaccard", least, samples, epsilon))
    assert len(set(want.tolist())) > 2 and -1 in want
    assert same_partition([made[k] for k in at], want.tolist())


def test_density_in_small_blocks_equals_that_in_one_which_takes_few_tables(spark, monkeypatch):
    from seamline.operators import cuts

    sets = dense_sets(8)
    leaves = tables.written(linkage.leaves_of(groups(spark, {"a": sets}), ["family"]).drop("family"), "leaves")
    names = []
    for module in (cuts, linkage, trees):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or tables.written(df, name))
    whole = labels_of(cuts.density(leaves, "jaccard", 8, epsilon=0.5))
    assert 3 < len(names) < 30  # over 60 when every tree was followed by rounds alone
    for module, name, size in ((tiles, "BUCKET", 8), (tiles, "TILE", 31), (linkage, "BLOCK", 64), (linkage, "EDGES", 20), (trees, "BLOCK", 16)):
        monkeypatch.setattr(module, name, size)
    assert labels_of(cuts.density(leaves, "jaccard", 8, epsilon=0.5)) == whole


def test_density_of_one_cluster_and_of_few_points(spark):
    from seamline.operators import cuts

    for sets, least in (([[1, 2, 3], [1, 2, 4], [1, 2, 5], [1, 2, 3, 4], [2, 3, 4]], 3), ([[1], [2]], 50)):
        times = np.arange(len(sets)) % 4 + 1
        at = np.repeat(np.arange(len(sets)), times)
        want = kernels.hdbscan(kernels.distance_matrix(sets, "jaccard")[np.ix_(at, at)], least)
        made = labels_of(cuts.density(linkage.leaves_of(groups(spark, {"a": sets}), ["family"]).drop("family"), "jaccard", least))
        assert same_partition([made[k] for k in at], want.tolist())


@pytest.mark.parametrize("chain,depth", [(False, 3), (True, 12)])
def test_displayed_nodes_equal_the_kernels(spark, chain, depth):
    from seamline.operators import dendrogram

    n, r = 40, random.Random(3)
    pairs = random_tree(n, 11, chain)
    groups_ = spark.range(n).select((F.col("id") * 2 + 1).alias("group_index"))
    merges = spark.createDataFrame([(k, a, b, (k + 1) / n) for k, (a, b) in enumerate(pairs)], "merge_index int, left int, right int, distance double")
    rows = [(2 * g + 1, r.randrange(-1, 3), r.choice(["P", "Q", "", None]), r.randint(1, 4)) for g in range(n) for _ in range(2) if g % 5]
    counts = spark.createDataFrame(rows, "group_index long, cluster_label int, partner_domain string, n long").groupBy("group_index", "cluster_label", "partner_domain").agg(F.sum("n").alias("n"))
    want, made = ({x.node_id: x.asDict() for x in dendrogram.nodes(groups_, merges, counts, depth, 0.5, dense=d).collect()} for d in (100, 0))
    assert set(want) == set(made)
    for k, x in want.items():
        for c, v in x.items():
            assert made[k][c] == pytest.approx(v, abs=1e-9) if isinstance(v, float) else made[k][c] == v, (k, c)
