"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has bit b set if more than half of its word shingles have bit b set in their
XXH64. Fingerprints within ``radius`` bits are linked. For the search, each bit position gets a vector
of ``radius + 1`` bits (all non-zero vectors in turn), and there is one mask for each non-zero vector v:
the positions whose own vector has an odd inner product with v. Any ``radius`` positions leave
some v orthogonal to them all, so every pair within the radius agrees under that v's mask: no pair is missed.

Inside a bucket no pairs are listed. Each fingerprint names itself and its variants with up to
``radius / 2`` bits flipped outside the mask; two fingerprints within the radius share a
variant, and - as the radius is even - all that share one are within the radius. A variant's fingerprints
are linked to the smallest one, so links stay linear in the bucket, whatever its size.
Components then come from alternating large-star and small-star steps on distinct fingerprints.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other; a
text with fewer words than a shingle is one shingle; equal texts share a fingerprint; repeated rows
give repeated rows; null ids do not count for ``component_id`` unless a class has no other; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, flag_keys, flagged_by, fresh, id_and_text, key_filter, quoted, with_group, written
from .decontaminate import shingles

BITS = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text; works on parts of 65,536 shingles, so memory is bounded."""
    from xxhash import xxh64_intdigest

    split = text.lower().split()
    if not split:
        return 0
    plain = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(split) - words + 1)
    stops = ends[min(words, len(split)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        a, b = starts[k : min(n, k + (1 << 16))].tolist(), stops[k : k + (1 << 16)].tolist()
        h = np.array([xxh64_intdigest(plain[i:j], seed) for i, j in zip(a, b)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, of every whole text."""

    def run(batches):
        for b in batches:
            got = []
            for k in range(0, b.num_rows, 256):
                got += [fingerprint(t, words) for t in b.column(1).slice(k, 256).cast(pa.binary()).to_pylist()]
            fp = np.array(got, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """One mask for each non-zero vector of ``radius + 1`` bits."""
    size = (1 << (radius + 1)) - 1
    own = [i % size + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (own[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) of distinct fingerprints whose closure under reachability is that of all pairs
    within ``radius`` bits; every link itself is such a pair. ``fps`` has distinct ``fp``."""
    if radius % 2:
        raise ValueError("the radius must be even, so that sharing a variant means being within it")
    masks = covering_masks(radius)
    flips = []
    for mask in masks:
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        flips.append([0] + [sum(c) for k in range(1, radius // 2 + 1) for c in combinations(free, k)])
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    keyed = fps.select("fp", table.alias("x")).select("fp", "x.t", "x.key")
    crowded = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    inside = keyed.join(crowded, ["t", "key"], "left_semi")
    by_table = F.array(*[F.array(*[F.lit(_signed(f)) for f in x]) for x in flips])
    named = inside.select("fp", "t", F.explode(F.element_at(by_table, F.col("t") + 1)).alias("flip"))
    named = named.select("fp", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    # At most one fingerprint for each choice of flipped bits shares a variant: a bounded set.
    stars = named.groupBy("t", "variant").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return stars.distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each linked node.

    Alternates large-star (link larger neighbours to the smallest one) and small-star (link smaller
    neighbours and the node to the smallest one), written to the shared folder each round, until the
    links no longer change; neighbourhoods are only ever aggregated to a minimum, never collected.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    before = None
    for _ in range(most_rounds):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("x"), F.col("b").alias("y")).filter("x <> y")
        large = large.distinct()
        # small-star on pairs (y larger, x smaller)
        least = large.groupBy("y").agg(F.min("x").alias("m"))
        small = large.join(least, "y").select(F.explode(F.array("x", "y")).alias("y"), F.col("m").alias("x"))
        old, links = links, written(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        discard(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), fingerprint (16 hex digits) and component_id of every document."""
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(fingerprint_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Shingle buckets of at most so many texts have all their pairs compared at once; larger ones first meet two pivots, and then all pairs that are still apart.
SMALL_BUCKET = 32
#: Candidates of a text that are verified before components are formed for the first time; of the others, all that are still apart follow.
VERIFIED_FIRST = 4
#: Counters of the shingle frequency sketch; it only orders shingles, so its size has no influence on the result.
SKETCH_BITS = 16
#: Words of 64 bits of a parity bitmap.
PARITY = [f"parity{k}" for k in range(4)]
#: Most words of a parity sketch, which grows with the text: at least two bits a shingle below that.
MOST_WORDS = 512
#: Allowance for rounding, in filters and in the comparison itself.
SLACK = 1e-12


def jaccard_of(a: bytes, b: bytes, words: int) -> float:
    """Jaccard similarity of the distinct word shingles of two texts; two blank texts are equal."""
    x, y = shingles(a, words), shingles(b, words)
    return len(x & y) / len(x | y) if x or y else 1.0


def _hashes(found: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s) for s in found], np.uint64)


def shingle_counts(base: DataFrame, words: int) -> np.ndarray:
    """How many texts have a shingle of each slot of hashes: ``2 ** SKETCH_BITS`` numbers, whatever the input."""
    size, shift = 1 << SKETCH_BITS, np.uint64(64 - SKETCH_BITS)

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for t in b.column(0).slice(k, 256).cast(pa.binary()).to_pylist():
                    np.add.at(total, (_hashes(list(shingles(t, words))) >> shift).astype(np.int64), 1)
        (slots,) = np.nonzero(total)
        for k in range(0, len(slots), 1 << 14):
            some = slots[k : k + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    got = base.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts


def set_fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of shingles from their hashes: bit b (as a signed long) is set if it is set in more than half of them."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big"))


def parity_words(shingles_: int) -> int:
    """Words of the parity sketch of a set: a power of two, so that a larger sketch folds onto a smaller one."""
    return min(MOST_WORDS, 1 << (max(1, -(-shingles_ // 32)) - 1).bit_length())


def parity_sketch(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` numbers of 64 bits; every hash flips the bit of its lowest digits, so the sketches of two sets differ in at
    most as many bits as the sets in members."""
    bits = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def prefixes(base: DataFrame, words: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """doc_id, th, ``sig`` (digest of the set of shingles), ``n`` (its size), ``prefix``, a small parity bitmap, a parity sketch and ``fp`` (the set's SimHash) of every text.

    The prefix is the ``n - ceil(similarity * n) + 1`` hashes that come first in one order of all shingles, rare ones first.
    A text that shares none of them misses too many of the text's shingles to be ``similarity`` like it.
    """
    from hashlib import blake2b

    shift = np.uint64(64 - SKETCH_BITS)

    def listed(found: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sigs, sizes, firsts, parities, sketches, fps = [], [], [], [], [], []
                for t in part.column(2).cast(pa.binary()).to_pylist():
                    found = sorted(shingles(t, words))
                    h = _hashes(found)
                    h = h[np.lexsort((h, counts[(h >> shift).astype(np.int64)]))]
                    sigs.append(blake2b(b"\n".join(found), digest_size=16).digest())
                    sizes.append(len(h))
                    parities.append(parity_sketch(h, len(PARITY)))
                    sketches.append(parity_sketch(h, parity_words(len(h))))
                    fps.append(set_fingerprint(h))
                    firsts.append(h[: len(h) - int(np.ceil((similarity - SLACK) * len(h))) + 1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), listed(firsts), *map(pa.array, np.array(parities).T), listed(sketches), pa.array(fps, pa.int64())],
                    names=["doc_id", "th", "sig", "n", "prefix", *PARITY, "sketch", "fp"],
                )

    schema = "doc_id long, th long, sig binary, n int, prefix array<long>, " + ", ".join(f"{c} long" for c in PARITY) + ", sketch array<long>, fp long"
    return base.select("doc_id", "th", "text").mapInArrow(run, schema)


def _most_apart(similarity: float):
    """In how many shingles sets of ``n_a`` and ``n_b`` may differ and be similar, by their sum."""
    s = similarity - SLACK
    return lambda total: total * ((1 - s) / (1 + s)) + 1e-6


def sketches_agree(pairs: DataFrame, similarity: float) -> DataFrame:
    """The rows whose sketches (sketch_a, n_a, sketch_b, n_b) leave room for similar sets: none that are similar are lost.

    Of similar sets one has at most 1.25 times the other's size, so one sketch is at most twice as long and is folded once.
    """
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    a, b = F.col("sketch_a"), F.col("sketch_b")
    a, b = F.when(F.size(a) > F.size(b), folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), folded(b)).otherwise(b)
    differ = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)
    return pairs.filter(F.coalesce(differ <= _most_apart(similarity)(F.col("n_a") + F.col("n_b")), F.lit(True)))


def _could_match(x: str, y: str, similarity: float):
    """False only where sizes or parity bitmaps prove that ``x`` and ``y`` are not similar."""
    s = similarity - SLACK
    differ = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITY)
    sizes = F.least(f"{x}.n", f"{y}.n") >= F.greatest(f"{x}.n", f"{y}.n") * s - 1e-6
    return sizes & (differ <= _most_apart(similarity)(F.col(f"{x}.n") + F.col(f"{y}.n")))


def _meeting(left: DataFrame, right: DataFrame, similarity: float, more) -> DataFrame:
    """(a, b) of the members x of ``left`` and y of ``right`` in one bucket that can be similar, and where ``more`` holds.

    Neither sizes nor parity bitmaps may differ too much, and enough shingles must follow in both prefixes: where two similar texts share their first
    shingle, those before it are in one of them only, so the pair passes there, if not in every bucket that they share.
    """
    s = similarity - SLACK
    could = _could_match("x", "y", similarity) & (
        F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= (F.col("x.n") + F.col("y.n")) * (s / (1 + s)) - 1e-6
    )
    both = left.alias("x").join(right.alias("y"), (F.col("x.h") == F.col("y.h")) & more & could)
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def covered_pairs(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that the covering tables propose, as stars: every node with the first of its own fingerprint, and
    the first ones of linked fingerprints with each other."""
    leads = written(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("m")), "leads")
    own = with_group(nodes.select("node", "fp"), leads.filter("m > 1"), "fp", "m", F.xxhash64("node")).filter("node <> lead")
    lead = lambda side: leads.select(F.col("fp").alias(f"fp_{side}"), F.col("lead").alias(side))
    between = fingerprint_links(leads.select("fp"), radius).toDF("fp_a", "fp_b").join(lead("a"), "fp_a").join(lead("b"), "fp_b")
    out = written(own.select(F.col("lead").alias("a"), F.col("node").alias("b")).unionByName(between.select("a", "b")), "covered")
    discard(leads)
    return out


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose a and b are in different components."""
    named = lambda side: roots.toDF(side, f"root_{side}")
    both = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    return both.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select(*pairs.columns)


def similar_links(nodes: DataFrame, texts_of, words: int, similarity: float) -> DataFrame | None:
    """Links (a, b) of ``nodes`` whose components are those of all pairs that are ``similarity`` alike; every link is such a pair.

    The covering tables of the fingerprints come first: what they propose is verified on the texts and linked. Similar sets may be too many bits
    apart for any table, so an exact search adds what is left between components. There, every similar pair meets in the bucket of a prefix shingle. Small buckets list
    all their pairs; in larger ones each member first meets two pivots, and once components of the links so far are known, every member of
    another component. A large group of copies is one component by then, so its pairs are never listed. Pairs that meet are ruled out by size, place of
    the shingle and parity bitmap, then once a pair by parity sketch, and only the rest by their texts. None if no two nodes meet.
    """

    def plausible(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """(a, b, of, count) of pairs a < b whose sketches leave room; every pair once, without those that are ``known`` or of one component. ``of`` is the one of the two that asks."""
        met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "of").groupBy("a", "b").agg(F.min("of").alias("of"), F.count("*").alias("count"))
        if known is not None:
            met = apart(met.join(known, ["a", "b"], "left_anti"), roots)
        met = written(met, "met")
        named = key_filter(met.select(F.explode(F.array("a", "b")).alias("node")), "node")
        sketches = flagged_by(nodes.select("node", "n", "sketch"), named, "node", "met").filter("met").drop("met")
        both = met.join(sketches.toDF("a", "n_a", "sketch_a"), "a").join(sketches.toDF("b", "n_b", "sketch_b"), "b")
        out = written(sketches_agree(both, similarity).select("a", "b", "of", "count"), "plausible")
        discard(met)
        return out

    def verify(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                left, right = (part.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
                ok = [jaccard_of(x, y, words) >= similarity - SLACK for x, y in zip(left, right)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "asked-now")
        texts = written(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "texts")
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        out = written(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "verified")
        discard(pairs, texts)
        return out

    proposed = covered_pairs(nodes.select("node", "fp"))
    tried = plausible(proposed.withColumn("of", F.col("b")))
    covered = verified(tried.select("a", "b"))
    roots = written(components(covered), "roots")
    discard(proposed)
    crowded = written(nodes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    tokens = nodes.select("node", "n", *PARITY, F.posexplode("prefix").alias("pos", "h"))
    shared = flagged_by(tokens, key_filter(crowded.select("h"), "h"), "h", "again").filter("again").drop("again")
    shared = written(shared.join(crowded, "h"), "shared")
    discard(crowded)
    small, large = shared.filter(F.col("m") <= SMALL_BUCKET), shared.filter(F.col("m") > SMALL_BUCKET)
    near = _meeting(small, small, similarity, F.col("x.node") < F.col("y.node")).withColumn("of", F.col("b"))
    whole, mixed = F.struct("node", "n", *PARITY), F.xxhash64("node", "h")
    pivots = written(large.groupBy("h").agg(F.min_by(whole, mixed).alias("p"), F.max_by(whole, mixed).alias("q")), "pivots")
    stars = large.alias("y").join(pivots, "h").select("y.*", F.explode(F.array("p", "q")).alias("x")).select("x", F.struct("node", "n", *PARITY).alias("y"))
    stars = stars.filter((F.col("x.node") != F.col("y.node")) & _could_match("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("y.node").alias("of"))

    candidates = plausible(near.unionByName(stars), tried.select("a", "b"))
    if candidates.isEmpty() and covered.isEmpty():
        return None
    order = Window.partitionBy("of").orderBy(F.desc("count"), "a", "b")
    asked = written(candidates.withColumn("turn", F.row_number().over(order)), "asked")

    now = asked.filter(F.col("turn") <= VERIFIED_FIRST).select("a", "b")
    links = covered.unionByName(verified(now))
    before, roots = roots, written(components(links), "roots")
    discard(before)
    known = tried.select("a", "b").unionByName(now)
    rest = apart(asked.filter(F.col("turn") > VERIFIED_FIRST).select("a", "b"), roots)
    placed = large.select("node", "n", *PARITY, "pos", "h").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h"), "mixed")
    discard(shared, pivots)
    placed_mixed = placed.join(mixed, "h", "left_semi")
    other = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    others = plausible(_meeting(placed_mixed, placed_mixed, similarity, other).withColumn("of", F.col("b")), known)
    more = verified(rest.unionByName(others.select("a", "b")).distinct())
    out = written(links.unionByName(more), "similar")
    discard(tried, candidates, asked, roots, placed, mixed, others, links, more)
    return out


def redundant(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (the text's hash) and kept_by of the documents that go: all but the smallest id of each group of near duplicates.

    Groups are the components of all pairs of documents whose sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Documents with equal sets are one node of the search, the one with the smallest id and text hash. Rows are
    known by id and text: null ids come after all others, of equal ids the smallest text hash stays, and rows equal in both are one document.
    """
    base = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    rows = written(prefixes(base, words, similarity, shingle_counts(base, words)).withColumn("node", F.monotonically_increasing_id()), "prefixes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "node")
    classes = written(rows.groupBy("sig").agg(F.min(first)["node"].alias("node"), F.count("*").alias("members")), "classes")
    # Most rows are the only one of their set; of the others, all but the first are left out of the search.
    several = rows.select("sig", "node").join(classes.filter("members > 1").select("sig", F.col("node").alias("lead")), "sig").filter("node <> lead")
    several = written(several.select("node"), "several")
    flagged = flagged_by(rows, key_filter(several, "node"), "node", "doubt")
    nodes = flagged.filter("NOT doubt").unionByName(flagged.filter("doubt").join(several, "node", "left_anti")).drop("doubt")

    def texts_of(wanted: DataFrame) -> DataFrame:
        keys = written(rows.select("node", F.col("doc_id").alias("i"), F.col("th").alias("t")).join(wanted, "node"), "wanted")
        some = flag_keys(base, keys.select(F.col("i").alias("doc_id"), F.col("t").alias("th"))).filter("named")
        some = some.join(keys, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
        return some.select("node", "text").dropDuplicates(["node"])

    links = similar_links(nodes.select("node", "n", "prefix", *PARITY, "sketch", "fp"), texts_of, words, similarity)
    rooted = classes.select("sig", "node")
    if links is not None:
        rooted = rooted.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        rooted = rooted.withColumn("root", F.col("node"))
    members = rows.select("doc_id", "th", "sig").distinct().join(rooted.select("sig", "root"), "sig")
    members = written(members.select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th").alias("who")), "members")
    stays = written(members.groupBy("root").agg(F.min("who").alias("first"), F.count("*").alias("m")).filter("m > 1"), "stays")
    gone = with_group(members, stays, "root", "m", F.xxhash64("who")).filter(F.col("first").isNotNull() & ~F.col("who").eqNullSafe(F.col("first")))
    gone = written(gone.select("who.doc_id", "who.th", F.col("first.doc_id").alias("kept_by")), "near-drop")
    discard(rows, classes, several, members, stays)
    return gone


def keep_representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates: the one with the smallest id.

    Only dropped rows are moved: they are named by id and text hash, the rest pass through a key filter of fixed size.
    Rows equal in id and text stay or go together.
    """
    drop = redundant(docs, words, similarity, id_col=id_col, text_col=text_col).select("doc_id", "th")
    cols = [F.col(quoted(c)) for c in docs.columns]
    own_id, own_th, key, named, of_id, of_th = fresh(docs, "own_id", "own_hash", "row_key", "named", "of_id", "of_hash")
    tagged = docs.withColumn(own_id, F.col(quoted(id_col)).cast("long")).withColumn(own_th, F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit(""))))
    tagged = tagged.withColumn(key, F.struct(F.col(own_id).alias("doc_id"), F.col(own_th).alias("th")))
    tagged = flagged_by(tagged, key_filter(drop.select(F.struct("doc_id", "th").alias("k")), "k"), key, named)
    stay = tagged.filter(named).join(drop.toDF(of_id, of_th), F.col(own_id).eqNullSafe(F.col(of_id)) & (F.col(own_th) == F.col(of_th)), "left_anti")
    return tagged.filter(f"NOT {named}").select(*cols).unionByName(stay.select(*cols))
