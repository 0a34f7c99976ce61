"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms are trigrams of byte classes (letter case, digits, punctuation marks, white space, bytes above 127), which show
the shape of a text in any language, and the shares of words and lines that repeat the one before. Term
frequencies are square-rooted and weighted by inverse document frequency; a truncated SVD of
the labelled sample gives the latent space. The labelled vectors are broadcast - at most
``max_labelled`` of them, a fixed bound - and every document's cosine with each of them is computed
exactly, in blocks of one matrix product. The score is the similarity-weighted mean of the ``neighbours`` nearest labels.

Fitting uses a bounded sample of the labelled rows, chosen by a hash of the id; scoring reads every whole text.

Edge cases: null, empty and term-free texts have no direction and get the sample's mean label; labelled
vectors as near as the last neighbour all vote; repeated rows give repeated rows; null labels and labelled ids
without a text are not learnt from; without any labelled row every score is 0.5; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, flat_bytes, id_and_text

#: Most labelled rows that are learnt from and broadcast.
MAX_LABELLED = 4096
NEIGHBOURS = 32
DIMENSIONS = 48
#: Similarities are raised to this power, itself a power of two, before they weigh a vote.
SHARPNESS = 8

_MARKS = b"!?.,;:'\"#$%&*@|<>()[]{}=+-_/\\~^`"
CLASSES = 8 + len(_MARKS)
TERMS = CLASSES**3
SHAPES = 4


def _classes() -> np.ndarray:
    out = np.full(256, 7, np.int32)  # other control bytes
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[9, 11, 12, 13, 32]] = 3
    out[10] = 4
    out[128:192] = 5  # continuation bytes
    out[192:] = 6
    for k, mark in enumerate(_MARKS):
        out[mark] = 8 + k
    return out


_CLASS = _classes()


def _repeats(text: bytes) -> tuple[float, float]:
    """Shares of words and of lines that are equal to the one before."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    same = lambda x: sum(map(bytes.__eq__, x, x[1:])) / max(1, len(x) - 1)
    return same(words), same(lines)


def term_matrix(column: pa.Array, vocabulary: np.ndarray | None = None):
    """Rows of square-rooted term shares. ``vocabulary`` maps a trigram code to its column, or to the
    last one for codes outside it; without one, the (row, code, count) triples are returned."""
    data, offsets = flat_bytes(column)
    n = len(offsets) - 1
    shapes = np.zeros((n, SHAPES), np.float32)
    width = None if vocabulary is None else int(vocabulary.max()) + 1
    dense = None if vocabulary is None else np.zeros((n, width), np.float32)
    triples = []
    for i in range(n):
        text = data[offsets[i] : offsets[i + 1]]
        if len(text) < 3:
            continue
        counts = np.zeros(TERMS if vocabulary is None else width, np.int64)
        for k in range(0, len(text) - 2, 1 << 20):
            c = _CLASS[text[k : k + (1 << 20) + 2]]
            code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            counts += np.bincount(code if vocabulary is None else vocabulary[code], minlength=len(counts))
        if vocabulary is None:
            (codes,) = np.nonzero(counts)
            triples.append((np.full(len(codes), i), codes, counts[codes]))
        else:
            dense[i] = np.sqrt(counts / (len(text) - 2))
        w, line = _repeats(text.tobytes())
        shapes[i] = np.sqrt([w, 1 - w, line, 1 - line])
    return (triples if vocabulary is None else dense), shapes


def votes_of(similarity: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The weight of every labelled vector's vote: its similarity, sharpened, for the nearest ``neighbours`` and all that are as near
    as the last of them; 0 for the others, and for those that point away."""
    s = np.maximum(similarity, 0).astype(np.float64)
    if neighbours < s.shape[1]:
        last = np.partition(similarity, -neighbours, axis=1)[:, -neighbours]
        s[similarity < last[:, None]] = 0
    for _ in range(SHARPNESS.bit_length() - 1):
        s *= s
    return s


@dataclass
class QualityModel:
    """What is broadcast: at most ``MAX_LABELLED`` rows of ``DIMENSIONS`` numbers, and the projection onto them."""

    vocabulary: np.ndarray
    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, column: pa.Array) -> np.ndarray:
        dense, shapes = term_matrix(column, self.vocabulary)
        z = (np.hstack([dense, shapes]) * self.weights) @ self.projection
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-9)

    def score(self, column: pa.Array) -> np.ndarray:
        """Exact cosines with every labelled vector, in blocks of texts."""
        n = len(column)
        out = np.full(n, self.prior)
        if not len(self.labels):
            return out
        for i in range(0, n, 256):
            z = self.project(column.slice(i, 256))
            w = votes_of(z @ self.vectors.T)
            total = w.sum(axis=1)
            votes = w @ self.labels
            ok = (np.abs(z).sum(axis=1) > 0) & (total > 0)
            out[i : i + len(z)][ok] = np.clip(votes[ok] / total[ok], 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out_of: int = 5, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """A model of at most ``max_labelled`` labelled documents with crc32(doc_id) mod ``held_out_of`` not 0.

    Rows are taken by the order of a hash of the id, so the choice is the same on every run.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", held_out_of) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def count(batches):
        for b in batches:
            triples, shapes = term_matrix(b.column(2))
            at = {int(r[0]): (c.tolist(), m.tolist()) for r, c, m in triples if len(r)}
            rows = [at.get(i, ([], [])) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array(shapes.tolist(), pa.list_(pa.float32()))],
                names=["doc_id", "y", "codes", "counts", "shapes"],
            )

    counted = texts.mapInArrow(count, "doc_id long, y int, codes array<int>, counts array<long>, shapes array<float>")
    # One text for each labelled id, whatever the number of its rows: the collected rows stay bounded.
    one = counted.groupBy("doc_id").agg(F.min(F.struct("codes", "counts", "shapes", "y")).alias("r")).select("doc_id", "r.*")
    rows = sorted(one.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.float64)
    if not rows:
        return QualityModel(np.zeros(TERMS, np.int32), np.zeros(1 + SHAPES, np.float32), np.zeros((1 + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    used = np.unique(np.concatenate([np.array(r["codes"], np.int32) for r in rows]))
    vocabulary = np.full(TERMS, len(used), np.int32)
    vocabulary[used] = np.arange(len(used))
    x = np.zeros((len(rows), len(used) + 1 + SHAPES), np.float32)
    for i, r in enumerate(rows):
        if r["counts"]:
            x[i, vocabulary[r["codes"]]] = np.sqrt(np.array(r["counts"]) / sum(r["counts"]))
        x[i, len(used) + 1 :] = r["shapes"]
    seen = (x > 0).sum(axis=0)
    weights = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    x *= weights
    # Randomised truncated SVD with a fixed seed: right singular vectors span the latent space.
    d = min(DIMENSIONS, *x.shape)
    q = x.T @ (x @ np.random.default_rng(7).standard_normal((x.shape[1], min(d + 8, *x.shape))).astype(np.float32))
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ vt.T[:, :d]).astype(np.float32)
    z = x @ projection
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    vectors = np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-9)
    return QualityModel(vocabulary, weights, projection, vectors, y, float(y.mean()))


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= ``threshold``) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that the model scores below ``threshold``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
