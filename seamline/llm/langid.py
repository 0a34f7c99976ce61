"""Language identification with a small byte convolutional network, trained here in numpy.

Filters of several widths slide over the bytes of a fixed-length window, each is rectified and max-pooled over
the window, and a softmax layer names the language. A whole text is cut into windows, all of which are
scored in batches; the text's score is the mean of its windows' probabilities, weighted by their bytes.
For inference, taps are fused into tables over byte pairs, so a filter of width 4 costs two look-ups.

Training takes a bounded sample of labelled windows: every window of every whole labelled text may be drawn, by a hash of its text's
id and its place, and each language gets the same number of them: ``windows_a_language``, or less where there are so many languages
that all would be more than ``MAX_WINDOWS``, but at least one. No language is left out. Prediction reads every whole text.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language that sorts
first; rows without a language are not learnt from; with no language to learn from everything is ``und``; repeated
rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, flat_bytes, text_blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bounds of the training sample: labelled windows of a language, and of all languages together.
WINDOWS_A_LANGUAGE = 1600
MAX_WINDOWS = 102_400


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case, and the two-byte capitals U+00C0 to U+00DE likewise."""
    out = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    if len(out) > 1:
        tail = out[1:]
        tail += ((out[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E)) * np.uint8(32)
    return out


def windows_of(data: np.ndarray, offsets: np.ndarray):
    """(windows, owner, size): zero-padded rows of ``WINDOW`` bytes, the text of each and its own bytes."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    out = np.zeros((int(count.sum()), WINDOW), np.uint8)
    flat, at = out.reshape(-1), 0
    for i, n in enumerate(lengths):
        flat[at : at + n] = folded(data[offsets[i] : offsets[i + 1]])
        at += int(count[i]) * WINDOW
    owner = np.repeat(np.arange(len(lengths)), count)
    size = np.full(len(owner), WINDOW)
    last = np.cumsum(count) - 1
    size[last[lengths > 0]] = (lengths - (count - 1) * WINDOW)[lengths > 0]
    return out, owner, size


@dataclass
class ByteCnn:
    """``taps[w][j]`` is the (256, FILTERS) table of byte j under filters of width ``WIDTHS[w]``."""

    languages: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def conv(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, taps in zip(WIDTHS, self.taps):
            n = x.shape[1] - k + 1
            out.append(sum(taps[j][x[:, j : j + n]] for j in range(k)))
        return out

    def pooled(self, x: np.ndarray):
        z = self.conv(x)
        where = [a.argmax(axis=1) for a in z]
        top = np.hstack([np.take_along_axis(a, w[:, None], 1)[:, 0] for a, w in zip(z, where)]) + self.bias
        return np.maximum(top, 0), where

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.dense + self.dense_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fused(self):
        """Tables over byte pairs: for each width, the tables of taps (0, 1) and of taps (2, 3)."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        t2, t3, t4 = self.taps
        return np.hstack([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1])]), np.hstack([pair(t3[2], 0 * t3[2]), pair(t4[2], t4[3])])

    def window_probabilities(self, x: np.ndarray, tables) -> np.ndarray:
        """Softmax of every window; the same numbers as ``softmax(pooled(x))`` up to rounding."""
        first, second = tables
        out = np.empty((len(x), len(self.languages)))
        f = FILTERS
        for i in range(0, len(x), 64):
            w = np.pad(x[i : i + 64], ((0, 0), (0, 1))).astype(np.int32)
            pairs = w[:, :-1] * 256 + w[:, 1:]
            a, b = first[pairs], second[pairs]
            a[:, :-2, f:] += b[:, 2:]
            top = np.hstack([a[:, : WINDOW - 1, :f].max(axis=1), a[:, : WINDOW - 2, f : 2 * f].max(axis=1), a[:, : WINDOW - 3, 2 * f :].max(axis=1)])
            out[i : i + 64] = self.softmax(np.maximum(top + self.bias, 0))
        return out


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 16, rate: float = 0.02, seed: int = 11) -> ByteCnn:
    """Adam on the cross-entropy; the gradient of a max-pooled filter reaches only its best position."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    net = ByteCnn(
        languages,
        [rng.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [*net.taps, net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            rows = order[i : i + 64]
            p, where = net.pooled(x[rows])
            d = net.softmax(p)
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            back = (d @ net.dense.T) * (p > 0)
            grads = []
            for w, k in enumerate(WIDTHS):
                g = np.zeros_like(net.taps[w])
                part = back[:, w * FILTERS : (w + 1) * FILTERS]
                for j in range(k):
                    byte = np.take_along_axis(x[rows], where[w] + j, 1)
                    np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), part)
                grads.append(g)
            grads += [back.sum(axis=0), p.T @ d, d.sum(axis=0)]
            step += 1
            lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= lr * m / (np.sqrt(v) + 1e-8)
    return net


def quota(languages: int, windows_a_language: int = WINDOWS_A_LANGUAGE) -> int:
    """Windows that each language gives to the sample."""
    return max(1, min(windows_a_language, MAX_WINDOWS // max(1, languages)))


def sampled_windows(known: DataFrame, windows_a_language: int = WINDOWS_A_LANGUAGE) -> list[tuple[str, bytes]]:
    """(language, window) of a bounded sample of all windows of ``known`` (doc_id, lang, text), sorted.

    A window is drawn if its hash is among the lowest share that gives its language a fifth more than its quota; what is above the quota
    goes here, highest hashes first. So nothing is sorted or gathered by language on the cluster, and what comes to the
    driver is in proportion to the quota, whatever the input. One number a language is gathered before that.
    """
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW)).cast("int")
    sizes = known.groupBy("lang").agg(F.sum(count).alias("windows")).collect()
    if not sizes:
        return []
    n, top = quota(len(sizes), windows_a_language), 1 << 62
    shares = [(r["lang"], int(min(1.0, (1.2 * n + 16) / r["windows"]) * top)) for r in sizes]
    below = known.sparkSession.createDataFrame(shares, "lang string, below long")
    rank = lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(top))
    some = known.withColumn("count", count).join(F.broadcast(below), "lang")
    some = some.select("lang", "text", "doc_id", F.filter(F.sequence(F.lit(0), F.col("count") - 1), lambda k: rank(k) < F.col("below")).alias("drawn")).filter("size(drawn) > 0")
    data = F.to_binary("text", F.lit("utf-8"))
    window = lambda k: F.struct(rank(k).alias("rank"), F.substring(data, k * WINDOW + 1, F.lit(WINDOW)).alias("w"))
    got = some.select("lang", F.explode(F.transform("drawn", window)).alias("x")).select("lang", "x.rank", "x.w").distinct().collect()
    got = sorted((r["lang"], r["rank"], bytes(r["w"])) for r in got if r["w"])
    out, last, taken = [], None, 0
    for lang, _, w in got:
        last, taken = lang, taken + 1 if lang == last else 1
        if taken <= n:
            out.append((lang, w))
    return out


def fit(docs: DataFrame, lang_col: str = "lang", mod: int = 4, held_out: int = 2, windows_a_language: int = WINDOWS_A_LANGUAGE) -> ByteCnn | None:
    """Train on documents with a language and crc32(doc_id) mod ``mod`` other than ``held_out``; None without any."""
    known = docs.select("doc_id", F.col(lang_col).alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    got = sampled_windows(known.filter(crc_mod("doc_id", mod) != held_out), windows_a_language)
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    x = np.zeros((len(got), WINDOW), np.uint8)
    for k, (_, w) in enumerate(got):
        x[k, : len(w)] = folded(np.frombuffer(w, np.uint8))
    number = {lang: k for k, lang in enumerate(languages)}
    return train(x, np.array([number[lang] for lang, _ in got]), languages)


def predict(docs: DataFrame, net: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        import regex

        letter, model = regex.compile(r"\p{L}"), shared.value
        tables = model.fused() if model else None
        for whole in batches:
            for k in range(0, whole.num_rows, 512):  # a batch may be large; its parts are not
                yield scored(whole.slice(k, 512), model, tables, letter)

    def scored(b, model, tables, letter):
        names, scores = [], []
        data, offsets = flat_bytes(b.column(1))
        for i, j in text_blocks(offsets):
            n = j - i
            if model is None:
                names += ["und"] * n
                scores += [0.0] * n
                continue
            lettered = np.array([bool(t and letter.search(t)) for t in b.column(1).slice(i, n).to_pylist()], bool)
            x, owner, size = windows_of(data, offsets[i : j + 1])
            mean = np.zeros((n, len(model.languages)))
            p = model.window_probabilities(x, tables) * size[:, None]
            for c in range(p.shape[1]):
                mean[:, c] = np.bincount(owner, p[:, c], minlength=n)
            mean /= np.maximum(1, np.diff(offsets[i : j + 1]))[:, None]
            names += [model.languages[c] if ok else "und" for c, ok in zip(mean.argmax(axis=1), lettered)]
            scores += np.where(lettered, np.clip(mean.max(axis=1), 0, 1), 0.0).tolist()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
