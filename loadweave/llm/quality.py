"""Quality rules and a hashed n-gram classifier.

Features are shares of hashed word 1-grams, word 2-grams and byte 4-grams, case kept,
square-rooted: 2**WORD_BITS, 2**WORD_BITS and 2**CHAR_BITS of them. A logistic regression is
trained on a bounded sample of the labelled documents, `per_class` of each class, in one task;
a part of the sample that training doesn't see calibrates the scores to probabilities (Platt).
Scoring runs in Arrow batches over whole texts and needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

WORD_BITS, CHAR_BITS = 11, 12
WIDTH = 2 * (1 << WORD_BITS) + (1 << CHAR_BITS)
PER_CLASS = 1_500
KEEP_AT = 0.5
SYMBOLS = b"#*$%&|<>"
SPACE = b"\t\n\x0b\x0c\r "
M = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hash of a word, remembered; emptied at a bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = (zlib.crc32(word) * 0x9E3779B97F4A7C15 ^ zlib.adler32(word) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
        return h


def features(text: bytes, words: list[bytes], hashes: WordHash) -> np.ndarray:
    """The feature vector of a whole text: three blocks, each of squared length 1 or, if empty, 0."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    blocks = []
    down = np.uint64(64 - WORD_BITS)
    for grams in (h, h[:-1] * M + h[1:]):
        blocks.append(np.bincount((grams * M >> down).astype(np.int64), minlength=1 << WORD_BITS))
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) >= 4:
        g = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)
        blocks.append(np.bincount(g, minlength=1 << CHAR_BITS))
    else:
        blocks.append(np.zeros(1 << CHAR_BITS, np.int64))
    return np.concatenate([np.sqrt(x / max(1, x.sum())) for x in blocks])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> float:
        """Calibrated probability of good quality."""
        z = self.slope * (float(x @ self.weights) + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by accelerated gradient steps. Rows of weight 0 don't count; x is
    used in its own precision, so that it is never copied."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb, pw, pb = w, b, w, b
    step = 1.0
    for k in range(rounds):
        z = np.clip(x @ vw.astype(x.dtype) + vb, -50, 50)
        g = weight * (1 / (1 + np.exp(-z)) - y)
        w, b = vw - step * (g.astype(x.dtype) @ x + l2 * vw), vb - step * g.sum()
        m = k / (k + 3)
        vw, vb, pw, pb = w + m * (w - pw), b + m * (b - pb), w, b
    return w, b


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    hashes = WordHash()
    pdf = pdf.sort_values(["doc_id", "quality"])
    x = np.empty((len(pdf), WIDTH), np.float32)
    for k, t in enumerate(pdf["text"]):
        t = b"" if t is None else t.encode()
        x[k] = features(t, t.split(), hashes)
    y = pdf["quality"].to_numpy(float)
    held = np.array([zlib.crc32(f"cal{i}".encode()) % 4 == 0 for i in pdf["doc_id"]])
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)

    def balanced(rows: np.ndarray) -> np.ndarray:
        """Weights that give both classes half of the total, over the chosen rows only."""
        n = [max(1, int((rows & (y == q)).sum())) for q in (0, 1)]
        return np.where(rows, np.where(y > 0.5, 0.5 / n[1], 0.5 / n[0]), 0.0)

    if len(set(y)) < 2:
        w, b, slope, offset = np.zeros(x.shape[1]), 0.0, 0.0, (20.0 if len(y) == 0 or y[0] > 0 else -20.0)
    else:
        w, b = _logistic(x, y, balanced(~held), 1e-5)
        z = (x @ w.astype(np.float32) + b)[:, None].astype(float)
        scale = max(1e-9, float(np.abs(z).mean()))
        slope, offset = _logistic(z / scale, y, balanced(held if held.any() else ~held), 1e-4)
        slope = float(slope[0]) / scale
    return pd.DataFrame({"weights": [w.astype(float).tolist()], "bias": [float(b)], "slope": [float(slope)], "offset": [float(offset)]})


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on the per_class labelled documents of each class with the lowest id hashes: a bounded,
    documented sample. Rows without id, or with a label other than 0 and 1, are no examples; of rows that repeat an
    id, the least text is the example."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = [marked.where(F.col("quality") == q).orderBy(*order).limit(per_class) for q in (0, 1)]
    sample = chosen[0].union(chosen[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row an id, however often it occurs
    schema = "weights array<double>, bias double, slope double, offset double"
    fitted = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit, schema).collect()
    if not fitted:
        return Model(np.zeros(WIDTH), 0.0, 0.0, 20.0)
    r = fitted[0]
    return Model(np.array(r["weights"]), r["bias"], r["slope"], r["offset"])


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of width words that occur twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    size = 1
    while size < width:  # exact ranks of windows of 2, 4, 8 words
        step = min(size, width - size)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        if size == 1 and rank.max() + 1 == len(rank):
            return 0
        size += step
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, repeated_lines(text), repeated_window_words(words)


def score_quality(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, probability.

    base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. kept: not
    base_failed and a calibrated probability of at least keep_at. Null text is empty and fails the
    base. Null or repeated doc_ids are rows like others; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for text in text_bytes(b.column("text")):
                words = text.split()
                m = measure(text, words)
                failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
                p = model.probability(features(text, words, hashes))
                for column, value in zip(rows, (*m, failed, not failed and p >= keep_at, p)):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows, types))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def document_evidence(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns, p (the classifier's calibrated probability of good quality, classes weighing alike) and
    n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            p, n = [], []
            for text in text_bytes(b.column("text")):
                words = text.split()
                p.append(model.probability(features(text, words, hashes)))
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p, pa.float64()), pa.array(n, pa.int64())], [*keep, "p", "n_words"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, p double, n_words long")
