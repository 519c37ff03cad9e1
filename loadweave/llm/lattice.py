"""LM scoring with a subword lattice.

Arcs of a word's lattice are the pieces of an existing vocabulary (never trained here). Their weights start
from the vocabulary's scores and are fitted to the distinct training words by ROUNDS rounds of
expectation-maximisation over all segmentations (forward and backward). The marginal over all ways to
cut the word, led by the word mark, into pieces is a forward recursion in log space; characters that
are no piece are spelt in byte pieces. One more arc spans
each whole training word: it has its discounted share (c - D) / N of the training tokens, and the
mass D V / N that discounting frees goes to the piece arcs. So frequent words keep their rate, and
rare and new ones are weighed by all their segmentations. The end symbol is a token of its own. A
document's score is the sum of its words' marginals and the end's; words sum to one or less.

What is gathered is the table of all distinct words, which grows with the corpus. Its most frequent
`head` words go to all tasks; the occurrences of the others meet the table in a join by word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes

MARK = "▁"
HEAD = 300_000
SMOOTH = 0.1
ROUNDS = 2
DISCOUNT = 0.75
FLUSH = 400_000
LN10 = math.log(10.0)


def in_training(doc_id: int | None) -> bool:
    """Training documents: crc32 of the id's text is no multiple of 10. A null id is held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


@lru_cache(2)
def vocabulary(path: str):
    """(processor, piece -> id of the ordinary pieces, byte -> id of the byte pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, single = {}, {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            single[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARK not in piece[1:]:
            ordinary[piece] = i
    return sp, ordinary, single


class Lattice:
    """Marginal log10 probability of a word over all its segmentations."""

    def __init__(self, ordinary: dict[str, int], single: dict[int, int], log_p: np.ndarray):
        self.byte = {b: float(log_p[i]) for b, i in single.items()}
        self.arcs: dict[str, float | None] = {}
        for piece in ordinary:  # prefixes of pieces tell where no longer piece can follow
            for n in range(1, len(piece)):
                self.arcs.setdefault(piece[:n], None)
        self.arcs.update({p: float(log_p[i]) for p, i in ordinary.items()})
        self.weights = {p: math.exp(log_p[i]) for p, i in ordinary.items()}
        self.byte_weights = {b: math.exp(log_p[i]) for b, i in single.items()}
        self.longest = max(map(len, ordinary), default=1)

    def score(self, word: str) -> float:
        s = MARK + word
        n, arcs, exp, log = len(s), self.arcs, math.exp, math.log
        come: list[list[float]] = [[] for _ in range(n + 1)]
        come[0].append(0.0)
        for i in range(n):
            into = come[i]
            if not into:
                continue
            if len(into) == 1:
                here = into[0]
            else:
                top = max(into)
                here = top + log(sum([exp(x - top) for x in into]))
            j = i + 1
            while j <= n:
                p = arcs.get(s[i:j], 0.0)
                if p == 0.0:
                    break
                if p is not None:
                    come[j].append(here + p)
                j += 1
            if arcs.get(s[i]) is None:
                come[i + 1].append(here + sum(self.byte[b] for b in s[i].encode()))
            come[i] = []
        top = max(come[n])
        return (top + log(sum(exp(x - top) for x in come[n]))) / LN10

    def expected(self, word: str, into: dict[str | int, float]) -> None:
        """Adds the expected number of each piece (a byte by its number) over all segmentations of the word: shares of the
        weight that runs through an arc, forward times arc times backward. Plain weights; where few are left
        the forward pass goes on from 1, and the backward pass takes that factor back."""
        s = MARK + word
        n, arcs, weights, byte = len(s), self.arcs, self.weights, self.byte_weights
        come = [0.0] * (n + 1)
        come[0] = 1.0
        factors: dict[int, float] = {}
        arcs_of: list[list[tuple[int, str, float]]] = []
        for i in range(n):
            found: list[tuple[int, str, float]] = []
            arcs_of.append(found)
            here = come[i]
            if here == 0.0:
                continue
            if here < 1e-60:
                factors[i] = here
                reach = slice(i, i + self.longest + 1)  # no piece has brought weight further than this
                come[reach] = [x / here for x in come[reach]]
                here = 1.0
            j = i + 1
            while j <= n:
                piece = s[i:j]
                w = weights.get(piece)
                if w is not None:
                    found.append((j, piece, w))
                    come[j] += here * w
                elif piece not in arcs:
                    break
                j += 1
            if not found or found[0][0] != i + 1:
                w = 1.0
                for b in s[i].encode():
                    w *= byte[b]
                found.append((i + 1, s[i], w))
                come[i + 1] += here * w
        total, get = come[n], into.get
        ahead = [0.0] * n + [1.0]
        for i in range(n - 1, -1, -1):
            here, out = come[i] / total, 0.0
            for j, piece, w in arcs_of[i]:
                w *= ahead[j]
                if factors:
                    for k in range(i + 1, j + 1):
                        w /= factors.get(k, 1.0)
                out += w
                w *= here
                if piece in weights:
                    into[piece] = get(piece, 0.0) + w
                else:
                    for b in piece.encode():
                        into[b] = get(b, 0.0) + w
            ahead[i] = out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, t): occurrences of every distinct word in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def flush():
            words = list(train.keys() | held.keys())
            c = np.fromiter((train[w] for w in words), np.int64, len(words))
            t = c + np.fromiter((held[w] for w in words), np.int64, len(words))
            train.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c), pa.array(t)], ["word", "c", "t"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                (train if in_training(doc_id) else held).update(text.lower().split())
                if len(train) + len(held) > FLUSH:
                    yield flush()
        if train or held:
            yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, c long, t long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def start_log_p(path: str) -> np.ndarray:
    """ln weight of each piece by the vocabulary's scores: those of a unigram vocabulary are log probabilities; those of a
    BPE vocabulary are minus the rank of the merge, which counts as a frequency rank (Zipf's law)."""
    sp, ordinary, single = vocabulary(path)
    usable = np.array(sorted([*ordinary.values(), *single.values()]))
    score = np.array([sp.get_score(int(i)) for i in usable])
    ranks = bool((score == np.round(score)).all())
    w = 1 / (2.7 - score) if ranks else np.exp(score)
    if single:  # a BPE vocabulary scores byte pieces 0: they are for what has no other piece
        w[np.isin(usable, list(single.values()))] = w.min()
    out = np.full(usable[-1] + 1, -np.inf)
    out[usable] = np.log(w / w.sum())
    return out


def fitted_log_p(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """ln weight of each piece after `rounds` of expectation-maximisation on the distinct training words of (word, c), each
    counted once: absolute discounting frees the same mass from each. Expected numbers are smoothed. What
    comes to the driver is as many numbers as the vocabulary has pieces."""
    log_p = start_log_p(path)
    usable = np.flatnonzero(np.isfinite(log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ordinary, single = vocabulary(path)
        lattice, found = Lattice(ordinary, single, log_p), {}
        for b in batches:
            for word in b.column("word").to_pylist():
                lattice.expected(word, found)
        ids = [single[k] if isinstance(k, int) else ordinary[k] for k in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(found.values()), pa.float64())], ["piece", "n"])

    for _ in range(rounds):
        rows = words.where("c > 0").select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(log_p))
        n[rows.column("piece").to_numpy()] = np.round(rows.column("n").to_numpy(), 6)  # sums in any order agree
        log_p = np.full(len(log_p), -np.inf)
        log_p[usable] = np.log((n[usable] + SMOOTH) / (n[usable] + SMOOTH).sum())
    return log_p


def _head_floor(words: DataFrame, head: int) -> float:
    """Least log2(t) step from which at most `head` words are left; at most 512 steps come here."""
    steps = words.groupBy(F.floor(F.log2("t") * 8).alias("b")).count().collect()
    left, floor = head, math.inf
    for row in sorted(steps, key=lambda r: -r["b"]):
        left -= row["count"]
        if left < 0:
            break
        floor = row["b"]
    return floor


def score_documents(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed word unigram) and score (subword lattice), both log10.

    Null text is empty: only the end is scored. A null doc_id is held out. Repeated rows are
    scored, and counted in training, each. Other columns are ignored. Without training documents
    all pieces weigh alike and the end is certain; no rows, no result."""
    spark = docs.sparkSession
    train = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0) & F.col("doc_id").isNotNull()
    ends = docs.where(train).count()
    counted = materialize(word_counts(docs))
    n_words, v_words = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = n_words + ends, v_words + (ends > 0)
    unit = total + SMOOTH * (distinct + 1)
    log_p = fitted_log_p(counted, path)
    free = DISCOUNT * distinct / total if total else 1.0  # the mass of the piece arcs

    def lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ordinary, single = vocabulary(path)
        lattice = Lattice(ordinary, single, log_p)
        for b in batches:
            c = b.column("c").to_numpy()
            base = np.log10((c + SMOOTH) / unit)
            pieces = np.array([lattice.score(w) for w in b.column("word").to_pylist()])
            whole = np.full(len(c), -np.inf)
            whole[c > 0] = np.log10((c[c > 0] - DISCOUNT) / max(total, 1))
            score = np.logaddexp(whole * LN10, (pieces + math.log10(free)) * LN10) / LN10
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), b.column("t"), pa.array(base), pa.array(score)], ["word", "c", "t", "base", "score"])

    words = materialize(counted.mapInArrow(lattices, "word string, c long, t long, base double, score double"))
    floor = _head_floor(words, head)
    top = words.where(F.floor(F.log2("t") * 8) >= floor).toArrow() if floor < math.inf else words.limit(0).toArrow()
    shared = spark.sparkContext.broadcast(
        (top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_numpy() > 0, top.column("base").to_numpy(), top.column("score").to_numpy())
    )
    end_base = math.log10((ends + SMOOTH) / unit)
    end_score = math.log10((ends - DISCOUNT) / total) if ends else 0.0

    fields = {
        "uid": pa.int64(), "doc_id": pa.int64(), "word": pa.string(), "n": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(),
        "b0": pa.float64(), "s0": pa.float64()
    }

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, head_known, head_base, head_score = shared.value
        place = {w: i for i, w in enumerate(head_words)}
        head_known, head_base, head_score = np.append(head_known, False), np.append(head_base, 0.0), np.append(head_score, 0.0)
        last = len(head_words)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, fields.values())], list(fields))

        rows: list[list] = [[] for _ in fields]
        for b in batches:
            for uid, doc_id, text in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                words = text.lower().split()
                at = np.fromiter((place.get(w, last) for w in words), np.int64, len(words))
                # no word holds a space, so this key meets no word in the join and is spread evenly
                values = (
                    uid, doc_id, f" {uid}", 0, len(words) + 1, int(head_known[at].sum()) + (ends > 0),
                    float(head_base[at].sum()) + end_base, float(head_score[at].sum()) + end_score
                )
                for column, value in zip(rows, values):
                    column.append(value)
                rare = Counter(w for w, i in zip(words, at.tolist()) if i == last)
                if rare:
                    for column, value in zip(rows, (uid, None, None, None, 0, 0, 0.0, 0.0)):
                        column.extend([value] * len(rare))
                    rows[2][-len(rare) :] = [w.decode() for w in rare]
                    rows[3][-len(rare) :] = rare.values()
                if len(rows[0]) > 100_000:
                    yield batch(rows)
                    rows = [[] for _ in fields]
        if rows[0]:
            yield batch(rows)

    # a row's number is made once and stays with its id, so scores can't move to another row
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    found = numbered.select("uid", "doc_id", "text").mapInArrow(parts, "uid long, doc_id long, word string, n long, n_tokens long, n_known long, b0 double, s0 double")
    met = found.join(words.select("word", "c", "base", "score"), "word", "left")
    n = F.col("n")
    sums = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, n).otherwise(0)).alias("n_known"),
        F.sum(F.col("b0") + n * F.coalesce("base", F.lit(0.0))).alias("base_score"),
        F.sum(F.col("s0") + n * F.coalesce("score", F.lit(0.0))).alias("score"),
    )
    return sums.select("doc_id", (~train).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
