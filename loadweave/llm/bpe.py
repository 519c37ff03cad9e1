"""Byte-level BPE by monoid tree reduction.

A node of the tree holds the tokens of a span. Two levels use the same rule, "encode halves,
join neighbours over a growing boundary window":

* a text is cut in halves until a leaf is short; the join matches the split pattern again from the
  last match that the cut can't have changed until a match ends where one of the right half begins;
* a match longer than a leaf is cut in halves too; the join encodes the last k and first k tokens
  again, doubling k, until both outer borders are stable.

A border is stable if the two tokens that meet there, encoded together, come out as themselves: a
token sequence is the encoding of its bytes if and only if each neighbouring pair is.
Decoding joins the bytes of halves up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

LEAF_CHARS = 1 << 16
LEAF_BYTES = 32
CACHED = 250_000


class PieceIds(dict):
    """Ids of a match, computed once; emptied when it holds CACHED matches."""

    def __init__(self, coder: "Coder"):
        self.coder = coder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        self[piece] = ids = self.coder.encode_match(piece.encode())
        return ids


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.none = len(self.bytes_of)
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = max(8, leaf_chars), max(2, leaf_bytes)
        self.stable = lru_cache(1 << 15)(self._stable)
        self.pieces = PieceIds(self)

    # --- one match ---------------------------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank and then leftmost first."""
        if len(data) > 96:
            return self.merge_long(data)
        get, none = self.ranks.get, self.none
        at = list(range(len(data) + 1))
        pair = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pair and (low := min(pair)) != none:
            i = pair.index(low)
            del at[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(data[at[i] : at[i + 2]], none)
            if i:
                pair[i - 1] = get(data[at[i - 1] : at[i + 1]], none)
        return [self.ranks[data[a:b]] for a, b in zip(at, at[1:])]

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over linked tokens, for windows that grew long."""
        n, get = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, mid, stop = heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue  # one of the two tokens has been merged since
            end[i], end[mid] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, stop, end[stop]))
            if i and (r := get(data[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(self.bytes_of[t] for t in chain(left[a:], right[:b])))
            if (not a or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def encode_span(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_span(data[:half]), self.encode_span(data[half:]))

    def encode_match(self, data: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else tuple(self.encode_span(data))

    # --- a text ------------------------------------------------------------------------------
    def matches(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.pattern.findall(text)
        cut = len(text) // 2
        left, right = self.matches(text[:cut]), self.matches(text[cut:])
        # A match reads at most two characters beyond its end, so those that end by cut - 2 stand.
        end = cut
        while left and end > cut - 2:
            end -= len(left.pop())
        start, i = cut, 0
        for m in self.pattern.finditer(text, pos=end):
            left.append(m[0])
            while start < m.end() and i < len(right):
                start += len(right[i])
                i += 1
            if start == m.end():
                break
        left.extend(right[i:])
        return left

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.matches(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file, once a worker."""
    with open(path, "rb") as f:
        return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_tokens, ids_sha256, decoded_sha256, and
    with keep_ids the ids themselves. Null text is empty and has no tokens. Rows with a null or
    repeated doc_id are rows like others; other columns are ignored. Needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        sha, digits = hashlib.sha256, c.digits
        for b in batches:
            n, ids_sha, out_sha, kept = [], [], [], []
            for text in b.column("text").to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(sha(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text): bytes that are no UTF-8 become U+FFFD; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            texts = [None if ids is None else c.decode(ids).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(length) of every row's text in tokens, without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            n = [sum(map(len, map(c.pieces.__getitem__, c.matches(x or "")))) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])

    return docs.select("text").mapInArrow(run, "length long")


def length_histogram(lengths: DataFrame, block: int = 512) -> DataFrame:
    """Exact histogram of (length) with its suffix sums, one row per length that occurs:

    length, n_docs, n_tokens (theirs), docs_from / tokens_from (of all with at least this length),
    docs_to (of all with at most this length), docs_total, tokens_total, tokens_truncated (tokens
    left if every document is cut to this length) and docs_truncated (documents longer than it).
    Quantile q is the first length with docs_to >= q * docs_total; for a limit between two lengths
    take the next length's suffix: tokens_total - tokens_from + limit * docs_from.

    Null lengths count as 0; an empty table gives no rows. Suffix sums are taken inside blocks of
    `block` lengths and over the block totals, so no task scans the histogram as a whole. The histogram is
    written once, so that texts aren't encoded again for the totals."""
    h = materialize(
        lengths.select(F.coalesce("length", F.lit(0)).cast("long").alias("length"))
        .groupBy("length")
        .agg(F.count("*").alias("n_docs"))
        .select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {block}").alias("b"))
    )
    inside = W.partitionBy("b").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    after = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = h.groupBy("b").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select(
        "b",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("docs_total"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    sums = h.select("*", F.sum("n_docs").over(inside).alias("d_in"), F.sum("n_tokens").over(inside).alias("t_in")).join(blocks, "b")
    docs_from, tokens_from = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    longer = docs_from - F.col("n_docs")
    return sums.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("docs_total") - longer).alias("docs_to"),
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - tokens_from + F.col("length") * docs_from).alias("tokens_truncated"),
        longer.alias("docs_truncated"),
    )
