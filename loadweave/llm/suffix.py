"""Exact repeated-passage removal with a bucketed, enhanced suffix array and its interval tree.

A suffix matters only if its first `width` bytes occur twice. Each window of `width` bytes has an
anchor, the leftmost lowest-hashed GRAM bytes in it; windows with equal bytes have equal anchors, so
the anchor hash buckets the suffixes. Windows of one document that share the anchor's place form a
run. Steps, each a join or an aggregation by key:

1. runs(): per document, its runs (anchor hash, content hash, start, number of windows).
2. Runs whose anchor hash occurs once can't repeat. Of equal runs only the first can stay.
3. A bucket with several different runs gets its suffixes sorted with their common-prefix lengths
   (the enhanced suffix array). A stack scan visits the common-prefix intervals; an interval of at
   least `width` bytes whose members are preceded by different bytes is a maximal repeat, reported
   with all its occurrences. All but the first occurrence is removed. Every repeated window
   lies in a maximal repeat with the same occurrences, so this removes exactly the bytes that
   an earlier equal window covers.
4. A bucket with more than `crowd` different runs is first split by context. Windows with the anchor at
   offsets lo to hi all hold the lo bytes before it and what follows up to width - hi: halving the
   offsets deals a run to two buckets whose keys hold half as many context bytes more. Equal windows have equal
   offsets, so they stay together; equal parts of runs collapse to the first again, and a part whose
   key is its own is done. After seven halvings a bucket is one window, so no task holds a crowd and
   every bucket that is left goes through step 3.

Runs count as equal by two 64-bit hashes (anchor and content); parts of split runs, and all that
step 3 finds, by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, fresh, materialize, splits, text_bytes

WIDTH = 100
CROWD = 1_000
U = np.uint64


def _byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    return _stir(x) | U(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


CODES = _byte_codes()
STEP = U(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes from each place: polynomial, by doubling, then stirred."""
    parts: dict[int, np.ndarray] = {1: CODES[data]}
    size = 1
    while 2 * size <= gram:
        h = parts[size]
        parts[2 * size] = h[:-size] * U(pow(int(STEP), size, 1 << 64)) + h[size:]
        size *= 2
    out, done = parts[size], size
    while done < gram:
        size = 1 << ((gram - done).bit_length() - 1)
        n = len(data) - done - size + 1
        factor = U(pow(int(STEP), size, 1 << 64))
        out = out[:n] * factor + parts[size][done : done + n]
        done += size
    return _stir(out)


def lowest(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost value with the lowest upper half among the span values from each place: each value
    carries its place in the lower half, and a window's minimum is that of a block's end and the next
    one's begin."""
    n = len(h) - span + 1
    blocks = -(-len(h) // span)
    x = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    x[: len(h)] = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    x = x.reshape(blocks, span)
    begins = np.minimum.accumulate(x, 1).ravel()[span - 1 : span - 1 + n]
    ends = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return (np.minimum(begins, ends) & U(0xFFFFFFFF)).astype(np.int64)


def text_runs(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, text, start, number of windows) of each run of the windows of texts that are at least
    width long. The texts are hashed as one; windows that cross a border don't count."""
    gram = max(1, width // 4)
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin, windows = np.cumsum(size) - size, size - (width - 1)
    before = np.cumsum(windows) - windows
    at = np.arange(windows.sum()) + np.repeat(begin - before, windows)
    place = lowest(h, width - gram + 1)[at]
    start, end = splits(place)
    n = end - start
    text = np.searchsorted(before, start, "right") - 1
    first, last = at[start], at[end - 1]
    # first and last window overlap, as a run has at most width - gram + 1 windows
    content = n.astype(np.uint64)
    for offset in sorted({*range(0, width - gram, gram), width - gram}):
        content = _stir(content * STEP + h[first + offset]) * STEP + h[last + offset]
    return h[place[start]].view(np.int64), content.view(np.int64), text, (first - begin[text]).astype(np.int32), n.astype(np.int32)


RUNS = "h long, c long, doc_id long, start int, n int"
CHUNK, LONG = 1 << 16, 1 << 20  # bytes of short texts that are hashed together, windows of a long text


def runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The runs of every text. A text of more than LONG windows is hashed in parts, which only cuts runs in two."""

    def batch(ids: list[int], offsets: list[int], texts: list[bytes]) -> pa.RecordBatch:
        h, c, text, start, n = text_runs(texts, width)
        start = start + np.array(offsets, np.int32)[text]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, np.array(ids, np.int64)[text], start, n)], [f.split()[0] for f in RUNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, offsets, texts, pending = [], [], [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                if doc_id is None:
                    continue
                for at in range(0, len(text) - width + 1, LONG):
                    ids.append(doc_id)
                    offsets.append(at)
                    texts.append(text[at : at + LONG + width - 1])
                    pending += len(texts[-1])
                    if pending > CHUNK:
                        yield batch(ids, offsets, texts)
                        ids, offsets, texts, pending = [], [], [], 0
            if texts:
                yield batch(ids, offsets, texts)

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def maximal_repeats(texts: list[bytes], windows: list[int], width: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least width bytes among suffixes 0 .. windows[i]-1 of texts[i]:
    (length, all occurrences (i, place)), by a stack scan over the sorted suffixes."""
    order = sorted((t[p:], i, p) for i, t in enumerate(texts) for p in range(windows[i]))
    # an open interval: length, first member, the byte before its members, or None if they differ
    stack: list[list] = []

    def before(k: int):
        _, i, p = order[k]
        return texts[i][p - 1] if p else (-1, i)  # what precedes a run is unknown: counts as different

    for k in range(1, len(order) + 1):
        common = 0
        if k < len(order):
            a, b = order[k - 1][0], order[k][0]
            if a[:width] == b[:width]:
                common = _common(a, b, width)
        left, same = k - 1, before(k - 1)
        while stack and stack[-1][0] > common:
            length, left, own = stack.pop()
            same = own if own == same else None
            if same is None:
                yield length, [x[1:] for x in order[left:k]]
        if common:
            if stack and stack[-1][0] == common:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == same else None
            else:
                stack.append([common, left, same])


def _common(a: bytes, b: bytes, low: int) -> int:
    """Length of the common prefix, known to be at least low."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _repeated_spans(part: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove in each bucket: every occurrence of a maximal repeat but the first, as the union
    of each run's occurrences."""
    h, ids, starts = (part.column(c).to_numpy() for c in ("h", "doc_id", "start"))
    data = part.column("data").to_pylist()
    docs, begins, ends = [], [], []
    for a, b in zip(*splits(h)):
        texts = data[a:b]
        covered: dict[int, list[dict]] = {}  # of each run: repeats nest and overlap, so only their union goes on
        for length, found in maximal_repeats(texts, [len(t) - width + 1 for t in texts], width):
            places = [(ids[a + i], starts[a + i] + p) for i, p in found]
            first = min(places)
            for (i, p), place in zip(found, places):
                if place != first:
                    covered.setdefault(i, []).append({"s": p, "e": p + length})
        for i, spans in covered.items():
            for s, e in merged(spans):
                docs.append(int(ids[a + i]))
                begins.append(int(starts[a + i]) + s)
                ends.append(int(starts[a + i]) + e)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "s", "e"])


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted(h, m, doc_id, start, n, width): joined to whole texts by document."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "m", "start", "size")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "m", "doc_id", "start", "data"]
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, pieces in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), b.column("wanted").to_pylist()):
                for x in pieces or ():
                    cut = text[x["start"] : x["start"] + x["size"]]
                    if len(cut) == x["size"]:
                        for column, value in zip(out, (x["h"], x["m"], doc_id, x["start"], cut)):
                            column.append(value)
            if out[0]:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    return docs.select("doc_id", "text").join(lists, "doc_id", "left").mapInArrow(run, "h long, m long, doc_id long, start int, data binary")


PART = "h long, doc_id long, start int, data binary, lo int, hi int, a int"


def _halves(parts: DataFrame, width: int) -> DataFrame:
    """Each part of a run (anchor at data[a], offsets lo to hi) as its windows of the lower and of the upper half of
    the offsets, keyed by the bytes that all windows of that half hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PART.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, start, data, lo, hi, a in zip(*(b.column(c).to_pylist() for c in names[1:])):
                middle = (lo + hi + 1) // 2
                for low, high in ((lo, middle - 1), (middle, hi)):
                    least, most = max(low, a - (len(data) - width)), min(high, a)  # this part's own offsets
                    if least > most:
                        continue
                    key = xxhash.xxh64_intdigest(data[a - low : a - high + width], low * width + high) - (1 << 63)
                    for column, value in zip(rows, (key, doc_id, start + a - most, data[a - most : a - least + width], low, high, most)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names)

    return parts.mapInArrow(run, PART)


def _with_anchor(data: DataFrame, width: int) -> DataFrame:
    """Whole runs as parts: all offsets, and where the anchor is."""
    gram = max(1, width // 4)
    span = width - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [int(lowest(gram_hashes(np.frombuffer(x[:width], np.uint8), gram), span)[0]) for x in b.column("data").to_pylist()]
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in ("h", "doc_id", "start", "data")),
                    *(pa.array(v, pa.int32()) for v in ([0] * n, [span - 1] * n, at))
                ], [f.split()[0] for f in PART.split(", ")]
            )

    return data.select("h", "doc_id", "start", "data").mapInArrow(run, PART)


def _split(crowded: DataFrame, width: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Crowded buckets, split by context until no bucket has more than `crowd` different parts: spans of parts that
    repeat an earlier part as a whole, and the buckets (h, doc_id, start, data) that are left."""
    spans, buckets = [], []
    parts = _with_anchor(crowded, width)
    while True:
        parts = materialize(_halves(parts, width))
        place = F.struct("doc_id", "start")
        first = materialize(parts.groupBy("h", "data", "lo", "hi", "a").agg(F.min(place).alias("first"), F.count("*").alias("k")))
        again = parts.join(first.where("k > 1").select("h", "data", "a", "first"), ["h", "data", "a"]).where(place != F.col("first"))
        spans.append(again.select("doc_id", F.col("start").alias("s"), (F.col("start") + F.length("data")).alias("e")))
        several = materialize(first.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
        left = materialize(first.join(several, "h").select("h", "m", "first.doc_id", "first.start", "data", "lo", "hi", "a"))
        buckets.append(left.where(F.col("m") <= crowd).select("h", "doc_id", "start", "data"))
        parts = left.where(F.col("m") > crowd).drop("m")
        if parts.isEmpty():
            return spans, buckets


def repeated_spans(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, s, e): bytes s to e of a document are covered by width-byte strings that also
    start earlier (a smaller doc_id, or the same document further left). Spans may overlap."""
    all_runs = runs(docs, width)
    # written first: a join of plain rows is one that adaptive execution can split where one anchor is very common
    often = materialize(all_runs.groupBy("h").count().where(F.col("count") > 1).select("h"))
    again = materialize(all_runs.join(often, "h"))
    first = materialize(again.groupBy("h", "c").agg(F.min(F.struct("doc_id", "start", "n")).alias("first"), F.count("*").alias("k")))
    place = F.struct("doc_id", "start", "n")
    equal = again.join(first.where("k > 1").select("h", "c", "first"), ["h", "c"]).where(place != F.col("first"))
    equal = equal.select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("n") + (width - 1)).alias("e"))
    several = materialize(first.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
    wanted = first.join(several, "h").select("h", "m", "first.doc_id", "first.start", (F.col("first.n") + (width - 1)).alias("size"))
    data = materialize(_fetch(docs, wanted))
    spans, buckets = [equal], [data.where(F.col("m") <= crowd).select("h", "doc_id", "start", "data")]
    crowded = data.where(F.col("m") > crowd)
    if not crowded.isEmpty():
        more, rest = _split(crowded, width, crowd)
        spans, buckets = spans + more, buckets + rest
    found = by_key(reduce(DataFrame.union, buckets), "h", lambda part: _repeated_spans(part, width), "doc_id long, s int, e int")
    return reduce(DataFrame.union, [*spans, found])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    return b"".join(parts)


def _span_lists(docs: DataFrame, width: int, crowd: int) -> DataFrame:
    return repeated_spans(docs, width, crowd).groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("found"))


def cut_repeats(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """docs, all columns, with the repeated bytes gone from text and n_chars, if there, counted
    again. A cut inside a character drops what is left of it. Rows stay even where no text does;
    nulls and repeated ids are as in remove_repeats()."""
    cut_id, spans = fresh(docs, "cut_id"), fresh(docs, "found")
    lists = _span_lists(docs.select("doc_id", "text"), width, crowd).select(F.col("doc_id").alias(cut_id), F.col("found").alias(spans))
    names, chars = docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, found in enumerate(b.column(spans).to_pylist()):
                if found and texts[i]:
                    texts[i] = kept_bytes(texts[i].encode(), merged(found)).decode("utf-8", "ignore")
            new = {"text": pa.array(texts, pa.string())}
            if chars:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)

    return docs.join(lists, F.col("doc_id") == F.col(cut_id), "left").select(*names, spans).mapInArrow(run, docs.schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, spans (array of s, e) and kept (the remaining bytes).

    Null text is empty. A text shorter than width loses nothing. A row with a null doc_id neither
    loses bytes nor makes others lose any. Rows that repeat a doc_id are places of one document:
    equal windows at the same place don't count as earlier, and each row loses the union of the
    spans found for its id. Other columns are ignored; an empty table gives no rows."""
    lists = _span_lists(docs, width, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for text, found in zip(text_bytes(b.column("text")), b.column("found").to_pylist()):
                cut = [(s, min(e, len(text))) for s, e in merged(found or []) if s < len(text)]
                kept = kept_bytes(text, cut)
                values = (len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"s": s, "e": e} for s, e in cut], kept)
                for column, value in zip(rows, values):
                    column.append(value)
            span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
            arrays = [b.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>, kept binary"
    return docs.select("doc_id", "text").join(lists, "doc_id", "left").mapInArrow(run, schema)
