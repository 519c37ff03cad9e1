"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is four blocks of 16 bits. Anchors are the words of a covering code of each
block: the perfect Hamming [15, 11] code on its low 15 bits, the top bit free, so covering radius
1. Of two fingerprints with at most 4 differing bits, some block differs in at most 1 bit, so the
one's home anchor in that block lies within 1 + 1 = 2 bits of the other: each fingerprint is
replicated to all anchors within 2 (8.6 a block on average) and compared with the homes there.
Equal fingerprints are one row, whatever their number. An anchor with more than `crowd` rows is
dealt again by the anchors of a second block: 4 differing bits leave two blocks with at most one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_key, fresh, materialize, splits, text_bytes
from .components import connected_components

BITS = 4
CROWD = 20_000


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of `width` words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first, last.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, name: str, names: list[str]) -> DataFrame:
    """Columns names of docs and each text's fingerprint as a long; null or wordless text gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in text_bytes(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fps.view(np.int64))], [*names, name])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in names), StructField(name, LongType())]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    return with_fingerprints(docs.select("doc_id", "text"), "fp", ["doc_id"])


def _syndromes() -> np.ndarray:
    """Syndrome of each 15-bit word: xor of the 1-based places of its bits."""
    words = np.arange(1 << 15)
    out = np.zeros(1 << 15, np.int64)
    for place in range(15):
        out ^= np.where(words >> place & 1, place + 1, 0)
    return out


def anchors(block: np.ndarray, syndrome: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 16-bit blocks: (row, anchor, is_home) for every code word within 2 bits. The place that
    corrects syndrome s is bit s - 1; two places p, q correct it if p ^ q == s."""
    low, top = block & 0x7FFF, block & 0x8000
    s = syndrome[low]
    flip = np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)
    home = low ^ flip
    rows, codes, homes = [np.arange(len(block))] * 2, [home | top, home | (top ^ 0x8000)], [True, False]
    for p in range(1, 16):
        q = s ^ p
        ok = np.flatnonzero((s > 0) & (p < q))
        rows.append(ok)
        codes.append((low[ok] ^ (1 << (p - 1)) ^ (1 << (q[ok] - 1))) | top[ok])
        homes.append(False)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate([np.full(len(r), h) for r, h in zip(rows, homes)])


def _deal(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(rep), pa.array(home)], ["k", "fp", "rep", "home"])


PLACED = "k long, fp long, rep long, home boolean"


def replicate(distinct: DataFrame) -> DataFrame:
    """(fp, rep) -> a row at each anchor in reach; k holds block and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        syndrome = _syndromes()
        for b in batches:
            fp, rep = b.column("fp").to_numpy(), b.column("rep").to_numpy()
            for i in range(4):
                row, code, home = anchors((fp >> (16 * i)) & 0xFFFF, syndrome)
                yield _deal((i << 32) | code, fp[row], rep[row], home)

    return distinct.select("fp", "rep").mapInArrow(run, PLACED)


def replicate_again(placed: DataFrame) -> DataFrame:
    """Rows of crowded anchors, at the anchors of each other block; a home is one in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        syndrome = _syndromes()
        for b in batches:
            k, fp, rep, home = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "fp", "rep", "home"))
            for j in range(4):
                own = np.flatnonzero((k >> 32) != j)
                row, code, near = anchors((fp[own] >> (16 * j)) & 0xFFFF, syndrome)
                at = own[row]
                yield _deal(((j + 1) << 40) | (k[at] >> 32 << 36) | ((k[at] & 0xFFFF) << 16) | code, fp[at], rep[at], home[at] & near)

    return placed.mapInArrow(run, PLACED)


def _links(part: pa.Table, bits: int) -> Iterator[pa.RecordBatch]:
    """Per anchor, edges that connect what is linked there: a spanning forest, never all pairs."""
    k, fp, rep, home = (part.column(c).to_numpy() for c in ("k", "fp", "rep", "home"))
    fp = fp.view(np.uint64)
    src, dst = [], []
    for a, b in zip(*splits(k)):
        if b - a < 2:
            continue
        homes = np.flatnonzero(home[a:b]) + a
        label = np.arange(b - a)
        for at in range(0, len(homes), 256):
            some = homes[at : at + 256]
            far = np.bitwise_count(fp[some][:, None] ^ fp[a:b][None, :])
            hit, other = np.nonzero((far <= bits) & (fp[some][:, None] < fp[a:b][None, :]))
            for s, e in zip(*splits(hit)):
                x = some[hit[s]] - a
                group = np.unique(label[np.r_[x, other[s:e]]])
                if len(group) > 1:
                    label[np.isin(label, group[1:])] = group[0]
                    src.extend([rep[a + group[0]]] * (len(group) - 1))
                    dst.extend(rep[a + group[1:]].tolist())
    if src:
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def near_links(distinct: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Edges (src, dst) between representatives of (fp, rep), spanning all links of `bits` or fewer."""
    if bits > 4:
        raise ValueError("the anchors cover up to 4 differing bits")
    placed = replicate(distinct)
    crowded = materialize(placed.groupBy("k").count().where(F.col("count") > crowd).select("k"))
    link = lambda part: _links(part, bits)
    if crowded.isEmpty():
        return by_key(placed, "k", link, "src long, dst long")
    again = replicate_again(placed.join(crowded, "k", "left_semi"))
    rest = placed.join(crowded, "k", "left_anti")
    return by_key(rest, "k", link, "src long, dst long").union(by_key(again, "k", link, "src long, dst long"))


def simhash_components(docs: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id.

    Null or wordless texts have fingerprint zero and link like any other. Rows with a null
    doc_id link with nothing and get a null component_id. Rows that repeat a doc_id each get
    their own fingerprint. Other columns are ignored; an empty table gives no rows."""
    fps = materialize(fingerprints(docs))
    named = _components(fps, bits, crowd)
    return fps.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _components(fps: DataFrame, bits: int, crowd: int) -> DataFrame:
    """(fp, component_id) of the fingerprints of (doc_id, fp) rows that have an id."""
    distinct = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(near_links(distinct, bits, crowd))
    return distinct.join(parts, distinct.rep == parts.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each component: its smallest doc_id's. Rows with a null doc_id stay.

    Rows that repeat a doc_id are judged by their own fingerprints. Where several rows with the smallest
    id are in its component, the one whose text, then whose JSON, comes first stays. An empty table gives no rows."""
    fps = materialize(fingerprints(docs))
    judged = materialize(fps.where("doc_id is not null").join(_components(fps, bits, crowd), "fp").groupBy("doc_id", "fp", "component_id").agg(F.count("*").alias("k")))
    repeated = materialize(judged.groupBy("doc_id").agg(F.sum("k").alias("k")).where("k > 1").select("doc_id"))
    gone = judged.where("doc_id != component_id").select("doc_id").union(repeated).distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    key, fp, row = fresh(docs, "fp_id"), fresh(docs, "fp"), F.struct(*docs.columns)
    own = judged.where("doc_id = component_id").select(F.col("doc_id").alias(key), F.col("fp").alias(f"{fp}_"))
    again = with_fingerprints(docs.join(repeated, "doc_id", "left_semi").select(docs.columns), fp, docs.columns)
    again = again.join(own, (F.col("doc_id") == F.col(key)) & (F.col(fp) == F.col(f"{fp}_")), "left_semi")
    first = again.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("first")).select("first.*")
    return kept.unionByName(first)
