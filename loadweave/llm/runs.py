"""Detection of periodic runs of words by harmonic grid probing.

A run is a stretch of consecutive words, with smallest period p and at least two periods long, that no neighbouring word
extends. Any such run holds two neighbouring points jp and (j + 1)p of the grid of p, whose words are then equal. So
probing the grids of all periods, n / p pairs for period p and n log n in all, finds every run: pairs that differ are gone at
once, pairs that agree are compared further around in growing chunks of arrays, and grid points inside runs already found (of
that period or of a divisor) are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .importance import CRC_SQL, crc_sql

LEAST = 12  # words of the shortest run
CHUNK = 64  # words that the first extension compares
AHEAD = 5  # neighbours on each side that sift probes at once
PROBES = 1 << 19  # pairs of one probing step

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _forward(ids: np.ndarray, i: int, p: int) -> int:
    """The first place at or after i whose word differs from the one p further on, or that has none."""
    end, size = len(ids) - p, CHUNK
    while i < end:
        z = min(end, i + size)
        differ = ids[i:z] != ids[i + p : z + p]
        at = int(differ.argmax())
        if differ[at]:
            return i + at
        i, size = z, min(2 * size, 1 << 16)
    return end


def _backward(ids: np.ndarray, i: int, p: int) -> int:
    """The last place before i whose word differs from the one p further on; -1 where there is none."""
    size = CHUNK
    while i > 0:
        a = max(0, i - size)
        differ = ids[a:i] != ids[a + p : i + p]
        at = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - at]:
            return i - 1 - at
        i, size = a, min(2 * size, 1 << 16)
    return -1


def _probe(ids: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(periods, places) of the grid pairs of periods low to high - 1 whose words agree, by period and then place."""
    n = len(ids)
    root = min(high, max(low, int(n**0.5)))
    periods, places = [], []
    for p in range(low, root):  # all pairs of a short period at once: two slices of that stride
        at = np.flatnonzero(ids[: n - p : p] == ids[p::p])
        if len(at):
            periods.append(np.full(len(at), p))
            places.append(at * p)
    for j in range((n - 1) // root if root < high else 0):  # pair j of all long periods at once
        top = min(high, (n - 1) // (j + 1) + 1)
        right = ids[(j + 1) * root : (j + 1) * (top - 1) + 1 : j + 1]
        p = np.flatnonzero((ids[j * root : j * (top - 1) + 1 : j] if j else ids[0]) == right) + root
        if len(p):
            periods.append(p)
            places.append(p * j)
    if not periods:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, at = np.concatenate(periods), np.concatenate(places)
    order = np.lexsort((at, p))
    return p[order], at[order]


def _sift(ids: np.ndarray, p: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Which pairs agree on enough neighbours in a row to be in a run: max(p, least - p) of them, of which at most AHEAD on
    each side are looked at here."""
    n, total = len(ids), np.ones(len(p), np.int64)
    for step in (1, -1):
        live, place = np.arange(len(p)), at
        for _ in range(AHEAD):
            place = place + step
            ok = (place >= 0) & (place + p[live] < n)
            live, place = live[ok], place[ok]
            same = ids[place] == ids[place + p[live]]
            live, place = live[same], place[same]
            if not len(live):
                break
            total[live] += 1
    return total >= np.minimum(np.maximum(p, least - p), AHEAD + 1)


def _outside(places: np.ndarray, p: int, runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs of period p that no run holds whole, given the starts and ends of the runs of one period."""
    i = np.searchsorted(runs[0], places, "right") - 1
    return (i < 0) | (places + p >= runs[1][i])


def find_runs(ids: np.ndarray, least: int = LEAST, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 period) words, by start and then period.

    Where a pair lies in a run whose period divides p, what has period p around it is that run, so it is passed over."""
    n = len(ids)
    found: list[tuple[int, int, int]] = []
    by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    low = 1
    while n >= least and 2 * low <= n:
        high = min(n // 2 + 1, max(low + 1, int(low * np.exp(min(40.0, probes / n)))))
        p, at = _probe(ids, low, high)
        live = _sift(ids, p, at, least) if len(p) else np.zeros(0, bool)
        p, at = p[live], at[live]
        cuts = np.flatnonzero(np.diff(p, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)]):
            q, places = int(p[a]), at[a:z]
            for d, runs in by_period.items():
                if q % d == 0 and len(places):
                    places = places[_outside(places, q, runs)]
            own, k = [], 0
            while k < len(places):
                i = int(places[k])
                start, stop = _backward(ids, i, q) + 1, _forward(ids, i, q)
                if stop - start + q >= max(least, 2 * q):
                    own.append((start, stop + q))
                k = int(np.searchsorted(places, stop))  # past the stretch just compared
            if own:
                by_period[q] = tuple(np.array(own).T)
                found += [(s, e - s, q) for s, e in own]
        low = high
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_words, runs (array of start, length, period: word numbers from
    0, by start and then period) and collapsed (the text's words without what runs repeat, joined by one space).

    Words are split by ASCII white space. Null and empty texts have no words, no runs and an empty collapsed text.
    Null or repeated doc_ids are rows like others; other columns are ignored; no rows, no result. edit(doc_id, words), if
    given, changes a document's words before the search. Rows are independent: there is no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, every, left = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                words = text.split()
                if edit is not None:
                    words = edit(doc_id, words)
                runs = find_runs(word_ids(words), least)
                if runs:
                    keep = kept_words(len(words), runs)
                    words_left = [words[i] for i in np.flatnonzero(keep)]
                else:
                    words_left = words
                counts.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                left.append(b" ".join(words_left).decode())
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(every, kind), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document by CRC of its id, their tail made periodic; other documents', and those without an id,
    as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return words[:a] + (head * (-(-(n - a) // p)))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """periodic_runs() as numbers and digests: doc_id, n_runs, start, length, period and exponent_milli of the longest run
    (ties: smallest start, then period), runs_sha256, collapsed_sha256."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best: Column = F.col("longest")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"),
        F.floor(-1000 * best["l"] / best["p"]).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = f"""
WITH {CRC_SQL.strip()}
given AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
    {crc_sql("hex(doc_id::VARCHAR)")}::BIGINT AS h
  FROM documents, table_of),
sized AS (SELECT doc_id, ws, h, h // 10 AS g, len(ws) AS n FROM given),
cut AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
tail AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
edited AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::BIGINT]) ELSE ws END AS ws
  FROM tail),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM edited),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches WHERE l >= {LEAST} AND l >= 2 * q GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
told AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256,
    arg_min({{'s': s, 'l': l, 'q': q}}, (-l, s, q)) AS best
  FROM runs GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS x FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM edited e LEFT JOIN told USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
