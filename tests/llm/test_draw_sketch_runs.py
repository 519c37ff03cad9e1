"""Importance draws, bottom-k sketches and periodic runs against brute force, with nulls, ties, repeated rows and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loadweave.llm import importance, queries, runs, sketch

SCHEMA = "doc_id long, text string"
EXTRA = """
lang r w skip buckets counts score rank weight n_words mark m d sketch
copies word_hashes prev stretch runs collapsed n_chars head times
""".split()
ODD = [
    (None, "no id here at all, only words and more words so that there are twenty of them in this row of the table, yes"), (None, None), (900, None), (901, ""), (902, " \t\n"), (903, "one"),
    (905, "same text twice " * 30), (906, "same text twice " * 30), (906, "same text twice " * 30), (906, "other text under the id " * 9), (907, "Ünïcode wörter ÄÖ und\x00null " * 12), (908, "😀 emoji 😀 " * 20)
]


def text(rng, n, words=60):
    return " ".join(f"Word{rng.randrange(words)}" + rng.choice(["", ",", "é", "-x"]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})


# --- 11 -----------------------------------------------------------------------------------------
def grams(t, n):
    low = (t or "").translate(str.maketrans(importance.UPPER, importance.LOWER))
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(w), Counter(" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1))


def brute_draw(docs, target, n, buckets, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for x, into in [(d[1], s) for d in docs] + [(x, t) for x in target]:
        for g, c in grams(x, n)[1].items():
            into[bucket(g)] += c
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, x in docs:
        n_words, g = grams(x, n)
        m = sum(g.values())
        weight = sum(gain[bucket(k)] * c for k, c in g.items()) // m if m else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, n_words, m, weight, score, None])
    able = sorted((r for r in out if r[4] is not None and r[1] >= 20), key=lambda r: (-r[4], r[0], *r[1:4]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("n, piece", [(1, 1 << 20), (3, 1 << 20), (1, 50), (3, 40)])
def test_importance_draw(spark, n, piece):
    rng = random.Random(n)
    docs = [(k, text(rng, rng.randrange(5, 80))) for k in range(40)] + ODD + [(7, text(rng, 30))] * 3 + [(990, "x" * 500 + " y" * 30)]
    target = [text(rng, 30, 8), None, "", "emoji 😀"]
    scored = importance.weigh(table(spark, docs), spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int"), n, 97, piece=piece)
    got = importance.draw(scored, 30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw(docs, target, n, 97, 30)


def test_importance_without_rows(spark):
    none, some = table(spark, []), table(spark, [(k, "a b c " * 10) for k in range(9)])
    assert importance.draw(importance.weigh(none, some)).count() == 0
    got = importance.draw(importance.weigh(some, none), 50).orderBy("rank").collect()
    assert sum(r["rank"] is not None for r in got) == 4 and len({r["weight"] for r in got}) == 1
    assert importance.draw(importance.weigh(some, none), 5).where("rank is not null").count() == 0


# --- 12 -----------------------------------------------------------------------------------------
def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def hashes(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    pieces = [h[i : i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else [[0, *h]] if h else []
    out = set()
    for p in pieces:
        seed = 42
        if len(h) < 5:  # a chain of two-number hashes
            acc = 0
            for x in p[1:]:
                acc = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), xxhash.xxh64_intdigest(acc.to_bytes(8, "little"), 42))
            out.add(signed(acc))
            continue
        for x in p:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        out.add(signed(seed))
    return out


def likeness(a, b, k):
    both = sorted(a | b)[:k]
    low_a, low_b = set(sorted(a)[:k]), set(sorted(b)[:k])
    return len(set(both) & low_a & low_b) / len(both) if both else 1.0


@pytest.mark.parametrize("k", [16, 128])
def test_likeness_to_edits(spark, k):
    rng = random.Random(5)
    docs = [(i, text(rng, rng.randrange(0, 120))) for i in range(40)] + [(50, "tail " * 400)] + ODD + [(20, "copy of an id")] * 3
    got = sketch.likeness_to_edits(table(spark, docs), k).collect()
    mark = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    order = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1])))
    want = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = hashes(t), hashes(edited), hashes(after)
        show = lambda x: "".join(f"{v & (1 << 64) - 1:016x}" for v in sorted(x)[:k])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), likeness(a, b, k), likeness(a, c, k)))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        size = len(r["fingerprint"]) // 16
        assert size == k or r["distinct_shingles"] == size


def test_sketch_estimates_and_merge(spark):
    rng = random.Random(2)
    whole = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(whole[:2000])), (2, " ".join(whole[1000:3000])), (3, " ".join(whole[:1000])), (4, ""), (5, None)]
    df = sketch.with_sketch(spark.createDataFrame(rows, SCHEMA), "text", "sketch", 512)
    s = {r["doc_id"]: r["sketch"] for r in df.collect()}
    pair = spark.createDataFrame([(s[1], s[2], s[3])], "a array<long>, b array<long>, c array<long>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = pair.select(sketch.resemblance(a, b, 512), sketch.containment(c, a, 512), sketch.containment(a, c, 512), sketch.distinct_shingles(a, 512)).first()
    assert r[0] == pytest.approx(1 / 3, abs=0.07) and r[1] > 0.9 and r[2] == pytest.approx(0.5, abs=0.08) and r[3] == pytest.approx(1996, rel=0.15)
    # parts of one text, in any order and number, give the sketch of their shingles together
    parts = [(k % 3, " ".join(rng.choice(whole) for _ in range(40))) for k in range(60)]
    each = sketch.with_sketch(spark.createDataFrame([*parts, (7, None)], SCHEMA), "text", "sketch", 32)
    got = {r["doc_id"]: r["sketch"] for r in sketch.merge(each, ["doc_id"], k=32).collect()}
    for key in range(3):
        assert got[key] == sorted(set().union(*(hashes(t) for d, t in parts if d == key)))[:32]
    assert got[7] == []


def test_sketches_are_native(spark, sf):
    plan = sketch.likeness_to_edits(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    one = table(spark, [(1, "a b c d e f g")])
    assert [(r["near_next"], r["n_chars"]) for r in sketch.likeness_to_edits(one).collect()] == [(1.0, 13)]
    assert sketch.likeness_to_edits(table(spark, [])).count() == 0


# --- 13 -----------------------------------------------------------------------------------------
def brute_runs(w, least):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def test_find_runs():
    rng = random.Random(1)
    for _ in range(400):
        words = rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(words) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            if len(w) > 6:
                a = rng.randrange(len(w) - 3)
                p = rng.randrange(1, max(2, (len(w) - a) // 2))
                for i in range(a, min(len(w), a + p * rng.randrange(2, 9))):
                    w[i] = w[a + (i - a) % p]
        least = rng.choice([12, 12, 4])
        for probes in (1 << 19, 50, 7):
            assert runs.find_runs(np.array(w, np.int32), least, probes) == brute_runs(w, least)


def test_find_runs_in_long_texts():
    w = np.random.default_rng(3).integers(0, 4000, 150_000).astype(np.int32)
    w[20_000:21_000] = 7
    w[50_000:110_000] = w[50_000 + np.arange(60_000) % 23_456]
    got = runs.find_runs(w)
    assert any(p == 1 and length >= 1000 for _, length, p in got) and any(p == 23_456 and 60_000 <= length < 60_010 for _, length, p in got)


def test_periodic_runs(spark):
    rows = [*ODD, (1, "a b c d " * 6 + "tail"), (2, " ".join("x" * 20)), (3, "no run here at all"), (4, "p q " * 8 + "r s t " * 7)]
    got = runs.periodic_runs(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (doc_id, t) in zip(sorted(got, key=lambda r: str((r["doc_id"], r["n_words"], r["collapsed"]))), sorted(rows, key=lambda r: str((r[0], len((r[1] or "").split()), "")))):
        assert r["n_words"] == len((t or "").encode().split())
    for doc_id, t in rows[-4:]:
        r = next(x for x in got if x["doc_id"] == doc_id)
        w = t.split()
        want = brute_runs(w, 12)
        gone = {i for s, length, p in want for i in range(s + p, s + length)}
        assert [tuple(x) for x in r["runs"]] == want and r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    d = {r["doc_id"]: r for r in runs.digest(runs.periodic_runs(table(spark, rows))).collect()}
    assert (d[1]["start"], d[1]["length"], d[1]["period"], d[1]["exponent_milli"]) == (0, 24, 4, 6000)
    assert d[3]["n_runs"] == 0 and d[3]["start"] is None and d[900]["collapsed_sha256"] == d[900]["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert runs.periodic_runs(table(spark, [])).count() == 0


def test_repeat_tail():
    assert runs.repeat_tail(None, [b"a"] * 3) == [b"a"] * 3 and runs.repeat_tail(1, []) == []
    changed = 0
    for doc_id in range(200):
        words = [b"%d" % i for i in range(50)]
        h = zlib.crc32(str(doc_id).encode())
        got, g, n = runs.repeat_tail(doc_id, words), h // 10, 50
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want = [words[i] if i < a or h % 10 else words[a + (i - a) % p] for i in range(n)]
        changed += h % 10 == 0
        assert got == want
    assert changed


def test_registered(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op11_importance_draw", "op12_bottom_k", "op13_periodic_runs"):
        assert queries.QUERIES[name](spark, sf).select("doc_id").distinct().count() == n
