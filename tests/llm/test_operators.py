"""The ten corpus operators against brute force on small data, with nulls, ties and repeated rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from loadweave.llm import bayes, bpe, chat, covertree, cube, lattice, quality, simhash, suffix
from loadweave.llm.components import connected_components

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")


def documents(spark, rows):
    """(doc_id, text) rows with the other columns of documents and one that clashes by name."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3), "n_chars": F.length("text").cast("long"), "count": F.lit(1), "h": F.lit("x")})


ODD = [
    (None, "no id here at all, only words"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "x" * 3000),
    (905, "same text twice " * 30), (906, "same text twice " * 30), (906, "same text twice " * 30)
]


# --- 1 ------------------------------------------------------------------------------------------
def brute_links(x, c=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= c
    label = np.arange(len(x))
    while True:
        new = np.where(hit, label[None, :], len(x)).min(1)
        if (new == label).all():
            return hit.sum(1) - 1, label
        label = new


@pytest.mark.parametrize("block", [1024, 90, 12])
def test_cover_tree_links(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    x = np.float32([base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.2, 0.4]) for _ in range(400)])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [
        (1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [1.0, None] * 4, 0), (1004, [float("inf")] * 8, 1),
        (None, [1.0] * 8, 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0)
    ]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df, block=block).collect()}
    n, label = brute_links(x.astype(float))
    assert len(got) == 408
    assert all(got[i]["n_links"] == n[i] and got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i) for i in range(400))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(1000, 1005))
    assert (got[1006]["n_links"], got[1006]["component_id"]) == (1, 1005) and got[None]["n_links"] == 0


def test_cover_tree_of_a_tight_crowd(spark, monkeypatch):
    """Many nearly equal vectors can't be told apart by centres; they are dealt by hash and placed by several tasks."""
    monkeypatch.setattr(covertree, "SALT", 40)
    monkeypatch.setattr(covertree, "PARTNERS", 3)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((150, 6)) + rng.normal(size=(150, 6)) * 1e-7, rng.normal(size=(250, 6)), np.ones((60, 6)) + rng.normal(size=(60, 6)) * 0.3])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df.withColumns({c: F.lit(1) for c in ("x", "rep", "node", "chunk", "copies")}), block=16).collect()}
    n, label = brute_links(x)
    assert all(got[i]["n_links"] == n[i] and got[i]["component_id"] == label[i] for i in range(len(x)))


def _shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none, quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_cover_tree_shuffles_no_pairs(spark):
    """Random vectors, whose chunks nearly all may hold links: what is shuffled grows with the vectors, not with the pairs of chunks."""
    rng, rows = np.random.default_rng(3), []
    for n in (300, 1500):
        x = rng.normal(size=(n, 16))
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
        before = _shuffled(spark)
        got = {r["vec_id"]: r["n_links"] for r in covertree.near_duplicates(df, block=16).collect()}
        rows.append(_shuffled(spark) - before)
        assert got == dict(enumerate(brute_links(np.float32(x).astype(float))[0]))
    assert rows[1] < 40 * 1500


def test_cover_tree_tells_vectors_of_one_hash_apart(spark, monkeypatch):
    monkeypatch.setattr(covertree, "_hash", lambda: F.pmod(F.hash("x"), F.lit(7)))
    rng = np.random.default_rng(4)
    x = np.float32(rng.normal(size=(60, 5)))
    x = np.concatenate([x, x[:20], x[:5], -0.0 * x[:1], np.float32([[0.0, 1, 0, 0, 0], [-0.0, 1, 0, -0.0, 0]])])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df).collect()}
    n, label = brute_links(np.delete(x, 85, 0).astype(float))
    keep = [i for i in range(len(x)) if i != 85]
    assert all(got[i]["n_links"] == n[k] and got[i]["component_id"] == keep[label[k]] for k, i in enumerate(keep))
    assert got[85]["n_links"] == 0


def test_cover_tree_extreme_and_repeated_rows(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [2.0, -1.0]), (4, None), (5, [0.0, -0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 1), (4, 0, 4), (4, 0, 4), (5, 0, 5)]


def test_cover_tree_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.near_duplicates(df).count() == 0
    assert covertree.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["kept"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 260)] + [(None, 1), (7, 7)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(df.limit(0)).count() == 0


# --- 2, 5 ---------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tree_equals_library(reference):
    ranks, enc = reference
    coders = [bpe.Coder(ranks, P.PATTERN, leaf_chars=8, leaf_bytes=2), bpe.coder(RANKS, P.PATTERN)]
    rng = random.Random(3)
    parts = ["a", "b", "the", "  ", " ", "\n", "'s", "'", "re", "'r", "e", "é", "日本", "1", "22", "!!", "#", "\t", "x", "ing", " \n ", " ", "ZZ", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 900, " " * 500 + "x", "日本" * 300, "ab" * 400, "#" * 700, "".join(rng.choice("abcdefghij") for _ in range(3000)), ""]
    for t in texts:
        want = enc.encode_ordinary(t)
        for c in coders:
            assert c.matches(t) == c.pattern.findall(t) and c.encode(t) == want and c.decode(want) == t.encode()


def test_bpe_documents(spark, reference):
    _, enc = reference
    rows = ODD + [(1, "Hello, world! It's über 2024.\n\n  ok")]
    got = bpe.encode_documents(documents(spark, rows), RANKS, P.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(documents(spark, rows), RANKS, P.PATTERN, keep_ids=True), RANKS, P.PATTERN)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((i or -1, t or "") for i, t in rows)


def test_length_histogram(spark, reference):
    _, enc = reference
    rows = ODD + [(k, "word " * k) for k in range(40)]
    got = bpe.length_histogram(bpe.token_counts(documents(spark, rows), RANKS, P.PATTERN), block=16).orderBy("length").collect()
    n = sorted(len(enc.encode_ordinary(t or "")) for _, t in rows)
    assert [r["length"] for r in got] == sorted(set(n))
    for r in got:
        at = r["length"]
        assert r["n_docs"] == n.count(at) and r["docs_from"] == sum(x >= at for x in n) and r["tokens_from"] == sum(x for x in n if x >= at)
        assert r["docs_to"] == sum(x <= at for x in n) and r["tokens_truncated"] == sum(min(x, at) for x in n) and r["docs_truncated"] == sum(x > at for x in n)
        assert r["docs_total"] == len(n) and r["tokens_total"] == sum(n)
    assert bpe.length_histogram(spark.createDataFrame([], "length long")).count() == 0


# --- 3 ------------------------------------------------------------------------------------------
def brute_targets(sizes, cap=3.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / w for s in order}
        more = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not more:
            return target
        full |= more


def test_cube_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * (rng.choice([0, 1, 5, 40, 400]) + rng.randint(0, 9))), rng.choice(["a", "a", "a", "b", "é", None, "tiny"] if i % 50 else ["tiny2"])) for i in range(900)]
    rows += [(None, "x y", "a"), (5, "dup id", "b"), (6, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = cube.mix(df, block=120)
    got = a.collect()
    assert len(got) == len(rows)
    again = cube.mix(df.repartition(7), block=120).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in again)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(dict(sizes))
    by_id = {i: s for i, _, s in rows if i not in (None, 5, 6)}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] in by_id:
            s = by_id[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
            taken[s] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 500, (s, taken[s], t)  # one long document at most
    assert cube.take(df, block=120).columns == df.columns
    assert cube.mix(df.limit(0)).count() == 0


def test_mix_tells_rows_apart_whose_hashes_meet(spark, monkeypatch):
    class Same:
        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *columns):
            return F.pmod(F.hash(*columns), F.lit(3)).cast("long")  # every hash is one of three

    rows = [(i % 20 if i % 7 else None, " ".join(["w"] * (i % 9)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(cube, "F", Same())
    got = cube.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(t.split())) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert sum(taken.values()) == pytest.approx(sum(target.values()), abs=9)


def test_take_where_no_text_has_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (2, " ", None)], "doc_id long, text string, source string").withColumn("exact", F.lit("x"))
    assert sorted(map(str, cube.take(df).collect())) == sorted(map(str, df.collect()))


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 300)
    for seed in range(5):
        p = rng.random(300)
        q = cube.fly(p.copy(), size, str(seed))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and (q * size).sum() == pytest.approx((p * size).sum(), abs=1e-4)


# --- 4 ------------------------------------------------------------------------------------------
def test_lattice_takes_long_words_in_linear_time():
    import time

    log_p = lattice.start_log_p(PIECES)
    _, ordinary, single = lattice.vocabulary(PIECES)
    model, took = lattice.Lattice(ordinary, single, log_p), []
    text = base64.b64encode(random.Random(1).randbytes(150_000)).decode()
    for n in (20_000, 200_000):
        start, found = time.perf_counter(), {}
        model.expected(text[:n], found)
        took.append(time.perf_counter() - start)
        assert sum(v * (len(k) if isinstance(k, str) else 1 / 3) for k, v in found.items()) == pytest.approx(n + 1, rel=1e-6)  # the mark is three bytes
    assert took[1] < 30 * took[0]  # ten times as long; the square would be a hundred


def test_lattice_marginal_is_the_sum_over_segmentations():
    pieces = {"▁": 0, "▁a": 1, "b": 2, "ab": 3, "a": 4, "▁ab": 5}
    log_p = np.log(np.array([0.2, 0.1, 0.25, 0.1, 0.2, 0.15]))
    model = lattice.Lattice(pieces, {}, log_p)

    def total(s):
        return 1.0 if not s else sum(math.exp(log_p[i]) * total(s[len(p) :]) for p, i in pieces.items() if s.startswith(p))

    for w in ("ab", "aab", "abab", "b"):
        assert 10 ** model.score(w) == pytest.approx(total("▁" + w))


def test_lattice_expected_counts_are_sums_over_segmentations():
    pieces = {"▁": 0, "▁a": 1, "b": 2, "ab": 3, "a": 4, "▁ab": 5}
    single = {b: 6 + k for k, b in enumerate("é".encode())}
    log_p = np.log(np.array([0.2, 0.1, 0.25, 0.1, 0.1, 0.15, 0.05, 0.05]))
    model = lattice.Lattice(pieces, single, log_p)

    def cuts(s):
        if not s:
            yield 1.0, []
        for p, i in pieces.items():
            if s.startswith(p):
                yield from ((math.exp(log_p[i]) * w, [p, *rest]) for w, rest in cuts(s[len(p) :]))
        if s[:1] == "é":
            for w, rest in cuts(s[1:]):
                yield w * math.exp(sum(log_p[single[b]] for b in "é".encode())), [*"é".encode(), *rest]

    got, want = {}, Counter()
    for word in ("ab", "aabéb", "abab", "b", "éé"):
        model.expected(word, got)
        ways = list(cuts("▁" + word))
        for w, cut in ways:
            for p in cut:
                want[p] += w / sum(x for x, _ in ways)
        assert 10 ** model.score(word) == pytest.approx(sum(x for x, _ in ways))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    long = {}
    model.expected("ab" * 300 + "é" * 40, long)  # weights far below the least double
    assert sum(v * (len(k) if isinstance(k, str) else 0.5) for k, v in long.items()) == pytest.approx(1 + 600 + 40)


def test_lattice_fit_raises_likelihood(spark):
    words = spark.createDataFrame([(w, 1, 1) for w in ("water", "waters", "watering", "river", "rivers", "unseen")] + [("held", 0, 3)], "word string, c long, t long")
    _, ordinary, single = lattice.vocabulary(PIECES)
    total = []
    for rounds in (0, 1, 3):
        log_p = lattice.fitted_log_p(words, PIECES, rounds)
        assert np.exp(log_p[np.isfinite(log_p)]).sum() == pytest.approx(1)
        total.append(sum(lattice.Lattice(ordinary, single, log_p).score(w) for w in ("water", "waters", "watering", "river", "rivers", "unseen")))
    assert total[0] < total[1] < total[2]


@pytest.mark.parametrize("head", [300_000, 3])
def test_lattice_base(spark, head):
    rng = random.Random(6)
    words = ["Alpha", "beta", "γάμμα", "d", "eps", "x" * 50, "日本"]
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 6]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + ODD[1:-1]
    got = {r["doc_id"]: r for r in lattice.score_documents(documents(spark, rows), PIECES, head).collect()}
    split = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t in rows}
    train = {i for i in split if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in train for w in split[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, ws in split.items():
        r, unit = got[i], n + 0.1 * (v + 1)
        base = sum(math.log10((c[w] + 0.1) / unit) for w in ws) + math.log10((len(train) + 0.1) / unit)
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(ws) + 1 and r["n_known"] == sum(c[w] > 0 for w in ws) + 1
        assert r["train_tokens"] == n and r["held_out"] == (i not in train) and -math.inf < r["score"] < 0
    # the whole score: training words by their discounted share and the pieces' share of what discounting freed
    counted = spark.createDataFrame([(w, k, k) for w, k in ((w.decode() if isinstance(w, bytes) else w, k) for w, k in c.items()) if k], "word string, c long, t long")
    _, ordinary, single = lattice.vocabulary(PIECES)
    model = lattice.Lattice(ordinary, single, lattice.fitted_log_p(counted, PIECES))
    free = 0.75 * v / n
    for i, ws in split.items():
        want = sum(math.log10((max(c[w] - 0.75, 0.0) / n if c[w] else 0.0) + free * 10 ** model.score(w)) for w in ws) + math.log10((len(train) - 0.75) / n)
        assert got[i]["score"] == pytest.approx(want, rel=1e-6)
    assert lattice.score_documents(documents(spark, ODD[:1]), PIECES).first()["held_out"]
    assert lattice.score_documents(documents(spark, []), PIECES).count() == 0


# --- 6 ------------------------------------------------------------------------------------------
def brute_repeats(rows, width):
    seen, out = set(), {}
    for d, t in sorted(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width,crowd", [(20, 1000), (20, 2), (33, 1000), (33, 3), (100, 1)])
def test_suffix_dedup(spark, width, crowd):
    rng = random.Random(5)

    def some(n, letters):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [some(rng.randint(8, 150), "abcdé ") for _ in range(12)]
    rows = []
    for i in range(90):
        s = "".join(rng.choice(passages)[: rng.randint(1, 150)] if rng.random() < 0.5 else some(rng.randint(1, 60), "abcd") for _ in range(rng.randint(0, 8)))
        s = some(rng.randint(1, 7), "ab") * rng.randint(1, 60) if rng.random() < 0.1 else s
        s = rng.choice(rows)[1] if rng.random() < 0.1 and rows else s
        rows.append((i * 7 % 1000, s))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(documents(spark, rows), width, crowd).collect()}
    assert got == brute_repeats([(d, t.encode()) for d, t in rows], width)


def test_suffix_dedup_odd_rows(spark):
    got = suffix.remove_repeats(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["n_removed"] == 0 and by[900]["n_bytes"] == 0 and by[904]["n_removed"] == 2999
    cut = suffix.cut_repeats(documents(spark, ODD))
    assert cut.columns == documents(spark, ODD).columns and cut.count() == len(ODD)
    assert suffix.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [1000, 20])
def test_suffix_dedup_of_a_crowd(spark, crowd):
    """One passage in many documents, between texts of their own: its border windows are one crowded bucket."""
    rng = random.Random(55)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = own(160)
    rows = [(i, own(rng.randint(0, 90)) + passage + own(rng.randint(0, 90))) for i in range(150)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(documents(spark, rows), 100, crowd).collect()}
    assert got == brute_repeats([(d, t.encode()) for d, t in rows], 100)


def test_runs_of_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(56)
    text = "".join(rng.choice("abcde") for _ in range(900))
    rows = [(1, text), (2, text[300:700] + "z" + text[100:350]), (3, text[::-1])]
    monkeypatch.setattr(suffix, "LONG", 128)
    monkeypatch.setattr(suffix, "CHUNK", 200)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(documents(spark, rows), 40).collect()}
    assert got == brute_repeats([(d, t.encode()) for d, t in rows], 40)


def test_maximal_repeats_have_all_occurrences():
    texts = [b"xxABCDEFyy", b"ABCDEFz", b"qABCDr", b"CDEF"]
    got = {(n, frozenset(o)) for n, o in suffix.maximal_repeats(texts, [max(0, len(t) - 3) for t in texts], 4)}
    assert (6, frozenset({(0, 2), (1, 0)})) in got and (4, frozenset({(0, 2), (1, 0), (2, 1)})) in got and (4, frozenset({(0, 4), (1, 2), (3, 0)})) in got


# --- 7, 8 ---------------------------------------------------------------------------------------
def brute_measures(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_quality_measures():
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "é", "\n", "#", "x y z\n", " ", "<", "a b a b a b a b a b "]) for _ in range(rng.randint(0, 40)))
        assert quality.measure(t.encode(), t.encode().split()) == brute_measures(t)


def quality_data(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "house", "walked", "the", "of", "evening", "quiet", "stone"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "win$$$", "###", "click>>>", "now&&&"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return documents(spark, rows + ODD), labels


def test_quality_classifier(spark):
    docs, labels = quality_data(spark)
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    right = [got[i]["kept"] == (i % 4 > 0) for i in range(1, 400, 2)]  # rows without a label
    assert sum(right) / len(right) > 0.95
    assert got[900]["base_failed"] and not got[900]["kept"] and got[905]["base_failed"]
    empty = quality.train(docs, labels.limit(0))
    assert quality.score_quality(docs, empty).where("kept and base_failed").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0


def brute_strength(groups):
    """groups: one list of arrays of p per parent."""
    n = sum(len(x) for g in groups for x in g)
    k = sum(len(g) for g in groups)
    if k - len(groups) < 1 or n <= k:
        return 20.0
    within = sum(((x - x.mean()) ** 2).sum() for g in groups for x in g) / (n - k)
    spread, n2 = 0.0, 0.0
    for g in groups:
        whole = np.concatenate(g)
        spread += sum(len(x) * (x.mean() - whole.mean()) ** 2 for x in g)
        n2 += sum(len(x) ** 2 for x in g) / len(whole)
    between = (spread - (k - len(groups)) * within) / (n - n2)
    return min(10_000.0, max(1.0, within / between)) if between > 0 else 10_000.0


def brute_site_posteriors(rows):
    key = lambda x: "-" if x is None or x != x else x
    hosts, paths = {}, {}
    for h, t, p in zip(rows.host, rows.path, rows.p):
        hosts.setdefault(key(h), []).append(p)
        paths.setdefault(key(h), {}).setdefault(key(t), []).append(p)
    mean = rows.p.mean()
    hk = brute_strength([[np.array(v) for v in hosts.values()]])
    pk = brute_strength([[np.array(v) for v in g.values()] for g in paths.values()])
    host = np.array([(sum(hosts[key(h)]) - p + hk * mean) / (len(hosts[key(h)]) - 1 + hk) for h, p in zip(rows.host, rows.p)])
    own = [paths[key(h)][key(t)] for h, t in zip(rows.host, rows.path)]
    return host, np.array([(sum(o) - p + pk * m) / (len(o) - 1 + pk) for o, p, m in zip(own, rows.p, host)])


def test_site_posteriors_where_hosts_and_paths_differ(spark):
    rng = np.random.default_rng(12)
    rows = []
    for h in range(6):
        for t in range(5):
            level = np.clip(0.5 + 0.07 * h + 0.05 * (t - 2), 0.05, 0.95)
            rows += [(f"h{h}" if h else None, f"t{t}", float(np.clip(rng.normal(level, 0.1), 0.001, 0.999)), int(rng.integers(0, 60))) for _ in range(int(rng.integers(1, 40)))]
    got = bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double, n_words long")).toPandas()
    assert len(got) == len(rows)
    host, path = brute_site_posteriors(got)
    assert np.allclose(got.host_posterior, host) and np.allclose(got.path_posterior, path)
    assert path.max() - path.min() > 0.3
    logit = lambda q: np.log(q / (1 - q))
    own = np.clip(logit(got.p), -12, 12) * got.n_words / (got.n_words + 8)
    assert np.allclose(got.posterior, 1 / (1 + np.exp(-(own + np.clip(logit(path), -3, 3)))))


def test_site_bayes(spark):
    docs, labels = quality_data(spark)
    model = quality.train(docs, labels)
    out = bayes.classify(docs, model)
    rows = out.toPandas()
    assert len(rows) == docs.count()
    host, path = brute_site_posteriors(rows)
    assert np.allclose(rows.host_posterior, host) and np.allclose(rows.path_posterior, path)
    kept = {r["doc_id"] for r in bayes.drop_rejected(docs, model).collect()}
    assert None in kept and all((i in kept) == (i % 4 > 0) for i in range(1, 400, 2))
    assert bayes.classify(docs.limit(0), model).count() == 0


# --- 9 ------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowd", [20_000, 4])
def test_simhash(spark, crowd):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(120)] if i % 5 == 0 or not rows else rng.choice(rows[-5:])[1].split()
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    rows += ODD
    got = simhash.simhash_components(documents(spark, rows), crowd=crowd).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    fp = {i: brute_fingerprint(t or "") for i, t in texts.items()}
    assert all(int(r["fingerprint"], 16) == fp[r["doc_id"]] for r in got)
    ids = sorted(i for i in fp if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(r["component_id"] == (None if r["doc_id"] is None else find(r["doc_id"])) for r in got)


def test_anchors_cover_every_close_pair():
    rng = np.random.default_rng(3)
    syndrome = simhash._syndromes()
    x = rng.integers(0, 1 << 16, 500)
    y = np.where(rng.random(500) < 0.8, x ^ (1 << rng.integers(0, 16, 500)), x)
    rx, cx, hx = simhash.anchors(x, syndrome)
    ry, cy, _ = simhash.anchors(y, syndrome)
    home = {r: c for r, c, h in zip(rx, cx, hx) if h}
    near = {}
    for r, c in zip(ry, cy):
        near.setdefault(r, set()).add(c)
    assert len(home) == 500 and all(home[i] in near[i] for i in range(500))
    assert max(len(v) for v in near.values()) <= 9


def test_drop_near_duplicates(spark):
    docs = documents(spark, ODD)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 900, 903, 904, 905}
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_drop_near_duplicates_of_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(5, text(1)), (5, text(1)), (6, text(1)), (7, text(2)), (7, text(3)), (8, text(2)), (3, text(3)), (None, text(1)), (9, text(4))]
    docs = documents(spark, rows).withColumn("fp", F.lit(1)).withColumn("fp_id", F.lit(2))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
    assert got == sorted([(5, text(1)), (7, text(2)), (3, text(3)), (-1, text(1)), (9, text(4))])


# --- 10 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("part", [256, 2])
def test_perspective_rotation(spark, part):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo\n"), (2, 0, "user", None), (2, None, None, "?"),
        (None, 0, "user", "x"), (3, 5, "a", "t"), (3, 5, "a", "t"), (3, 700, "b", "u")
    ]
    rows += [(4, None, f"r{k % 3}", f"text {k}") for k in range(9)] + [(5, 7, "a", "same")] * 5 + [(5, 8, "b", "é日本")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = chat.rotate(df, part).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(c, role or "unknown") for c, _, role, _ in rows}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), role or "unknown", text or "") for c, t, role, text in rows if c == conv)
        groups = []
        for t in turns:
            block = t[0] // part if t[0] >= 0 else 0
            if groups and groups[-1][0] == block and len(groups[-1][1]) < part:
                groups[-1][1].append(t)
            else:
                groups.append((block, [t]))
        for view in {t[1] for t in turns}:
            start = 0
            for k, (_, group) in enumerate(groups):
                whole, spans = "", []
                for _, role, text in group:
                    head = "<|im_start|>assistant\n" if role == view else f"<|im_start|>user name={role}\n"
                    if role == view:
                        spans.append((len(whole) + len(head), len(whole) + len(head) + len(text) + 11))
                    whole += head + text + "<|im_end|>\n"
                want[conv, view, k] = (len(group), len(spans), start, whole, spans, sum(e - s for s, e in spans))
                start += len(whole)
    assert {(r["conv_id"], r["perspective"], r["part"]): (r["n_turns"], r["n_own"], r["start"], r["rendered"], [tuple(m) for m in r["mask"]], r["mask_chars"]) for r in got} == want
    assert len(got) == len(want) and chat.rotate(df.limit(0)).count() == 0


def test_rotation_is_native(spark, sf):
    from loadweave.llm.queries import QUERIES

    plan = QUERIES["op10_perspective_rotation"](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
