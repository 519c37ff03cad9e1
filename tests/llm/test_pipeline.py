"""The whole chain of the pipeline against brute force, stage by stage, on a given table with planted copies and passages."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from loadweave.llm import quality

from .test_operators import brute_fingerprint, brute_site_posteriors, brute_targets

WIDTH = 100


def judged(docs, labels):
    """Ids that the site posteriors reject, from each document's own probability."""
    rows = quality.document_evidence(docs.selectExpr("doc_id", "text", "source as host", "lang as path"), quality.train(docs, labels), "doc_id", "host", "path").toPandas()
    _, path = brute_site_posteriors(rows)
    logit = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    own = np.clip(logit(rows.p), -12, 12) * rows.n_words / (rows.n_words + 8)
    posterior = 1 / (1 + np.exp(-(own + np.clip(logit(path), -3, 3))))
    assert not (abs(posterior - 0.5) < 1e-9).any()
    return set(rows.doc_id[posterior < 0.5])


def representatives(texts):
    """Smallest ids of the groups whose fingerprints are linked, directly or not, by at most 4 bits."""
    fp = {i: brute_fingerprint(t or "") for i, t in texts.items()}
    ids, root = sorted(fp), {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([fp[i] for i in ids], np.uint64)
    for k, a in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 4) + k + 1:
            x, y = find(a), find(ids[j])
            root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def without_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - WIDTH + 1):
            w = t[p : p + WIDTH]
            if w in seen:
                gone[p : p + WIDTH] = b"\1" * WIDTH
            seen.add(w)
        out[i] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    return out


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The given documents and labels; copies with a word changed, a passage in many documents, and texts of one word planted."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rng, n = random.Random(6), int(docs.doc_id.max()) + 1
    long = docs[docs.text.str.len() > 600].head(12)
    passage = " ".join(f"shared{rng.randrange(9999)}é" for _ in range(40))
    more = []
    for k, r in enumerate(long.itertuples()):
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        for text in (" ".join(words), f"{r.text[k * 7 : 300 + k * 20]} {passage} {r.text[:250]}"):
            more.append({"doc_id": n + len(more), "text": text, "lang": r.lang, "source": r.source, "n_chars": len(text)})
    more += [{"doc_id": n + len(more), "text": "", "lang": "en", "source": long.source.iloc[0], "n_chars": 0}, {"doc_id": n + len(more) + 1, "text": None, "lang": None, "source": None, "n_chars": None}]
    root = str(tmp_path_factory.mktemp("tables"))
    given = spark.read.parquet(f"{sf}/documents.parquet")
    given.unionByName(spark.createDataFrame([tuple(m[c] for c in given.columns) for m in more], given.schema)).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


def test_chain_equals_brute_force(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    good = set(rows) - judged(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    first = representatives({i: rows[i][0] for i in good})
    cut = without_repeats({i: rows[i][0] for i in first})
    assert len(rows) > len(good) > len(first) > 50 and any(cut[i] != (rows[i][0] or "") for i in first)

    got = corpus_pipeline.run(spark, folder).collect()
    copies = Counter(r["doc_id"] for r in got)
    sizes = {i: len(cut[i].encode().split()) for i in cut}
    whole = Counter()
    for i in cut:
        whole[rows[i][1]] += sizes[i]
    target, taken = brute_targets(dict(whole)), Counter()
    for i in cut:
        source = rows[i][1]
        rate = target[source] / whole[source] if sizes[i] else 1
        assert copies[i] in ({1} if not sizes[i] else {int(rate + 1e-9), int(np.ceil(rate - 1e-9))}), i
        taken[source] += copies[i] * sizes[i]
    assert set(copies) <= set(cut)
    for source, t in target.items():
        assert abs(taken[source] - t) <= max(sizes[i] for i in cut if rows[i][1] == source)
    assert sum(taken.values()) == pytest.approx(sum(whole.values()), rel=0.05)

    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    told = {}
    for i in cut:
        ids = enc.encode_ordinary(cut[i])
        told[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(cut[i].encode()).hexdigest())
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == told[r["doc_id"]] for r in got)
