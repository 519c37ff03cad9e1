"""Importance resampling toward a target distribution (hashed n-gram features, Gumbel top-k).

Each partition's texts pass through a DuckDB connection of their task: SQL lower-cases, unnests words, builds n-grams in
windows and counts them by bucket, the bucket being a registered zlib CRC. The counts, one row a document, are spilled to
Parquet in the shared folder, from where Spark merges them over all documents, derives each bucket's gain and scores.

A document's weight is the mean gain of its features: how much more frequent they are in the target. Its score adds a Gumbel
variate made from its id, so that the highest scores are a draw without replacement whose odds follow the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
SLICE = 1 << 22  # bytes of text that one SQL statement takes
PIECE = 1 << 20  # characters of a long text that it takes at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")  # what ends a word, before lower-casing
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def counting_sql(n: int, buckets: int) -> str:
    """SQL over docs(r, text, skip): r, n_words, n_features and the lists of buckets and counts (a bucket may be listed more than
    once). The first `skip` words of a row only lead in: n-grams that end in them were counted before."""
    grams = ["SELECT r, w AS g FROM words WHERE pos > skip"]
    for k in range(2, n + 1):
        window = f"string_agg(w, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        grams.append(f"SELECT r, g FROM (SELECT r, pos, skip, {window} AS g FROM words) WHERE pos >= {k} AND pos > skip")
    return f"""
WITH found AS (SELECT r, skip, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM docs),
words AS (SELECT r, skip, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM found),
counted AS MATERIALIZED (SELECT r, g, count(*)::INTEGER AS c FROM ({" UNION ALL ".join(grams)}) GROUP BY r, g),
dealt AS MATERIALIZED (SELECT g, (crc(g) % {buckets})::INTEGER AS b FROM (SELECT DISTINCT g FROM counted)),
lists AS (SELECT r, list(b) AS buckets, list(c) AS counts, sum(c)::BIGINT AS n_features FROM counted JOIN dealt USING (g) GROUP BY r)
SELECT r, (len(ws) - skip)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM found LEFT JOIN lists USING (r) ORDER BY r"""


class Counter:
    """One task's DuckDB connection. A statement takes at most SLICE bytes of short texts, or one piece of a long one."""

    def __init__(self, n: int, buckets: int, piece: int):
        self.con = duckdb.connect(config={"threads": 1})
        self.con.execute("SET temp_directory = ''")  # statements are small; nothing goes to a folder of one machine
        self.con.create_function("crc", lambda g: zlib.crc32(g.encode()), ["VARCHAR"], "BIGINT")
        self.n, self.sql, self.piece = n, counting_sql(n, buckets), piece

    def count(self, texts: list[str], skips: list[int]) -> pa.Table:
        rows = pa.table({"r": pa.array(range(len(texts)), pa.int32()), "text": pa.array(texts, pa.large_string()), "skip": pa.array(skips, pa.int32())})
        self.con.register("docs", rows)
        out = self.con.sql(self.sql).to_arrow_table()
        self.con.unregister("docs")
        return out.drop_columns("r")

    def long_text(self, text: str) -> pa.Table:
        """The same for one text, in pieces that end between words; the last n - 1 words lead in the next one."""
        totals: dict[int, int] = {}
        n_words = n_features = at = 0
        lead: list[str] = []
        while at < len(text):
            found = BETWEEN.search(text, min(len(text), at + self.piece))
            end = found.end() if found else len(text)
            out = self.count([" ".join([*lead, text[at:end]])], [len(lead)])
            n_words, n_features = n_words + out["n_words"][0].as_py(), n_features + out["n_features"][0].as_py()
            for b, c in zip(out["buckets"][0].as_py(), out["counts"][0].as_py()):
                totals[b] = totals.get(b, 0) + c
            if self.n > 1:
                own, back = [], end
                while len(own) < self.n - 1 and back > at:  # the last words, from a tail that grows
                    back = max(at, back - 4096)
                    start = BETWEEN.search(text, back, end)
                    own = [w for w in BETWEEN.split(text[start.end() if start and back > at else back : end]) if w]
                lead = [*lead, *own][-(self.n - 1) :]
            at = end
        return pa.table({"n_words": [n_words], "n_features": [n_features], "buckets": pa.array([list(totals)], pa.list_(pa.int32())), "counts": pa.array([list(totals.values())], pa.list_(pa.int32()))})

    def of(self, texts: list[str]) -> Iterator[pa.Table]:
        held, size = [], 0
        for text in texts:
            if len(text) > self.piece:
                if held:
                    yield self.count(held, [0] * len(held))
                held, size = [], 0
                yield self.long_text(text)
                continue
            held.append(text)
            size += len(text)
            if size >= SLICE:
                yield self.count(held, [0] * len(held))
                held, size = [], 0
        if held:
            yield self.count(held, [0] * len(held))


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS, keep: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """One row per row of texts(text, ...): the keep columns, n_words, n_features (runs of 1 to n words, repeats counted) and
    arrays of buckets and counts. A null or empty text has no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, types = Counter(n, buckets, piece), [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            at = 0
            for part in counter.of([x or "" for x in batch.column("text").to_pylist()]):
                columns = [part[c].cast(t).combine_chunks() for c, t in zip(("n_words", "n_features", "buckets", "counts"), types)]
                kept = [batch.column(c).slice(at, part.num_rows) for c in keep]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, "n_words", "n_features", "buckets", "counts"])

    fields = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keep)
    return texts.select(*keep, "text").mapInArrow(run, f"{fields}n_words long, n_features long, buckets array<int>, counts array<int>")


def _merged(counts: DataFrame, name: str) -> DataFrame:
    """(bucket, name): occurrences in all rows."""
    each = counts.select(F.inline(F.arrays_zip("buckets", "counts"))).toDF("bucket", "count")
    return each.groupBy("bucket").agg(F.sum("count").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row (gains array<long>): per bucket, floor(1000 ln) of its smoothed share in the target over that in the source.
    As many entries as there are buckets, however large the tables."""
    s_all, t_all = (x.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0] for x in (source, target))
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_merged(source, "s"), "bucket", "left").join(_merged(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(s_all + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets)))
    both = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    return both.agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("g")).select(F.col("g.gain").alias("gains"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of the id's uniform variate; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_words, n_features, weight, score, written. target(text, ...) is what
    documents are to resemble; other columns of both are ignored.

    Null and empty texts have no features and weight 0. A null doc_id has no variate: its score is null. Rows that repeat a
    doc_id are documents of their own with one variate. Empty tables are allowed: without a target all buckets are as
    frequent there, without documents there are no rows."""
    own = materialize(bucket_counts(docs, n, buckets, ["doc_id"], piece))
    aim = materialize(bucket_counts(target, n, buckets, (), piece))
    table = F.broadcast(gains(own, aim, buckets))  # one row of `buckets` numbers
    gained = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get("gains", b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    weight = F.when(F.col("n_features") > 0, F.floor(gained / F.col("n_features"))).otherwise(0)
    out = own.crossJoin(table).select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight"))
    out = materialize(out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    discard(own)
    discard(aim)
    return out


def draw(scored: DataFrame, percent: int = 10, least: int = LEAST_WORDS, block: int = 256) -> DataFrame:
    """scored with rank: 1, 2, ... by falling score, ties to the smaller doc_id, for the highest floor(percent N / 100) of the N rows
    with a score and at least `least` words; null for all others.

    Scores are counted first; prefix sums over the counts, in two levels, say where each score's ranks begin, so no task
    ranks all rows. Rows alike in all columns are counted, ranked as one and written out again, so copies of an id are no
    hot group."""
    able = F.col("score").isNotNull() & (F.col("n_words") >= least)
    counts = scored.where(able).groupBy("score").count().withColumn("block", F.floor(F.col("score") / block))
    down = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)  # one row for each `block` scores
    blocks = counts.groupBy("block").agg(F.sum("count").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
    inside = W.partitionBy("block").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.join(blocks.drop("n"), "block").select("score", "count", (F.col("above") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("above"))
    starts = materialize(starts)  # at most as many rows as scores: weights and variates have bounded ranges
    drawn = percent * (starts.agg(F.sum("count")).first()[0] or 0) // 100
    lowest = starts.where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = F.coalesce(able & (F.col("score") >= lowest), F.lit(False))
    order = [c for c in scored.columns if c not in ("score", "doc_id")]
    alike = scored.where(high).groupBy(*scored.columns).agg(F.count("*").alias("alike"))
    before = W.partitionBy("score").orderBy("doc_id", *order).rowsBetween(W.unboundedPreceding, -1)
    placed = alike.withColumn("before", F.coalesce(F.sum("alike").over(before), F.lit(0))).join(starts.drop("count"), "score")
    placed = placed.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    placed = placed.withColumn("rank", F.col("above") + F.col("before") + F.col("again"))
    ranked = placed.select(*scored.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


CRC_SQL = """
table_of AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) AS s(i))),"""


def crc_sql(hexed: str) -> str:
    """zlib's CRC-32 of the bytes that a text of hex digits names, in SQL beside CRC_SQL's table_of."""
    octets = f"list_transform(range(length({hexed}) // 2), lambda k: ('0x' || substr({hexed}, (2 * k + 1)::INTEGER, 2))::UBIGINT)"
    folded = f"list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::INTEGER]))"
    return f"xor({folded}, 4294967295::UBIGINT)"


SQL = f"""
WITH {CRC_SQL.strip()}
own AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM benchmark),
names AS (SELECT w, hex(w) AS x FROM (SELECT w FROM own UNION SELECT w FROM aim)),
dealt AS (SELECT w, {crc_sql("x")} % {BUCKETS} AS b FROM names, table_of),
totals AS (SELECT (SELECT count(*) FROM own) AS s_all, (SELECT count(*) FROM aim) AS t_all),
s AS (SELECT b, count(*) AS s FROM own JOIN dealt USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM aim JOIN dealt USING (w) GROUP BY b),
gains AS (
  SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (b), totals),
sums AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN dealt USING (w) JOIN gains USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
