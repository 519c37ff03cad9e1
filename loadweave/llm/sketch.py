"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, ascending. The sketch of a union is the k smallest of the
united sketches, so parts merge in any order; resemblance, containment and the number of distinct shingles are estimated from
sketches alone, and exactly where a text has at most k shingles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, fresh, materialize

K = 128
SHINGLE = 5
SPACE = r"[\x20\x09-\x0D]+"
LOWEST, SPAN = -(2.0**63), 2.0**64  # hashes are signed


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words between ASCII white space, in order; none for null."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct numbers of an array."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = SHINGLE) -> DataFrame:
    """df and a column `name`: the sketch of the shingles of `width` words of column `text`. Fewer words are one shingle; a null or
    empty text, or one of white space, has none. Words count as they are written."""
    w = fresh(df, "word_hashes")
    size = F.size(w)
    shingle = lambda h, i: F.xxhash64(h, *(F.get(w, i + j) for j in range(1, width)))
    many = F.slice(F.transform(w, shingle), 1, size - (width - 1))
    few = F.when(size > 0, F.array(F.aggregate(w, F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return df.withColumn(w, word_hashes(F.col(text))).withColumn(name, F.when(size >= width, bottom(many, k)).otherwise(few)).drop(w)


def as_text(sketch: Column | str) -> Column:
    """The hashes as 16 hex digits each, joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all; 1 for two texts without any."""
    both = union(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) over the share of all hash values below the k-th; exact below k."""
    share = (F.element_at(sketch, k).cast("double") - LOWEST + 1.0) / SPAN
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too; 1 where a has none."""
    common = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge(sketches: DataFrame, keys: Sequence[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for all rows of each key. Only the k smallest hashes of a key in each task's rows are shuffled, so the rows
    of a hot key never meet. Null sketches count as empty; a key whose rows have no hash has an empty sketch."""
    h = fresh(sketches, "hash")
    each = sketches.select(*keys, F.explode_outer(sketch).alias(h)).distinct()
    place = fresh(sketches, "place")
    low = each.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(F.col(h).asc_nulls_last()))).where(F.col(place) <= k)
    return low.groupBy(*keys).agg(F.array_sort(F.collect_list(h)).alias(sketch))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_chars, copies, prev_id, prev_mark, prev_chars): distinct documents in order of falling doc_id (null last, then
    by mark, a hash of the text), each with the one before it; before the first comes the last.

    Keys are dealt by range, so that each task orders a stretch; the stretches' ends, a row each, are joined to the next."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = docs.select("doc_id", mark.alias("mark"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    keys = keys.groupBy("doc_id", "mark", "n_chars").agg(F.count("*").alias("copies"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    dealt = materialize(keys.repartitionByRange(*order).withColumn("stretch", F.spark_partition_id()))
    here = F.struct("doc_id", "mark", "n_chars")
    inside = dealt.withColumn("prev", F.lag(here).over(W.partitionBy("stretch").orderBy(*order)))
    last = F.max_by(here, F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), F.col("mark"))).alias("last")
    ends = dealt.groupBy("stretch").agg(last)  # as many rows as stretches
    turn = W.orderBy("stretch")
    final = F.last("last").over(turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = ends.select("stretch", F.coalesce(F.lag("last").over(turn), final).alias("before"))
    out = inside.join(ends, "stretch").withColumn("prev", F.coalesce("prev", "before"))
    prev = F.col("prev")
    return out.select("doc_id", "mark", "n_chars", "copies", prev["doc_id"].alias("prev_id"), prev["mark"].alias("prev_mark"), prev["n_chars"].alias("prev_chars"))


def likeness_to_edits(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, distinct_shingles, contained_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document,
    in order of falling doc_id; the last one's next is the first. near_edited and near_next are resemblances of the text to
    the edited and to the next text, contained_next the share of its shingles that the next one has.

    Null text is empty. Null doc_ids come last. Rows that repeat a doc_id follow one another by a hash of the text; equal
    rows are each other's next, and only the last of them meets the next document. One row alone is its own next. Other
    columns are ignored; no rows, no result. Texts are dealt by key once, and of the next text only the part used moves again."""
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("m"), text.alias("text"))
    links = materialize(successors(docs))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))
    known = whole.join(links, same).drop("d", "m")
    repeated = known.where("copies > 1").dropDuplicates(["doc_id", "mark"])
    once = known.where("copies = 1").unionByName(repeated)
    sketched = with_sketch(once, "text", "sketch", k, width)
    heads = sketched.select(
        F.col("prev_id").alias("d"), F.col("prev_mark").alias("m"), F.substring("text", F.lit(1), (F.floor(F.col("prev_chars") / 2)).cast("int")).alias("head"), F.col("sketch").alias("next_sketch")
    )
    own = sketched.select("doc_id", "mark", "n_chars", "copies", "text", "sketch")
    met = own.join(heads, same)
    half = F.floor(F.col("n_chars") / 2).cast("int")

    def edited(head: Column) -> Column:
        return F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), head)

    # of equal rows all but one have their own text next
    alone = met.withColumn("times", F.lit(1).cast("long"))
    copies = own.where("copies > 1").select("*", F.substring("text", F.lit(1), half).alias("head"), F.col("sketch").alias("next_sketch"), (F.col("copies") - 1).alias("times"))
    names = ["doc_id", "n_chars", "text", "sketch", "head", "next_sketch", "times"]
    rows = alone.select(*names).unionByName(copies.select(*names))
    rows = with_sketch(rows.withColumn("edited", edited(F.col("head"))).drop("text", "head"), "edited", "edited_sketch", k, width)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    out = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"), resemblance(a, b, k).alias("near_edited"),
        resemblance(a, c, k).alias("near_next"), distinct_shingles(a, k).alias("distinct_shingles"), containment(a, c, k).alias("contained_next"), "times",
    )
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("time", "times")
