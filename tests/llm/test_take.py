"""Each row is taken as often as mix() says, whatever its doc_id."""

from collections import Counter

from pyspark.sql import functions as F

from loadweave.llm import cube


def test_take_follows_mix_row_by_row(spark):
    ids = F.when(F.col("id") % 3 == 0, F.col("id") % 12).when(F.col("id") % 3 == 1, F.col("id"))  # repeated, own, null
    text = F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit(" w"), (F.col("id") * 7 % 40).cast("int")))
    df = spark.range(600).select(ids.alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), "id")
    want = {r["id"]: r["copies"] for r in cube.mix(df, block=120, carry=["id"]).collect()}
    assert len(want) == 600 and len(set(want.values())) > 2
    got = Counter(r["id"] for r in cube.take(df, block=120).collect())
    assert got == {k: n for k, n in want.items() if n}
    again = Counter(r["id"] for r in cube.take(df.repartition(7), block=120).collect())
    assert got == again
    plain = {(r["doc_id"], r["size"], r["uid"]): r["copies"] for r in cube.mix(df, block=120).collect()}
    assert sum(plain.values()) == sum(got.values())
