"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For each participant (a role that speaks in the conversation) the dialogue is rendered with that
speaker as the assistant and all others as named users; the mask marks what the assistant says.
A conversation is rendered in parts of at most PART consecutive turns, so one that is very long is many
rows that tasks share; prefix sums over the parts' lengths, which are known before anything is rendered,
place each part in the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """turns(conv_id, turn, role, text, ...) -> one row per conversation, perspective and part: conv_id,
    perspective, part (0, 1, ... in order), n_turns, n_own (the speaker's turns), start (characters of the
    dialogue before this part), rendered, mask (array of [s, e): character spans in rendered that the
    speaker said, closing mark included) and mask_chars. Parts are the turns of `part` consecutive turn
    numbers, cut again after every `part` turns where numbers repeat.

    Turns go by number, ties by role and text; a null turn number comes first. A null role speaks
    as "unknown", a null text is empty; both stay turns. A null conv_id is one conversation.
    Repeated rows are turns of their own. Other columns are ignored; no rows, no result."""
    clean = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.expr(f"turn div {part}"))
    rank = F.row_number().over(W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")) - 1
    clean = clean.withColumn("piece", F.floor(rank / part))
    key = ["conv_id", "block", "piece"]
    parts = clean.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def head(role: Column) -> Column:
        return F.concat(F.lit(f"{OPEN}user name="), role, F.lit("\n"))

    own_head, close = F.lit(f"{OPEN}assistant\n"), F.lit(CLOSE)
    said = clean.groupBy(*key, "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    said = said.withColumn("as_user", F.col("chars") + F.col("n") * (F.length(head(F.col("role"))) + F.length(close)))
    sizes = said.groupBy(*key).agg(F.sum("as_user").alias("as_user"))
    sizes = sizes.withColumn("part", F.row_number().over(W.partitionBy("conv_id").orderBy("block", "piece")) - 1)
    cast = said.select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    spoken = said.select(*(F.col(k).alias(f"s_{k}") for k in key), "role", "n")
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key]
    views = sizes.join(cast, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    views = views.join(spoken, [*same, F.col("perspective") == F.col("role")], "left")
    chars = F.col("as_user") - F.coalesce("n", F.lit(0)) * (F.length(head(F.col("perspective"))) - F.length(own_head))
    before = W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = views.select(*(F.col(k).alias(f"s_{k}") for k in key), "perspective", "part", F.coalesce(F.sum(chars).over(before), F.lit(0)).alias("start"))
    views = parts.join(starts, same)

    def piece(x: Column) -> Column:
        own = x["role"] == F.col("perspective")
        lead = F.when(own, own_head).otherwise(head(x["role"]))
        return F.struct(own.alias("own"), F.length(lead).alias("head"), F.concat(lead, x["text"], close).alias("said"))

    views = views.withColumn("pieces", F.transform("turns", piece)).drop("turns")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["said"])
        span = F.struct((acc["at"] + x["head"]).cast("int").alias("s"), end.cast("int").alias("e"))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("mask"))
    views = views.withColumn("mask", F.aggregate("pieces", zero, step, lambda acc: acc["mask"]))
    return views.select(
        "conv_id",
        "perspective",
        F.col("part").cast("long").alias("part"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda x: x["own"])).cast("long").alias("n_own"),
        "start",
        F.array_join(F.transform("pieces", lambda x: x["said"]), "").alias("rendered"),
        "mask",
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("mask_chars"),
    )


def mask_text(mask: str = "mask") -> Column:
    """The mask as text, s-e spans joined by commas, for digests and SQL engines."""
    return F.array_join(F.transform(mask, lambda x: F.concat_ws("-", x["s"], x["e"])), ",")


SQL = f"""
WITH clean AS (
  SELECT conv_id, coalesce(CAST(turn AS BIGINT), -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
ranked AS (
  SELECT *, turn // {PART} AS block, (row_number() OVER (PARTITION BY conv_id, turn // {PART} ORDER BY turn, role, text) - 1) // {PART} AS piece FROM clean),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY block, piece) - 1 AS part FROM ranked),
said AS (
  SELECT c.conv_id, v.role AS perspective, c.part, c.turn, c.role, c.text, c.role = v.role AS own,
    CASE WHEN c.role = v.role THEN '{OPEN}assistant' || chr(10) ELSE '{OPEN}user name=' || c.role || chr(10) END AS head
  FROM numbered c JOIN (SELECT DISTINCT conv_id, role FROM clean) v ON c.conv_id IS NOT DISTINCT FROM v.conv_id),
placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS whole,
    sum(length(head || text || '<|im_end|>' || chr(10))) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text
      ROWS UNBOUNDED PRECEDING) AS e
  FROM said),
parts AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
    string_agg(whole, '' ORDER BY turn, role, text) AS rendered,
    coalesce(string_agg(CAST(e - length(whole) + length(head) AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY turn, role, text) FILTER (own), '') AS mask,
    coalesce(sum(length(whole) - length(head)) FILTER (own), 0) AS mask_chars
  FROM placed GROUP BY ALL)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, n_turns, n_own,
  CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  rendered, mask, CAST(mask_chars AS BIGINT) AS mask_chars
FROM parts
"""
