"""Chat formatting with cumulative-snapshot collapse, with DataFrame functions only.

Logs hold snapshots of conversations as they grew. Every turn's rolling prefix
hash covers its conversation up to it. A conversation whose whole hash is some
other's proper prefix, or equals that of one with a smaller id, is dropped by
anti-joins; the rest are maximal and are rendered.

A prefix hash is three 40-bit sums of hashes of (turn, role, text), so running
sums give it; long conversations sum by blocks of turns first, and no group is
longer than a block, or the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SUMS = ("h0", "h1", "h2", "rows")


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(kept, turns): the maximal conversations as (conv, copies), and all distinct turn rows with their block.

    Rows without a conversation id belong to none and are left out; repeated
    rows count once; several rows of one turn form one step, in the order of
    role and text; a null turn comes before all others.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    t = t.filter("conv IS NOT NULL").distinct().withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 40))))
    t = scratch.keep(t, "turns")
    null = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in ("turn", "role", "text")]
    hashed = t.select("conv", "block", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), *[F.pmod(F.xxhash64(F.lit(i), *null), F.lit(1 << 40)).alias(f"h{i}") for i in range(3)])
    step = hashed.groupBy("conv", "block", "turn").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(3)], F.count("*").alias("rows"))
    total = step.groupBy("conv", "block").agg(*[F.sum(c).alias(c) for c in SUMS])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("conv", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b_{c}") for c in SUMS])
    so_far = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    prefix = step.select("conv", "block", "turn", *[F.sum(c).over(so_far).alias(c) for c in SUMS]).join(before, ["conv", "block"])
    prefix = scratch.keep(prefix.select("conv", "turn", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in SUMS]), "prefixes")
    last = prefix.groupBy("conv").agg(F.max("turn").alias("turn"))
    whole = prefix.join(last, ["conv", "turn"], "left_semi").groupBy("turn", *SUMS).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    inner = prefix.join(last, ["conv", "turn"], "left_anti").select("turn", *SUMS).distinct()
    kept = whole.join(inner, ["turn", *SUMS], "left_anti").select("conv", "copies")
    return scratch.keep(kept, "kept"), t


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 256) -> DataFrame:
    """conv_col, part, n_rows, copies, chat: the maximal conversations in ChatML.

    A conversation's turns are rendered in parts of `block` turn numbers, so
    that no group is unbounded; most have one part. Parts count from 0 in
    order; `copies` counts equal whole conversations. A null role is
    "unknown", a null text empty.
    """
    kept, t = collapse(turns, conv_col, turn_col, role_col, text_col, block)
    parts = t.join(kept, "conv").groupBy("conv", "block", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    no = Window.partitionBy("conv").orderBy("block")
    said = F.transform("rows", lambda r: F.concat(F.lit("<|im_start|>"), F.coalesce(r["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(r["text"], F.lit("")), F.lit("<|im_end|>\n")))
    out = parts.select("conv", (F.row_number().over(no) - 1).cast("long").alias("part"), F.size("rows").cast("long").alias("n_rows"), "copies", F.array_join(said, "").alias("chat"))
    return out.withColumnRenamed("conv", conv_col)
