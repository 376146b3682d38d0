"""Chat logs: snapshots that a longer conversation continues are dropped, the others rendered. DataFrame functions only.

A conversation that is logged after every turn leaves snapshots, each the beginning of the next. Every turn gets a
rolling hash of all turns up to it. A conversation whose last hash is an inner hash of another one is a snapshot; an
anti-join keeps the others, and of equal ones the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stillwave.llm.common import stash

#: Turn numbers of a part of a conversation: a very long one is hashed in parts.
PART = 1024
#: How a turn is written. Its markers are broken where they occur in a text.
BEFORE, BETWEEN, AFTER = "<|im_start|>", "\n", "<|im_end|>\n"
MARK, BROKEN = "<|", "< |"


def prefixes(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn: conv, pos (from 1), n (turns in all), h1, h2 (hash of the turns up to it), role, text.

    The hash is the XOR of hashes of position, role and text, so that parts of a conversation are hashed side by side
    and joined by their totals. Turns are ordered by number, null last, then by role and text.
    """
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.coalesce(F.floor(F.col(turn) / PART), F.lit(1 << 60)).cast("long").alias("part"))
    inside = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_last("turn"), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    rows = rows.withColumn("rank", F.row_number().over(inside))
    counts = (rows.groupBy("conv", "part").agg(F.count("*").alias("c"))
              .select("conv", "part", F.coalesce(F.sum("c").over(parts), F.lit(0)).alias("skip"), F.sum("c").over(whole).alias("n")))
    rows = rows.join(counts, ["conv", "part"]).withColumn("pos", F.col("skip") + F.col("rank"))
    own = lambda seed: F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")),
                                  F.col("text").isNull(), F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"x1": own(1), "x2": own(2)})
    totals = (rows.groupBy("conv", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
              .select("conv", "part", *[F.coalesce(F.bit_xor(t).over(parts), F.lit(0)).alias(f"b{t}") for t in ("t1", "t2")]))
    rows = rows.withColumns({"r1": F.bit_xor("x1").over(upto), "r2": F.bit_xor("x2").over(upto)})
    return rows.join(totals, ["conv", "part"]).select(
        "conv", "pos", "n", F.col("r1").bitwiseXOR(F.col("bt1")).alias("h1"),
        F.col("r2").bitwiseXOR(F.col("bt2")).alias("h2"), "role", "text")


def written(role: Column, text: Column) -> Column:
    """One turn as text; a null role is ``unknown``, a null text empty."""
    safe = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit(MARK), F.lit(BROKEN))
    return F.concat(F.lit(BEFORE), safe(role, "unknown"), F.lit(BETWEEN), safe(text, ""), F.lit(AFTER))


def maximal_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                          text: str = "text") -> DataFrame:
    """Conversations that no other one continues, rendered: the id, ``n_turns``, ``n_copies``, ``rendered``.

    Of equal conversations the smallest id stays and ``n_copies`` counts them. Turns without a conversation id belong
    to none and are left out. Repeated turns stay and count. Columns of other names are not looked at. An empty table
    gives an empty result. Hot first turns and copies are added up before the shuffle; only a conversation that stays
    is put together in one place, since it is one value of the result.
    """
    rows = stash(prefixes(turns, conv, turn, role, text))
    last = rows.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = rows.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    kept = last.join(inner, ["n", "h1", "h2"], "left_anti").select("conv", "n_copies")
    return (rows.join(kept, "conv").groupBy("conv").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("n_copies").alias("n_copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", written(F.col("role"), F.col("text")).alias("line")))),
                                 lambda s: s["line"]), "").alias("rendered"))
        .withColumnRenamed("conv", conv))
