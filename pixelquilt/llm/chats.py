"""Chat formatting: logged snapshots of a conversation collapse into the longest, which is rendered.

The rolling hash of a conversation's first k turns is that of its first k - 1, xor a hash of
(k, role, text); two 64-bit hashes stand for a prefix.  A conversation is dropped by anti-join
if its own hashes are those of a proper prefix of another, or of an equal conversation with a
smaller id; what remains is maximal.

A conversation's turns are dealt by (conversation, block of ``BLOCK`` turn numbers): ranks and
hashes are summed up by block and carried from block to block, so one conversation with a third
of all turns is many groups of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquilt.llm.common import materialize

#: Turn numbers of one block; also what one rendered part holds.
BLOCK = 1024
#: The turn markers.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame) -> DataFrame:
    """Turns with a conversation id, their block, and two hashes of role and text."""
    rows = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 60)))
    return rows.withColumns({"block": block, "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept, covered_by): covered_by is the longest conversation that begins with
    this one (of several, and of equal ones, the smallest id); null where kept.

    Turns go by (turn number, hashes of role and text), a null number first.  A null role reads as
    'unknown', a null text as empty; turns without a conversation id are left out.  An empty
    table gives an empty one.
    """
    rows = materialize(_turns(turns).select("conv_id", "block", "turn", "h1", "h2"), "turns")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "h1", "h2")
    rows = rows.withColumn("r", F.row_number().over(inside))
    sizes = rows.groupBy("conv_id", "block").agg(F.max("r").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "turn-blocks")
    rows = rows.join(offsets.select("conv_id", "block", "start"), ["conv_id", "block"]).withColumn("k", F.col("start") + F.col("r"))
    rolled = rows.select("conv_id", "block", "k", F.xxhash64("k", "h1").alias("g1"), F.xxhash64("h2", "k").alias("g2"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rolled.withColumns({"p1": F.expr("bit_xor(g1)").over(so_far), "p2": F.expr("bit_xor(g2)").over(so_far)})
    rolled = materialize(rolled, "turn-hashes")
    ends = rolled.groupBy("conv_id", "block").agg(F.expr("bit_xor(g1)").alias("e1"), F.expr("bit_xor(g2)").alias("e2"))
    carried = ends.select("conv_id", "block", *[F.coalesce(F.expr(f"bit_xor({e})").over(before), F.lit(0).cast("long")).alias(c) for e, c in (("e1", "c1"), ("e2", "c2"))])
    lengths = offsets.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    whole = carried.join(lengths, "conv_id")
    prefixes = rolled.join(whole, ["conv_id", "block"]).select("conv_id", "n_turns", "k", F.expr("p1 ^ c1").alias("p1"), F.expr("p2 ^ c2").alias("p2"))
    prefixes = materialize(prefixes, "turn-prefixes")

    mine = prefixes.where("k = n_turns").select("conv_id", "n_turns", "p1", "p2")
    #: Summed up before the shuffle, so a first turn that all share is a row from each task.
    longest = F.max(F.struct("n_turns", (-F.col("conv_id")).alias("id")))
    extended = prefixes.where("k < n_turns").groupBy(F.col("k").alias("n_turns"), "p1", "p2").agg(longest.alias("x"))
    equal = mine.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("least"))
    own = equal.join(extended, ["n_turns", "p1", "p2"], "left").select("n_turns", "p1", "p2", "least", (-F.col("x.id")).alias("longer"))
    by = F.coalesce("longer", F.when(F.col("least") < F.col("conv_id"), F.col("least")))
    covered = mine.join(own, ["n_turns", "p1", "p2"]).select("conv_id", "n_turns", F.lit(False).alias("kept"), by.alias("covered_by")).where("covered_by is not null")
    covered = materialize(covered, "covered")
    maximal = mine.join(covered, "conv_id", "left_anti").select("conv_id", "n_turns", F.lit(True).alias("kept"), F.lit(None).cast("long").alias("covered_by"))
    return maximal.unionByName(covered)


def turn_text(role: Column, text: Column) -> Column:
    """One turn between its markers; markers that stand in the text itself are opened up."""
    plain = F.replace(text, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), plain, F.lit(CLOSE + "\n"))


def render(turns: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(conv_id, part, n, text): conversations (those in ``kept``) in parts, in order, of at most BLOCK
    turn numbers; one after another they are the formatted conversation."""
    rows = _turns(turns)
    if kept is not None:
        blocks = rows.select("conv_id", "block").distinct().join(kept.select("conv_id"), "conv_id", "left_semi")
        rows = rows.join(blocks, ["conv_id", "block"])
    piece = F.struct("turn", "h1", "h2", turn_text(F.col("role"), F.col("text")).alias("s"))
    parts = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(piece)).alias("x"))
    return parts.select("conv_id", F.col("block").alias("part"), F.size("x").cast("long").alias("n"), F.array_join("x.s", "").alias("text"))
