"""Chat formatting: logged snapshots collapse to the longest conversation, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.ordering import ordered_row_number
from tidewatch.session import written

#: Turns in one rendered part, and in one block of the rolling hash.
PART = 1024
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, low, high, low_before, high_before) of every turn.

    Positions count from 1 in the order of turn, then of a hash of role and text.
    low and high are 128 bits for the conversation up to the turn: a combination of
    hashes of (position, role, text) that is summed in any order, so conversations
    of any length are cut into blocks, whose sums are carried forward.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    numbered = ordered_row_number(rows, ["conv_id"], F.col("turn"), F.xxhash64("role", "text"), "position")
    numbered = written(numbered.select("conv_id", F.col("position").cast("long").alias("position"), "role", "text"), "turns")
    hashed = numbered.select(
        "*", F.floor((F.col("position") - 1) / PART).alias("block"),
        F.xxhash64("position", "role", "text").alias("h_low"), F.xxhash64(F.lit("high"), "text", "role", "position").alias("h_high"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = hashed.withColumns({"i_low": F.bit_xor("h_low").over(upto), "i_high": F.bit_xor("h_high").over(upto)})
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h_low").alias("s_low"), F.bit_xor("h_high").alias("s_high"))
    # Only conversations longer than a block carry anything; one row for each further block.
    carried = blocks.select(
        "conv_id", "block", F.bit_xor("s_low").over(earlier).alias("c_low"), F.bit_xor("s_high").over(earlier).alias("c_high")
    ).filter("block > 0").withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    joined = inside.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")

    def whole(kind: str) -> Column:
        return F.col(f"i_{kind}").bitwiseXOR(F.coalesce(f"c_{kind}", F.lit(0)))

    return joined.select(
        "conv_id", "position", "role", "text", whole("low").alias("low"), whole("high").alias("high"),
        whole("low").bitwiseXOR(F.col("h_low")).alias("low_before"), whole("high").bitwiseXOR(F.col("h_high")).alias("high_before"),
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no prefix of a longer one, one of each set of equals."""
    last = F.max(F.struct("position", "low", "high")).alias("last")
    whole = prefixes.groupBy("conv_id").agg(last).select("conv_id", "last.*")
    whole = whole.groupBy("position", "low", "high").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    # What stands before a later turn is the prefix of a longer conversation; equal prefixes are one row.
    shorter = prefixes.filter("position > 1").select(
        (F.col("position") - 1).alias("position"), F.col("low_before").alias("low"), F.col("high_before").alias("high")
    ).distinct()
    kept = whole.join(shorter, ["position", "low", "high"], "left_anti")
    return kept.select("conv_id", F.col("position").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, part: int = PART, start: str = START, middle: str = MIDDLE, end: str = END) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): the maximal conversations of ``turns`` (conv_id, turn, role, text), rendered.

    A conversation whose turns are the first turns of a longer one, by role and text,
    is a snapshot of it and is left out; of equal conversations the smallest conv_id
    stays, and n_copies counts them. A conversation is one row, part 0, unless it has
    more than ``part`` turns: then its text goes on in parts 1, 2, and so on, so that
    no task collects a conversation of unbounded length.

    Repeated rows are one turn; turns that share a number are ordered by a hash of role
    and text; a null number comes first. Null roles and texts are empty. Rows without
    conv_id are one conversation. Other columns are ignored.
    """
    prefixes = written(rolling_prefixes(turns), "prefixes")
    kept = maximal_conversations(prefixes).withColumnRenamed("conv_id", "_kept")
    chosen = prefixes.select("conv_id", "position", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")))
    said = F.concat(F.lit(start), "role", F.lit(middle), "text", F.lit(end))
    number = F.floor((F.col("position") - 1) / part).alias("part")
    parts = chosen.select("conv_id", "n_turns", "n_copies", number, F.struct("position", said.alias("said")).alias("turn"))
    gathered = parts.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select("conv_id", "part", "n_turns", "n_copies", F.array_join("turns.said", "").alias("text"))
