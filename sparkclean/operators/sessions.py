"""Gap sessions: rows follow each other until the gap to the row before is too long."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots that are ordered together.
BLOCK = 4096


def gap_sessions(rows: DataFrame, ts: str, keys: list[str] | None = None, gap_s: int = 120) -> DataFrame:
    """``rows`` with ``session_start`` and ``session_size``; a gap of exactly ``gap_s`` seconds does not split.

    Rows without a time are dropped. Rows fall into slots as long as the gap, inside which no gap can split, and slots
    into blocks: the ordered passes see one row for each slot in a block, and one for each block of a key.
    """
    keys = keys or []
    micros = gap_s * 1_000_000
    rows = rows.where(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(ts)).withColumn("_slot", F.floor(F.col("_at") / micros))
    slots = rows.groupBy(*keys, "_slot").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("_n"))
    slots = slots.withColumn("_block", F.floor(F.col("_slot") / BLOCK))
    order = Window.partitionBy(*keys, "_block").orderBy("_slot")
    gap = F.col("_first") - F.lag("_last").over(order)
    slots = slots.withColumn("_inner", F.sum(F.when(gap > micros, 1).otherwise(0)).over(order))
    blocks = slots.groupBy(*keys, "_block").agg(F.min("_first").alias("_begin"), F.max("_last").alias("_end"), F.max("_inner").alias("_more"))
    over = Window.partitionBy(*keys).orderBy("_block")
    split = F.when(F.col("_begin") - F.lag("_end").over(over) <= micros, 0).otherwise(1)
    blocks = blocks.withColumn("_split", split).withColumn("_base", F.sum(F.col("_split") + F.col("_more")).over(over) - F.col("_more"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("s._block") == F.col("b._block")]
    slots = slots.alias("s").join(blocks.alias("b"), reduce(and_, same)).select("s.*", (F.col("_base") + F.col("_inner")).alias("_session"))
    ends = slots.groupBy(*keys, "_session").agg(F.timestamp_micros(F.min("_first")).alias("session_start"), F.sum("_n").alias("session_size"))
    placed = slots.select(*keys, "_slot", "_session").join(ends, [*keys, "_session"]).drop("_session")
    return rows.join(placed, [*keys, "_slot"]).drop("_at", "_slot")


def sessions_of_two(rows: DataFrame, ts: str, keys: list[str] | None = None, gap_s: int = 120) -> DataFrame:
    """The rows of sessions with at least two rows."""
    return gap_sessions(rows, ts, keys, gap_s).where("session_size > 1")
