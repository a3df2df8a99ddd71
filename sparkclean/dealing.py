"""Rows of equal keys in one task, for functions that read a task's rows as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def together(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """``rows`` dealt by ``keys``, over ``tasks`` partitions if given; rows of equal keys meet in one, whatever ``rows`` comes from.

    Spark leaves a plain ``repartition`` out where its input is dealt by the same columns, as by a join on them. Nothing
    asks for the keys then, so adaptive execution may read that join's shuffle by map task, once it broadcasts the other
    side, or cut a large partition: equal keys end up in several tasks. No join is dealt by a hash of its keys.
    """
    by = F.xxhash64(*keys)
    return rows.repartition(tasks, by) if tasks else rows.repartition(by)
