"""Shared pieces: rows whose key recurs, sizes of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recurring(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Rows of ``df`` whose ``keys`` occur in at least ``least`` rows; a null key recurs with nothing.

    Counts are summed before the shuffle and joined back, so one very common key is no single task.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(counts, keys, "left_semi")
