"""Scores inside a group, the recommended keep and the reason for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signals and their weights, added in this order: fixed values.
WEIGHTS = {"resolution": 0.35, "sharpness": 0.45, "exposure": 0.15, "byte_size": 0.05}
#: A normalised signal from which it is a reason, and what the reasons say: fixed values.
REASON_FROM = 0.99
REASONS = {"resolution": "highest resolution", "sharpness": "sharpest", "exposure": "best exposed"}
BALANCED, LOWER = "Best overall balance of resolution and sharpness of ", "Lower overall quality than the recommended photo in this group of "


def normalized(members: DataFrame) -> DataFrame:
    """``members`` with ``<signal>_score``: each signal over its group's maximum, 0 where that is not positive."""
    tops = members.groupBy("group_id").agg(*[F.max(s).alias(f"_{s}") for s in WEIGHTS], F.count("*").alias("group_size"))
    joined = members.join(tops, "group_id")
    scores = {f"{s}_score": F.when(F.col(f"_{s}") > 0, F.col(s) / F.col(f"_{s}")).otherwise(0.0) for s in WEIGHTS}
    return joined.withColumns(scores).drop(*[f"_{s}" for s in WEIGHTS])


def weighted(members: DataFrame) -> DataFrame:
    """The normalised members with ``total``, the weighted sum in the fixed order."""
    total = None
    for signal, weight in WEIGHTS.items():
        part = F.col(f"{signal}_score") * weight
        total = part if total is None else total + part
    return normalized(members).withColumn("total", total)


def scored(members: DataFrame) -> DataFrame:
    """``weighted`` members with ``recommended_keep`` (highest total, ties by id) and ``reason``."""
    best = members.groupBy("group_id").agg(F.min(F.struct(-F.col("total"), F.col("asset_id").alias("item")))["item"].alias("recommended_keep"), F.max("total").alias("_best"))
    high = lambda s: F.col(f"{s}_score") >= REASON_FROM
    first = F.when(high("resolution") | high("sharpness"), F.concat_ws(", ", *[F.when(high(s), REASONS[s]) for s in ("resolution", "sharpness")]))
    text = F.coalesce(first, F.when(high("exposure"), REASONS["exposure"]))
    size = F.col("group_size").cast("string")
    good = F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)), F.lit(" of "), size, F.lit("."))
    good = F.coalesce(good, F.concat(F.lit(BALANCED), size, F.lit(".")))
    low = F.concat(F.lit(LOWER), size, F.lit("."))
    return members.join(best, "group_id").withColumn("reason", F.when(F.col("total") == F.col("_best"), good).otherwise(low)).drop("_best")
