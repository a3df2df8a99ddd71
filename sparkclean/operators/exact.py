"""Exact duplicates by keys from cheap to expensive: dimensions, byte size, content digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .groups import recurring

DIMENSIONS = ["library_id", "width", "height"]


def dimension_buckets(assets: DataFrame) -> DataFrame:
    """Assets that share library, width and height with another one."""
    return recurring(assets, DIMENSIONS)


def size_buckets(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates, with ``byte_size`` from ``sizes``, that also share the size; a null size matches nothing."""
    return recurring(candidates.drop("byte_size").join(sizes.select("asset_id", "byte_size"), "asset_id"), [*DIMENSIONS, "byte_size"])


def with_digests(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """Candidates with the SHA-256 of their content as ``digest``; an asset without content has none and drops out."""
    return candidates.join(contents.select("asset_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest")).where("digest is not null"), "asset_id")


def digest_groups(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """Candidates that also share the digest of their content, which is read once."""
    return recurring(stage(with_digests(candidates, contents), "digests"), [*DIMENSIONS, "byte_size", "digest"])


def earliest(ts: str, item: str) -> Column:
    """Aggregate: the item of the earliest time, undated ones last, ties by id."""
    return F.min(F.struct(F.col(ts).isNull(), F.col(ts), F.col(item).alias("item")))["item"]


def exact_duplicates(assets: DataFrame, sizes: DataFrame | None = None, contents: DataFrame | None = None) -> DataFrame:
    """``(group_id, asset_id, byte_size, digest, recommended_keep, confidence, kind)`` for members of exact groups.

    ``sizes`` and ``contents`` default to columns of ``assets``; contents are read once, for what shares dimensions and
    size. ``group_id`` is the group's smallest id; the earliest asset is recommended.
    """
    narrow = stage(assets.select("asset_id", *DIMENSIONS, "creation_ts", *(["byte_size"] if sizes is None else [])), "narrow")
    left = recurring(narrow, [*DIMENSIONS, "byte_size"]) if sizes is None else size_buckets(dimension_buckets(narrow), sizes)
    found = stage(with_digests(left, assets if contents is None else contents), "digests")
    keys = [*DIMENSIONS, "byte_size", "digest"]
    heads = found.groupBy(*keys).agg(F.count("*").alias("n"), F.min("asset_id").alias("group_id"), earliest("creation_ts", "asset_id").alias("recommended_keep"))
    return found.join(heads.where("n > 1"), keys).select("group_id", "asset_id", "byte_size", "digest", "recommended_keep", F.lit(1.0).alias("confidence"), F.lit("exactDuplicate").alias("kind"))


def size_errors(assets: DataFrame) -> DataFrame:
    """Assets without a known size: left out of exact detection and listed here."""
    return assets.where("byte_size is null").select("asset_id", F.lit("size unavailable").alias("error"))
