"""The whole library scan: screenshots, exact duplicates, similar groups and videos, in one call or phase by phase."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exact import exact_duplicates
from ..operators.near import similar_groups
from ..sources import generations
from ..sources.scans import assets_of_type, in_scope, screenshots
from ..storage import stage

#: The phases in their order; the similar groups leave out what the exact ones hold.
PHASES = ["screenshots", "exact", "similar", "videos"]


def _phases(assets: DataFrame, hashes: DataFrame, signals: DataFrame | Callable[[DataFrame], DataFrame], granted: DataFrame | None, exact: Callable[[], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    scope = in_scope(assets, granted)
    photos = scope.where("media_type = 'photo'")
    return {
        "screenshots": lambda: screenshots(photos),
        "exact": lambda: exact_duplicates(photos),
        "similar": lambda: similar_groups(photos, hashes, signals, exact()),
        "videos": lambda: assets_of_type(scope, "video", ["library_id", "asset_id", "creation_ts", "byte_size"]),
    }


def scan_library(assets: DataFrame, hashes: DataFrame, signals: DataFrame | Callable[[DataFrame], DataFrame], granted: DataFrame | None = None) -> dict[str, DataFrame]:
    """``screenshots``, ``exact``, ``similar`` and ``videos``; exact members are found once and left out of the similar ones."""
    found: dict[str, DataFrame] = {}
    for phase, rows in _phases(assets, hashes, signals, granted, lambda: found["exact"]).items():
        found[phase] = stage(rows(), phase) if phase == "exact" else rows()
    return found


def scan_in_phases(path: str, assets: DataFrame, hashes: DataFrame, signals: DataFrame | Callable[[DataFrame], DataFrame], granted: DataFrame | None = None) -> dict[str, DataFrame]:
    """The same, each phase written and committed at ``path`` before the next one begins.

    A scan that is stopped leaves the phases that are done, for ``scanned``; called again, it goes on with the first
    phase that is missing.
    """
    spark = assets.sparkSession
    state = generations.current(spark, path)
    for phase, rows in _phases(assets, hashes, signals, granted, lambda: generations.read(spark, path, state, "exact")).items():
        if state is None or phase not in state.tables:
            found = rows().drop("content")
            state = generations.commit(spark, path, state, {phase: ([generations.write(found, path)], found.schema)})
    return scanned(spark, path)


def scanned(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The phases that are done, by name."""
    state = generations.current(spark, path)
    return {phase: generations.read(spark, path, state, phase) for phase in PHASES if state and phase in state.tables}


def phase_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(phase, n_items, done)`` for every phase; one that is not done has found nothing yet."""
    done = scanned(spark, path)
    names = spark.createDataFrame([(p, p in done) for p in PHASES], "phase string, done boolean")
    counts = spark.createDataFrame([], "phase string, n long")
    for phase, rows in done.items():
        counts = counts.union(rows.agg(F.count("*").alias("n")).select(F.lit(phase), "n"))
    return names.join(counts, "phase", "left").select("phase", F.coalesce("n", F.lit(0)).alias("n_items"), "done")
