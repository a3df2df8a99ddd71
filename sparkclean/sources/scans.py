"""Scans of asset, video and contact tables, lookups by id, and versioned snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dealing import together
from ..storage import remove
from . import generations
from .generations import Generation

#: Version of the snapshot layout; another version is not read.
SCHEMA_VERSION = 1
#: Seconds that readers of a replaced snapshot may go on with it.
KEEP_S = 24 * 3600
_TYPES = ["photo", "fullSizePhoto", "video", "fullSizeVideo"]


def assets_of_type(assets: DataFrame, media_type: str, columns: list[str]) -> DataFrame:
    """Metadata columns of one media type; the filter and the columns reach the reader."""
    return assets.where(F.col("media_type") == media_type).select(*columns)


def with_byte_size(assets: DataFrame, content: str = "content") -> DataFrame:
    """``byte_size`` as stated, else the length of the content."""
    return assets.withColumn("byte_size", F.coalesce("byte_size", F.octet_length(content).cast("long")))


def primary_resources(resources: DataFrame) -> DataFrame:
    """One row of ``(asset_id, resource_type, pos)`` for each asset: the first of the preferred types, else the first."""
    rank = F.coalesce(*[F.when(F.col("resource_type") == t, i) for i, t in enumerate(_TYPES)], F.lit(len(_TYPES)))
    order = Window.partitionBy("asset_id").orderBy(rank, "pos")
    return resources.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def content_hashes(assets: DataFrame, item: str = "asset_id", content: str = "content") -> DataFrame:
    return assets.select(item, F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"))


def chunk_hashes(chunks: DataFrame, item: str = "asset_id") -> DataFrame:
    """``(item, content_hash, byte_size)``: SHA-256 of contents that lie in rows ``(item, pos, chunk)``, in the order of ``pos``.

    Chunks are brought together by item and sorted, both of which spill to disk, and go through a running digest batch by
    batch: a task holds one batch of chunks and never a whole content. How many chunks a batch has is bounded by
    ``spark.sql.execution.arrow.maxBytesPerBatch``. A null chunk is empty; an item of null chunks only has no hash.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [item, "content_hash", "byte_size"]
        own, state, size, known = None, None, 0, False
        kind = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([state.hexdigest() if known else None], pa.string()), pa.array([size], pa.int64())], names)

        for batch in batches:
            kind = batch.column(0).type
            for name, chunk in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                if state is None or name != own:
                    if state is not None:
                        yield told()
                    own, state, size, known = name, hashlib.sha256(), 0, False
                if chunk.is_valid:
                    data = chunk.as_buffer()
                    state.update(data)
                    size, known = size + data.size, True
        if state is not None:
            yield told()

    kind = chunks.schema[item].dataType.simpleString()
    placed = together(chunks, item).sortWithinPartitions(item, "pos").select(item, F.col("chunk").cast("binary").alias("chunk"))
    return placed.mapInArrow(digest, f"`{item}` {kind}, content_hash string, byte_size long")


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``(item, byte_size, modification_ts)`` of all files under ``folder``; contents are not read. Empty files are left out by the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(_below(F.col("path"), folder).alias("item"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modification_ts"))


def still_there(ids: DataFrame, live: DataFrame, item: str) -> DataFrame:
    """The ids that the live table holds."""
    return ids.join(live.select(item), item, "left_semi")


def display_fields(ids: DataFrame, raw: DataFrame, item: str = "contact_id") -> DataFrame:
    """Raw fields of each id, with ``is_stale`` where there is no record."""
    return ids.join(raw.withColumn("_there", F.lit(True)), item, "left").withColumn("is_stale", F.col("_there").isNull()).drop("_there")


def sizes_or_zero(rows: DataFrame, sizes: DataFrame, item: str = "asset_id") -> DataFrame:
    """Rows with ``byte_size`` from ``sizes``, 0 where it is unknown."""
    return rows.drop("byte_size").join(sizes.select(item, "byte_size"), item, "left").withColumn("byte_size", F.coalesce("byte_size", F.lit(0)))


def screenshots(assets: DataFrame) -> DataFrame:
    return assets.where("is_screenshot")


def in_scope(assets: DataFrame, granted: DataFrame | None = None) -> DataFrame:
    """Assets of a limited grant, or all, with ``scanned_with_limited_access``."""
    found = assets if granted is None else assets.join(granted.select("library_id", "asset_id"), ["library_id", "asset_id"], "left_semi")
    return found.withColumn("scanned_with_limited_access", F.lit(granted is not None))


def save_snapshot(rows: DataFrame, path: str, columns: list[str], version: int = SCHEMA_VERSION, keep_s: float = KEEP_S) -> Generation:
    """Replace the snapshot at ``path`` by the named columns, marked with the layout's version, as a new generation.

    A job that dies on the way leaves the old snapshot in place; of two that replace the same one, the second to commit
    gets ``Conflict``. Readers of the old one keep it for ``keep_s`` seconds.
    """
    spark = rows.sparkSession
    base, kept = generations.current(spark, path), rows.select(*columns)
    new = generations.commit(spark, path, base, {"snapshot": ([generations.write(kept, path)], kept.schema)}, {"version": version})
    generations.expire(spark, path, keep_s)
    return new


def load_snapshot(spark: SparkSession, path: str, schema: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """The snapshot's rows; none if it is missing, unreadable or of another version, so that a full scan follows.

    Which files belong to it, and their sizes, are held against the manifest. A store that fails is an error: it does not
    look like a missing snapshot.
    """
    nothing, found = spark.createDataFrame([], schema), generations.current(spark, path)
    if found is None or found.marks.get("version") != version or "snapshot" not in found.tables:
        return nothing
    try:
        rows = generations.read(spark, path, found, "snapshot")
    except generations.Unreadable:
        return nothing
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*nothing.columns) if all(kinds.get(f.name) == f.dataType for f in nothing.schema.fields) else nothing


def drop_snapshot(spark: SparkSession, path: str) -> bool:
    """Delete the snapshot; False if there was none."""
    return remove(spark, path)


def _below(path: Column, folder: str) -> Column:
    """The part of a file's path below ``folder``."""
    top = folder.rstrip("/").split("://")[-1].split("/", 1)[-1]
    return F.regexp_replace(F.substring_index(path, f"/{top}/", -1), "^/+", "")


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(item, lineno, line)`` of all files under ``folder``, large ones read by many tasks.

    A file is read in splits. A line's number is its place in its split, which the running row number of a task gives, and
    the lines of the splits before, which prefix sums over a row for each split give. The text is read twice and not
    shuffled; the counts are broadcast if they are small.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(folder)
    lines = read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "start", "first", before.alias("before"))
    placed = lines.join(splits, ["path", "start"])
    return placed.select(_below(F.url_decode("path"), folder).alias("item"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("lineno"), F.col("value").alias("line"))


def source_lines(spark: SparkSession, folder: str, extensions: list[str], skipped: list[str] | None = None) -> DataFrame:
    """``(item, lineno, line)`` of all files under ``folder`` with one of the ``extensions``, but for ``skipped`` folder names.

    ``item`` is the path below ``folder``.
    """
    on = F.lower(F.regexp_extract("item", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    for name in skipped or []:
        on &= ~F.array_contains(F.slice(F.split("item", "/"), 1, F.greatest(F.size(F.split("item", "/")) - 1, F.lit(0))), name)
    return numbered_lines(spark, folder).where(on)


def apply_deletes(live: DataFrame, requested: DataFrame, item: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """What stays of ``live``, and the requested ids that were there."""
    return live.join(requested.select(item), item, "left_anti"), still_there(requested.select(item).distinct(), live, item)


def changed_since(assets: DataFrame, snapshot: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """Assets to scan again: new ones, changed ones, and all of them if the snapshot has another version."""
    known = snapshot.where(F.col("schema_version") == version).select("asset_id", "modification_ts")
    return assets.join(known, ["asset_id", "modification_ts"], "left_anti")
