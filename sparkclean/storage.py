"""Tables kept between the steps of one job, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = threading.local()

#: How many times the size of their files the rows of a table take at most, unless the session says more.
ROWS_TO_FILES = 32


def _made() -> list[str]:
    """The tables staged by this thread, so that jobs in other threads of the driver keep theirs."""
    if not hasattr(_own, "made"):
        _own.made = []
    return _own.made


def estimate_by_rows(spark: SparkSession) -> None:
    """Have Spark take tables for as large as their rows may be, not as their packed files.

    By the files alone a table of hashes is planned as the small side of a join, and its rows, many times as large, are
    collected by the driver. What is small once it was shuffled is still broadcast then, by its measured size.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) < ROWS_TO_FILES:
        spark.conf.set(name, ROWS_TO_FILES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the input tables, ``<folder>/<name>.parquet``."""
    estimate_by_rows(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a new temporary one, on a single machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, and a lost executor costs only a new read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made().append(path)
    estimate_by_rows(spark)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """The tables staged by this thread of the driver and not dropped yet, oldest first."""
    return list(_made())


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables once nothing reads them any more, as after a job's result was written."""
    for path in paths:
        remove(spark, path)
        if path in _made():
            _made().remove(path)


def place_of(spark: SparkSession, path: str) -> tuple:
    """The store that holds ``path``, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder in any store; False if there was none."""
    store, place = place_of(spark, path)
    return bool(store.delete(place, True))
