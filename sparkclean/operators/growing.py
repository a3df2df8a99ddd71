"""Connected components that grow: batches of edges join a stored forest, and what they do not touch is neither read nor written.

The store is a table of links ``(bucket, u, v)`` from nodes to smaller ones in which no node but a root is ever given a
link, so a batch only adds rows: one for each node that is new and for each root that loses to a smaller one. Links lie in
folders by the hash of ``u``, so a lookup reads the buckets of the nodes it looks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import generations
from ..storage import stage
from .components import connected_components, contracted, star_forest

BUCKETS = 64
#: Batches after which the links are compacted.
PARTS = 16


def _links(spark: SparkSession, path: str, state: generations.Generation) -> DataFrame:
    return generations.read(spark, path, state, "links")


def _bucket(node: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def roots_of(spark: SparkSession, path: str, state: generations.Generation | None, nodes: DataFrame) -> DataFrame:
    """``(node, root)`` for the distinct ``nodes``: where the stored links lead; a node that is not stored is its own root.

    Each step reads the buckets of the nodes that are still on their way; there are as many steps as links in the longest
    chain, one for each batch since the last compaction at most.
    """
    found = nodes.select("node", F.col("node").alias("root"))
    if state is None:
        return found
    links, buckets = _links(spark, path, state).where("u <> v"), state.marks["buckets"]
    arrived, moving = None, stage(found.withColumn("bucket", _bucket("root", buckets)), "moving")
    while True:
        read = [r["bucket"] for r in moving.select("bucket").distinct().collect()]  # as many as buckets at most
        step = moving.join(links.where(F.col("bucket").isin(read)).select("bucket", F.col("u").alias("root"), "v"), ["bucket", "root"], "left")
        step = stage(step.select("node", "root", "v"), "step")
        still = step.where("v is null").select("node", "root")
        arrived = still if arrived is None else arrived.unionByName(still)
        if step.where("v is not null").isEmpty():
            return arrived
        moving = stage(step.where("v is not null").select("node", F.col("v").alias("root"), _bucket("v", buckets).alias("bucket")), "moving")


def grow(spark: SparkSession, path: str, edges: DataFrame, batch: int | None = None, buckets: int = BUCKETS) -> generations.Generation:
    """Add a batch of edges ``(u, v)`` to the components at ``path``, which are begun if there are none.

    A batch whose number is not above the last one's changes nothing, so a batch may be replayed; of two writers that add
    to the same generation one gets ``Conflict`` and may try again. Rows with a null end are no edges.
    """
    state = generations.current(spark, path)
    if state and batch is not None and state.marks.get("batch", -1) >= batch:
        return state
    buckets = state.marks["buckets"] if state else buckets
    edges = edges.select("u", "v").where("u is not null and v is not null")
    new = stage(contracted(edges.where("u <> v")), "new-edges")
    loops = edges.where("u = v").select("u", "v").distinct()
    ends = new.select(F.col("u").alias("node")).union(new.select("v")).distinct()
    roots = stage(roots_of(spark, path, state, ends), "roots")
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    joined = new.join(end("u"), "u").join(end("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    added = star_forest(joined).union(loops).withColumn("bucket", _bucket("u", buckets))
    parts = [*(state.tables["links"] if state else []), generations.write(added.repartition("bucket"), path, ["bucket"])]
    state = generations.commit(spark, path, state, {"links": (parts, added.schema)}, {"buckets": buckets} | ({} if batch is None else {"batch": batch}))
    return state if len(parts) < PARTS else compact(spark, path)


def components(spark: SparkSession, path: str) -> DataFrame:
    """``(node, component)`` of all edges added so far; nothing was added yet is an error."""
    state = generations.current(spark, path)
    if state is None:
        raise ValueError(f"no components at {path}")
    return connected_components(_links(spark, path, state))


def compact(spark: SparkSession, path: str) -> generations.Generation:
    """Replace the stored links by one from each node to its root, so that lookups take one step again."""
    state = generations.current(spark, path)
    whole = connected_components(_links(spark, path, state)).select(F.col("node").alias("u"), F.col("component").alias("v"))
    whole = whole.withColumn("bucket", _bucket("u", state.marks["buckets"]))
    return generations.commit(spark, path, state, {"links": ([generations.write(whole.repartition("bucket"), path, ["bucket"])], whole.schema)})
