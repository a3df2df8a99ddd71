"""Connected components of an edge list: forests inside each task, then large-star and small-star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

#: Edges that a task holds at once.
HELD = 1 << 20


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to ``n`` - 1 and edges ``a``-``b``, the smallest node that each node reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def contracted(edges: DataFrame, held: int = HELD) -> DataFrame:
    """Edges ``(u, v)`` from nodes to smaller ones that join what the edges of each task join: a forest of stars for each.

    A task holds ``held`` edges or so; a forest that has grown beyond half of that is passed on and begun anew.
    """

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, waiting, size = None, [], 0

        def joined() -> pd.DataFrame:
            part = pd.concat([*waiting] if forest is None else [forest, *waiting])
            codes, names = pd.factorize(np.concatenate([part["u"].to_numpy(), part["v"].to_numpy()]), sort=True)
            root = roots(len(names), codes[: len(part)], codes[len(part) :])
            moved = np.flatnonzero(root != np.arange(len(names)))
            return pd.DataFrame({"u": names[moved], "v": names[root[moved]]})

        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= held:
                forest, waiting, size = joined(), [], 0
                if len(forest) > held // 2:
                    yield forest
                    forest = None
        if waiting or forest is not None:
            yield joined()

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInPandas(stars, f"u {kind}, v {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of ``u`` to the smallest of ``u`` and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link ``u`` and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and no edge leads to a node that has one; edges lead down."""
    ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("v")))
    return ends.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least <> most").isEmpty()


def star_forest(edges: DataFrame) -> DataFrame:
    """``(u, v)`` for every node of the edge list but the smallest of each component, which is ``v``; staged.

    Edges whose ends are equal or null are none. Each round first contracts what one task sees, so that a list which fits
    a task is done in one round; of larger ones there are about as many rounds as the logarithm of the nodes.
    """
    current = stage(contracted(edges.where("u <> v")), "stars")
    while not are_stars(current):
        current = stage(contracted(_small_star(_large_star(current))), "stars")
    return current


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edge list ``(u, v)``; the component is its smallest node.

    Self loops and repeated edges may occur; rows with a null end are no edges. A node without an edge to
    another node comes out only if it has a self loop. An empty list gives an empty table.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null")
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    stars = star_forest(edges)
    return (
        stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(stars.select(F.col("v"), F.col("v")))
        .union(loops)
        .groupBy("node").agg(F.min("component").alias("component"))
    )
