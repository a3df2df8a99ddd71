"""Near duplicates: close difference hashes inside a bucket, joined into groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.images import hamming
from ..storage import stage
from .components import connected_components, roots
from .scoring import scored, weighted
from .sessions import sessions_of_two

#: Hashes of one bucket that are grouped in one pass; of larger buckets, hashes of one band compared in one piece.
WHOLE, PIECE = 8192, 512


def grey_grid(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``(asset_id, grid)``: ``height`` rows of ``width`` cells, each the mean of its box of ``(asset_id, x, y, luma)``.

    An image smaller than the grid has no grid.
    """
    sides = pixels.groupBy("asset_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).where((F.col("w") >= width) & (F.col("h") >= height))
    cells = pixels.join(sides, "asset_id").select("asset_id", F.floor(F.col("y") * height / F.col("h")).alias("row"), F.floor(F.col("x") * width / F.col("w")).alias("col"), "luma")
    means = cells.groupBy("asset_id", "row", "col").agg(F.round(F.avg("luma")).cast("int").alias("v"))
    rows = means.groupBy("asset_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("cells"))  # width cells at most
    grids = rows.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    return grids.select("asset_id", F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["v"])).alias("grid"))


def similarity_candidates(assets: DataFrame, exact_members: DataFrame | None = None) -> DataFrame:
    """Dated assets that are no screenshots and in no exact group."""
    found = assets.where("not is_screenshot and creation_ts is not null")
    return found if exact_members is None else found.join(exact_members.select("asset_id"), "asset_id", "left_anti")


def close_hashes(hashes: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """``(keys, a, b, distance, n_a, n_b)``: pairs of different hashes within ``limit`` bits under the same keys.

    Equal hashes are one row with a count before anything is compared. Of ``limit`` + 2 blocks of bits at least two are
    equal in such a pair, so an equality join on each pair of blocks misses none. Neither side is ever small: each hash is
    a row for each pair of blocks, which Spark's estimate leaves out.
    """
    distinct = hashes.where("phash is not null").groupBy(*keys, "phash").agg(F.count("*").alias("n"))
    both = [m - (1 << 64) if m >> 63 else m for m in _bands(limit)]
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.col("phash").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(both)])
    banded = distinct.withColumn("band", F.explode(bands))
    left = banded.select(*keys, "band", F.col("phash").alias("a"), F.col("n").alias("n_a"))
    right = banded.select(*keys, "band", F.col("phash").alias("b"), F.col("n").alias("n_b"))
    pairs = left.join(right.hint("merge"), [*keys, "band"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= limit))
    return pairs.drop("band").distinct().withColumn("distance", hamming(F.col("a"), F.col("b")))


def similar_pairs(hashed: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """``(left_id, right_id, distance)``: links that stand for all pairs of rows within ``limit`` bits under the same keys.

    Rows of an equal hash are one class, named by its smallest id: that id is linked with each other row of the class, at
    distance 0, and with the ids of close classes. Every pair is a pair of two linked or equal classes.
    """
    own = stage(hashed.where("phash is not null").select(*keys, "asset_id", "phash"), "hashes")
    heads = own.groupBy(*keys, "phash").agg(F.min("asset_id").alias("head"))
    head_of = lambda c: heads.select(*keys, F.col("phash").alias(c), F.col("head").alias(f"{c}_head"))
    close = close_hashes(own, keys, limit).join(head_of("a"), [*keys, "a"]).join(head_of("b"), [*keys, "b"])
    across = close.select(F.least("a_head", "b_head").alias("left_id"), F.greatest("a_head", "b_head").alias("right_id"), "distance")
    inside = own.join(heads, [*keys, "phash"]).where("asset_id <> head").select(F.col("head").alias("left_id"), F.col("asset_id").alias("right_id"), F.lit(0).alias("distance"))
    return across.union(inside)


def _bands(limit: int) -> list[int]:
    """Masks of all pairs of ``limit`` + 2 blocks of bits: hashes within ``limit`` bits agree under one of them."""
    edges = [round(i * 64 / (limit + 2)) for i in range(limit + 3)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(masks, 2)]


def _weighed(n: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray, counts: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs ``a``-``b`` of classes: the first class that each class reaches, and for those the pairs and distances summed.

    A pair of classes stands for ``n_a * n_b`` pairs; only those that ``counts`` are summed.
    """
    root = roots(len(n), a, b)
    weight = n[a] * n[b] * counts
    pairs, sums = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    np.add.at(pairs, root[a], weight)
    np.add.at(sums, root[a], weight * distance)
    return root, pairs, sums


def _by_runs(rows: DataFrame, keys: list[str], order: str, solved: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``solved(rows, run)`` over rows brought together by ``keys`` and sorted; ``run`` numbers the rows of equal keys.

    Many runs go through a task together; one is never cut.
    """

    def numbered(part: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(part), bool)
        for k in keys:
            column, empty = part[k].to_numpy(), part[k].isna().to_numpy()
            new[1:] |= (column[1:] != column[:-1]) & ~(empty[1:] & empty[:-1])
        return np.cumsum(new)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            run = numbered(part)
            cut = int(np.searchsorted(run, run[-1])) if len(run) else 0  # the last run may go on in the next batch
            rest = part.iloc[cut:].reset_index(drop=True)
            if cut:
                yield solved(part.iloc[:cut].reset_index(drop=True), run[:cut])
        if rest is not None and len(rest):
            yield solved(rest, numbered(rest))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(solve, schema)


def _close_in_runs(fps: np.ndarray, run: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of hashes within ``limit`` bits in one run."""
    left, right = [], []
    alive, step = np.arange(len(fps)), 1
    while len(alive):
        alive = alive[alive + step < len(fps)]
        alive = alive[run[alive] == run[alive + step]]
        near = np.bitwise_count(fps[alive] ^ fps[alive + step]) <= limit
        left.append(alive[near])
        right.append(alive[near] + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (alive, alive)


def _in_runs(heads: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``(keys, phash, head, n, group_id, pairs, distances)`` of whole buckets."""

    def solved(part: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        fps = part["phash"].to_numpy().view(np.uint64)
        a, b = _close_in_runs(fps, run, limit)
        root, pairs, sums = _weighed(part["n"].to_numpy(), a, b, np.bitwise_count(fps[a] ^ fps[b]).astype(np.int64))
        out = part.assign(group_id=part["head"].to_numpy()[root], pairs=pairs[root], distances=sums[root])
        return out[(pairs[root] > 0) | (part["n"] > 1)]

    rows = heads.select(*keys, "phash", "head", "n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _by_runs(rows, keys, "head", solved, f"{schema}, group_id {heads.schema['head'].dataType.simpleString()}, pairs long, distances long")


def dense_links(heads: DataFrame, keys: list[str], limit: int = 5, piece: int = PIECE) -> DataFrame:
    """``(u, v, pairs, distances)``: links that join what all pairs within ``limit`` bits under the same keys join, with sums.

    ``heads`` is ``(keys, phash, head, n)``, a row for each hash. Hashes that agree in two of ``limit`` + 2 blocks are
    compared; more than ``piece`` of them are cut and compared piece by piece, and of the links of a piece a forest is
    passed on: of ``c`` close classes no more than ``c`` - 1 links in each piece. The pairs of a piece and their distances are
    summed at the smallest class of each tree, a pair only in the first block pair that it agrees in.
    """
    masks = _bands(limit)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.col("phash").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    keyed = heads.select(F.xxhash64(*keys).alias("bucket"), F.to_json(F.struct(*keys)).alias("key"), "phash", "head", "n", F.explode(bands).alias("band"))
    by = ["bucket", "key", "band"]
    sizes = keyed.groupBy(*by).agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"), F.count("*").alias("size")).where("size > 1").drop("size")
    keyed = keyed.join(sizes, by).withColumn("own", F.pmod(F.xxhash64("phash"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    keyed = keyed.select("bucket", "key", "band.i", "band.bits", "phash", "head", "n", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(part: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        fps, side, band, heads_ = part["phash"].to_numpy().view(np.uint64), part["own"].to_numpy(), part["i"].to_numpy(), part["head"].to_numpy()
        a, b = _close_in_runs(fps, run, limit)
        met = ((part["low"] == part["high"]).to_numpy()[a]) | (side[a] != side[b])  # rows of one side meet in a run of their own
        a, b = a[met], b[met]
        differ, first = fps[a] ^ fps[b], np.ones(len(a), bool)
        for k, m in enumerate(masks):
            first &= (band[a] <= k) | ((differ & np.uint64(m)) != 0)
        root, pairs, sums = _weighed(part["n"].to_numpy(), a, b, np.bitwise_count(differ).astype(np.int64), first)
        told = np.flatnonzero((root != np.arange(len(part))) | (pairs > 0))
        return pd.DataFrame({"u": heads_[told], "v": heads_[root[told]], "pairs": pairs[told], "distances": sums[told]})

    kind = heads.schema["head"].dataType.simpleString()
    return _by_runs(keyed, ["bucket", "key", "i", "bits", "low", "high"], "head", compare, f"u {kind}, v {kind}, pairs long, distances long")


def hash_groups(hashed: DataFrame, keys: list[str], limit: int = 5, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """``(group_id, asset_id, confidence)`` for groups of two and more joined by pairs within ``limit`` bits.

    Confidence is one minus the mean distance over all linked pairs, equal ones at 0, divided by 64. Equal hashes are one
    class. A bucket of at most ``whole`` classes is solved in one pass; the classes of larger ones are joined by
    ``dense_links`` and grouped over the cluster.
    """
    own = stage(hashed.where("phash is not null").select(*keys, "asset_id", "phash"), "hashes")  # read again for the members
    heads = stage(own.groupBy(*keys, "phash").agg(F.min("asset_id").alias("head"), F.count("*").alias("n")), "heads")
    large = heads.groupBy(*keys).agg(F.count("*").alias("classes")).where(F.col("classes") > whole).drop("classes")
    if large.isEmpty():
        grouped = _in_runs(heads, keys, limit)
    else:
        large = stage(large, "large")
        same = lambda other: reduce(and_, [F.col(f"h.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys])
        dense = heads.alias("h").join(large.alias("l"), same("l"), "left_semi")
        links = stage(dense_links(dense, keys, limit, piece), "linked")
        alone = dense.where("n > 1").select(F.col("head").alias("u"), F.col("head").alias("v"))
        nodes = stage(connected_components(links.select("u", "v").union(alone)).withColumnRenamed("component", "group_id"), "nodes")
        sums = links.join(nodes, F.col("v") == F.col("node")).groupBy("group_id").agg(F.sum("pairs").alias("pairs"), F.sum("distances").alias("distances"))
        joined = dense.join(nodes, F.col("head") == F.col("node")).join(sums, "group_id", "left").fillna(0, ["pairs", "distances"])
        small = _in_runs(heads.alias("h").join(large.alias("l"), same("l"), "left_anti"), keys, limit)
        grouped = small.unionByName(joined.select(small.columns))
    grouped = stage(grouped, "grouped")
    equal = grouped.groupBy("group_id").agg(F.max("pairs").alias("pairs"), F.max("distances").alias("distances"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("equal"))
    sums = equal.select("group_id", (1 - F.col("distances") / (F.col("pairs") + F.col("equal")) / 64).alias("confidence"))
    same = reduce(and_, [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*keys, "phash"]])
    members = own.alias("o").join(grouped.select(*keys, "phash", "group_id").alias("g"), same)
    return members.select("g.group_id", "o.asset_id").join(sums, "group_id").select("group_id", "asset_id", "confidence")


def similar_groups(assets: DataFrame, hashes: DataFrame, signals: DataFrame | Callable[[DataFrame], DataFrame], exact_members: DataFrame | None = None, gap_s: int = 120, limit: int = 5) -> DataFrame:
    """Groups of similar assets taken close together in time, with scores and the recommended keep.

    Columns: ``group_id, asset_id, confidence, kind, total, reason, recommended_keep``. ``hashes`` is ``(asset_id,
    phash)``; assets without a hash drop out. ``signals`` may be a function of the members' ``asset_id``s, so that
    signals are worked out for members only.
    """
    placed = sessions_of_two(similarity_candidates(assets, exact_members).select("library_id", "asset_id", "creation_ts"), "creation_ts", ["library_id"], gap_s)
    groups = hash_groups(placed.join(hashes, "asset_id"), ["library_id", "session_start"], limit)
    groups = stage(groups, "groups")
    known = signals(groups.select("asset_id")) if callable(signals) else signals
    judged = scored(stage(weighted(groups.join(known, "asset_id")), "scores"))
    return judged.select("group_id", "asset_id", "confidence", F.lit("similar").alias("kind"), "total", "reason", "recommended_keep")
