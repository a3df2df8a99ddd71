"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order and posted, with that order, in the inverted files of the first
few. A query reads the files of its own first pivots, ranks what they hold by how well the two orders agree (a sum over
the pivots that both hold, of products of weights that fall with the rank: many queries and vectors at once are one matrix
product), and computes exact inner products of the best ranked. Vectors stay where they are stored: the queries go to them,
a bounded number in each pass, and only each shard's best are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

#: Pivots as a multiple of the square root of the vectors' number, at most as many as 16 bits name; the sample is that of
#: the smallest hashed ids.
PIVOTS_BY_ROOT, MOST_PIVOTS = 2.26, 32_767
#: How many pivots are kept in order; in how many files a vector is posted; which share of what it reads a query reranks.
PREFIX, POSTED, RERANKED = 96, 4, 0.3
#: Of how many pivots, the first of the sample, orders are kept; files are those of all pivots.
ORDERED = 512
#: How many files a query reads: this many times the pivots' number to this power, 96 of 229.
READ, READ_POWER = 1.63, 0.75
#: Vectors whose files are read together; queries of one pass, which go to all shards; shards of which each tells its best.
BLOCK, QUERIES, SHARDS = 16_384, 16_384, 24
#: Queries whose orders meet those of a block in one product.
TOGETHER = 256


def usable(vectors: DataFrame) -> DataFrame:
    """Rows ``(vec_id, v)`` whose vector is not null, not zero and of finite components."""
    whole = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def orders(pivots: np.ndarray, vectors: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first."""
    near = vectors @ pivots.T
    part = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1).astype(np.int16)


def weights(orders: np.ndarray, pivots: int) -> np.ndarray:
    """Each order as a row over all pivots: the root of the places that are left from a pivot on, 0 for those not in it."""
    n, prefix = orders.shape
    out = np.zeros((n, pivots), np.float32)
    out[np.arange(n)[:, None], orders] = np.sqrt(np.arange(prefix, 0, -1, dtype=np.float32))
    return out


def _ordered(rows: DataFrame, pivots: np.ndarray, top: float, files: int, prefix: int) -> DataFrame:
    """``(vec_id, v binary, f binary, o binary)``: a vector as stored, its first ``files`` pivots, and its order.

    A vector gets one more component that makes all norms ``top``, so that the nearest in angle has the largest product.
    """

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stored = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                v = stored.astype(np.float64)
                wide = np.concatenate([v, np.sqrt(np.maximum(0, top**2 - (v * v).sum(axis=1)))[:, None]], axis=1)
                if len(pivots) > ORDERED:
                    f, o = orders(pivots, wide, files), orders(pivots[:ORDERED], wide, prefix)
                else:
                    whole = orders(pivots, wide, max(files, prefix))
                    f, o = whole[:, :files], whole[:, :prefix]
                columns = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (stored, f, o)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *columns], ["vec_id", "v", "f", "o"])

    return rows.mapInArrow(order, "vec_id long, v binary, f binary, o binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest scores, ties to the smaller id; an id with the same score counts once."""
    if len(ids) > k:
        likely = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        ids, scores = ids[likely], scores[likely]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    return ids[new][:k], scores[new][:k]


def _search(ordered: DataFrame, queries: DataFrame, k: int, pivots: int, read: int, share: float, kind: str) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: each query's ``k`` best among the postings that it reads.

    ``ordered`` and ``queries`` are ``(vec_id, v, f, o)``; the queries of one pass are collected and sent to the shards.
    """
    spark, rows = ordered.sparkSession, queries.distinct().toArrow()
    asked = rows.column("vec_id").to_numpy()
    kinds = (("v", kind), ("f", np.int16), ("o", np.int16))
    sent = spark.sparkContext.broadcast((asked, *(np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(len(asked), -1) for c, t in kinds)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
        if size:
            yield pa.Table.from_batches(waiting)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted, asked_files, asked_orders = sent.value
        wanted = wanted.astype(np.float64)
        found = [(np.empty(0, np.int64), np.empty(0))] * len(asked)
        for block in blocks(batches):
            block = block.group_by(["vec_id", "v", "f", "o"]).aggregate([])  # equal rows count once
            ids = block.column("vec_id").to_numpy()
            vectors, files, places = (np.frombuffer(b"".join(block.column(c).to_pylist()), t).reshape(len(ids), -1) for c, t in kinds)
            vectors, weighed = vectors.astype(np.float64), weights(places, min(pivots, ORDERED))
            sizes = np.bincount(files.ravel(), minlength=pivots)
            taken = np.minimum(sizes, np.maximum(4 * k, np.ceil(share * sizes)))  # of a file alone
            for a in range(0, len(asked), TOGETHER):
                some = slice(a, a + TOGETHER)
                reads = np.full((pivots, len(asked[some])), read >= pivots)
                reads[asked_files[some, :read].T, np.arange(reads.shape[1])] = True
                held = reads.take(files[:, 0], axis=0)
                for file in files.T[1:]:
                    held |= reads.take(file, axis=0)
                agreed = weighed @ weights(asked_orders[some], min(pivots, ORDERED)).T
                agreed[~held] = -1
                agreed, number = np.ascontiguousarray(agreed.T), held.sum(axis=0)
                reranked = np.maximum(4 * k, np.ceil(number * (taken @ reads) / np.maximum(1, sizes @ reads))).astype(np.int64)
                for q, (query, vector, agree, n, most) in enumerate(zip(asked[some], wanted[some], agreed, number.tolist(), reranked.tolist()), a):
                    best = np.argpartition(agree, -most)[-most:] if n > most else np.flatnonzero(agree >= 0)
                    best = best[ids[best] != query]
                    if len(best):
                        own_ids, own_scores = _best(ids[best], vectors[best] @ vector, k)
                        found[q] = _best(np.concatenate([found[q][0], own_ids]), np.concatenate([found[q][1], own_scores]), k)
        counts = [len(f[0]) for f in found]
        if sum(counts):
            columns = [np.repeat(asked, counts), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    told = ordered.coalesce(SHARDS).mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done = stage(told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
    sent.destroy()
    return done


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, by_root: float = PIVOTS_BY_ROOT, prefix: int = PREFIX, posted: int = POSTED, read: float = READ, share: float = RERANKED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows whose id ``every`` divides, the ``k`` found of largest inner product.

    Every usable vector of ``vectors`` (``vec_id``, ``embedding``) is indexed; scores are exact, in double precision, ties
    go to the smaller id, and a query is not its own neighbour. Vectors that are null, zero, or that hold null or
    non-finite components take no part; vectors of one length are an index of their own, as products need equal lengths;
    equal rows count once. A query for which the files hold fewer than ``k`` others is compared with all vectors of its
    length. An empty table gives an empty result.
    """
    rows = stage(usable(vectors), "vectors")
    nothing = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    found = [_nearest(rows.where(F.size("v") == n), k, every, by_root, prefix, posted, read, share) for n in lengths]
    return reduce(DataFrame.unionByName, found, nothing) if len(found) != 1 else found[0]


def _nearest(rows: DataFrame, k: int, every: int, by_root: float, prefix: int, posted: int, read: float, share: float) -> DataFrame:
    """The same for usable vectors of one length, of which there is one at least."""
    double = F.transform("v", lambda x: x.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x)).alias("square"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")).first()
    top = math.sqrt(facts["square"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_PIVOTS, max(32, round(by_root * math.sqrt(facts["n"]))))).collect()
    base = np.array([r["v"] for r in sample])
    pivots = np.concatenate([base, np.sqrt(np.maximum(0, top**2 - (base * base).sum(axis=1)))[:, None]], axis=1)
    n, prefix, posted = len(pivots), min(prefix, len(pivots), ORDERED), min(posted, len(pivots))
    files_read, kind = math.ceil(read * n**READ_POWER), "float32" if dict(rows.dtypes)["v"] == "array<float>" else "float64"
    ordered = _ordered(rows, pivots, top, posted, prefix)  # worked out again in each pass rather than stored
    queries = stage(_ordered(rows.where(F.col("vec_id") % every == 0), pivots, top, min(n, files_read), prefix), "queries")

    def passes(queries: DataFrame, count: int, read: int, share: float) -> list[DataFrame]:
        n_passes = -(-count // QUERIES)
        part = F.pmod(F.xxhash64("vec_id"), F.lit(n_passes or 1))
        return [_search(ordered, queries.where(part == i), k, n, read, share, kind) for i in range(n_passes)]

    found = passes(queries, facts["asked"], files_read, share)
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    whole = reduce(DataFrame.unionByName, found)
    full = whole.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stage(queries.join(full, "vec_id", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        rest = reduce(DataFrame.unionByName, passes(short, n_short, n, 1.0))
        whole = whole.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return whole.select("query_id", "rank", "vec_id", "score")
