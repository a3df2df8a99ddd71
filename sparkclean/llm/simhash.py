"""SimHash near-duplicates verified through pivot distance tables.

Fingerprints within three bits agree on at least two of five bit blocks, so the ten pairs of blocks name buckets
that hold every link. Inside a bucket a table of Hamming distances to reference fingerprints rules pairs out: if the
distances to any one reference differ by more than the limit, so do the fingerprints. Survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..storage import stage

BITS = 64
#: Fingerprints of one bucket that are compared in one piece; larger buckets are cut and compared piece by piece.
PIECE = 512


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """The hashes of all word shingles of a text in its order; a shorter text is one shingle, one without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64, n)


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text; 0 for a text without words."""
    hashes = shingle_hashes(text, words, seed)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 16384):
        bits = np.unpackbits(hashes[k : k + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with a column ``fp``: 64 bits of the majority over the hashes of all word shingles."""

    @F.pandas_udf(T.LongType())
    def signature(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words, seed) for t in texts], dtype=np.int64)

    return docs.withColumn("fp", signature("text"))


def references(n: int = 16, seed: int = 7) -> np.ndarray:
    """The reference fingerprints: fixed random bits, a column of the distance table each."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)


def links_in_runs(fps: np.ndarray, run: np.ndarray, pivots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``limit`` bits among rows of an equal ``run``, which are adjacent.

    The distance table discards pairs by their largest coordinate difference; survivors are verified.
    """
    distances = distance_table(fps, pivots)
    left, right = [], []
    alive = np.arange(len(fps))
    step = 1
    while len(alive):
        alive = alive[alive + step < len(fps)]
        alive = alive[run[alive] == run[alive + step]]
        a, b = alive, alive + step
        for k in range(0, len(pivots), 4):
            near = (np.abs(distances[a, k : k + 4] - distances[b, k : k + 4]) <= limit).all(axis=1)
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= limit
        left.append(a[near])
        right.append(b[near])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (alive, alive)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ``n`` nodes and edges ``a``-``b``, the smallest node that each node reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def _block_masks(limit: int) -> list[int]:
    """Masks of all pairs of ``limit`` + 2 blocks: fingerprints within ``limit`` bits agree under one of them."""
    edges = np.linspace(0, BITS, limit + 3).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [signed(x | y) for x, y in combinations(blocks, 2)]


def links(distinct: DataFrame, limit: int = 3, piece: int = PIECE) -> DataFrame:
    """Edges ``(u, v)`` of a forest that joins whatever fingerprints of ``distinct`` (column ``fp``) link.

    Every pair within ``limit`` bits is compared; of the links found in one batch only as many are passed on as
    join the same fingerprints, so a dense bucket does not give the square of its size.
    """
    masks = _block_masks(limit)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.i", "k.key")
    sizes = keyed.groupBy("i", "key").count().where("count > 1").withColumn("pieces", F.ceil(F.col("count") / piece).cast("int"))
    keyed = keyed.join(sizes, ["i", "key"])
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    keyed = keyed.select("fp", F.xxhash64("i", "key", F.least("own", "other"), F.greatest("own", "other")).alias("run"))
    pivots = references()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(part: pd.DataFrame) -> pd.DataFrame:
            fps = part["fp"].to_numpy().view(np.uint64)
            a, b = links_in_runs(fps, part["run"].to_numpy(), pivots, limit)
            signed = np.sort(np.unique(np.concatenate([fps[a], fps[b]])).view(np.int64))
            place = lambda x: np.searchsorted(signed, x.view(np.int64))
            root = forest(len(signed), place(fps[a]), place(fps[b]))
            moved = root != np.arange(len(signed))
            return pd.DataFrame({"u": signed[moved], "v": signed[root[moved]]})

        kept = None
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            runs = kept["run"].to_numpy()
            cut = int(np.searchsorted(runs, runs[-1])) if len(runs) else 0  # the last run may go on in the next batch
            if cut:
                yield found(kept.iloc[:cut])
                kept = kept.iloc[cut:].reset_index(drop=True)
        if kept is not None and len(kept):
            yield found(kept)

    return keyed.repartition("run").sortWithinPartitions("run").mapInPandas(compare, "u long, v long")


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprint_components(rows: DataFrame, limit: int = 3) -> DataFrame:
    """``(fp, component)`` for each distinct fingerprint of ``rows``; links within ``limit`` bits join them."""
    return _classes(rows, F.count("*"), limit).select("fp", "component")


def _classes(rows: DataFrame, least: Column, limit: int) -> DataFrame:
    """``(fp, least, component)`` for each distinct fingerprint of ``rows``."""
    classes = stage(rows.groupBy("fp").agg(least.alias("least")), "classes")
    members = connected_components(links(classes.select("fp"), limit)).withColumnRenamed("node", "fp")
    return classes.join(members, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs`` (``doc_id``, ``text``).

    Rows whose fingerprints differ by ``limit`` bits or fewer are linked; ``component_id`` is the smallest doc_id that
    links lead to. A null or wordless text has fingerprint zero and links like any other. A null doc_id is kept and
    never becomes a component_id unless its component has no other id. Repeated rows come out as often as they went in.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = stage(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp"), "fingerprints")
    joined = _classes(rows, F.min("doc_id"), limit)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stage(joined.join(least, "component").select("fp", "component_id"), "members")
    return rows.join(found, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, limit: int = 3) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest doc_id, ids before null.

    All columns are kept; of repeated rows one stays.
    """
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), "text")
    rows = stage(fingerprints(whole, words).select("doc", "fp").withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row"))
    first = _classes(rows, order, limit).groupBy("component").agg(F.min("least").alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select("doc.*")
