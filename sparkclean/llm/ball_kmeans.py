"""Vector codes by product quantisation whose codebooks are fitted with ball k-means, in whole numbers.

The vectors of an entry form its ball. An entry can only take a vector from another one if the two entries are no further
apart than twice the vector's distance to its own entry. So an entry whose distance exceeds twice the ball's radius is no
neighbour of the ball; vectors nearer than half the way to the nearest neighbour are the stable core, which nothing is
compared with; and the rings between the neighbours' half distances tell how many neighbours, nearest first, each other
vector meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_staged, stage, staged
from .spread import spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared together.
TOGETHER = 1 << 14


def usable(vectors: DataFrame) -> DataFrame:
    """``vectors`` whose ``embedding`` is not null and holds neither null nor non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & fine)


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part, ``parts x entries x width`` whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Balls:
    """One part's entries with their distances from each other, nearest first. All distances are squared and exact."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.norms = (entries * entries).sum(axis=1)
        apart = self.norms[:, None] + self.norms[None, :] - 2 * (entries @ entries.T)
        np.fill_diagonal(apart, -1)  # an entry comes first in its own list
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 1)

    def to(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The distance of each row of ``x`` to the entry named for it."""
        step = x - self.entries[which]
        return (step * step).sum(axis=1)

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of all entries, ties to the lower index, and its distance."""
        away = self.norms[None, :] - 2 * (x @ self.entries.T)
        code = away.argmin(axis=1)
        return code, away[np.arange(len(x)), code] + (x * x).sum(axis=1)

    def moved(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, from each row's former entry: only the entries that its ring allows are compared."""
        code, own = code.copy(), self.to(x, code)
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(self.entries) + 1))
        for ball in np.flatnonzero(np.diff(edges)).tolist():
            rows = order[edges[ball] : edges[ball + 1]]
            apart, near = self.apart[ball], self.near[ball]
            neighbours = int(np.searchsorted(apart, 4 * own[rows].max(), side="right"))  # within twice the radius
            if neighbours < 2:
                continue
            ring = np.searchsorted(apart[:neighbours], 4 * own[rows], side="right")  # entries to compare, the own one first
            rows, ring = rows[ring > 1], ring[ring > 1]
            width = 2
            while len(rows):
                now = rows[ring <= width] if width < neighbours else rows
                if len(now):
                    those = np.sort(near[: min(width, neighbours)])
                    away = self.norms[those][None, :] - 2 * (x[now] @ self.entries[those].T)
                    best = away.argmin(axis=1)
                    code[now], own[now] = those[best], away[np.arange(len(now)), best] + (x[now] * x[now]).sum(axis=1)
                rows, ring = (rows[ring > width], ring[ring > width]) if width < neighbours else (rows[:0], ring[:0])
                width *= 2
        return code, own


def _numbers(rows: pa.RecordBatch, width: int, dtype: type) -> np.ndarray:
    """The vectors of a batch, ``rows x parts x width``."""
    whole = b"".join(rows.column("v").to_pylist())
    return np.frombuffer(whole, np.int32).reshape(rows.num_rows, PARTS, width).astype(dtype)


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, length, largest, v)``: components as ``floor(scale * x)`` in 32 bits, padded with 0 to a multiple of 4.

    ``largest`` is the largest absolute value, before it is cut to 32 bits.
    """
    scaled = usable(vectors).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("x"))
    scaled = scaled.withColumn("largest", F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for row in batch.column("x"):
                x = np.clip(row.values.to_numpy(zero_copy_only=False), -(2**31), 2**31 - 1).astype(np.int32)
                packed.append(np.pad(x, (0, -len(x) % PARTS)).tobytes())
            length = pa.array([len(p) // 4 for p in packed], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), length, batch.column("largest"), pa.array(packed, pa.binary())], ["vec_id", "label", "length", "largest", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in scaled.schema.fields}
    return scaled.mapInArrow(pack, f"vec_id {kinds['vec_id']}, label {kinds['label']}, length int, largest double, v binary")


def _assigned(rows: DataFrame, books: Broadcast, width: int, dtype: type, first: bool) -> DataFrame:
    """``rows`` with ``codes``, a byte for each part, and ``error``; from the codes of the round before unless ``first``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(part) for part in books.value.astype(dtype)]
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                x = _numbers(part, width, dtype)
                old = None if first else np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
                codes, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p, own in enumerate(balls):
                    code, away = own.all(x[:, p]) if first else own.moved(x[:, p], old[:, p])
                    codes[:, p] = code
                    error += away.astype(np.int64)
                columns = {"vec_id": part.column("vec_id"), "label": part.column("label"), "v": part.column("v"), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary, codes binary, error long")


def _sums(rows: DataFrame, width: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts ``parts x entries`` and sums ``parts x entries x width`` of the rows by their codes: summed in each task, then over tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            x = _numbers(batch, width, np.int64)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                own = np.bincount(codes[:, p], minlength=entries)
                begin, used = np.cumsum(own) - own, own > 0
                counts[p] += own
                sums[p, used] += np.add.reduceat(x[np.argsort(codes[:, p], kind="stable"), p], begin[used]) if len(x) else 0
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = rows.select("v", "codes").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    counts, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # a row for each entry
        counts[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"]] = [r[f"s{i}"] for i in range(width)]
    return counts, sums


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The rows of ``whole_numbers``, all of one length, with ``codes`` and ``error``, and the codebooks they refer to.

    Each round writes the rows with their codes, from which the next one starts, and drops the table before it.
    """
    spark = rows.sparkSession
    facts = rows.agg(F.max("length").alias("length"), F.max("largest").alias("largest")).first()
    width = facts["length"] // PARTS
    reach = 4 * width * (int(facts["largest"]) + 1) ** 2 * 4  # four times the largest squared distance
    if reach >= 1 << 62 or facts["largest"] >= 2**31:
        raise ValueError("components are too large: squared distances would not fit 64 bits")
    dtype = np.float64 if reach < 1 << 53 else np.int64  # either way every product and sum is exact
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.stack([np.frombuffer(r["v"], np.int32).reshape(PARTS, width) for r in start], axis=1).astype(np.int64)
    coded, path = rows, None
    for t in range(rounds + 1):
        sent = spark.sparkContext.broadcast(books)
        coded = stage(_assigned(coded, sent, width, dtype, t == 0), "codes")
        if path:
            drop_staged(spark, [path])
        path = staged()[-1]
        if t < rounds:
            counts, sums = _sums(coded, width, books.shape[1])
            used = counts > 0
            books[used] = sums[used] // counts[used][:, None]
    return coded, Codebooks(books)


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for each usable row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Components become ``floor(scale * x)``; vectors are cut into four consecutive parts; each part's codebook begins as
    that part of the ``entries`` smallest ids and takes ``rounds`` rounds of k-means with floored means, entries without
    parts staying as they are. ``code`` holds the nearest entries, two hex digits each, ``error`` the squared distances,
    ``label_error`` their sum over equal labels, nulls together.

    Rows whose vector is null or holds a null or non-finite component are dropped. Repeated rows count each time; null
    ids come last among the first entries, ties by the vector; a table of fewer rows has fewer entries; other columns are
    not read. Vectors of another length have codebooks of their own; a length that four does not divide is filled up
    with zeros, which are part of the entries; an empty vector has code ``00000000`` and error 0. Components beyond
    about 2**17 for 64 dimensions, whose errors would not fit 64 bits, are an error. An empty table gives no rows.
    """
    rows = stage(whole_numbers(vectors, scale), "numbers")
    lengths = sorted(r["length"] for r in rows.select("length").distinct().collect())  # one plan for each length
    nothing = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")).where("false")
    parts = []
    for length in lengths:
        coded, books = fit(rows.where(F.col("length") == length), entries, rounds)
        parts.append(coded.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error", F.lit(books.sha256()).alias("codebooks_sha256")))
    whole = reduce(DataFrame.unionByName, parts, nothing) if len(parts) != 1 else parts[0]
    sums = whole.groupBy("label").agg(F.sum("error").alias("label_error"))
    return spread_join(whole, sums, ["label"], ["vec_id", "code"]).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def compressed_sql() -> str:
    """DuckDB SQL over ``embeddings``, of one length that four divides, for the rows of ``compressed`` with its usual parameters."""
    steps = [
        "rows_ AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 4 AS w FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, part, unnest(range(0, w)) AS pos, unnest(v[part * w + 1:(part + 1) * w]) AS x FROM (SELECT *, unnest(range(0, 4)) AS part FROM rows_))",
        "book0 AS MATERIALIZED (SELECT part, entry, pos, x AS y FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM rows_ QUALIFY row_number() OVER (ORDER BY vec_id) <= 256) USING (vec_id))",
    ]
    for t in range(ROUNDS + 1):
        steps.append(
            f"near{t} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d FROM (SELECT vec_id, part, entry, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN book{t} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"
        )
        if t < ROUNDS:
            steps.append(
                f"book{t + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m, y) AS y FROM book{t} b LEFT JOIN (SELECT part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM x JOIN near{t} USING (vec_id, part) GROUP BY ALL) n ON n.part = b.part AND n.entry = b.entry AND n.pos = b.pos)"
            )
    steps.append(f"codes AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY 1)")
    steps.append(f"hash AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN rows_ USING (vec_id), hash"
