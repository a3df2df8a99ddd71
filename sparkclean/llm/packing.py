"""Mixture-controlled packing: deficit round-robin over source queues.

Each window gives every queue its quantum, its target share of the window, in whole tokens; what a quantum has over or
under whole tokens is carried to the next windows as the queue's deficit. Documents are cut where a quantum ends. With
the queues' quanta laid end to end at edges ``E``, the tokens before edge ``E`` in the first ``t`` windows are
``floor(t * E)``: every window is full, every queue within one token of its target in each window and over all windows,
and a token's window follows from its place in its queue, in any partition. When a queue runs dry, the others take over
its share in proportion; what is left of it, less than one quantum, goes to the end.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

WINDOW = 2048
END_ID = 1
#: Tokens of a window from which a source has a queue of its own; the sources below share one queue.
LEAST_QUANTUM = 2
#: Tokens of the shared queue that are ordered together, about, and such groups that are summed together.
ORDERED, FAN = 1 << 16, 4096


class Encoder:
    """Ids of texts by a byte-level vocabulary of `tokenizers`.

    ``ranks`` names the same vocabulary as a file of ranks, by which `tiktoken` gives the same ids in less than half the
    time; texts that hold the name of a special token, and all texts without such a file, go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, ranks: str | None = None) -> Encoder:
    """One encoder for each Python process and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (vocabulary, ranks) not in _encoders:
        _encoders[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _encoders[vocabulary, ranks]


def tokenized(docs: DataFrame, vocabulary: str, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``docs`` (``doc_id``, ``source``, ``text``) as ``(doc_id, source, doc_tokens, ids)``; ids are 16-bit, ends with ``end_id``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, ranks)
        if own.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits; this vocabulary has more")
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            ids = [np.array(own.ids(t or ""), "<u2").tobytes() + end for t in batch.column("text").to_pylist()]
            sizes = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes, pa.array(ids, pa.binary())], ["doc_id", "source", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(encode, "doc_id long, source string, doc_tokens long, ids binary")


def _before(totals: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, before)``: the sum of ``value`` over all smaller integer keys, in two levels."""
    coarse = F.floor(F.col(key) / FAN)
    within = Window.partitionBy(coarse).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    tops = totals.groupBy(coarse.alias("top")).agg(F.sum(value).alias("all"))
    tops = tops.select("top", F.coalesce(F.sum("all").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = totals.select(key, coarse.alias("top"), F.coalesce(F.sum(value).over(within), F.lit(0)).alias("inner"))
    return own.join(tops, "top").select(key, (F.col("base") + F.col("inner")).alias("before"))


def _share(targets: dict[str, float] | None, total: int) -> Column:
    if targets is None:
        return F.col("tokens") / F.lit(total)
    whole = float(sum(targets.values()))
    value = F.lit(None).cast("double")
    for name, weight in targets.items():
        value = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(weight / whole)).otherwise(value)
    return F.coalesce(value, F.raise_error(F.concat(F.lit("no target for source "), F.coalesce("source", F.lit("null")))).cast("double"))


@dataclass(frozen=True)
class Phase:
    """``windows`` windows from number ``at`` on, while the same queues last: quanta between ``edges``, places before in ``begin``."""

    at: int
    windows: int
    edges: np.ndarray
    begin: np.ndarray

    def before(self, t: np.ndarray, queue: int) -> np.ndarray:
        """Tokens of a queue in the phase's first ``t`` windows."""
        return np.floor(t * self.edges[queue + 1]) - np.floor(t * self.edges[queue])


@dataclass(frozen=True)
class Schedule:
    """Which place in which window the tokens of the queues take."""

    window: int
    phases: list[Phase]
    #: Places of each queue before its rest, and where the rests begin in the stream of windows.
    served: np.ndarray
    rests: np.ndarray

    def pieces(self, queue: int, place: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
        """``(start, length, sequence, offset)`` arrays of the pieces of a document at ``place`` of its queue."""
        end = place + size
        for phase in self.phases:
            zero = int(phase.begin[queue])
            a, b = max(place - zero, 0), end - zero
            quantum = phase.edges[queue + 1] - phase.edges[queue]
            if b <= 0 or not quantum:
                continue
            t = np.arange(max(0, int(a / quantum) - 2), min(phase.windows, int(b / quantum) + 3) + 1, dtype=np.float64)
            if len(t) < 2:
                continue
            edge = phase.before(t, queue)
            low, high = np.maximum(edge[:-1], a), np.minimum(edge[1:], b)
            on = high > low
            ahead = np.floor((t[:-1] + 1) * phase.edges[queue]) - np.floor(t[:-1] * phase.edges[queue])
            found = (low + zero - place, high - low, t[:-1] + phase.at, ahead + low - edge[:-1])
            yield tuple(x[on].astype(np.int64) for x in found)
        rest = max(place, int(self.served[queue]))
        if rest < end:
            begin = int(self.rests[queue]) + rest - int(self.served[queue])
            edges = np.array([begin, *range(begin - begin % self.window + self.window, begin + end - rest, self.window), begin + end - rest], np.int64)
            yield edges[:-1] - begin + rest - place, np.diff(edges), edges[:-1] // self.window, edges[:-1] % self.window


def scheduled(tokens: list[int], shares: list[float], window: int) -> Schedule:
    """The windows of queues of these lengths; a queue of less than a token to a window must be the only one."""
    left, share = np.array(tokens, np.int64), np.array(shares, np.float64)
    begin, lasts = np.zeros(len(left), np.int64), (left > 0) & (share > 0)
    at, phases = 0, []
    while lasts.any():
        edges = np.concatenate([[0.0], np.cumsum(np.where(lasts, share, 0))])
        edges = np.where(edges == edges[-1], window, edges * (window / edges[-1]))
        quanta = np.diff(edges)
        phase = Phase(at, 0, edges, begin)
        served = lambda n: np.diff(np.floor(n * edges)).astype(np.int64)  # noqa: B023,E731
        n = int((left[lasts] / quanta[lasts]).min()) + 2
        while n and (served(n) > left).any():
            n -= 1
        if n:
            phases.append(Phase(at, n, edges, begin))
            at, begin, left = at + n, begin + served(n), left - served(n)
        lasts &= left >= quanta
    return Schedule(window, phases, begin, at * window + np.cumsum(left) - left)


def schedule(rows: DataFrame, window: int = WINDOW, targets: dict[str, float] | None = None) -> tuple[DataFrame, Schedule]:
    """``(row, queue, place)``, where each document starts in its queue, and the schedule of the queues.

    ``rows`` is ``(row, source, doc_tokens)`` with distinct ``row``, whose upper bits name the part of the table that
    holds it. ``targets`` maps each source to its wanted share; without it a source gets its share of all tokens, so
    that all queues end together. A source without a target raises an error in the job. Sources of less than
    ``LEAST_QUANTUM`` tokens to a window share a queue, in which a document's turn comes when its source's deficit covers it.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("part", F.shiftrightunsigned("row", 33))
    parts = stage(rows.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens")), "queues")
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    sources = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    sources = stage(sources.withColumn("quantum", _share(targets, total) * window), "sources")
    large = F.col("quantum") >= LEAST_QUANTUM
    own = [(r["source"], r["tokens"], r["quantum"]) for r in sources.where(large).collect()]  # window / LEAST_QUANTUM at most
    own.sort(key=lambda r: (-r[2], r[0] is not None, r[0] or ""))
    small = sources.where(~large).agg(F.sum("tokens").alias("tokens"), F.sum("quantum").alias("quantum")).first()
    shared = [small["tokens"] or 0, small["quantum"] or 0.0]
    while own and shared[0] and shared[1] < LEAST_QUANTUM:
        _, tokens, quantum = own.pop()
        shared = [shared[0] + tokens, shared[1] + quantum]
    plan = scheduled([n for _, n, _ in own] + [shared[0]], [q for *_, q in own] + [shared[1]], window)
    queues = F.broadcast(spark.createDataFrame([(name, k) for k, (name, *_) in enumerate(own)], "source string, queue int")).alias("o")
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("ahead")).alias("p")
    facts = parts.join(sources.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source"))).select("p.source", "part", "ahead", "quantum").alias("f")
    facts = facts.join(queues, F.col("f.source").eqNullSafe(F.col("o.source")), "left").select("f.*", F.coalesce("queue", F.lit(len(own))).alias("queue")).alias("f")
    inner = Window.partitionBy("source", "part").orderBy("row")
    queued = rows.withColumn("end", F.sum("doc_tokens").over(inner)).alias("r")
    queued = queued.join(facts, F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.part") == F.col("f.part")))
    queued = queued.select("row", "r.source", "doc_tokens", "queue", "quantum", (F.col("end") + F.col("ahead")).alias("end"))
    alone = queued.where(F.col("queue") < len(own)).select("row", "queue", (F.col("end") - F.col("doc_tokens")).alias("place"))
    if not shared[0]:
        return alone, plan
    turns = queued.where(F.col("queue") == len(own)).withColumn("turn", F.col("end") / F.col("quantum"))
    turns = turns.withColumn("group", F.floor(F.col("turn") * (shared[1] / ORDERED)))
    before = _before(turns.groupBy("group").agg(F.sum("doc_tokens").alias("tokens")), "group", "tokens")
    order = Window.partitionBy("group").orderBy("turn", "source", "row").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("inner", F.coalesce(F.sum("doc_tokens").over(order), F.lit(0)))
    return alone.unionByName(turns.join(before, "group").select("row", "queue", (F.col("before") + F.col("inner")).alias("place"))), plan


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, window: int = WINDOW, targets: dict[str, float] | None = None, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a window, with its ids.

    Columns: ``doc_id, start, length, doc_tokens, sequence_id, offset, source, ids``; ``ids`` holds unsigned
    little-endian 32-bit integers. Every id of every row of ``docs`` (``doc_id``, ``source``, ``text``), repeated rows
    included, lies in one piece; all windows but the last are full, and all but the last few hold their target shares. A
    null text is empty and gives the end id alone; a null source is a queue of its own; a null doc_id is kept; an empty
    table gives no pieces. Other columns are ignored.
    """
    rows = stage(tokenized(docs, vocabulary, ranks, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    places, plan = schedule(rows.select("row", "source", "doc_tokens"), window, targets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found, ids = [], [], []
            for k, (queue, place, z) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("queue", "place", "ids")))):
                own = np.frombuffer(z, "<u2").astype("<u4").tobytes()
                for columns in plan.pieces(queue, place, len(z) // 2):
                    found.append(columns)
                    of.append(np.full(len(columns[0]), k))
                    ids += [own[4 * a : 4 * (a + n)] for a, n in zip(columns[0].tolist(), columns[1].tolist())]
            if ids:
                of = pa.array(np.concatenate(of))
                start, length, sequence, offset = (pa.array(np.concatenate(x)) for x in zip(*found))
                columns = [batch.column("doc_id").take(of), start, length, batch.column("doc_tokens").take(of), sequence, offset, batch.column("source").take(of)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], _PIECES)

    placed = rows.join(places, "row").select("doc_id", "source", "doc_tokens", "queue", "place", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


_PIECES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"]
