"""Streaming forms: bursts as they close, bursts as they grow, and rescans of what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import generations
from ..sources.scans import SCHEMA_VERSION, changed_since

#: Deltas of a snapshot after which a rescan folds them into one table.
DELTAS = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bursts(stream: DataFrame, keys: list[str], ts: str = "creation_ts", gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """``(keys, session_start, session_end, session_size)`` of bursts of two and more.

    In append mode a burst comes out once the watermark has passed its end; later rows of it are dropped.
    """
    sessions = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("session_size"), F.max(ts).alias("session_end"))
    return sessions.where("session_size > 1").select(*keys, F.col("w.start").alias("session_start"), "session_end", "session_size")


# --- bursts that are shown while they grow ---

_OPEN = "id long, first long, last long, size long, revision int, shown boolean"


class _Bursts(StatefulProcessor):
    """Holds a key's open bursts and tells of each one that a micro-batch or the watermark has changed."""

    def __init__(self, keys: list[str], gap_us: int):
        self.keys, self.gap = keys, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def _rows(self, key: tuple[Any, ...], told: list[tuple]) -> pd.DataFrame:
        columns = ["burst_id", "revision", "state", "first_us", "last_us", "session_size", "into"]
        out = pd.DataFrame(told, columns=columns)
        for i, name in enumerate(self.keys):
            out.insert(i, name, [key[i]] * len(out))
        return out.astype({"into": "Int64"})

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part["at_us"].tolist())
        before = sorted((list(b) for b in self.open.get()), key=lambda b: b[1]) if self.open.exists() else []
        # an open burst is one piece, a new row another; pieces no further apart than the gap are one burst
        pieces = sorted([(b[1], b[2], b[3], b) for b in before] + [(t, t, 1, None) for t in times], key=lambda p: p[:2])
        bursts: list[list] = []  # first, last, size, what they were before, whether anything is new
        for first, last, size, old in pieces:
            if bursts and first - bursts[-1][1] <= self.gap:
                own = bursts[-1]
                own[1], own[2] = max(own[1], last), own[2] + size
                own[3] += [old] if old else []
                own[4] += old is None
            else:
                bursts.append([first, last, size, [old] if old else [], int(old is None)])
        told, kept = [], []
        for first, last, size, olds, new in bursts:
            if not new and len(olds) == 1:
                kept.append(tuple(olds[0]))
                continue
            main = min(olds, key=lambda b: (not b[5], b[0])) if olds else [first, 0, 0, 0, 0, False]
            shown = main[5] or size > 1
            told += [(b[0], b[4] + 1, "merged", b[1], b[2], b[3], main[0]) for b in olds if b is not main and b[5]]
            told += [(main[0], main[4] + 1, "open", first, last, size, None)] if shown else []
            kept.append((main[0], first, last, size, main[4] + int(shown), shown))
        self.open.put(kept)
        self._wake(kept)
        if told:
            yield self._rows(key, told)

    def _ends(self, last_us: int) -> int:
        """The first millisecond at which no row that is on time can still belong to a burst with this last row."""
        return (last_us + self.gap) // 1000 + 1

    def _wake(self, kept: list[tuple]) -> None:
        """One timer for the open burst that ends first: it closes all that are over by then and sets the next."""
        if kept:
            self.handle.registerTimer(min(self._ends(b[2]) for b in kept))

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        bursts = [tuple(b) for b in self.open.get()] if self.open.exists() else []
        over = [b for b in bursts if self._ends(b[2]) <= now]
        kept = [b for b in bursts if self._ends(b[2]) > now]
        if over:
            self.open.put(kept) if kept else self.open.clear()
        self._wake(kept)
        told = [(b[0], b[4] + 1, "closed", b[1], b[2], b[3], None) for b in over if b[5]]
        if told:
            yield self._rows(key, told)

    def close(self) -> None:
        pass


def growing_bursts(stream: DataFrame, keys: list[str], ts: str = "creation_ts", gap_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """Revisions of bursts: published with their second row, revised with each micro-batch that changes them, until closed.

    Columns: the keys, ``burst_id`` (microseconds of its first row when it began), ``revision`` from 1, ``state`` (``open``,
    ``closed``, or ``merged`` when a late row joined it to the burst ``into``), ``session_start``, ``session_end`` and
    ``session_size``. The highest revision of each burst is how it stands, those that were merged left out; closed ones do
    not change any more. A gap of exactly ``gap_s`` seconds does not split. Rows without a time are dropped, and rows that
    come ``late`` after the newest one. A key's rows of one micro-batch and its open bursts, which span no more than
    ``late``, meet in one task.

    Append mode; needs the RocksDB state store (``use_rocksdb``).
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(*keys, ts, F.unix_micros(ts).alias("at_us"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", burst_id long, revision int, state string, first_us long, last_us long, session_size long, into long"
    found = rows.groupBy(*keys).transformWithStateInPandas(_Bursts(keys, gap_s * 1_000_000), schema, "Append", "EventTime")
    at = lambda c, name: F.timestamp_micros(c).alias(name)
    return found.select(*keys, "burst_id", "revision", "state", at("first_us", "session_start"), at("last_us", "session_end"), "session_size", "into")


def latest_bursts(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """How the bursts stand: the highest revision of each, without those that became part of another."""
    rest = [c for c in revisions.columns if c not in (*keys, "burst_id", "revision")]
    last = revisions.groupBy(*keys, "burst_id").agg(F.max(F.struct("revision", *rest)).alias("r"))
    return last.select(*keys, "burst_id", "r.*").where("state <> 'merged'")


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams started from now on is kept in RocksDB, which state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- rescans ---


def known_assets(spark: SparkSession, path: str, of: DataFrame | None = None) -> DataFrame:
    """``(asset_id, modification_ts)`` as last scanned; with ``of`` only for its ``asset_id``s, which are found before any shuffle."""
    state = generations.current(spark, path)
    if state is None or "known" not in state.tables:
        return spark.createDataFrame([], "asset_id string, modification_ts timestamp")
    rows = generations.read(spark, path, state, "known")
    rows = rows if of is None else rows.join(of.select("asset_id").distinct(), "asset_id", "left_semi")
    last = rows.groupBy("asset_id").agg(F.max(F.struct("generation", "modification_ts")).alias("last"))
    return last.select("asset_id", "last.modification_ts")


def scan_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that committed batches have scanned; None before the first one."""
    state = generations.current(spark, path)
    return generations.read(spark, path, state, "results") if state and "results" in state.tables else None


def rescan_batch(rows: DataFrame, number: int, path: str, scan: Callable[[DataFrame], DataFrame], version: int = SCHEMA_VERSION) -> bool:
    """Scan what is new or changed in a batch of assets and note it as known, in one commit; False if the batch was done before.

    Of an asset that is in the batch several times the newest version counts. What a batch wrote before it failed belongs
    to no generation, so a replay starts over; after the commit a replay changes nothing. With another ``version`` than
    the stored one nothing counts as known.
    """
    spark = rows.sparkSession
    state = generations.current(spark, path)
    if state and state.marks.get("version") == version and state.marks.get("batch", -1) >= number:
        return False
    fresh = state is None or state.marks.get("version") != version
    newest = rows.groupBy("asset_id").agg(F.max_by(F.struct(*rows.columns), "modification_ts").alias("r")).select("r.*")
    known = known_assets(spark, path, rows)
    known = known.where("false") if fresh else known
    changed = changed_since(newest, known.withColumn("schema_version", F.lit(version)), version)
    done = generations.write(changed, path)
    changed = spark.read.schema(changed.schema).parquet(f"{path}/data/{done.folder}")  # what is scanned is what is noted
    results = scan(changed)
    generation = (state.number if state else 0) + 1
    note = changed.select("asset_id", "modification_ts").withColumn("generation", F.lit(generation).cast("long"))
    olds = [] if fresh else state.tables.get("known", [])
    if len(olds) >= DELTAS:
        merged = known_assets(spark, path).join(note, "asset_id", "left_anti").withColumn("generation", F.lit(generation).cast("long")).unionByName(note)
        notes = [generations.write(merged, path)]
    else:
        notes = [*olds, generations.write(note, path)]
    written = [*([] if fresh else state.tables.get("results", [])), generations.write(results, path)]
    generations.commit(spark, path, state, {"known": (notes, note.schema), "results": (written, results.schema)}, {"batch": number, "version": version})
    return True


def rescans(stream: DataFrame, path: str, scan: Callable[[DataFrame], DataFrame], checkpoint: str, version: int = SCHEMA_VERSION) -> StreamingQuery:
    """Scan the new and changed assets of each micro-batch; ``scan_results`` has the rows, ``known_assets`` the snapshot.

    ``path`` belongs to this stream and its checkpoint: batches are told apart by their number.
    """
    return stream.writeStream.foreachBatch(lambda rows, number: rescan_batch(rows, number, path, scan, version) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- selection ---


class _Selection(StatefulProcessor):
    """Holds a group's keep, its last reset and the members changed since, and tells of each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keep = handle.getValueState("keep", "keep string")
        self.reset = handle.getValueState("reset", "epoch int, all boolean, keep string")
        self.items = handle.getMapState("items", "item string", "epoch int, selected boolean")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq")
        epoch, everything, spared = before = self.reset.get() if self.reset.exists() else (0, False, None)
        chosen = given = self.keep.get()[0] if self.keep.exists() else None
        told, items, changed = [], {}, set()  # each member's state is read once and written once in a micro-batch

        def selected(item: str) -> bool:
            if item not in items:
                items[item] = self.items.getValue((item,)) if self.items.containsKey((item,)) else (-1, False)
            at, now = items[item]
            return bool(now) if at == epoch else everything and item != spared

        for seq, item, op, recommended in zip(log["seq"].tolist(), log["item_id"], log["op"], log["recommended_keep"]):
            keep = chosen if chosen is not None else recommended
            if op in ("select_all", "deselect_all"):
                epoch, everything, spared = epoch + 1, op == "select_all", keep
                told.append((key[0], seq, None, everything, spared))
                continue
            if op == "set_keep":
                chosen, now = item, False
            elif item != keep:
                now = not selected(item)
            else:
                continue
            items[item] = (epoch, now)
            changed.add(item)
            told.append((key[0], seq, item, now, None))
        if epoch != before[0]:
            self.reset.update((epoch, everything, spared))
        if chosen != given:
            self.keep.update((chosen,))
        for item in changed:
            self.items.updateValue((item,), items[item])
        if told:
            yield pd.DataFrame(told, columns=["group_id", "seq", "item_id", "selected", "keep"])

    def close(self) -> None:
        pass


def selection_changes(log: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, seq, item_id, selected, keep)``: what each event of a streamed log changes; a reset has a null item.

    The rules are those of ``review.replay``: a reset selects all but the keep of that moment, or none. A group's state
    is its keep, its last reset and the members that were changed since the reset, looked up one by one, so it
    does not grow with a group's size; the events of a group in one micro-batch meet in one task. ``members`` and
    ``groups`` are tables. Append mode; needs the RocksDB state store (``use_rocksdb``).
    """
    known = members.select("group_id", F.col("asset_id").alias("item_id"), F.lit(True).alias("known")).distinct()
    named = log.join(known, ["group_id", "item_id"], "left").where("known or op in ('select_all', 'deselect_all')")
    rows = named.join(groups.select("group_id", "recommended_keep"), "group_id", "left").select("group_id", "seq", "item_id", "op", "recommended_keep")
    return rows.groupBy("group_id").transformWithStateInPandas(_Selection(), "group_id string, seq long, item_id string, selected boolean, keep string", "Append", "None")


def standing_selection(changes: DataFrame, members: DataFrame) -> DataFrame:
    """``(group_id, asset_id, selected)`` of all members after the ``changes`` so far."""
    resets = changes.where("item_id is null").groupBy("group_id").agg(F.max(F.struct("seq", "selected", "keep")).alias("reset"))
    own = changes.where("item_id is not null").groupBy("group_id", F.col("item_id").alias("asset_id")).agg(F.max(F.struct("seq", "selected")).alias("own"))
    rows = members.select("group_id", "asset_id").join(resets, "group_id", "left").join(own, ["group_id", "asset_id"], "left")
    later = F.col("own").isNotNull() & (F.col("reset").isNull() | (F.col("own.seq") > F.col("reset.seq")))
    base = F.coalesce(F.col("reset.selected"), F.lit(False)) & ~F.coalesce(F.col("reset.keep") == F.col("asset_id"), F.lit(False))
    return rows.select("group_id", "asset_id", F.when(later, F.col("own.selected")).otherwise(base).alias("selected"))
