"""Removal of repeated byte strings through the Burrows-Wheeler transform of blocks of candidate text.

Every window of ``length`` bytes names one anchor, the smallest hashed gram inside it, so equal windows name equal
anchors at the same place. Windows of one anchor that follow each other form a stretch of text. Equal stretches of an
anchor are one, marked as doubled if it occurs more than once. The stretches of all anchors that occur
again meet in blocks, whose suffix array and transform are built; breadth-first backward extension of intervals yields
the common prefix lengths by increasing value and stops at ``length``: what has no value by then repeats. A suffix of a
doubled stretch weighs two: its common prefix with its twin gets its value from the same extension, which reaches
it from the stretch's end mark. An anchor of very many stretches is split by further anchors of its windows, each by a hash of its own, into groups of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dealing import together
from ..storage import stage
from .batches import sliced

LENGTH, GRAM = 200, 24
#: Bytes of texts that are hashed at once, and bytes of stretches whose transform is built at once.
CHUNK, BLOCK = 1 << 21, 1 << 20
#: Different stretches of one anchor that meet in one block; larger groups are split by further anchors, so many times at
#: most, and what is then still larger meets by digests of its windows.
GROUP, SPLITS = 3000, 6


def gram_hashes(data: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on; ``gram`` is 3 times a power of two."""
    odd = np.uint64(0x9E3779B97F4A7C15)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a * odd) ^ b
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x

    h = data.astype(np.uint64) + np.uint64(1)
    h = joined(joined(h[:-2], h[1:-1]), h[2:])
    size = 3
    while size < gram:
        h = joined(h[:-size], h[size:])
        size *= 2
    if seed:
        h = (h ^ np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * odd
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, ...]:
    """``(first window, last window, anchor hash)`` of each stretch of texts laid end to end in ``data``.

    ``ends`` are the texts' ends; no window crosses one.
    """
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data, gram, seed)
    low = np.uint64(0xFFFFFF)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the left
    span, wanted = 1, length - gram + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wanted:
        least = np.minimum(least[: -(wanted - span)], least[wanted - span :])
    anchor = (least & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(data) + 1, np.int64)
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[: len(anchor)]) > 0)
    if not len(windows):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.flatnonzero((np.diff(anchor[windows]) != 0) | (np.diff(windows) != 1)) + 1
    first, last = windows[np.concatenate([[0], new])], windows[np.concatenate([new - 1, [len(windows) - 1]])]
    return first, last, hashes[anchor[first]]


def suffix_array(joined: np.ndarray, is_mark: np.ndarray) -> np.ndarray:
    """The suffix array of texts with an end mark after each, by prefix doubling of what is not yet in order.

    End marks are smaller than bytes and ordered by place. Ranks and places are sorted as one number.
    """
    n = len(joined)
    shift = np.uint64(n.bit_length())
    places = np.arange(n, dtype=np.uint64)
    low = (np.uint64(1) << shift) - np.uint64(1)
    byte = np.concatenate([np.where(is_mark, 0, joined.astype(np.uint64) + np.uint64(1)), np.zeros(3, np.uint64)])
    key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(4):  # what follows an end mark does not count
        own = np.where(ended, 0, byte[k : n + k]).astype(np.uint64)
        key = key << np.uint64(9) | own
        ended |= own == 0
    packed = np.sort(key << shift | places)
    order = (packed & low).astype(np.int64)
    key = packed >> shift
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) | ended[order]
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # the place of the first suffix of the same rank
    rank = np.empty(n, np.int64)
    rank[order] = group
    size = 4
    while True:
        last = np.concatenate([fresh[1:], [True]])
        open_ = np.flatnonzero(~(fresh & last))
        if not len(open_):
            return order
        at = order[open_]
        key = group[open_].astype(np.uint64) << shift | rank[np.minimum(at + size, n - 1)].astype(np.uint64)
        if 3 * int(shift) <= 64:
            packed = np.sort(key << shift | at.astype(np.uint64))
            order[open_], key = packed & low, packed >> shift
        else:
            resort = np.argsort(key)
            order[open_], key = at[resort], key[resort]
        fresh[open_] = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        rank[order[open_]] = group[open_]
        size *= 2


def repeated_starts(texts: list[bytes], length: int = LENGTH, doubled: list[bool] | None = None) -> np.ndarray:
    """Marks the positions of the joined ``texts``, an end mark after each, whose ``length`` bytes start elsewhere too.

    A ``doubled`` text counts as if it stood there twice.
    """
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    marks = np.cumsum(sizes + 1) - 1
    n = len(joined)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    symbols = joined.astype(np.int64) + len(texts)
    symbols[marks] = np.arange(len(texts))
    order = suffix_array(joined, is_mark)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]  # of the suffix that begins one symbol earlier
    before = symbols[order - 1]  # the transform
    shift = np.uint64(n.bit_length())
    same = (np.sort(before.astype(np.uint64) << shift | np.arange(n, dtype=np.uint64)) & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    left, right = np.full(n, -1), np.full(n, n)
    equal = before[same[1:]] == before[same[:-1]]
    left[same[1:][equal]] = same[:-1][equal]
    right[same[:-1][equal]] = same[1:][equal]
    # unknown[r]: the common prefix of the suffixes at places r - 1 and r has no value yet
    unknown = np.ones(n + 1, bool)
    heads = symbols[order]
    lo = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    hi = np.concatenate([lo[1:] - 1, [n - 1]])
    unknown[0] = False
    unknown[hi + 1] = False
    # a doubled suffix stands for two, whose common prefix ends with the text: its value comes from the end mark backwards
    twins = np.flatnonzero(doubled) if doubled else np.zeros(0, np.int64)
    at, alone = place[marks[twins]], np.ones(n, bool)
    for k in twins.tolist():
        alone[place[marks[k] - sizes[k] : marks[k]]] = False
    for value in range(1, length):
        more = sizes[twins] >= value
        twins, at = twins[more], step[at[more]]
        alone[at] = True
        if not len(lo):
            if not len(twins):
                break
            continue
        wide = hi - lo + 1
        ends = np.cumsum(wide)
        low = np.repeat(lo, wide)
        inside = np.arange(ends[-1]) - np.repeat(ends - wide, wide) + low
        new_lo = np.sort(step[inside[left[inside] < low]])
        new_hi = np.sort(step[inside[right[inside] > np.repeat(hi, wide)]])
        found = unknown[new_hi + 1]
        lo, hi = new_lo[found], new_hi[found]
        unknown[hi + 1] = False
    repeated = np.zeros(n, bool)
    repeated[order] = unknown[:-1] | unknown[1:] | ~alone
    return repeated


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_SPANS = "array<struct<a: int, b: int>>"
_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _packed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``(row, rest, z)``: each document's bytes, compressed, under a number of its own, and its ``carried`` columns."""
    docs = docs.select(F.struct(*[f"`{c}`" for c in carried]).alias("rest"), F.col("text").cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(z, pa.binary())], ["rest", "z"])

    packed = docs.mapInArrow(pack, f"rest {docs.schema['rest'].dataType.simpleString()}, z binary")
    return stage(packed.withColumn("row", F.monotonically_increasing_id()), "packed")


def _anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``(row, lo, hi, anchor, stretch)``: windows ``lo`` to ``hi`` of a document, their anchor's hash and a hash of their text."""

    def cut(texts: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        data = b"".join(t for _, t, _ in texts)
        ends = np.cumsum([len(t) for _, t, _ in texts])
        first, last, anchor = stretches(np.frombuffer(data, np.uint8), ends, length, gram)
        digest = xxhash.xxh3_64_intdigest
        text = np.fromiter([digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64, len(first))
        of = np.searchsorted(ends, first, side="right")
        starts = np.array([s for *_, s in texts]) - np.concatenate([[0], ends[:-1]])
        columns = [np.array([r for r, *_ in texts], np.int64)[of], (first + starts[of]).astype(np.int32), (last + starts[of]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(anchor.view(np.int64)), pa.array(text.view(np.int64))], ["row", "lo", "hi", "anchor", "stretch"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        held, size = [], 0
        for batch in batches:
            for row, z in zip(batch.column("row").to_pylist(), batch.column("z").to_pylist()):
                text = press.decompress(z)
                for s in range(0, max(1, len(text) - length + 1), CHUNK):  # giant texts in parts that share length - 1 bytes
                    part = text[s : s + CHUNK + length - 1]
                    if len(part) >= length:
                        held.append((row, part, s))
                        size += len(part)
                    if size >= CHUNK:
                        yield cut(held)
                        held, size = [], 0
        if held:
            yield cut(held)

    return stage(rows.select("row", "z").mapInArrow(find, "row long, lo int, hi int, anchor long, stretch long"), "anchors")


def _texts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (``row, lo, hi, anchor, stretch, n``) with the stretches' bytes as ``text``."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, asked in zip(batch.column("z").to_pylist(), batch.column("asked").to_pylist()):
                text = press.decompress(z)
                out += [(x["anchor"], x["stretch"], x["n"], text[x["lo"] : x["hi"] + length]) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.binary()])], ["anchor", "stretch", "n", "text"])

    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "anchor", "stretch", "n")).alias("asked"))
    return rows.select("row", "z").join(asked, "row").select("z", "asked").mapInArrow(fetch, _TEXTS)


_TEXTS = "anchor long, stretch long, n long, text binary"


def _by_transform(texts: DataFrame, length: int) -> DataFrame:
    """``(anchor, stretch, spans)``: the ranges of windows in each stretch that start elsewhere too."""

    def expand(held: list[tuple]) -> pa.RecordBatch:
        repeated = repeated_starts([t for *_, t in held], length, [n > 1 for *_, n, _ in held])
        spans, at = [], 0
        for *_, t in held:
            spans.append([{"a": a, "b": b} for a, b in _spans(repeated[at : at + len(t) - length + 1])])
            at += len(t) + 1
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(spans, _ARROW_SPANS)], ["anchor", "stretch", "spans"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("anchor", "stretch", "n", "text"))):
                if (size >= BLOCK or len(held) >= 30_000) and item[0] != held[-1][0]:
                    yield expand(held)
                    held, size = [], 0
                held.append(item)
                size += len(item[3])
        if held:
            yield expand(held)

    placed = together(texts.select("anchor", "stretch", "n", "text"), "anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(find, f"anchor long, stretch long, spans {_SPANS}")


def _split(texts: DataFrame, length: int, gram: int, seed: int) -> DataFrame:
    """The stretches cut where a further anchor of their windows changes: ``(up_anchor, up_stretch, shift, anchor, stretch, n, text)``.

    The new anchor is a hash of the old and the further one, so that equal windows still meet; ``shift`` is the place of
    the part's first window in the whole.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            data = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            first, last, further = stretches(np.frombuffer(data, np.uint8), ends, length, gram, seed)
            of = np.searchsorted(ends, first, side="right")
            parts = [data[a : b + length] for a, b in zip(first.tolist(), last.tolist())]
            up = [batch.column(c).take(pa.array(of)) for c in ("anchor", "stretch", "n")]
            anchors = [digest(b"%d %d" % (a, f)) for a, f in zip(up[0].to_pylist(), further.tolist())]
            columns = [up[0], up[1], pa.array(first - np.concatenate([[0], ends[:-1]])[of]), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (anchors, [digest(t) for t in parts])), up[2], pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["up_anchor", "up_stretch", "shift", "anchor", "stretch", "n", "text"])

    return texts.select("anchor", "stretch", "n", "text").mapInArrow(cut, f"up_anchor long, up_stretch long, shift long, {_TEXTS}")


def _marks(texts: DataFrame, length: int, gram: int, group: int, seed: int = 1) -> DataFrame:
    """``(anchor, stretch, spans)`` of different stretches ``(anchor, stretch, n, text)``."""
    variants = stage(texts.groupBy("anchor").agg(F.count("*").alias("variants")).where(F.col("variants") > group), "hot")
    if variants.isEmpty():
        return _by_transform(texts, length)
    found = _by_transform(texts.join(variants, "anchor", "left_anti"), length)
    hot = texts.join(variants.select("anchor"), "anchor")
    if seed > SPLITS:
        return found.unionByName(_by_digests(hot, length))
    parts = stage(_split(hot, length, gram, seed), "split")
    folded = parts.groupBy("anchor", "stretch").agg(F.sum("n").alias("n"), F.first("text").alias("text"))
    marks = _marks(stage(folded, "parts"), length, gram, group, seed + 1)
    moved = F.transform("spans", lambda x: F.struct((x["a"] + F.col("shift")).cast("int").alias("a"), (x["b"] + F.col("shift")).cast("int").alias("b")))
    whole = parts.join(marks, ["anchor", "stretch"]).groupBy("up_anchor", "up_stretch").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    return found.unionByName(whole.toDF("anchor", "stretch", "spans"))


def _by_digests(texts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many stretches: windows meet by their digests, wherever they are."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for anchor, stretch, n, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "stretch", "n", "text"))):
                found = [digest(text[k : k + length]) for k in range(len(text) - length + 1)]
                size = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * size, pa.int64()), pa.array([stretch] * size, pa.int64()), pa.array([n] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(found, pa.binary())], ["anchor", "stretch", "n", "k", "digest"])

    single = texts.mapInArrow(windows, "anchor long, stretch long, n long, k int, digest binary")
    counts = single.groupBy("digest").agg(F.sum("n").alias("times")).where("times > 1")
    found = single.join(counts, "digest").groupBy("anchor", "stretch")
    return found.agg(F.transform(F.collect_list("k"), lambda k: F.struct(k.alias("a"), (k + 1).alias("b"))).alias("spans"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``(row, spans)``: byte ranges of each row (``row``, ``z``) covered by strings that start twice or more."""
    anchors = _anchored(rows, length, gram)
    seen = stage(anchors.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "seen")
    again = stage(anchors.join(seen, "anchor"), "again")
    folded = again.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("first"))
    texts = stage(_texts(rows, folded.select("anchor", "stretch", "n", "first.*"), length), "texts")
    marks = stage(_marks(texts, length, gram, group).where(F.size("spans") > 0), "marks")
    shifted = F.transform("spans", lambda s: F.struct((F.col("lo") + s["a"]).alias("a"), (F.col("lo") + s["b"] - 1 + length).alias("b")))
    return again.join(marks, ["anchor", "stretch"]).select("row", shifted.alias("s")).groupBy("row").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _removed(docs: DataFrame, carried: list[str], length: int, gram: int, group: int) -> DataFrame:
    """``(rest, n_bytes, n_removed, n_spans, kept)`` for each row."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist()):
                text = press.decompress(z)
                out, last, n, end = [], 0, 0, -1
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if a > end:
                        out.append(text[last:a])
                        n += 1
                    end = last = max(end, b)
                rest = b"".join([*out, text[last:]])
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                runs.append(n)
                kept.append(rest)
            columns = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *columns, pa.array(kept, pa.binary())], ["rest", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = _packed(docs, carried)
    spans = repeated_spans(rows, length, gram, group)
    kind = rows.schema["rest"].dataType.simpleString()
    return rows.join(spans, "row", "left").select("rest", "z", "spans").mapInArrow(remove, f"rest {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Remove from each row of ``docs`` (``doc_id``, ``text``) every byte of strings that start twice or more.

    Columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary``: the UTF-8 bytes, how many are
    removed in how many runs, and what remains. Strings are ``length`` bytes, inside one text, and judged on the input;
    two starts in one document count too, and so do two equal rows. A null text is empty; texts shorter than
    ``length`` are kept whole; null ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    found = _removed(docs, ["doc_id"], length, gram, group)
    return found.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``docs`` with what remains of each text in its place; a character of which a byte is removed goes whole.

    All columns and rows are kept; a null text becomes an empty one.
    """
    found = _removed(docs, [c for c in docs.columns if c != "text"] or ["text"], length, gram, group)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])

    kind = found.schema["rest"].dataType.simpleString()
    texts = found.select("rest", "kept").mapInArrow(whole, f"rest {kind}, text string")
    return texts.select(*["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])
