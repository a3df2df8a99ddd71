"""Benchmark passages in training texts, by a broadcast hash set of the benchmark's word windows.

Both sides are normalised alike. The windows of the benchmark go to every executor as sorted fingerprints with a SHA-256
of each, in parts of a bounded size; the windows of each text are looked up there, hits are verified by the digest, and
spans of words, or whole documents, are removed. Texts are not shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .batches import sliced
from .words import BLANK, WORD, Fingerprints, Words, mixed, polynomials, words_of

#: Words of a window.
WINDOW = 10
#: Windows, and bytes of item ids, that are broadcast at once: some 60 MB. A larger benchmark takes several passes.
AT_ONCE, ID_BYTES = 1 << 19, 1 << 25
#: A word's bytes: letters, digits and all beyond ASCII; the others are blanks between neighbours.
KINDS = np.full(256, BLANK, np.uint8)
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = KINDS[128:] = WORD
LEAK = "struct<n_words:long,n_hit:long,spans:array<struct<begin:long,end:long>>,items:array<string>>"


def _prints(words: Words, n: int) -> np.ndarray:
    high, low = Fingerprints(words, polynomials(2)).of(n)
    return mixed((high << np.uint64(31) | low) ^ np.uint64(n))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(fp, n, digest, item)``: the distinct windows of each item; an item of fewer words is one window, without words none.

    Windows of items without an id are kept, with a null item.
    """

    def listed(rows: list[tuple[int, int, bytes, int]], items: pa.Array) -> pa.RecordBatch:
        fp, n, digest, doc = zip(*rows) if rows else ((), (), (), ())
        columns = [pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), items.take(pa.array(doc, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["fp", "n", "digest", "item"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", 1 << 17):
            words = words_of(part.column("text"), KINDS)
            counts = np.bincount(words.text, minlength=part.num_rows)
            first = np.cumsum(counts) - counts
            prints = {n: _prints(words, n) for n in np.unique(np.minimum(counts[counts > 0], size)).tolist()}
            rows: list[tuple[int, int, bytes, int]] = []
            for doc, (count, begin) in enumerate(zip(counts.tolist(), first.tolist())):
                n = min(count, size)
                for i in range(begin, begin + count - n + 1) if n else ():
                    rows.append((int(prints[n][i : i + 1].view(np.int64)[0]), n, hashlib.sha256(words.slice(i, n)).digest(), doc))
                    if len(rows) == 1 << 16:
                        yield listed(rows, part.column("item"))
                        rows.clear()
            yield listed(rows, part.column("item"))

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(windows, "fp long, n int, digest binary, item string").distinct()


@dataclass(frozen=True)
class HashSet:
    """Some windows of the benchmark: sorted fingerprints, for each its windows, for each window its digest and items."""

    sizes: list[int]
    fps: np.ndarray
    first: np.ndarray
    digests: list[bytes]
    items: list[list[str]]

    @staticmethod
    def of(rows: pa.Table) -> HashSet:
        fps, digests, items = rows.column("fp").to_numpy().view(np.uint64), rows.column("digest").to_pylist(), rows.column("item").to_pylist()
        windows: dict[tuple[int, bytes], list[str]] = {}
        for fp, digest, item in sorted(zip(fps.tolist(), digests, items), key=lambda r: r[:2]):
            own = windows.setdefault((fp, digest), [])
            if item is not None:
                own.append(item)
        unique, first = np.unique(np.array([fp for fp, _ in windows], np.uint64), return_index=True)
        return HashSet(sorted(set(rows.column("n").to_pylist())), unique, np.append(first, len(windows)), [d for _, d in windows], list(windows.values()))

    def filter(self) -> np.ndarray:
        """A table of flags by the fingerprint's last bits, of 16 places for each fingerprint and 8 million at most."""
        out = np.zeros(1 << min(23, max(16, math.ceil(math.log2(16 * len(self.fps) + 1)))), bool)
        out[self.fps & np.uint64(len(out) - 1)] = True
        return out

    def found(self, prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``prints`` of known fingerprints, and which ones they are."""
        at = np.flatnonzero(table[prints & np.uint64(len(table) - 1)])
        which = np.minimum(np.searchsorted(self.fps, prints[at]), len(self.fps) - 1)
        same = self.fps[which] == prints[at]
        return at[same], which[same]


def _scan(docs: DataFrame, known: Broadcast, before: bool) -> DataFrame:
    """``docs`` with ``leak`` for the windows of one broadcast hash set, added to what an earlier pass found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: HashSet = known.value
        table = own.filter()
        for part in sliced(batches, "text"):
            words = words_of(part.column("text"), KINDS)
            counts = np.bincount(words.text, minlength=part.num_rows)
            begin = np.cumsum(counts) - counts
            old = part.column("leak").to_pylist() if before else None
            change = np.zeros(len(words) + 1, np.int32)
            items: dict[int, set[str]] = {}
            for n in own.sizes:
                on = np.flatnonzero(words.text[: max(0, len(words) - n + 1)] == words.text[n - 1 :])
                at, which = own.found(_prints(words, n)[on], table)
                for i, w in zip(on[at].tolist(), which.tolist()):
                    digest = hashlib.sha256(words.slice(i, n)).digest()
                    for k in range(own.first[w], own.first[w + 1]):
                        if own.digests[k] == digest:
                            change[i] += 1
                            change[i + n] -= 1
                            items.setdefault(int(words.text[i]), set()).update(own.items[k])
            for doc, leak in enumerate(old or []):
                for span in leak["spans"]:
                    a, b = (begin[doc] + np.searchsorted(words.raw_starts[begin[doc] : begin[doc] + counts[doc]], x) for x in (span["begin"], span["end"]))
                    change[a] += 1
                    change[b] -= 1
                if leak["items"]:
                    items.setdefault(doc, set()).update(leak["items"])
            hit = np.cumsum(change[:-1]) > 0
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1] | (words.text[1:] != words.text[:-1])
            closes[:-1] &= ~hit[1:] | (words.text[1:] != words.text[:-1])
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
            edges = pa.array(np.searchsorted(words.text[opens], np.arange(part.num_rows + 1)), pa.int32())
            spans = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(words.raw_starts[opens]), pa.array(words.raw_ends[closes])], ["begin", "end"]))
            n_hit = pa.array(np.bincount(words.text[hit], minlength=part.num_rows))
            names = pa.array([sorted(items.get(doc, ())) for doc in range(part.num_rows)], pa.list_(pa.string()))
            leak = pa.StructArray.from_arrays([pa.array(counts), n_hit, spans, names], ["n_words", "n_hit", "spans", "items"])
            columns = [c for c in part.schema.names if c != "leak"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], leak], [*columns, "leak"])

    return docs.mapInArrow(scan, docs.drop("leak").withColumn("leak", F.lit(None).cast(LEAK)).schema)


def marked(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, at_once: int = AT_ONCE) -> DataFrame:
    """All rows and columns of ``docs`` (``text``) with ``leak``: ``n_words``, ``n_hit``, ``spans`` and ``items``.

    A word is hit if it lies inside an occurrence of a window: ``size`` consecutive words of an item of ``benchmark``
    (``item_id``, ``text``), or all words of a shorter one. Words are runs of letters, digits and characters beyond
    ASCII, lower-cased in A-Z. ``spans`` are the maximal runs of hit words as byte places in the text, ``items`` the ids
    whose windows occur, sorted as strings.

    A null or empty text has no words; repeated rows each get their own result; items of one id are one item; an item
    without an id marks words and is not listed; a column ``leak`` of ``docs`` is replaced, others stay. With an empty
    benchmark nothing is hit. The hash set holds ``at_once`` windows at most; a larger benchmark is dealt evenly, by
    hash, into several, and each pass but the last writes its result.
    """
    windows = stage(benchmark_windows(benchmark, size), "windows")
    total = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("b")).first()
    passes = max(1, math.ceil(total["n"] / at_once), math.ceil(total["b"] / ID_BYTES))
    out = docs.drop("leak").withColumn("text", F.col("text").cast("string"))
    for k in range(passes):
        own = windows.where(F.pmod(F.xxhash64("digest", "item"), F.lit(passes)) == k).toArrow()  # at_once rows or so
        known = docs.sparkSession.sparkContext.broadcast(HashSet.of(own))
        out = _scan(out, known, k > 0)
        if k + 1 < passes:
            out = stage(out, "leaks")
    return out


def _outside(text: str, spans: str) -> Column:
    """The text without the byte spans."""
    whole = F.encode(F.col(text), "UTF-8")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.octet_length(text).cast("long")))
    cut = lambda a, b: F.decode(F.substring(whole, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.array_join(F.zip_with(begins, ends, cut), ""))


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` whose texts lack every hit word with what stands between the words of a span; no row goes."""
    found = marked(docs, benchmark, size)
    return found.withColumn("text", _outside("text", "leak.spans")).drop("leak")


def without_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit word."""
    return marked(docs, benchmark, size).where("leak.n_hit = 0").drop("leak")


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of marked documents."""
    items = F.sha2(F.array_join("leak.items", ",").cast("binary"), 256)
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"))


def digest_sql() -> str:
    """DuckDB SQL over ``documents`` and ``benchmark`` for the rows of ``digest`` with the usual window."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
 items AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(len(w), {WINDOW}) AS m FROM b WHERE len(w) > 0))),
 windows AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM items) sizes)),
 hits AS (SELECT doc_id, i, m, item_id FROM windows JOIN items USING (m, t)),
 n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS word FROM hits) GROUP BY 1),
 names AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN names USING (doc_id)"""
