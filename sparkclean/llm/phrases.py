"""Phrases whose words occur together more often than apart, by Rabin-Karp fingerprints.

Every run of words is named by a fingerprint of 62 bits and a check of 31 more, from prefix polynomials over three bases.
Only fingerprints are shuffled, each with its count and a pointer to a document that holds it; two phrases under one
fingerprint differ in the check and stay two keys. Fingerprints that are frequent are looked up in the documents their
pointers name, so no other phrase is ever written out as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .batches import sliced
from .spread import spread_join
from .words import BLANK, BREAK, Fingerprints, Words, mixed, polynomials, words_of

#: Runs of words that a task groups together before it passes them on.
HELD = 1 << 21
#: Bits of the table that tells which shorter runs may be frequent: so many for each of them, and at most.
BITS_EACH, MOST_BITS = 8, 1 << 27
#: Groups in which a language's best phrases are found before the last of them are compared.
TOPS = 64
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
_GRAM = "n int, fp long, control int, count long, row long"


def numbered(docs: DataFrame) -> DataFrame:
    """``(row, lang, text)`` of all documents, staged; a null language is ``und``, a null text empty."""
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), lang.alias("lang"), text.alias("text")), "texts")


class Grams:
    """The fingerprints of one part's runs of words, apart for each language."""

    def __init__(self, words: Words, langs: np.ndarray, bits: int):
        self.words, self.own = words, langs[words.text]
        self.prints = Fingerprints(words, polynomials(3))
        self.bits = np.uint64(64 - bits)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and check of the run of ``n`` words from each word on, whether or not the words are neighbours."""
        high, low, control = self.prints.of(n)
        return mixed((high << np.uint64(31) | low) ^ self.own[: len(high)]) >> self.bits, control.astype(np.int32)


def _columns(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    seeds = part.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return part.column("text"), seeds, part.column("row").to_numpy(zero_copy_only=False)


def _seed() -> Column:
    return F.xxhash64("lang").alias("seed")


def _grouped(n: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Counts and smallest rows of equal fingerprints; an unlikely second check under one may give rows of its own."""
    fp, control, row = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(fp)
    fp, control, row = fp[order], control[order], row[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (control[1:] != control[:-1])
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(row, at) if len(at) else row
    columns = [np.full(len(at), n, np.int32), fp[at].view(np.int64), control[at], np.diff(np.append(at, len(fp))), least]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "fp", "control", "count", "row"])


def _counted(texts: DataFrame, lengths: list[int], bits: int, shorter: tuple[int, Broadcast] | None = None) -> DataFrame:
    """``(n, fp, control, count, row)`` of all runs of the given lengths, and for n = 0 all words of a language.

    ``shorter`` is a bit table's size and its broadcast bytes: only runs whose both runs of one word less may be frequent
    are counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {n: [] for n in lengths}
        totals: dict[int, list[int]] = {}
        size = 0
        table = np.frombuffer(shorter[1].value, np.uint8) if shorter else None
        for part in sliced(batches, "text"):
            text, seeds, rows = _columns(part)
            words = words_of(text, KINDS)
            grams = Grams(words, seeds, bits)
            if 1 in lengths:
                for seed, row, n in zip(seeds.view(np.int64).tolist(), rows.tolist(), np.bincount(words.text, minlength=len(rows)).tolist()):
                    total = totals.setdefault(seed, [0, row])
                    total[0] += n
            for n in lengths:
                on = words.runs(n)
                if table is not None and n > 1:
                    slot = grams.of(n - 1)[0] & np.uint64(shorter[0] - 1)
                    known = (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    on = on & known[: len(on)] & known[1 : len(on) + 1]
                fp, control = grams.of(n)
                on = np.flatnonzero(on)
                held[n].append((fp[on], control[on], rows[words.text[on]]))
                size += len(on)
            if size > HELD:
                yield from (_grouped(n, held[n]) for n in lengths)
                held, size = {n: [] for n in lengths}, 0
        if size:
            yield from (_grouped(n, held[n]) for n in lengths)
        if totals:
            rows = [(0, seed, 0, n, row) for seed, (n, row) in totals.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["n", "fp", "control", "count", "row"])

    return texts.select("row", _seed(), "text").mapInArrow(count, _GRAM)


def _table(frequent: DataFrame, n: int) -> tuple[int, Broadcast]:
    """A bit table of the frequent runs of ``n`` words: its size in bits, bounded, and its broadcast bytes."""
    own = frequent.where(F.col("n") == n)
    size = 1 << 15
    while size < min(MOST_BITS, BITS_EACH * own.count()):
        size *= 2
    slot = F.col("fp").bitwiseAND(F.lit(size - 1)) + 1
    blocks = own.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    whole = bytearray(size // 8)
    for r in blocks.collect():  # size / 32,768 rows of 4 KB
        at = (r["block"] - 1) * 4096
        whole[at : at + 4096] = r["bits"]
    return size, own.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_prints(texts: DataFrame, most_words: int = 3, least: int = 10, bits: int = 64) -> DataFrame:
    """``(n, fp, control, a, row)`` of all runs of up to ``most_words`` words that occur ``least`` times or more, staged.

    Runs of one and two words are counted in one pass. Longer ones have a pass for each length, in which a table of the
    frequent shorter ones keeps most rare runs out of the shuffle; what it lets through is counted exactly. The rows
    with n = 0 hold all words of a language, whose hash is their fingerprint.
    """

    def kept(grams: DataFrame) -> DataFrame:
        sums = grams.groupBy("n", "fp", "control").agg(F.sum("count").alias("a"), F.min("row").alias("row"))
        return stage(sums.where((F.col("a") >= least) | (F.col("n") == 0)), "grams")

    found = [kept(_counted(texts, [1, 2][:most_words], bits))]
    for n in range(3, most_words + 1):
        found.append(kept(_counted(texts, [n], bits, _table(found[-1], n - 1))))
    return reduce(DataFrame.unionByName, found)


def named(texts: DataFrame, prints: DataFrame, bits: int = 64) -> DataFrame:
    """``(lang, n, phrase, a)``: the text of each fingerprint, from the document that its pointer names.

    A document brings no more fingerprints than it has runs of words. Its runs are hashed again, and each fingerprint is
    written out from the first run that has it, together with its check; one that is not there is an error.
    """
    wanted = prints.where("n > 0").groupBy("row").agg(F.collect_list(F.struct("n", "fp", "control", "a")).alias("wanted"))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            text, seeds, _ = _columns(part)
            words = words_of(text, KINDS)
            grams = Grams(words, seeds, bits)
            lists, flat = part.column("wanted"), part.column("wanted").flatten()
            doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            length, fps, controls, a = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            keys = lambda d, fp, control: mixed(mixed(fp ^ mixed(d.astype(np.uint64) + np.uint64(1))) ^ control.astype(np.uint64))
            phrases: list[str | None] = [None] * len(doc)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                asked = keys(doc[own], fps[own].view(np.uint64), controls[own])
                order = np.argsort(asked)
                fp, control = grams.of(n)
                at = np.flatnonzero(words.runs(n))
                have = keys(words.text[at], fp[at], control[at])
                place = np.minimum(np.searchsorted(asked[order], have), len(asked) - 1)
                hit = np.flatnonzero(asked[order][place] == have)
                _, first = np.unique(place[hit], return_index=True)
                for h in hit[first].tolist():
                    phrases[own[order[place[h]]]] = words.slice(at[h], n).decode("utf-8", "replace")
            if None in phrases:
                raise RuntimeError("a fingerprint is not in the document that its pointer names")
            langs = part.column("lang").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([langs, flat.field(0), pa.array(phrases, pa.string()), pa.array(a)], ["lang", "n", "phrase", "a"])

    return texts.join(wanted, "row").select("row", _seed(), "lang", "text", "wanted").mapInArrow(lookup, "lang string, n int, phrase string, a long")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, covered: int = 50, first: int = 2000, bits: int = 64) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``first`` phrases of 2 to ``most_words`` words.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. A
    phrase that occurs ``a`` >= ``least`` times is scored by its worst cut: ``floor(10**6 * a * a / (l * r))`` for the
    counts ``l`` and ``r`` of its two sides, ties to the earlier cut; ``n`` counts all words of the language. A phrase
    inside a longer one that occurs at least ``covered`` percent as often is dropped. Order: score, count, then the
    bytes of the phrase.

    Null languages are one language with ``und``; null and empty texts have no words; repeated rows count each time;
    other columns are not read; a table without phrases gives no rows. ``bits`` narrows fingerprints, for tests.
    """
    texts = numbered(docs)
    prints = frequent_prints(texts, most_words, least, bits)
    counts = stage(named(texts, prints, bits), "phrases")
    facts = counts.select("lang", "phrase", "a")
    candidates = counts.where("n > 1").withColumn("w", F.split("phrase", " "))
    words = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("left"), words(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = spread_join(cuts, facts.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side], ["phrase", "k"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"), wide("l") * wide("r")))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where("n > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"), "n")
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)))
    longer = longer.groupBy("lang", words(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("most"))
    left = worst.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOPS))
    best = left.withColumn("_at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_at") <= first).drop("_at")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = prints.where("n = 0").select(F.col("fp").alias("_lang"), F.col("a").alias("n"))
    return best.join(totals, F.xxhash64("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """DuckDB SQL over ``documents`` for the rows of ``collocations`` with its usual parameters."""
    return r"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
 words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
 grams AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3)) sizes(m))),
 f AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, any_value(g) AS w, count(*) AS a FROM grams GROUP BY ALL),
 totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
 c AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
 cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
 worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 inner_ones AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, m)) AS i FROM c WHERE m = 3) GROUP BY ALL),
 kept AS (SELECT w.* FROM worst w LEFT JOIN inner_ones i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
