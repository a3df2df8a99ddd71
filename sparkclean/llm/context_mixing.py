"""Language-model scoring by online logistic context mixing over hashed-context bit predictors.

A text is modelled as its lower-cased words, each followed by a blank, the last by an end byte. Every bit of it is
predicted from five contexts (the last one to four bytes, and the word so far, eight letters of it at most); each predictor is a
hashed slot with counts of zeros and ones over all training texts. A mixer adds the predictors' log odds with weights
that a gate chooses by bit position and by how well the two longest contexts are known, and an adaptive table refines
its output. Mixer and table learn online: texts are dealt by a hash of their own into shards, and in each shard scored
in a fixed order, lump by lump, each lump of training bits being learnt right after it was predicted. So a score depends
on the table, not on how it is cut. A training text's bits are predicted from the counts without themselves, so that
its score compares with that of a text that was not learnt.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .batches import sliced

#: Hashed slots of each predictor, as powers of two: the model's size, whatever the corpus has.
SLOT_BITS = (17, 19, 22, 23, 23)
#: Most words whose counts every task holds; the counts of all others are joined.
COMMON_WORDS = 1 << 18
CONTEXTS, BINS, END = len(SLOT_BITS), 32, 0xFF
FIRST = [sum(1 << b for b in SLOT_BITS[:k]) for k in range(CONTEXTS + 1)]
#: Bytes of normal text that are scored together, pairs of a byte and its contexts in a lump, and training tokens to a shard.
BLOCK, LUMP, SHARD = 3 << 20, 1 << 13, 4_000_000
#: Bytes of words that are counted together.
COUNTED = 24 << 20
#: Lumps of a shard that are learnt once before they are scored.
WARM = 16
#: Most tasks that shards are dealt over; beyond, a task has several shards.
MOST_TASKS = 100_000
PRIOR = 0.05
LEVELS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same for a column: the words of all texts, one after the other, and the edges of the texts among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, edges = lists.flatten(), lists.offsets.to_numpy()
    whole = pc.greater(pc.binary_length(flat), 0)  # blanks at either end make empty ones
    kept = np.concatenate([[0], np.cumsum(whole.to_numpy(zero_copy_only=False))])
    return flat.filter(whole).cast(pa.binary()), kept[edges - edges[0]]


def normal(words: pa.Array, edges: np.ndarray) -> list[bytes]:
    """The normal texts of these words."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words), b" ").to_pylist()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _laid_out(texts: list[bytes], places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with ends between, the places of their bytes and of one end after each if asked, and their sizes with that end."""
    gap = bytes([END]) * 8
    data = np.frombuffer(gap + b"".join(x for t in texts for x in (t, gap)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    if not places:
        return data, np.empty(0, kind), sizes
    return data, np.arange(sizes.sum(), dtype=kind) + np.repeat((8 + 7 * np.arange(len(sizes))).astype(kind), sizes), sizes


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, the first one lowest."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[at]


def grams_of(texts: list[bytes]) -> np.ndarray:
    """For each byte of the texts and their ends: the four bytes before it, the last one lowest, with itself above them."""
    data, at, _ = _laid_out(texts)
    wide = data.astype(np.uint64)
    for k in (1, 2):
        wide[k:] |= wide[:-k] << np.uint64(8 * k)
    grams = wide[at - 1]
    grams |= data[at].astype(np.uint64) << np.uint64(32)
    return grams


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, with the last eight letters of each byte's word so far, and the texts' sizes with their ends."""
    data, at, sizes = _laid_out(texts)
    kind = at.dtype.type
    wide = data.astype(np.uint64)
    for k in (1, 2, 4):  # the last 2, 4, 8 bytes, the last one lowest
        wide[k:] |= wide[:-k] << np.uint64(8 * k)
    word = np.arange(1, len(data) + 1, dtype=kind)
    word[(data != 32) & (data != END)] = 0
    np.maximum.accumulate(word, out=word)  # where the word of the next byte begins
    prefixes = wide[at - 1]
    del wide
    grams = data[at].astype(np.uint64) << np.uint64(32)
    grams |= prefixes & _MASKS[4]
    prefixes &= _MASKS[np.minimum(at - word[at - 1], 8)]
    return grams, prefixes, sizes


def lines(grams: np.ndarray, prefixes: np.ndarray, predictors: range = range(CONTEXTS)) -> np.ndarray:
    """The first slot of each context's 16 slots for a byte's high four bits, and for its low ones: ``(2, predictors, n)``."""
    high = (grams >> np.uint64(36)) + np.uint64(1)
    salt = high * np.uint64(0xC2B2AE3D27D4EB4F)
    out = np.empty((2, len(predictors), len(grams)), np.int64)
    for i, k in enumerate(predictors):
        if k == 0:  # one byte before: every context has slots of its own
            one = (grams & np.uint64(0xFF)) * np.uint64(32)
            out[0, i], out[1, i] = one, one + high
        else:
            h = _mixed((grams & np.uint64((1 << 8 * (k + 1)) - 1) if k < 4 else prefixes) ^ (np.uint64(k + 1) << np.uint64(56)))
            for half, x in enumerate((h, (h ^ salt) * _ODD)):
                out[half, i] = x >> np.uint64(68 - SLOT_BITS[k])
    return out * 16 + np.array([FIRST[k] for k in predictors])[None, :, None]


def bits(grams: np.ndarray, prefixes: np.ndarray, predictors: range = range(CONTEXTS)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit of the bytes, high to low: the node reached in the byte, the slots of the predictors, the bit."""
    byte = (grams >> np.uint64(32)).astype(np.int64)
    at = lines(grams, prefixes, predictors)
    for j in range(8):
        node = (1 << j) | (byte >> (8 - j))
        half = 1 << j % 4
        yield node, at[j // 4] + (half | node & (half - 1)), byte >> (7 - j) & 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, in order of places, and each key's number among them.

    Keys meet at the places of a table by some of their bits; those that find another key there try other bits.
    """
    n = len(keys)
    kind = np.int32 if n < 1 << 31 else np.int64
    left = np.arange(n, dtype=kind)
    first, own, shift = left.copy(), keys, 0
    size = max(10, n.bit_length())
    table = np.empty(1 << size, kind)
    while len(left):
        spot = ((own * (_ODD + np.uint64(2 * shift))) >> np.uint64(64 - size)).view(np.int64)
        table[spot[::-1]] = left[::-1]  # the first one stays
        holder = table[spot]
        other = np.flatnonzero(keys[holder] != own)
        holder[other] = left[other]
        first[left if shift else slice(None)] = holder
        left, shift = left[other], shift + 1
        own = keys[left]
    heads = first == np.arange(n, dtype=kind)
    return np.flatnonzero(heads), (np.cumsum(heads, dtype=kind) - kind(1))[first]


class Pairs:
    """The distinct pairs of a byte and its contexts in some texts, in text order, and how often ``learnt`` texts have each.

    Pairs of texts that are not learnt are apart and have ``times`` 0.
    """

    def __init__(self, texts: list[bytes], learnt: list[bool]) -> None:
        data, _, self.sizes = _laid_out(texts, False)
        self.words = pc.list_flatten(pc.split_pattern(pa.array(texts, pa.binary()), b" ")).dictionary_encode()  # an empty text has an empty one
        code, letters = self.words.indices.to_numpy(), pc.binary_length(self.words.dictionary).to_numpy()
        letters = letters[code].astype(np.int64)
        after = np.cumsum(letters + 1)
        self.last = np.searchsorted(after, np.cumsum(self.sizes))  # each text's last word
        text = np.repeat(np.arange(len(texts)), np.diff(self.last, prepend=-1))
        starts = after - letters - 1 + 8 + 7 * text
        first = np.diff(text, prepend=-1) > 0
        ends = np.diff(text, append=len(texts)) > 0
        apart = ~np.array(learnt, bool)[text]
        # A word's first three bytes are known by these and the four before, the others by the word and what stands at its ends.
        heads = np.minimum(letters + 1, 3)
        windows = _windows(data, starts - 4) & _MASKS[4 + heads] | apart.astype(np.uint64) << np.uint64(63)
        tails = code * 8 + (first * 4 + ends * 2 + apart)
        own = np.zeros(8 * len(self.words.dictionary), np.int64)
        own[tails[::-1]] = np.arange(len(code))[::-1]  # the first one stays
        begun = own[tails] == np.arange(len(code))
        self.by_word, found = [], []
        for (one, number), a, b in ((distinct(_mixed(windows)), 0 * heads, heads), ((np.flatnonzero(begun), (np.cumsum(begun) - 1)[own[tails]]), heads, letters + 1)):
            self.by_word.append(number)
            n = (b - a)[one]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - a[one], n)
            found.append((np.repeat(starts[one], n) + inside, inside, np.repeat(np.arange(len(one)), n), np.repeat(apart[one], n), np.repeat(np.bincount(number, minlength=len(one)), n)))
        found[1][2][:] += int(self.by_word[0].max()) + 1
        at, inside, self.whole, apart, times = map(np.concatenate, zip(*found))
        place = np.full(len(data), -1, np.int32 if len(at) < 1 << 31 else np.int64)
        place[at] = np.arange(len(at))
        order = place[place >= 0]  # that of the texts
        at, inside, self.whole, apart, times = (x[order] for x in (at, inside, self.whole, apart, times))
        bytes_before = _windows(data, at - 8).byteswap()  # the last one lowest
        grams, prefixes = bytes_before & _MASKS[4] | data[at].astype(np.uint64) << np.uint64(32), bytes_before & _MASKS[np.minimum(inside, 8)]
        keys = _mixed(prefixes)
        keys ^= grams
        keys ^= (~apart).astype(np.uint64) << np.uint64(63)
        one, self.number = distinct(_mixed(keys))
        self.grams, self.prefixes = grams[one], prefixes[one]
        self.times = np.where(apart[one], 0, np.bincount(self.number, times, len(one)))

    def by_text(self, costs: np.ndarray) -> np.ndarray:
        """The sums of the pairs' costs over each text."""
        whole = np.bincount(self.whole, costs[self.number])
        heads, tails = self.by_word
        most = int(heads.max()) + 1
        words = whole[heads] + np.append(whole[most:], np.zeros(int(tails.max()) + 1))[tails]
        return np.add.reduceat(words, np.append(0, self.last[:-1] + 1))


#: What a slot tells of a count: one of 256 codes, exact below 32, within a tenth above.
_STEP = 0.11
_COUNTS = np.concatenate([np.arange(32.0), 32 * np.exp(_STEP * (np.arange(224) + 0.5))])


def codes(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < 32, counts, np.minimum(255, 32 + np.log(np.maximum(counts, 32) / 32) / _STEP)).astype(np.uint8)


def _by_code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds and levels of the two gating contexts by a slot's code; then the same without one zero, and without one one."""
    zeros, ones = np.tile(_COUNTS, 256), np.repeat(_COUNTS, 256)
    less = [(zeros, ones), (np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))]
    odds = np.concatenate([np.log(b + PRIOR) - np.log(a + PRIOR) for a, b in less]).astype(np.float32)
    total = np.concatenate([a + b for a, b in less])
    return odds, *(sum((total > edge).astype(np.int8) for edge in edges) for edges in ((0.5, 7.5, 127.5), (0.5, 15.5, 511.5)))


_ODDS, _ORDER, _WORD = _by_code()

#: Slots of one array that is summed over tasks.
_SPAN = 1 << 16
_SPANS = -(-FIRST[-1] // _SPAN)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Normal texts, in lists of about ``BLOCK`` bytes."""
    held, size = [], 0
    for batch in sliced(batches, "text"):
        held += normal(*words_of(batch.column("text")))
        size += batch.column("text").nbytes
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _add(total: np.ndarray, grams: np.ndarray, prefixes: np.ndarray, times: np.ndarray, predictors: range) -> None:
    """Add to ``total``, zeros and ones by slot, what pairs of a byte and its contexts count."""
    for a in range(0, len(times), LUMP):
        lump = slice(a, a + LUMP)
        for _, slots, bit in bits(grams[lump], prefixes[lump], predictors):
            for b in (0, 1):
                on = bit == b
                np.add.at(total[b], slots[:, on].ravel(), np.tile(times[lump][on], len(predictors)))


def learn_slots(training: DataFrame, counts: DataFrame) -> np.ndarray:
    """For each slot the codes of its zeros (low byte) and ones (high byte), over every bit of every training text.

    Byte contexts are counted over the texts, the word context over the table ``counts`` of all distinct words, each
    followed by a blank, and over the texts' ends. Tasks count in arrays of the model's size; equal parts of these are
    summed in two rounds, one part at a time, and only the codes of the sums, two bytes to a slot, come to the driver.
    """

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _SPANS * _SPAN), np.uint32)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            if held:
                grams = np.concatenate([g for g, _ in held])
                order = np.argsort(grams)
                grams = grams[order]
                heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                _add(total, grams[heads], grams[heads], np.add.reduceat(np.concatenate([n for _, n in held])[order], heads).astype(np.uint32), range(4))
                held.clear()

        for texts in blocks(batches):
            held.append(np.unique(grams_of(texts), return_counts=True))
            grams, prefixes, sizes = contexts([t[t.rfind(b" ") + 1 :] for t in texts])  # the last words, for the ends
            ends = np.cumsum(sizes) - 1
            _add(total, grams[ends], prefixes[ends], np.ones(len(ends), np.uint32), range(4, 5))
            if sum(len(g) for g, _ in held) > 1 << 21:
                add()
        add()
        yield from _arrays(enumerate(total.reshape(-1, _SPAN)))

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _SPANS * _SPAN), np.uint64)
        for batch in sliced(batches, "word"):
            found = [(w + b" ", c) for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()) if w]
            if found:
                grams, prefixes, sizes = contexts([w for w, _ in found])
                on = np.ones(len(grams), bool)
                on[np.cumsum(sizes) - 1] = False  # the ends of these are no ends of texts
                _add(total, grams[on], prefixes[on], np.repeat(np.array([c for _, c in found], np.uint64), sizes - 1), range(4, 5))
        yield from _arrays(enumerate(total.reshape(-1, _SPAN)))

    def summed(last: bool) -> object:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()

            def totals() -> Iterator[tuple[int, np.ndarray]]:
                at, total = None, None
                for batch in batches:
                    for part, z in zip(batch.column("part"), batch.column("z")):
                        if (k := part.as_py()) != at:
                            if at is not None:
                                yield at, codes(total) if last else total
                            at, total = k, np.zeros(_SPAN, np.uint64)
                        new = unpack.decompress(z.as_buffer())
                        total += np.frombuffer(new, np.uint32 if len(new) == 4 * _SPAN else np.uint64)
                if at is not None:
                    yield at, codes(total) if last else total

            return _arrays(totals())

        return add

    kind = "part int, z binary"
    parts = training.select("text").mapInArrow(of_texts, kind).union(counts.mapInArrow(of_words, kind)).withColumn("salt", F.spark_partition_id() % 64)
    once = parts.repartition("part", "salt").sortWithinPartitions("part").mapInArrow(summed(False), kind)
    both = np.zeros((2 * _SPANS, _SPAN), np.uint8)
    for r in once.repartition("part").sortWithinPartitions("part").mapInArrow(summed(True), kind).collect():  # 2 bytes a slot at most
        both[r["part"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["z"]), np.uint8)
    low, high = both.reshape(2, -1)
    return low.astype(np.uint16) | high.astype(np.uint16) << np.uint16(8)


def _arrays(arrays: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Packed arrays that are not all zero, a few to a batch; counts that fit 32 bits are packed as such."""
    press = zstandard.ZstdCompressor(level=1)
    made = ((k, a.astype(np.uint32) if a.dtype == np.uint64 and int(a.max()) < 1 << 32 else a) for k, a in arrays if a.any())
    while held := [(k, press.compress(np.ascontiguousarray(a))) for k, a in islice(made, 16)]:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int32()), pa.array([z for _, z in held], pa.binary())], ["part", "z"])


_GATES = np.arange(LEVELS**2, dtype=np.int8)[:, None]


class Mixer:
    """Gated weights and the refining table, learning online."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots
        self.weights = np.full((8, LEVELS**2, CONTEXTS), 0.35)
        self.square = np.full((8, LEVELS**2, CONTEXTS), 1e-3)
        self.refine = np.zeros((256 * BINS, 2))

    def run(self, pairs: Pairs, lumps: int | None = None) -> np.ndarray:
        """Bits of each pair of the first ``lumps``, or of all; each lump is learnt after it was predicted."""
        chance = np.ones(len(pairs.times))  # of eight bits, each 1e-6 at least
        for a in range(0, len(chance) if lumps is None else min(len(chance), lumps * LUMP), LUMP):
            lump = slice(a, a + LUMP)
            times = pairs.times[lump].astype(np.float32)
            learnt = (times > 0).astype(np.int64) << 16
            for j, (node, at, bit) in enumerate(bits(pairs.grams[lump], pairs.prefixes[lump])):
                chance[lump] *= self._bit(j, node, self.slots.take(at), bit, times, learnt)
        return -np.log2(chance)

    def _bit(self, j: int, node: np.ndarray, code: np.ndarray, bit: np.ndarray, times: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        code = code + learnt * (bit + 1)  # without the bit's own count, if it was counted
        odds = _ODDS.take(code)
        gate = _ORDER.take(code[-2]) * np.int8(LEVELS) + _WORD.take(code[-1])
        x = np.einsum("kn,kn->n", odds, self.weights[j].T.astype(np.float32).take(gate.astype(np.intp), axis=1))
        np.minimum(np.maximum(x, -11, out=x), 11, out=x)
        p = 1 / (1 + np.exp(-x))
        cell = node * BINS + np.minimum(np.maximum(x * (BINS / 16) + BINS / 2, 0), BINS - 1).astype(np.int64)
        seen = self.refine.take(cell, axis=0)
        q = (p + (seen[:, 1] + 4 * p) / (seen[:, 0] + seen[:, 1] + 4)) / 2  # the mean of mixer and table
        np.minimum(np.maximum(q, 1e-6, out=q), 1 - 1e-6, out=q)
        error = (bit - p).astype(np.float32) * times
        one = (gate == _GATES).astype(np.float32)
        slope = (one @ (odds * error).T) / np.maximum(1, one @ times)[:, None]
        self.square[j] += slope * slope
        self.weights[j] += 0.05 * slope / np.sqrt(self.square[j])
        self.refine += np.bincount(2 * cell + bit, times, 512 * BINS).reshape(-1, 2)
        return np.abs(1 - bit - q)


def word_counts(training: DataFrame) -> DataFrame:
    """``(word, c)`` over all training texts; the empty word is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])

        for batch in sliced(batches, "text"):
            held += [words_of(batch.column("text"))[0], pa.array([b""] * batch.num_rows, pa.binary())]
            if sum(words.nbytes for words in held) >= COUNTED:
                yield out()
                held.clear()
        yield out()

    return training.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _common(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words, at most ``most``, by a threshold that no tie crosses."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("words"))
    running = sizes.withColumn("so_far", F.sum("words").over(Window.orderBy(F.desc("c"))))
    least = running.where(F.col("so_far") <= most).agg(F.min("c")).first()[0]
    return {} if least is None else {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).collect()}


def score(docs: DataFrame, common: int = COMMON_WORDS, shard: int = SHARD) -> DataFrame:
    """Score every row of ``docs`` (``doc_id``, ``text``) by models of the rows that are not held out.

    Columns: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``. The
    base is a smoothed unigram over lower-cased words and text ends; ``score`` is the log10 probability of the same
    sequence, blanks and end included, under the mixed model. A shard has about ``shard`` training tokens. A null text
    is empty and has only its end; a null doc_id counts as an empty one and is held out; repeated rows are learnt as
    often as they occur; with nothing to learn from, counts are zero and N = V = 0. Other columns are ignored; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    context = docs.sparkSession.sparkContext
    counts = stage(word_counts(training), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    scale = total["n"] + 0.1 * (total["v"] + 1)
    frequent = context.broadcast({w: math.log10((c + 0.1) / scale) for w, c in _common(counts, common).items()})
    slots = context.broadcast(learn_slots(training, counts))
    shards = max(1, math.ceil(total["n"] / shard))

    def scored(mixer: Mixer, held: list[pa.RecordBatch], warm: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words, edges = words_of(rows.column("text"))
        pairs = Pairs(normal(words, edges), pc.invert(rows.column("held_out")).to_pylist())
        if warm:
            mixer.run(pairs, WARM)
        bits_of = pairs.by_text(mixer.run(pairs))
        kinds = pa.concat_arrays([pairs.words.dictionary, pa.array([b""], pa.binary())])  # the last one is the end
        logs = list(map(frequent.value.get, kinds.to_numpy(zero_copy_only=False).tolist()))
        apart = np.array([x is None for x in logs])
        # An empty text has an empty word, which is its end; all others have an end after their last word.
        sizes, spoken = np.diff(edges) + 1, np.maximum(np.diff(edges), 1)
        own = np.full(sizes.sum(), len(kinds) - 1)
        coded = pairs.words.indices.to_numpy()
        told = np.repeat(sizes > 1, spoken)
        own[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = coded[told]
        text = np.repeat(np.arange(len(sizes)), sizes)
        known = np.array([x or 0.0 for x in logs])[own].tolist()
        ends = np.cumsum(sizes)
        base = [math.fsum(known[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())]
        on = np.flatnonzero(apart[own])
        rest, k = np.unique(text[on] * len(kinds) + own[on], return_counts=True)
        word = kinds.take(pa.array(rest % len(kinds)))
        rests = np.searchsorted(rest, np.arange(len(sizes) + 1) * len(kinds))
        columns = [
            rows.column("doc_id"), rows.column("held_out"), sizes, sizes - np.add.reduceat(apart[own], ends - sizes, dtype=np.int64), base, -bits_of * math.log10(2), pairs.sizes, bits_of / pairs.sizes,
            pa.ListArray.from_arrays(pa.array(rests, pa.int32()), pa.StructArray.from_arrays([word, pa.array(k, pa.int64())], ["word", "k"])),
        ]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, _KINDS)], _NAMES)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at, mixer, warm = [], 0, None, None, True
        for batch in sliced(batches, "text"):
            begin, sizes = 0, pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            for i, number in enumerate(batch.column("shard").to_pylist()):
                if at is not None and (size >= BLOCK or number != at):
                    yield scored(mixer, [*held, *([batch.slice(begin, i - begin)] if i > begin else [])], warm)
                    held, size, warm, begin = [], 0, False, i
                if number != at:
                    at, mixer, warm = number, Mixer(slots.value), True
                size += sizes[i]
            held.append(batch.slice(begin))
        if held:
            yield scored(mixer, held, warm)

    own = F.xxhash64("doc_id", "text")
    dealt = docs.withColumns({"shard": F.pmod(own, F.lit(shards)).cast("int"), "order": F.xxhash64(own, F.lit(1))})
    dealt = dealt.repartitionById(min(shards, MOST_TASKS), F.col("shard") % min(shards, MOST_TASKS)).sortWithinPartitions("shard", "order")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, bits_per_byte double, rest array<struct<word: binary, k: long>>"
    rows = dealt.mapInArrow(judge, schema)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    frequent.destroy()  # the staged rows hold all that comes from these
    slots.destroy()
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(scale))).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known")
    )
    return rows.drop("rest").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0))).alias("base_score"), "score", "n_bytes", "bits_per_byte",
    )


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "bits_per_byte", "rest"]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))]
