"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A segmentation is the encoder's own exactly if each two adjacent pieces are what it makes of the two put together. So
the encoder is a shortest-path problem over pieces: a path scores the sum of its pieces and may only join compatible
neighbours. Where no piece can reach over a word start, the path breaks into words, whose ids are remembered.
A giant document is split into chunks; the states at a chunk's border are the pieces that begin before it and end at or
after it. Each chunk gives a max-plus matrix from its entry to its exit states, matrices are combined associatively
in blocks and over blocks, and each chunk, told its entry and exit, traces its own pieces back. A word that lies whole
inside a chunk has one state before it and one after it: it is a factor of one row and column, searched once in each
process and remembered. So every id of a giant document comes from the search. Documents of less than a chunk are
encoded by the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dealing import together
from ..storage import stage
from .batches import sliced

#: Characters of a chunk; documents of more are split. Chunks whose matrices are combined in one group.
CHUNK, FAN = 1 << 14, 64
SPACE = "▁"
#: Words, and pairs of pieces, that one process remembers.
REMEMBERED, PAIRS = 300_000, 200_000
#: A word with the blanks before it, or blanks at the end.
_WORD = re.compile(r" *[^ ]+| +")


class Pieces:
    """A BPE model of `sentencepiece` as a graph of compatible pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.ids = {model.id_to_piece(k): k for k in plain}
        self.scores = {model.id_to_piece(k): model.get_score(k) for k in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model reaches over a word start")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.words: dict[str, bytes] = {}
        self.score_of = np.array([model.get_score(k) for k in range(size)])
        self.factors: dict[str, bytes] = {}
        # the number of each piece of several characters that the encoder leaves whole; -1 for what such pieces begin with
        good = {p: k for p, k in self.ids.items() if len(p) > 1 and self.is_piece(p)}
        self.grown = {p[:k]: -1 for p in good for k in range(2, len(p))} | good
        self.letters: dict[str, int] = {}
        self.close: dict[int, bool] = {}
        sample = "Ａ ﬁ e\u0301  x\t½ "
        if model.normalize(sample) != escaped(sample):
            raise ValueError("this model changes texts before it cuts them; only models that leave them alone are read")

    def merged(self, text: str) -> list[str]:
        """The encoder's pieces of a short text by its own rule: join the best-scored neighbours, leftmost first."""
        symbols, score, none = list(text), self.scores.get, -np.inf
        joined = [score(a + b, none) for a, b in pairwise(symbols)]
        while joined and (best := max(joined)) > none:
            at = joined.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del joined[at]
            for k in (at - 1, at):
                if 0 <= k < len(joined):
                    joined[k] = score(symbols[k] + symbols[k + 1], none)
        return symbols

    def fits(self, a: str, b: str) -> bool:
        """Whether the encoder leaves these two pieces apart."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 4 * PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def is_piece(self, text: str) -> bool:
        """Whether the encoder leaves this text whole: a piece, or one character that is none."""
        if len(text) == 1:
            return True
        if text not in self.scores:
            return False
        found = self.whole.get(text)
        if found is None:
            found = self.whole[text] = self.merged(text) == [text]
        return found

    def score(self, piece: str) -> float:
        return self.scores.get(piece, -1e6)

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character that is no piece becomes its bytes, or unknown in a model without bytes."""
        out = []
        for p in pieces:
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.bytes[0] != self.unknown:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def letter(self, letter: str) -> int:
        """The number of one character; one that is no piece has a number beyond all pieces."""
        return self.letters.setdefault(letter, self.ids.get(letter, len(self.score_of) + ord(letter)))

    def factor(self, word: str) -> bytes:
        """Ids of the path through a whole word with the blanks before it.

        There is one path of compatible pieces, so the first that is found is the best; longer pieces are tried first,
        and a piece from which the end was not reached is not tried again.
        """
        text = word.replace(" ", SPACE)
        close, size, n, number, letters = self.close, len(self.score_of), len(text), self.grown.get, self.letters
        many = size + 0x110000
        if len(close) > 2 * PAIRS:
            close.clear()
        at, last, k, path, left, tried = 0, "", -1, [], [], set()
        while at < n:
            if len(left) == len(path):  # a new place: the pieces that begin here, the longest last
                first = text[at]
                found = [(first, letters[first] if first in letters else self.letter(first))]
                for end in range(at + 2, n + 1):
                    piece = text[at:end]
                    own = number(piece)
                    if own is None:
                        break
                    if own >= 0:
                        found.append((piece, own))
                left.append(found)
            while found:
                piece, own = found.pop()
                if tried and (at, piece) in tried:
                    continue
                if k >= 0:
                    fits = close.get(key := k * many + own)
                    if fits is None:
                        both = last + piece
                        fits = close[key] = number(both, -1) < 0 and self.merged(both) == [last, piece]
                    if not fits:
                        continue
                path.append((piece, own))
                at += len(piece)
                last, k = piece, own
                break
            else:
                left.pop()
                found, (piece, _) = left[-1], path.pop()
                at -= len(piece)
                tried.add((at, piece))
                last, k = path[-1] if path else ("", -1)
        ids = [own for _, own in path]
        return array("i", ids if max(ids) < size else self.numbers([piece for piece, _ in path])).tobytes()

    def product(self, words: list[str]) -> tuple[bytes, float]:
        """The max-plus product of the factors of words that follow each other: their ids, and the scores of these summed."""
        known = self.factors
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.factor(w)
        ids = b"".join(map(known.__getitem__, words))
        return ids, float(self.score_of[np.frombuffer(ids, "<i4")].sum())

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids (little-endian 32-bit) of texts given as words with the blanks before them; words are encoded once."""
        known = self.words
        new = list({w for words in texts for w in words}.difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for words in texts for w in words})
        ids = self.model.encode([w[1:] for w in new], num_threads=1)  # the encoder adds the first blank
        if " " in new:
            ids[new.index(" ")] = self.numbers([SPACE])
        flat = array("i", chain.from_iterable(ids)).tobytes()
        known.update(zip(new, (flat[a:b] for a, b in pairwise(accumulate((4 * len(x) for x in ids), initial=0)))))
        return [b"".join(map(known.__getitem__, words)) for words in texts]


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def escaped(text: str | None) -> str:
    """The text as the model sees it: a blank before it, blanks as marks; nothing for an empty text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def words(text: str) -> list[str]:
    """The words of an escaped text, each with the marks before it as blanks; marks at the end are a word too."""
    text = text.replace(SPACE, " ")
    if text[:1] == " " and text[-1] != " " and "  " not in text:
        return [" " + w for w in text[1:].split(" ")]
    return _WORD.findall(text)


def encode(text: str, model: Pieces) -> bytes:
    """Ids of a whole escaped text, word by word."""
    return model.encode([words(text)])[0]


class Chunk:
    """Positions ``begin`` to ``end`` of an escaped text, of which ``text`` holds these and a piece's length around."""

    def __init__(self, text: str, begin: int, end: int, first: bool, last: bool, model: Pieces) -> None:
        self.text, self.begin, self.end, self.first, self.last, self.model = text, begin, end, first, last, model

    def starts_word(self, at: int) -> bool:
        return self.text[at] == SPACE and (at == 0 or self.text[at - 1] != SPACE)

    def inside(self) -> tuple[int, int]:
        """From the first to the last word start in the chunk; no piece crosses either. Twice the same place if there are none."""
        text, a = self.text, self.begin
        while (a := text.find(SPACE, a, self.end)) >= 0 and not self.starts_word(a):
            a += 1
        if a < 0:
            return self.begin, self.begin
        b = self.end
        while not self.starts_word(b := text.rfind(SPACE, a, b)):
            pass
        return a, b

    def without(self, a: int, b: int) -> Chunk:
        """The chunk with ``a`` to ``b`` taken out, which are word starts."""
        return Chunk(self.text[:a] + self.text[b:], self.begin, self.end - (b - a), self.first, self.last, self.model)

    def border(self, at: int) -> list[tuple[int, int]]:
        """The pieces that begin before ``at`` and end there or later, in order."""
        model, text = self.model, self.text
        spans = ((j, i) for j in range(max(0, at - model.longest), at) for i in range(at, min(len(text), j + model.longest) + 1))
        return [s for s in spans if model.is_piece(text[s[0] : s[1]])]

    def entries(self) -> list[tuple[int, int]]:
        return [(0, 0)] if self.first else self.border(self.begin)

    def exits(self) -> list[tuple[int, int]]:
        found = self.border(self.end)
        return [s for s in found if s[1] == self.end] if self.last else found

    def walk(self, entries: list[tuple[int, int]]) -> tuple[dict, dict]:
        """Best scores of each piece from each entry, and how it was reached.

        ``scores[(j, i)]`` is a vector over ``entries``; ``came[(j, i)]`` the piece before, for one entry.
        """
        model, text = self.model, self.text
        scores: dict[tuple[int, int], np.ndarray] = {}
        came: dict[tuple[int, int], tuple | None] = {}
        ending: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(entries):
            v = np.full(len(entries), -np.inf)
            v[k] = 0
            scores[s] = v
            came[s] = None
            ending.setdefault(s[1], []).append(s)
        for j in range(self.begin, self.end):
            before = ending.pop(j, None)
            if not before:
                continue
            free = self.first and j == 0 or self.starts_word(j)
            for i in range(j + 1, min(len(text), j + model.longest) + 1):
                if i > j + 1 and text[i - 1] == SPACE and text[i - 2] != SPACE:
                    break  # no piece reaches over a word start
                piece = text[j:i]
                if not model.is_piece(piece):
                    continue
                joined = [p for p in before if free or self.fits(p, piece)]
                if joined:
                    key = (j, i)
                    scores[key] = np.max([scores[p] for p in joined], axis=0) + model.score(piece)
                    came[key] = max(joined, key=lambda p: scores[p].max())
                    ending.setdefault(i, []).append(key)
        return scores, came

    def fits(self, before: tuple[int, int], piece: str) -> bool:
        a = self.text[before[0] : before[1]]
        return not a or self.model.fits(a, piece)

    def matrix(self) -> np.ndarray:
        """The max-plus transfer matrix, entries by exits."""
        entries, exits = self.entries(), self.exits()
        scores, _ = self.walk(entries)
        out = np.full((len(entries), len(exits)), -np.inf)
        for x, s in enumerate(exits):
            if s in scores:
                out[:, x] = scores[s]
        return out

    def trace(self, entry: int, exit_: int, at: int = -1, ids: bytes = b"") -> bytes:
        """Ids of the pieces that begin inside the chunk, between the given states, with ``ids`` put in at ``at``."""
        start, stop = self.entries()[entry], self.exits()[exit_]
        _, came = self.walk([start])
        path, back = [], stop
        while back is not None and back != start:
            path.append(back)
            back = came[back]
        numbers = lambda spans: np.array(self.model.numbers([self.text[j:i] for j, i in spans]), "<i4").tobytes()
        path.reverse()
        return numbers(s for s in path if s[0] < at) + ids + numbers(s for s in path if s[0] >= at)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The states at all borders on the best path through ``matrices`` from state ``first`` to state ``last``."""
    scores = [np.where(np.arange(len(matrices[0])) == first, 0.0, -np.inf)]
    for m in matrices:
        scores.append((scores[-1][:, None] + m).max(axis=0))
    path = [last]
    for m, v in zip(reversed(matrices), reversed(scores[:-1])):
        path.append(int((v + m[:, path[-1]]).argmax()))
    return path[::-1]


def _unpacked(rows: int, m: bytes) -> np.ndarray:
    return np.frombuffer(m, np.float64).reshape(rows, -1)


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of ordered batches in runs of equal first ``keys`` columns."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and row[:keys] != run[0][:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


_CUT = "row long, doc_id long, part long, begin int, end int, first boolean, last boolean, text string"
_MATRIX = f"{_CUT}, at int, ids binary, rows int, m binary"
_PRODUCT = "row long, block long, rows int, m binary"
_BORDER = "row long, block long, entry int, exit int"
_STATE = "row long, part long, entry int, exit int"
_IDS = "doc_id long, row long, part long, ids binary"


def _giants(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """``(doc_id, row, part, ids)`` of documents of more than one chunk."""
    around = pieces_of(path).longest + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                whole = escaped(text)
                n = len(whole)
                cuts = [(k, b, min(b + chunk, n), max(0, b - around)) for k, b in enumerate(range(0, n, chunk))]
                for at in range(0, len(cuts), FAN):
                    yield _table([(row, doc_id, k, b - o, e - o, b == 0, e == n, whole[o : e + around]) for k, b, e, o in cuts[at : at + FAN]], _arrow(_CUT))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for batch in sliced(batches, "text"):
            out = []
            for row, doc_id, part, begin, end, first, last, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = Chunk(text, begin, end, first, last, model)
                a, b = own.inside()
                ids, score = model.product(words(text[a:b]))
                own = own.without(a, b)
                m = own.matrix() + score
                out.append((row, doc_id, part, own.begin, own.end, first, last, own.text, a, ids, len(m), m.tobytes()))
            yield _table(out, _arrow(_MATRIX))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            whole = None
            for *_, rows, m in run:
                whole = _unpacked(rows, m) if whole is None else combined(whole, _unpacked(rows, m))
            yield _table([(*run[0][:2], len(whole), np.ascontiguousarray(whole).tobytes())], _arrow(_PRODUCT))

    def over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1):
            matrices = [_unpacked(rows, m) for *_, rows, m in run]
            ends = np.zeros(1)
            for m in matrices:
                ends = (ends[:, None] + m).max(axis=0)
            at = states(matrices, 0, int(ends.argmax()))
            yield _table([(*r[:2], a, b) for r, a, b in zip(run, at, at[1:])], _arrow(_BORDER))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            at = states([_unpacked(r[3], r[4]) for r in run], *run[0][5:])
            yield _table([(r[0], r[2], a, b) for r, a, b in zip(run, at, at[1:])], _arrow(_STATE))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for batch in sliced(batches, "ids"):
            rows = zip(*(c.to_pylist() for c in batch.columns))
            out = [(doc_id, row, part, Chunk(text, begin, end, first, last, model).trace(a, b, at, ids)) for row, doc_id, part, begin, end, first, last, text, at, ids, a, b in rows]
            yield _table(out, _arrow(_IDS))

    # counts are given, as small matrices would else be put into one task
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows, *keys: together(rows, *keys, tasks=tasks)
    matrices = stage(dealt(docs.mapInArrow(split, _CUT), "row", "part").mapInArrow(transfer, _MATRIX).withColumn("block", F.floor(F.col("part") / FAN)), "matrices")
    slim = matrices.select("row", "block", "part", "rows", "m")
    blocks = dealt(slim, "row", "block").sortWithinPartitions("row", "block", "part").drop("part").mapInArrow(product, _PRODUCT)
    borders = stage(dealt(blocks, "row").sortWithinPartitions("row", "block").mapInArrow(over_blocks, _BORDER), "borders")
    told = dealt(slim.join(borders, ["row", "block"]), "row", "block").sortWithinPartitions("row", "block", "part")
    own = told.mapInArrow(inside, _STATE)
    return matrices.drop("block", "rows", "m").join(own, ["row", "part"]).select("row", "doc_id", "part", "begin", "end", "first", "last", "text", "at", "ids", "entry", "exit").mapInArrow(trace, _IDS)


def encoded(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, row, part, ids)``: the ids of every row of ``docs`` (``doc_id``, ``text``), little-endian 32-bit.

    A document of ``chunk`` characters or more goes through the scan, which settles all of it, and has a row for each
    chunk; any other is encoded by the library and has one row, part 0. ``row`` tells repeated documents apart. The ids in order of parts are those of the model's own encoder. A null or empty text has
    no ids; null doc_ids are kept; other columns are ignored; an empty table gives an empty result.
    """

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for batch in sliced(batches, "text"):
            ids = model.encode([words(" " + t) if t else [] for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.zeros(len(ids), np.int64)), pa.array(ids, pa.binary())], ["doc_id", "row", "part", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    return rows.where(~giant).mapInArrow(direct, _IDS).unionByName(_giants(rows.where(giant), path, chunk))


def decoded(parts: DataFrame, path: str) -> DataFrame:
    """``parts`` with ``numbers``, their ids as an array, and ``text``: what these stand for, without the blank before the first part.

    An id that stands for no text, as unknown, gives what the model's own decoder gives.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        texts = {k: p.replace(SPACE, " ").encode() for p, k in model.ids.items()} | {k: bytes([b]) for b, k in enumerate(model.bytes) if k != model.unknown}
        texts[model.unknown] = model.model.decode([model.unknown]).encode()
        table = pa.array([texts.get(k) for k in range(len(model.score_of))], pa.large_binary())
        for batch in sliced(batches, "ids"):
            out, all_ids = [], batch.column("ids").to_pylist()
            ends = np.cumsum([0, *map(len, all_ids)]) // 4
            flat = pa.array(np.frombuffer(b"".join(all_ids), "<i4"))
            taken = table.take(flat)
            if taken.null_count:
                raise ValueError("an id of these parts is no piece")
            _, edges, data = taken.buffers()
            data = memoryview(data or b"")
            edges = np.frombuffer(edges, np.int64, len(taken) + 1)[ends].tolist() if len(taken) else [0] * len(ends)
            for part, a, b in zip(batch.column("part").to_pylist(), edges, edges[1:]):
                text = str(data[a:b], "utf-8", "replace")
                out.append(text[1:] if part == 0 else text)
            numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers, pa.array(out, pa.string())], [*batch.schema.names, "numbers", "text"])

    return parts.mapInArrow(decode, f"{_IDS}, numbers array<int>, text string")
