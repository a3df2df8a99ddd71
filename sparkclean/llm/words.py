"""Words of many texts at once, and Rabin-Karp fingerprints of all their runs of words by prefix polynomials.

The bytes of a part of a table lie in one array. Words of one piece of text are kept one blank apart, so a run of words is
a slice of the normal form, and the fingerprint of any slice comes from the prefix sums at its two ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, BLANK, BREAK = 0, 1, 2
#: Primes below 2**31, so that products of two remainders and sums of a block of bytes fit 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Bytes whose prefix sums are worked out together.
BLOCK = 1 << 20


def lower_case() -> np.ndarray:
    """A table of all bytes that maps A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, without a copy, and the edges of its rows there; null is empty."""
    filled = pc.fill_null(column, "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    _, offsets, data = filled.buffers()
    edges = np.frombuffer(offsets, width, len(filled) + 1, filled.offset * np.dtype(width).itemsize).astype(np.int64) if len(filled) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[edges[0] : edges[-1]], edges - edges[0]


@dataclass(frozen=True)
class Words:
    """The words of some texts: ``normal`` bytes with each word's ``starts`` and ``ends``, its text's number and its piece.

    ``raw_starts`` and ``raw_ends`` are byte places in the text itself. Words are neighbours if their pieces are equal.
    """

    normal: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    raw_starts: np.ndarray
    raw_ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def slice(self, first: int, n: int) -> bytes:
        """The ``n`` words from number ``first`` on, one blank apart."""
        return self.normal[self.starts[first] : self.ends[first + n - 1]].tobytes()

    def runs(self, n: int) -> np.ndarray:
        """Where ``n`` neighbours begin: a flag for each word that has ``n`` - 1 words after it."""
        count = max(0, len(self) - n + 1)
        return self.piece[:count] == self.piece[n - 1 : n - 1 + count]


def words_of(column: pa.Array, kinds: np.ndarray) -> Words:
    """The lower-cased words of a string column; ``kinds`` tells for each byte whether it is of a word, a blank or a break."""
    data, edges = raw_texts(column)
    kind = kinds[data]
    inside = kind == WORD
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    inner = edges[1:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    first = inside & ~before
    raw_starts = np.flatnonzero(first)
    closing = np.empty_like(inside)
    closing[-1:] = True
    closing[:-1] = ~inside[1:]
    closing[inner[inner > 0] - 1] = True
    raw_ends = np.flatnonzero(inside & closing) + 1
    text = np.searchsorted(edges, raw_starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), raw_starts) + text
    # one blank before a word is kept where a blank stands there; elsewhere the word begins a piece
    kept = inside.copy()
    kept[:-1] |= (kind[:-1] == BLANK) & first[1:]
    table = lower_case()
    table[kinds == BLANK] = 32
    places = np.cumsum(kept, dtype=np.int64)
    begin = edges[text]
    return Words(table[data[kept]], places[raw_starts] - 1, places[raw_ends - 1], text, piece, raw_starts - begin, raw_ends - begin)


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n`` - 1."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += more
    return out


class Polynomial:
    """Fingerprints modulo one prime: of bytes ``b0 b1 ...`` the sum of ``(b_i + 1) * base**i``."""

    _tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, modulus: int, base: int):
        self.modulus, self.base, self.inverse = modulus, base, pow(base, -1, modulus)
        key = (modulus, base)
        if key not in self._tables:
            self._tables[key] = _powers(base, modulus, BLOCK), _powers(self.inverse, modulus, BLOCK)
        self.up, self.down = self._tables[key]

    def prefixes(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The prefix sums at all starts and at all ends, and the factor that takes a start's power away."""
        m, data = np.uint64(self.modulus), words.normal
        at_start, at_end, factor = (np.empty(len(words), np.uint64) for _ in range(3))
        total = 0
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * self.up[: b - a], out=sums[1:])
            lift, drop = np.uint64(pow(self.base, a, self.modulus)), np.uint64(pow(self.inverse, a, self.modulus))
            take = lambda places: (sums[places - a] % m * lift + np.uint64(total)) % m  # noqa: B023, E731
            s = slice(*np.searchsorted(words.starts, (a, b)))
            e = slice(*np.searchsorted(words.ends, (a + 1, b + 1)))
            at_start[s], at_end[e] = take(words.starts[s]), take(words.ends[e])
            factor[s] = self.down[words.starts[s] - a] * drop % m
            total = int((int(sums[-1]) % self.modulus * int(lift) + total) % self.modulus)
        return at_start, at_end, factor


class Fingerprints:
    """Fingerprints of all runs of ``n`` words of ``words``, from the prefixes of one polynomial or more."""

    def __init__(self, words: Words, polynomials: list[Polynomial]):
        self.parts = [(np.uint64(p.modulus), *p.prefixes(words)) for p in polynomials]

    def of(self, n: int) -> list[np.ndarray]:
        """For each polynomial the remainder of the run of ``n`` words that begins at each word but the last ``n`` - 1."""
        out = []
        for m, at_start, at_end, factor in self.parts:
            count = max(0, len(at_start) - n + 1)
            out.append((at_end[n - 1 : n - 1 + count] + m - at_start[:count]) % m * factor[:count] % m)
        return out


def polynomials(n: int, seed: int = 20) -> list[Polynomial]:
    """``n`` polynomials with drawn bases, over the two primes in turn."""
    rng = np.random.default_rng(seed)
    return [Polynomial(p, int(rng.integers(1 << 20, p - 1))) for p in (PRIMES[i % 2] for i in range(n))]


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits spread over the whole range, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
