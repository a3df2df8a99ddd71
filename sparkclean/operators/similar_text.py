"""Similarity join of short texts by edit distance, whose output stays linear in dense blocks.

Two texts are close if ``1 - edits / longer length`` reaches a limit. Lengths at which the limit allows no edit leave equal
texts only. Where it allows one, a pair differs in one place, so texts that are equal without that place are close to each
other, all of them, and one link each joins them. Where it allows more, close texts share one of their rarest grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

#: Texts of one gram that are compared in one piece; more of them are cut and compared piece by piece.
PIECE = 512
#: So many of the most frequent grams are known as such to every task.
COMMON = 4096
#: Pairs whose edits are counted together.
PAIRS = 1 << 14


def tolerated(length: int, limit: float) -> int:
    """The most edits at which texts of which the longer one has ``length`` characters are close."""
    edits = int((1 - limit) * length) + 1
    while edits and 1 - edits / length < limit:
        edits -= 1
    return edits


def most_tolerated(length: int, limit: float) -> int:
    """The most edits between a text of this length and any longer one that is close to it."""
    most, longer = 0, max(1, length)
    while longer - (own := tolerated(longer, limit)) <= length:
        most, longer = max(most, own), longer + 1
    return most


def gram_size(limit: float) -> int:
    """Characters of a gram: the most at which close texts share a gram at any length that allows an edit."""
    for size in (3, 2, 1):
        first = next(n for n in range(1, 10_000) if tolerated(n, limit))
        if all(n - size + 1 > size * tolerated(n, limit) for n in range(first, first + 1000)):
            return size
    raise ValueError("limits of about a half and less leave texts without a shared character")


def rare_grams(text: str, size: int, edits: int, common: dict[str, int]) -> list[str]:
    """The text's rarest grams, one more than ``edits`` can spoil, each with its number among equal ones.

    Texts within ``edits`` share the rarest gram that they have in common, and both list it.
    """
    seen: Counter[str] = Counter()
    grams = []
    for i in range(len(text) - size + 1):
        gram = text[i : i + size]
        grams.append((common.get(gram, -1), gram, seen[gram]))
        seen[gram] += 1
    return [f"{gram}{number}" for _, gram, number in sorted(grams)[: size * edits + 1]]


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between ``a[i]`` and ``b[i]``, for all pairs at once: one step for each character of the longest ``a``."""
    wide = lambda texts: np.array([list(map(ord, t)) + [0] * (most - len(t)) for t in texts], np.int32).reshape(len(texts), most)
    most = max(map(len, [*a, *b]), default=0)
    left, right, place = wide(a), wide(b), np.arange(most + 1, dtype=np.int32)
    size_a, size_b = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    row = np.tile(place, (len(a), 1))
    out = np.where(size_a == 0, size_b, 0)
    for i in range(most):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (left[:, i : i + 1] != right))
        row = np.minimum.accumulate(new - place, axis=1) + place
        done = size_a == i + 1
        out[done] = row[done, size_b[done]]
    return out


def close_pairs(a: list[str], b: list[str] | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of close texts of ``a`` and ``b``, or of ``a`` alone; length and letter counts rule most pairs out first."""
    bags = lambda texts: np.stack([np.bincount([ord(c) & 31 for c in t], minlength=32) for t in texts]).astype(np.int16)
    other = a if b is None else b
    counts, counts_b = bags(a), bags(other)
    size, size_b = counts.sum(axis=1), counts_b.sum(axis=1)
    allowed = np.array([tolerated(n, limit) if n else 0 for n in range(max(size.max(), size_b.max()) + 1)])
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        x, y = (np.concatenate(c) for c in zip(*waiting))
        waiting.clear()
        for i in range(0, len(x), PAIRS):
            p, q = x[i : i + PAIRS], y[i : i + PAIRS]
            near = edit_distances([a[k] for k in p], [other[k] for k in q]) <= allowed[np.maximum(size[p], size_b[q])]
            found.append((p[near], q[near]))

    for i in range(len(a)):
        start = i + 1 if b is None else 0
        edits = allowed[np.maximum(size[i], size_b[start:])]
        surplus = counts_b[start:] - counts[i]
        y = start + np.flatnonzero((np.maximum(surplus, 0).sum(axis=1) <= edits) & (np.maximum(-surplus, 0).sum(axis=1) <= edits))
        waiting.append((np.full(len(y), i), y))
        if sum(len(y) for _, y in waiting) > PAIRS:
            settle()
    if waiting:
        settle()
    return tuple(np.concatenate(c) for c in zip(*found))


def joining(n: int, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Of the pairs ``a[i]``-``b[i]`` of nodes 0 to ``n`` - 1, in order, those that join two parts not joined before."""
    above, kept = list(range(n)), []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for x, y in zip(a, b):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _one_edit(forms: DataFrame, first: int, last: int) -> DataFrame:
    """``(block, a, b)`` for the lengths ``first`` to ``last``, at which one edit is allowed.

    Texts of one length that are equal without their character at one place are a class, no larger than the alphabet;
    and a text without a character may be another text. Both links are of one edit.
    """
    size = F.length("form")
    places = F.explode(F.sequence(F.lit(1), size)).alias("p")
    cut = forms.where(size.between(first, last)).select("block", "form", places)
    cut = cut.select("block", "form", "p", F.concat(F.substring("form", F.lit(1), F.col("p") - 1), F.substring("form", F.col("p") + 1, F.length("form"))).alias("rest"))
    classes = cut.groupBy("block", "p", "rest").agg(F.collect_set("form").alias("own")).where(F.size("own") > 1)
    swapped = classes.select("block", F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b")
    shorter = forms.select("block", F.col("form").alias("rest"))
    dropped = cut.select("block", "form", "rest").distinct().join(shorter, ["block", "rest"]).select("block", F.least("form", "rest").alias("a"), F.greatest("form", "rest").alias("b"))
    return swapped.union(dropped)


def _by_grams(forms: DataFrame, limit: float, piece: int) -> DataFrame:
    """``(block, a, b)``: of the close pairs of each piece as many as join the same texts."""
    spark, size = forms.sparkSession, gram_size(limit)
    grams = forms.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("form") - size + 1), lambda p: F.substring("form", p, F.lit(size)))).alias("gram"))
    often = grams.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(COMMON).collect()
    common = spark.sparkContext.broadcast({r["gram"]: len(often) - i for i, r in enumerate(often)})

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edits: dict[int, int] = {}
        for batch in batches:
            keys = []
            for form in batch["form"]:
                if len(form) not in edits:
                    edits[len(form)] = most_tolerated(len(form), limit)
                keys.append(rare_grams(form, size, edits[len(form)], common.value))
            yield pd.DataFrame({"block": batch["block"], "form": batch["form"], "gram": keys}).explode("gram")

    keyed = stage(forms.mapInPandas(rare, "block string, form string, gram string"), "grams")
    sizes = keyed.groupBy("block", "gram").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"), F.count("*").alias("n")).where("n > 1").drop("n")
    keyed = keyed.join(sizes, ["block", "gram"]).withColumn("own", F.pmod(F.xxhash64("form"), F.col("pieces")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    keyed = keyed.select("block", "gram", "form", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        low, high = part["low"].iloc[0], part["high"].iloc[0]
        left, right = (sorted(part["form"][part["own"] == side]) for side in (low, high))
        a, b = close_pairs(left, None if low == high else right, limit) if left and right else (np.zeros(0, np.int64),) * 2
        names = left if low == high else left + right
        kept = joining(len(names), a.tolist(), (b if low == high else b + len(left)).tolist())
        pairs = [sorted((names[x], names[y])) for x, y in kept]
        return pd.DataFrame({"block": part["block"].iloc[0], "a": [p for p, _ in pairs], "b": [q for _, q in pairs]}, dtype=object)

    return keyed.groupBy("block", "gram", "low", "high").applyInPandas(compare, "block string, a string, b string")


def close_texts(rows: DataFrame, keys: list[str], text: str, limit: float = 0.9, piece: int = PIECE) -> DataFrame:
    """``(keys, a, b)``: pairs of close texts under the same keys that join the same texts as all close pairs do.

    Every pair given is close; which of the pairs of a dense block are given is left open. Equal texts are one; null
    texts and null keys take no part. Shuffled are the distinct texts, at most ``2 * length`` shortened forms of each
    where one edit is allowed and ``3 * edits + 1`` grams of each where more are, and links of no more than these. A gram
    of more than ``piece`` texts is compared in pieces.
    """
    block = F.to_json(F.struct(*keys))
    known = rows.where(" and ".join(f"`{c}` is not null" for c in [*keys, text])).select(block.alias("block"), F.col(text).alias("form")).distinct()
    single = known.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    forms = stage(known.join(single, "block", "left_semi"), "forms")
    one = [n for n in range(1, 10_000) if tolerated(n, limit) == 1]
    links = _one_edit(forms, one[0], one[-1]) if one else forms.select("block", F.col("form").alias("a"), F.col("form").alias("b")).where("false")
    if one:  # else the limit allows no edit
        several = next(n for n in range(1, 10_000) if most_tolerated(n, limit) > 1)
        long = forms.where(F.length("form") >= several)
        if not long.isEmpty():
            links = links.union(_by_grams(long, limit, piece))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return links.distinct().select(F.from_json("block", kinds).alias("k"), "a", "b").select("k.*", "a", "b")
