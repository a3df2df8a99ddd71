"""Quality rules: a conditional random field marks lines as content or boilerplate, and the content share decides.

Labels are known for documents, not for lines. Training begins with the document's label on each of its lines, repeats
of a line being boilerplate, and then alternates: the chain is fitted (first to lines alone, without their neighbours),
and the lines of each training document are marked anew by it, as far as the document's label allows, which bounds the
share of content. Runs of boilerplate lines spliced
into good documents show the chain how labels change inside a text. Viterbi decoding marks the lines of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf

#: Labelled documents of each label that are trained on, and the longest of them in characters and in lines.
SAMPLE, SAMPLE_CHARS, SAMPLE_LINES = 800, 30_000, 200
#: How often the lines of the training documents are marked, and steps of training on each marking.
MARKINGS, STEPS = 3, 60
#: Share of a text's characters in content lines from which it is kept.
LEAST_CONTENT = 0.5

_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """How many words stand in windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        windows = np.zeros(n, np.uint64)
        for k in range(size):
            windows = (windows ^ (windows >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.isin(windows, twice))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_of(text: str, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """The five base figures of a text and whether they reject it."""
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    repeats = repeated_words(words)
    chars = len(text) - sum(map(text.count, _BLANKS))
    return n, chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


def lines_of(text: str) -> list[bytes]:
    """The lines with a word."""
    return [line for line in text.encode("utf-8", "surrogatepass").split(b"\n") if line.split(None, 1)]


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of features for each line."""
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n, size = len(words), len(line)
        without = lambda drop: 1 - len(line.translate(None, drop)) / size  # noqa: B023,E731
        rows.append((
            1.0, min(n, 40) / 40, n < 4, without(b"#*$%&|<>") * 4, without(_UPPER) * 2, without(_DIGITS) * 4, without(b"!") * 8,
            line.rstrip()[-1:] in b".!?\"')", line in seen, sum(map(eq, words, words[1:])) / n, min(size / n, 30) / 10, n > 12,
        ))
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, 12)


def _repeats(lines: list[bytes]) -> np.ndarray:
    first = {line: k for k, line in reversed(list(enumerate(lines)))}
    return np.array([first[line] != k for k, line in enumerate(lines)], bool)


def _marked(content: np.ndarray, lines: list[bytes], good: bool, least: float) -> np.ndarray:
    """Labels of a training document's lines by their probability of ``content``, as far as its own label allows.

    Lines change sides, the most probable first, while a good document's content share stays at ``least`` or more and a
    bad one's below.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    own = np.full(len(lines), int(good))
    other, repeats = content > 0.5, _repeats(lines)
    change = np.flatnonzero(~other if good else other & ~repeats)
    change = change[np.argsort(content[change] if good else -content[change], kind="stable")]
    most = (1 - least) * sizes.sum() if good else least * sizes.sum()
    taken = np.cumsum(sizes[change])
    own[change[taken <= most] if good else change[taken < most]] = int(not good)
    if good and sizes[~repeats].sum() >= least * sizes.sum():
        own[repeats] = 0
    return own


def _spliced(good: list[tuple[list[bytes], np.ndarray]], bad: list[tuple[list[bytes], np.ndarray]]) -> list[tuple[list[bytes], np.ndarray]]:
    """Each good document with the boilerplate lines of a bad one inside, after as many of its lines as its number says."""
    out = []
    for k, (lines, own) in enumerate(good if bad else []):
        run = [line for line, y in zip(*bad[k % len(bad)]) if not y]
        at = k % (len(lines) + 1)
        out.append((lines[:at] + run + lines[at:], np.concatenate([own[:at], np.zeros(len(run), int), own[at:]])))
    return out


def fitted(texts: list[tuple[str, bool]], least: float = LEAST_CONTENT, markings: int = MARKINGS, most_lines: int = SAMPLE_LINES) -> crf.Crf | None:
    """The chain from texts and whether they are good; None if all are of one kind."""
    documents = [(lines, good) for text, good in texts for lines in [lines_of(text)] if 0 < len(lines) <= most_lines]
    if len({good for _, good in documents}) < 2:
        return None
    features = [line_features(lines) for lines, _ in documents]
    counts = [sum(len(lines) for lines, good in documents if good == kind) for kind in (False, True)]
    weights = [sum(counts) / counts[good] for _, good in documents]  # both kinds weigh the same
    alone = [(x[k : k + 1], np.array([int(good and not again)]), w) for x, (lines, good), w in zip(features, documents, weights) for k, again in enumerate(_repeats(lines))]
    model = crf.fit([(x, y) for x, y, _ in alone], rounds=STEPS, weights=[w for *_, w in alone])
    content = [1 / (1 + np.exp(np.diff(-model.scores(x) - model.first, axis=1)[:, 0])) for x in features]
    for _ in range(markings):
        own = [_marked(p, lines, good, least) for p, (lines, good) in zip(content, documents)]
        sides = [[(lines, y) for (lines, good), y in zip(documents, own) if good == kind] for kind in (False, True)]
        spliced = _spliced(sides[True], sides[False])
        sequences = [*zip(features, own), *((line_features(lines), y) for lines, y in spliced)]
        model = crf.fit(sequences, rounds=STEPS, weights=weights + [1.0] * len(spliced), start=model)
        content = [crf.marginals(model, x)[:, 1] for x in features]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> crf.Crf | None:
    """Fit the chain on at most ``sample`` documents of each quality label, those of the smallest hashed ids.

    Texts of more than ``sample_chars`` characters or ``SAMPLE_LINES`` lines are not trained on. Without a labelled
    document of either quality there is no model, and the base rules alone decide.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * sample ids at most
    sized = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    found = sized.join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("row")).select("doc_id", "row.*").orderBy("doc_id").collect()
    return fitted([(r["text"], r["quality"] == 1) for r in found])


def judge(text: str | None, model: crf.Crf | None, least: float = LEAST_CONTENT) -> tuple:
    """``(base figures..., content share, kept)`` of one text."""
    text = text or ""
    base = base_of(text, text.encode("utf-8", "surrogatepass").split())
    lines = lines_of(text)
    marks = model.decode(model.scores(line_features(lines))) if model else [1] * len(lines)
    share = sum(len(line) for line, m in zip(lines, marks) if m) / max(1, sum(map(len, lines)))
    return *base, share, bool(not base[-1] and share >= least)


def with_verdict(docs: DataFrame, model: crf.Crf | None, least: float = LEAST_CONTENT) -> DataFrame:
    """``docs`` with the base figures, ``content_share`` and ``kept``; columns of those names are replaced."""
    added = [f.split()[0] for f in BASE.split(", ")] + ["content_share", "kept"]
    docs = docs.drop(*added)
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, model, least) for t in batch.column("text").to_pylist()]
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(verdicts, f"{kinds}, {BASE}, content_share double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_CONTENT) -> DataFrame:
    """Judge every row of ``docs`` (``doc_id``, ``text`` and any other columns) after training on ``labels``.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept``. A null
    text counts as empty and is not kept. Repeated rows are judged alike; a null doc_id is judged but never trained
    on; with an empty table of labels the base rules alone decide; an empty table of documents stays empty.
    """
    return with_verdict(docs, train(docs, labels), least)
