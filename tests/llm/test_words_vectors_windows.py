"""Phrase mining, vector codes and decontamination against plain versions, with their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkclean.llm import ball_kmeans, decontaminate, permutation_index, phrases
from sparkclean.llm.spread import spread_join
from sparkclean.llm.words import Fingerprints, polynomials, words_of

SCHEMA = "doc_id long, text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def shown(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("row", "n", "fp", "lang_", "phrase", "count", "leak", "_text", "v", "codes", "error", "length", "items", "words") if c not in df.columns})


# --- words and fingerprints ---


def test_words_and_fingerprints():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t.é日\n-") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "x" * 5000]
    column = pa.array(["left out", *texts, "left out"])[1:-1]
    words = words_of(column, phrases.KINDS)
    got = defaultdict(list)
    for i in range(len(words)):
        got[int(words.text[i])].append((words.slice(i, 1).decode(), texts[words.text[i]].encode()[words.raw_starts[i] : words.raw_ends[i]].decode().translate(LOWER)))
    for k, t in enumerate(texts):
        want = [w for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOWER)) for w in re.findall(r"[^ \t]+", piece)]
        assert got.get(k, []) == [(w, w) for w in want]
    for n in (1, 2, 3):
        prints, of = list(zip(*Fingerprints(words, polynomials(3)).of(n))), {}
        for i in np.flatnonzero(words.runs(n)).tolist():
            assert of.setdefault(words.slice(i, n), prints[i]) == prints[i]
        assert len(set(of.values())) == len(of)


def test_fingerprints_over_blocks(monkeypatch):
    from sparkclean.llm import words as module

    column = pa.array(["ab cde f " * 30 + "g" * 70, "ab cde"])
    whole = [x.tolist() for x in Fingerprints(words_of(column, phrases.KINDS), polynomials(2)).of(2)]
    monkeypatch.setattr(module, "BLOCK", 16)
    assert [x.tolist() for x in Fingerprints(words_of(column, phrases.KINDS), polynomials(2)).of(2)] == whole


def test_spread_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([None, "a", "a", "a", "b", None])], "k string, i int")
    facts = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    assert shown(spread_join(rows, facts, ["k"], ["i"]), "i", "x") == [(0, 2), (1, 1), (2, 1), (3, 1), (5, 2)]


# --- 11 ---


def plain_collocations(rows, most=3, least=10, covered=50, first=2000):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang or "und"] += len(w)
            for n in range(1, most + 1):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, f in counts.items():
        found, over = [], Counter()
        for g, a in f.items():
            if len(g) > 2 and a >= least:
                for m in range(2, len(g)):
                    for i in range(len(g) - m + 1):
                        over[g[i : i + m]] = max(over[g[i : i + m]], a)
        for g, a in f.items():
            if len(g) < 2 or a < least or over[g] and 100 * over[g] >= covered * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    vocabulary = ["the", "of", "New", "York", "city", "é", "日本", "a" * 50, "x-y"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = [(i, t, ["en", "en", "en", "de", None, "und"][i % 6]) for i, t in enumerate(texts)]
    long = "New York city of the " * 4000
    return rows + [rows[3], rows[3], (None, None, "en"), (7, "", "fr"), (8, "only one", "it"), (9, long, "es")]


COLLOCATION = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("parameters", "bits"), [({}, 64), ({}, 9), ({"most": 4, "least": 3, "covered": 70, "first": 5}, 64), ({"most": 2}, 64)])
def test_collocations(spark, prose, parameters, bits):
    """Nine bits leave 512 fingerprints for far more runs, so that only the check tells them apart."""
    docs = clashing(spark.createDataFrame(prose, SCHEMA).repartition(7))
    named = {"most": "most_words"}
    got = phrases.collocations(docs, **{named.get(k, k): v for k, v in parameters.items()}, bits=bits)
    assert shown(got, *COLLOCATION) == plain_collocations(prose, **parameters)


def test_collocations_without_phrases(spark):
    for rows in ([], [(1, None, None)], [(1, "a b", "en")]):
        assert phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_collocation_scores_pass_64_bits(spark):
    n = 3_000_000  # 10**6 * n * n is beyond 2**63
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("p q\n"), n // 3).alias("text"), F.lit("en").alias("lang"))
    assert shown(phrases.collocations(docs), *COLLOCATION) == [("en", 1, "p q", n, n, n, 2 * n, 10**6)]


# --- 12 ---


def plain_codes(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(i, label, [nearest(part(v, p), books[p]) for p in range(4)]) for i, v, label in kept]
    sums = Counter()
    for _, label, near in coded:
        sums[label] += sum(d for d, _ in near)
    return sorted(((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), sums[label], sha) for i, label, near in coded), key=repr)


CODE = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("step", "entries"), [(0.001, 256), (1.0, 256), (0.25, 7), (900.0, 16)])
def test_codes(spark, step, entries):
    """Coarse steps give many ties and equal entries; the largest take the whole-number path."""
    rng = random.Random(3)
    rows = [(i, [rng.randint(-9, 9) * step for _ in range(8)], rng.choice([1, 2, None])) for i in rng.sample(range(-400, 400), 330)]
    rows += [rows[0], rows[0], (None, rows[1][1], 4), (None, [0.5] * 8, None), (900, None, 1), (901, [1.0, None, *[0.0] * 6], 1), (902, [math.nan, *[0.0] * 7], 1), (903, [math.inf, *[0.0] * 7], None)]
    got = ball_kmeans.compressed(clashing(spark.createDataFrame(rows, VECTORS).repartition(4)), entries)
    assert shown(got, *CODE) == plain_codes(rows, entries)


def test_codes_of_few_odd_or_no_vectors(spark):
    assert ball_kmeans.compressed(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(1, [0.5, 1.0, 2.0, 3.0], 1), (2, [0.5, 1.0, 2.0, 3.0], 1), (3, [1.0] * 5, 1), (4, [], None)]
    got = {r.vec_id: r for r in ball_kmeans.compressed(spark.createDataFrame(rows, VECTORS)).collect()}
    assert [got[i].code for i in (1, 2, 3, 4)] == ["00000000"] * 4 and {r.error for r in got.values()} == {0}
    assert got[3].codebooks_sha256 == hashlib.sha256(b"1024,1024,1024,1024,1024,0,0,0").hexdigest() and got[4].codebooks_sha256 == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        ball_kmeans.compressed(spark.createDataFrame([(1, [1e30] * 4, 1)], VECTORS))


def test_stable_cores_and_rings_give_the_nearest_entry():
    rng = np.random.default_rng(2)
    for dtype, scale in ((np.float64, 30), (np.int64, 3)):
        entries = rng.integers(-scale, scale, (40, 4)).astype(dtype)
        entries[7] = entries[30]
        x = rng.integers(-scale, scale, (3000, 4)).astype(dtype)
        balls = ball_kmeans.Balls(entries)
        code, away = balls.all(x)
        for former in (code, rng.integers(0, 40, 3000), np.zeros(3000, np.int64)):
            got, distance = balls.moved(x, former)
            assert (got == code).all() and (distance == away).all()


# --- 13 ---


def plain_leaks(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1) if n else ():
            known[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


LEAK = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["alpha", "Beta", "g1", "é", "日本", "delta"]) for _ in range(n))
    items = [(i, prose(rng.randint(11, 40))) for i in range(40)] + [(100, "Short one"), (101, "solo"), (102, ""), (103, None), (None, prose(15)), (7, prose(12))]
    items += [(200 + i, items[0][1]) for i in range(30)]
    docs = [(i, prose(rng.randint(0, 80))) for i in range(60)]
    for i in range(60):
        text = rng.choice(items)[1] or ""
        words = re.split(r"\W+", text)
        docs.append((100 + i, f"{prose(5)}... {rng.choice([' ', chr(10), '--']).join(w.upper() for w in words[rng.randint(0, 2):])}! {prose(5)}"))
    return docs + [(1, None), (2, ""), (3, " .,"), (None, items[3][1]), docs[70], docs[70], (9, f"{items[4][1]} {items[4][1]} " * 300)], items


@pytest.mark.parametrize(("size", "at_once"), [(10, 1 << 19), (10, 40), (3, 1 << 19)])
def test_leaks(spark, leaks, size, at_once):
    docs = clashing(spark.createDataFrame(leaks[0], "doc_id long, text string").repartition(5))
    found = decontaminate.marked(docs, clashing(spark.createDataFrame(leaks[1], "item_id long, text string")), size, at_once)
    assert shown(decontaminate.digest(found), *LEAK) == plain_leaks(*leaks, size)
    assert set(docs.columns) | {"leak"} == set(found.columns)


def test_leaks_are_removed(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Début, {passage.upper()}; fin日 {passage}"), (2, "kept  as it is"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    assert shown(decontaminate.without_spans(docs, bench), "doc_id", "text") == [(1, "Début, ; fin日 "), (2, "kept  as it is"), (3, None)]
    assert shown(decontaminate.without_documents(docs, bench), "doc_id") == [(2,), (3,)]
    assert [r.leak.items for r in decontaminate.marked(docs, bench).orderBy("doc_id").collect()] == [["a"], [], []]


def test_leaks_of_empty_tables(spark, leaks):
    docs, bench = spark.createDataFrame(leaks[0], "doc_id long, text string"), spark.createDataFrame(leaks[1], "item_id long, text string")
    assert decontaminate.marked(docs.limit(0), bench).collect() == []
    assert shown(decontaminate.digest(decontaminate.marked(docs, bench.limit(0))), *LEAK) == plain_leaks(leaks[0], [])


def test_queries_go_to_the_shards_in_passes(spark, monkeypatch):
    """Each pass tells no more than each shard's best: vectors and queries are not copied to the files that they meet in."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rng.normal(size=(900, 8)))]
    df = spark.createDataFrame(rows + rows[:30], "vec_id long, embedding array<float>, label int").repartition(7)
    shown = lambda: sorted(tuple(r) for r in permutation_index.nearest(df, read=1000.0, share=1.0).collect())
    e = np.array([v for _, v, _ in rows])
    want = {}
    for q in range(0, 900, 20):
        s = e @ e[q]
        s[q] = -np.inf
        want[q] = np.lexsort((np.arange(900), -s))[:20].tolist()
    for name, value in {"QUERIES": 1 << 14, "BLOCK": 1 << 14, "SHARDS": 24}.items():
        assert getattr(permutation_index, name) == value
        monkeypatch.setattr(permutation_index, name, value // 500 or 2)
    got = shown()
    assert {q: [v for _, _, v, _ in sorted(r for r in got if r[0] == q)] for q in want} == want and len(got) == 20 * len(want)
