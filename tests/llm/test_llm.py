"""The operators of the pipeline against plain versions, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from sparkclean.llm import context_mixing, crf, html_text, licenses, packing, permutation_index, piece_scan, pii, quality, registry, simhash, suffix_dedup  # noqa: E402

from test_near_copies import first_of_each  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are as with they be at one have this from by hot word but what some we can out other were all there when up use your how said an each she".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, nulls, an empty and a long text, ties, repeated rows and null ids."""
    rng = random.Random(9)
    base = [text(rng, rng.randint(3, 160)) for _ in range(40)]
    long = text(rng, 6000) + "\n" + "é日本" * 500 + "x" * 3000
    texts = base + [base[0], base[1], base[2] + " more", base[3].upper(), None, "", " \n\t ", long, long[: len(long) // 2], "a", "a a a a a a a a a a a a"]
    passage = text(rng, 80)
    texts += [f"{text(rng, 30)} {passage} {text(rng, 20)}" for _ in range(6)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, base[7], "en", "s1", 1), (10**15 + 1, base[8] + " !", None, "s1", None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("row", "fp", "z", "rest", "part", "kept_", "begin", "ids", "doc", "word", "spans", "title")})


def shown(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- 1 ---


def gone_bytes(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for (doc_id, *_), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield doc_id, t, gone


def remaining(rows, length):
    return [(doc_id, bytes(b for b, g in zip(t, gone) if not g)) for doc_id, t, gone in gone_bytes(rows, length)]


def removed(rows, length):
    out = []
    for doc_id, t, gone in gone_bytes(rows, length):
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [3000, 4, 1])
def test_suffix_dedup(docs, corpus, group):
    got = suffix_dedup.dedup(clashing(docs), group=group)
    assert shown(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(corpus, 200)


def test_suffix_dedup_of_nothing(docs):
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0
    assert suffix_dedup.deduplicated(docs.where("doc_id = 0 and n_chars < 0")).columns == docs.columns


def test_repeated_starts():
    rng = random.Random(1)
    for trial in range(60):
        n = rng.choice([1, 2, 3, 5])
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(n, 40))) for _ in range(rng.randint(1, 10))]
        counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        want = [counts[t[i : i + n]] > 1 if i + n <= len(t) else False for t in texts for i in range(len(t) + 1)]
        assert suffix_dedup.repeated_starts(texts, n).tolist() == want
        twice = [rng.random() < 0.3 for _ in texts]
        for t, d in zip(texts, twice):
            counts.update([t[i : i + n] for i in range(len(t) - n + 1)] if d else [])
        want = [counts[t[i : i + n]] > 1 if i + n <= len(t) else False for t in texts for i in range(len(t) + 1)]
        both = suffix_dedup.repeated_starts(texts + [t for t, d in zip(texts, twice) if d], n)[: len(want)]
        assert both.tolist() == want and suffix_dedup.repeated_starts(texts, n, twice).tolist() == want


# --- 2 ---


def test_html_on_held_out_pages():
    model = html_text.trained()
    wrong = total = 0
    for page, labels in html_text.labelled_pages(60, seed=77):
        blocks = html_text.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(model.scores(html_text.block_features(blocks))), labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_html_rows(spark):
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>one</a></li></ul></nav><article><h1>Head &amp; line</h1><p>First  sentence of\nthe text.<p>Second &eacute; <b>bold</b> one.</article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<nav>x</nav>"), (1, "u", page), (4, "u", "<p" * 200 + "<<>><!-- ")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract(clashing(df))
    want = "Head & line\nFirst sentence of the text.\nSecond é bold one."
    assert shown(got.where("page_id = 1"), "text", "n_chars") == [(want, len(want))] * 2
    assert got.count() == 6 and shown(got.where("page_id in (2, 3) or page_id is null"), "text", "n_chars") == [("", 0)] * 3
    assert html_text.extract(df.limit(0)).count() == 0


# --- 3 ---


def test_context_mixing(docs, corpus):
    tokens = lambda t: (t or "").encode().lower().split() + [b"end of text"]
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0
    c = Counter(w for i, t, *_ in corpus if not held(i) for w in tokens(t))
    n = sum(c.values())
    want = sorted(((i, held(i), len(k := tokens(t)), sum(c[w] > 0 for w in k), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in k), 6)) for i, t, *_ in corpus), key=repr)
    for common in (1 << 18, 5):
        got = context_mixing.score(clashing(docs), common=common)
        assert shown(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)) == want
    rows = got.collect()
    assert all(r.score < 0 for r in rows) and sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out) * 1.3
    assert context_mixing.score(docs.limit(0)).count() == 0


def test_context_mixing_does_not_see_the_cut(docs):
    one, six = (sorted(((r.doc_id, r.score) for r in context_mixing.score(docs.repartition(n), shard=1500).collect()), key=repr) for n in (1, 6))
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(one, six))


def plain_bits(train, held, lump, rounds, texts=None):
    """Bits of each text by loops over single bits: counts, gates, online weights and the refining table."""
    m = context_mixing
    count = lambda n: n if n < 32 else m._COUNTS[int(m.codes(np.array([n]))[0])]
    slots: dict = {}
    normal = lambda t: b" ".join(m.tokens(t))
    pairs_of = lambda t: list(zip(*m.contexts([t])[:2]))

    def add(g, p, predictors):
        for _, at, bit in m.bits(np.array([g]), np.array([p]), predictors):
            for k in at[:, 0].tolist():
                slots.setdefault(k, [0, 0])[int(bit[0])] += 1

    for t in train:
        for g, p in pairs_of(normal(t)):
            add(g, p, range(4))
        add(*pairs_of(normal(t))[-1], range(4, 5))
        for w in m.tokens(t):
            for g, p in pairs_of(w + b" ")[:-1]:
                add(g, p, range(4, 5))
    texts = [normal(t) for t in (*train, *held)] if texts is None else texts
    pairs = m.Pairs(texts, [t in map(normal, train) for t in texts])
    weights = {(j, g): [0.35] * 5 for j in range(8) for g in range(16)}
    square = {k: [1e-3] * 5 for k in weights}
    refine: dict = {}
    for _ in range(rounds):
        cost = {}
        for a in range(0, len(pairs.times), lump):
            lumps = list(zip(pairs.grams[a : a + lump], pairs.prefixes[a : a + lump], pairs.times[a : a + lump].tolist()))
            steps = [list(m.bits(np.array([g]), np.array([p]))) for g, p, _ in lumps]
            for j in range(8):
                slope, whole, seen = {}, Counter(), []
                for (g, p, times), step in zip(lumps, steps):
                    node, at, bit = int(step[j][0][0]), step[j][1][:, 0].tolist(), int(step[j][2][0])
                    odds, totals = [], []
                    for k in at:
                        n = [count(x) for x in slots.get(k, (0, 0))]
                        n[bit] = max(0, n[bit] - (times > 0))
                        odds.append(math.log(n[1] + 0.05) - math.log(n[0] + 0.05))
                        totals.append(sum(n))
                    gate = (j, 4 * sum(totals[3] > e for e in (0.5, 7.5, 127.5)) + sum(totals[4] > e for e in (0.5, 15.5, 511.5)))
                    x = max(-11, min(11, sum(o * w for o, w in zip(odds, weights[gate]))))
                    q = 1 / (1 + math.exp(-x))
                    cell = node * 32 + max(0, min(31, math.trunc((x + 8) * 2)))
                    zeros, ones = refine.get(cell, (0, 0))
                    r = min(1 - 1e-6, max(1e-6, (q + (ones + 4 * q) / (zeros + ones + 4)) / 2))
                    cost[g, p, times > 0] = cost.get((g, p, times > 0), 0) - math.log2(r if bit else 1 - r)
                    whole[gate] += times
                    slope[gate] = [s + (bit - q) * times * o for s, o in zip(slope.get(gate, [0] * 5), odds)]
                    seen.append((cell, bit, times))
                for gate, s in slope.items():
                    for k in range(5):
                        d = s[k] / max(1, whole[gate])
                        square[gate][k] += d * d
                        weights[gate][k] += 0.05 * d / math.sqrt(square[gate][k])
                for cell, bit, times in seen:
                    refine.setdefault(cell, [0, 0])[bit] += times
    return [[sum(cost[g, p, learnt] for g, p in pairs_of(normal(t))) for t in side] for learnt, side in ((True, train), (False, held))]


def test_scores_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(21)
    texts = [text(rng, rng.randint(1, 40)) for _ in range(14)] + ["", None, "the the the", "Über 日本"]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert 0 < sum(held) < 6
    learnt, others = ([t for t, h in zip(texts, held) if h == want] for want in (False, True))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = F.xxhash64("doc_id", "text")
    order = [b" ".join(context_mixing.tokens(r.text)) for r in df.orderBy(F.xxhash64(own, F.lit(1))).collect()]
    got = {r.doc_id: r.score for r in context_mixing.score(df).collect()}
    a, b = plain_bits(learnt, others, context_mixing.LUMP, 2, order)
    want = {False: iter(a), True: iter(b)}
    assert all(math.isclose(got[i], -next(want[h]) * math.log10(2), rel_tol=1e-4) for i, h in enumerate(held))
    monkeypatch.setattr(context_mixing, "LUMP", 70)
    normal = [b" ".join(context_mixing.tokens(t)) for t in learnt]
    pairs = context_mixing.Pairs(normal, [True] * len(normal))
    table = np.zeros((2, context_mixing.FIRST[-1]), np.uint32)
    grams, prefixes, sizes = context_mixing.contexts(normal)
    context_mixing._add(table, grams, prefixes, np.ones(len(grams), np.uint32), range(4))
    ends = np.cumsum(sizes) - 1
    context_mixing._add(table, grams[ends], prefixes[ends], np.ones(len(ends), np.uint32), range(4, 5))
    grams, prefixes, sizes = context_mixing.contexts([w + b" " for t in learnt for w in context_mixing.tokens(t)])
    letters = np.setdiff1d(np.arange(len(grams)), np.cumsum(sizes) - 1)
    context_mixing._add(table, grams[letters], prefixes[letters], np.ones(len(letters), np.uint32), range(4, 5))
    codes = context_mixing.codes(table).astype(np.uint16)
    costs = context_mixing.Mixer(codes[0] | codes[1] << np.uint16(8)).run(pairs)
    assert np.allclose(pairs.by_text(costs), plain_bits(learnt, [], 70, 1)[0], rtol=1e-4)


def test_distinct_keys():
    keys = np.random.default_rng(7).integers(0, 3000, 20_000).astype(np.uint64)
    first, number = context_mixing.distinct(keys)
    _, want = np.unique(keys, return_index=True)
    assert first.tolist() == sorted(want.tolist()) and (keys[first][number] == keys).all() and len(context_mixing.distinct(keys[:0])[0]) == 0


# --- 4 ---


def test_quality(docs, corpus, spark):
    rng = random.Random(2)
    junk = [" ".join(rng.choice(WORDS) + "%%%" for _ in range(40)) for _ in range(30)]
    rows = [(1000 + i, t, None, None, None) for i, t in enumerate(junk)] + [(2000 + i, text(rng, 60).capitalize() + ".", None, None, None) for i in range(30)]
    both = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    labels = spark.createDataFrame([(r[0], int(r[0] >= 2000), 0) for r in rows[::2]] + [(None, 1, 0), (2001, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(clashing(both), labels)
    assert got.count() == both.count()
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[2000 + i] for i in range(30)) and not any(kept[1000 + i] for i in range(30))
    for r in got.where("doc_id < 100").collect():
        w = (r.text or "").encode().split()
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [line for line in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        chars, symbols = len(re.sub(r"[\x20\x09-\x0D]", "", r.text or "")), len(re.findall(r"[#*$%&|<>]", r.text or ""))
        again = sum(line in lines[:k] for k, line in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), chars, symbols, again)
        assert (r.n_repeat_words, r.base_failed) == (len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    assert shown(quality.quality(docs, labels.limit(0)).where("not base_failed and not kept"), "doc_id") == []
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_crf_learns_a_chain():
    rng = np.random.default_rng(0)
    sequences = []
    for _ in range(80):
        y = np.cumsum(rng.random(12) < 0.2) % 2
        sequences.append((np.stack([np.ones(12), y + rng.normal(0, 0.6, 12)], axis=1), y))
    model = crf.fit(sequences)
    right = lambda f: np.mean([f(x) == y for x, y in sequences])
    assert right(lambda x: np.array(model.decode(model.scores(x)))) > right(lambda x: x[:, 1] > 0.5) + 0.03 and model.decode(np.zeros((0, 2))) == []


def test_decoding_and_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    for n in range(1, 7):
        model = crf.Crf(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, 3))
        e = model.scores(x)
        paths = list(itertools.product((0, 1), repeat=n))
        score = [model.first[y[0]] + sum(e[k, y[k]] for k in range(n)) + sum(model.transition[a, b] for a, b in zip(y, y[1:])) for y in paths]
        assert model.decode(e) == list(paths[int(np.argmax(score))])
        p = np.exp(score) / np.exp(score).sum()
        want = [sum(w for w, y in zip(p, paths) if y[k]) for k in range(n)]
        assert np.allclose(crf.marginals(model, x)[:, 1], want)


def test_lines_of_one_document_get_both_marks():
    """Bad texts that begin with clean lines, and a repeated line: the chain finds where the junk is, in unseen texts too."""
    rng = random.Random(6)
    clean = lambda: text(rng, rng.randint(8, 20)).capitalize() + "."
    junk = lambda: rng.choice([" ".join(w + "%%%" for w in text(rng, 12).split()), text(rng, 9).upper().replace(" ", "!! "), " ".join([rng.choice(WORDS)] * 14)])

    def bad():
        k, m = rng.randint(0, 2), rng.randint(5, 8)
        return [clean() for _ in range(k)] + [junk() for _ in range(m)], [1] * k + [0] * m

    train = [("\n".join(clean() for _ in range(rng.randint(3, 9))), True) for _ in range(60)] + [("\n".join(bad()[0]), False) for _ in range(60)]
    model = quality.fitted(train)
    right = total = mixed = 0
    for _ in range(40):
        lines, want = bad()
        got = model.decode(model.scores(quality.line_features(quality.lines_of("\n".join(lines)))))
        right, total, mixed = right + sum(a == b for a, b in zip(got, want)), total + len(want), mixed + (len(set(got)) > 1)
    assert right >= 0.95 * total and mixed >= 15
    assert quality.fitted(train[:60]) is None and quality.fitted([]) is None


# --- 5 ---


@pytest.mark.parametrize("targets", [None, {"s0": 3, "s1": 1, "s2": 1, "s3": 1, None: 1}])
def test_packing(docs, corpus, targets):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.vocabulary()[0])
    want = Counter()
    for i, t, *_ in corpus:
        want[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    got = packing.pack(clashing(docs), *registry.vocabulary(), targets=targets).collect()
    windows: dict = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in windows.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in windows.values()) <= 1
    copies, ids_of, covered = Counter(i for i, _ in want.elements()), dict(want), {}
    for r in got:
        covered.setdefault((r.doc_id, r.doc_tokens), Counter()).update(zip(range(r.start, r.start + r.length), np.frombuffer(r.ids, "<u4").tolist()))
    assert covered == {(i, len(ids)): Counter({x: copies[i] for x in enumerate(ids)}) for i, ids in ids_of}


@pytest.mark.parametrize("targets", [None, {"a": 5, "b": 3, "c": 1, "d": 1, None: 2}])
def test_windows_hold_their_shares(spark, targets):
    """Few long, many short and rare sources: each window is within a token of every target while all queues last."""
    rng = random.Random(12)
    sizes = {"a": (4, 3000), "b": (400, 30), "c": (60, 90), "d": (30, 60), None: (20, 200)}
    rows = [(None, text(rng, rng.randint(1, 2 * n)), None, s, None) for s, (k, n) in sizes.items() for _ in range(k)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), *registry.vocabulary(), window=256, targets=targets).collect()
    of = {s: sum(r.length for r in got if r.source == s) for s in sizes}
    weights = targets or of
    shares: dict = {}
    for r in got:
        shares.setdefault(r.sequence_id, Counter())[r.source] += r.length
    assert sorted(shares) == list(range(len(shares))) and all(sum(w.values()) == 256 for k, w in shares.items() if k < len(shares) - 1)
    quanta = {s: 256 * w / sum(weights.values()) for s, w in weights.items()}
    lasting = int(min(of[s] / quanta[s] for s in sizes)) - 1
    assert lasting >= 40
    served = Counter()
    for k in range(lasting):
        served.update(shares[k])
        assert all(abs(shares[k][s] - q) < 2 and abs(served[s] - (k + 1) * q) < 1 for s, q in quanta.items())


def test_rare_sources_share_a_queue(spark):
    rng = random.Random(13)
    rows = [(k, text(rng, 60), None, f"rare{k}" if k % 3 == 0 else "a", None) for k in range(600)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), *registry.vocabulary(), window=256).collect()
    total, rare = (sum(r.length for r in got if f(r)) for f in (lambda r: True, lambda r: r.source != "a"))
    windows: dict = {}
    for r in got:
        windows.setdefault(r.sequence_id, Counter())[r.source != "a"] += r.length
    assert all(abs(w[True] - 256 * rare / total) < 2 for k, w in windows.items() if k < len(windows) - 2)


def test_encoder_gives_the_tokenizers_ids():
    own = packing.Encoder(*registry.vocabulary())
    rng = random.Random(3)
    parts = [*"abzAZ019 .,!?;:'\"-_()\n\t éßĀЖа٣²日本", "don't", "<|endoftext|>", "  ", "\r\n", "\x85", "　"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert list(own.ids(t)) == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids_of_long_texts(corpus):
    own = packing.Encoder(*registry.vocabulary())
    rng = random.Random(4)
    long = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), 10, 32, 32])) for _ in range(30_000))
    for t in [long, " ".join(t or "" for _, t, *_ in corpus), "ab" * 20_000, " " * 5000 + "x" + "\n" * 3000]:
        assert list(own.ids(t)) == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_of_nothing(docs):
    assert packing.pack(docs.limit(0), *registry.vocabulary()).count() == 0


# --- 6 ---


def test_licenses(spark):
    s = licenses.SENTENCES
    rows = [
        (1, "Intro.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License. All rights reserved."), (2, None), (3, ""),
        (4, f"{s['m03']}:\n{s['m04']}.\n{s['m05']}"), (5, s["m04"]), (6, f"{s['b01']}\n{s['b02']}\n{s['b03']}\n{s['b04']}"), (None, "LICENSED UNDER CC BY-NC 4.0!"), (1, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shown(licenses.scan(clashing(df)), "doc_id", "n_sentences", "licenses", "n_matches")
    assert got == sorted([(1, 4, "Apache-2.0,MIT,all-rights-reserved", 3), (2, 0, "", 0), (3, 0, "", 0), (4, 3, "MIT", 1), (5, 1, "", 0), (6, 4, "BSD-3-Clause", 1), (None, 1, "CC-BY-NC-4.0", 1), (1, 1, "", 0)], key=repr)
    assert licenses.scan(df.limit(0)).count() == 0


WRAPPED = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""


def test_wrapped_headers_gaps_and_more_licences(spark):
    import textwrap

    s = licenses.SENTENCES
    wrap = lambda *parts: "\n".join("# " + line for line in textwrap.wrap(" ".join(p.capitalize() + "." for p in parts), 72))
    apart = "Some other words stand here. " * 400
    rows = [
        (1, WRAPPED, "Apache-2.0"), (2, wrap(s["m03"], s["m04"], s["m05"]), "MIT"), (3, wrap(s["g02"], s["g04"], s["g05"]), "GPL-3.0-or-later"), (4, wrap(s["l01"]), "LGPL-2.1-or-later"), (5, wrap(s["i01"]), "ISC"),
        (6, wrap(s["z01"], s["z02"], s["z03"]), "zlib"), (7, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", "MPL-2.0"), (8, wrap(s["u01"]), "Unlicense"), (9, wrap(s["l03"]), "AGPL-3.0-or-later"),
        (10, f"{s['m03']}.\n{apart}\n{s['m04']}.", ""), (11, f"{s['m03']}.\nA line. Another one.\n{s['m04']}.", "MIT"), (12, f"Short title\n{s['r01']}", "all-rights-reserved"), (13, "x" * 2_000_000 + "\n" + s["m01"], "MIT"), (14, ("word " * 9 + "\n") * 40_000, ""),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: name for i, _, name in rows}


def test_licenses_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(registry.ORACLE_SQL["op6_license_sentences"]).fetchall()
    got = registry.QUERIES["op6_license_sentences"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# --- 7 ---


def test_pii(spark):
    rows = [
        (1, "Write to Jane.Doe@Example.com or +1 (663) 555-6869, from 10.1.2.3 and 66.7.8.9."), (2, "jane.doe@example.com; 663-555-6869; card 4111 1111 1111 1111, 078-05-1120"),
        (3, None), (4, ""), (5, "nothing here 2024-01-02, 12 345"), (6, "Mrs Anna Müller met Herr Karl Müller. Anna left; Иван Петров stayed."), (7, "IBAN DE89 3704 0044 0532 0130 00 key 11acdfb36bb72224148e6160f674b4be4560aa11"), (None, "a@b.co"), (2, "a@b.co"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_entities", F.lit("old"))
    got = {r.doc_id: r for r in pii.pseudonymize(df.where("doc_id <> 2 or doc_id is null or length(text) > 9"), b"k").collect()}
    forms = lambda t: list(pii.mentions(t))
    assert got[1].n_entities == 4 and got[2].n_entities == 4 and got[3].text is None and got[5].text == rows[4][1] and got[4].n_entities == 0
    one, two = forms(got[1].text), forms(got[2].text)
    assert [m[2] for m in one] == ["email", "phone", "ip", "ip"] and one[0][3] == two[0][3] and one[1][3] == two[1][3]
    assert got[1].text[one[2][0] : one[2][1]].startswith("10.") and "+1 (" in got[1].text and "555-6869" not in got[1].text + got[2].text
    assert [m[2] for m in two] == ["email", "phone", "card", "ssn"]
    names = [got[6].text[a:b] for a, b, *_ in forms(got[6].text)]
    assert len(names) == 7 and names[0] == names[4] and names[1] == names[3] and names[5] in pii.GIVEN["m", "cyrillic"] and names[0] in pii.GIVEN["f", "latin"] and "Müller" not in got[6].text
    assert [m[2] for m in forms(got[7].text)] == ["iban", "secret"] and "DE" in got[7].text
    assert pii.pseudonymize(df.limit(0), b"k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymize(df, b"")


def test_surrogates_stay_distinct(spark):
    """Very short addresses draw from few surrogates: those that meet draw again."""
    forms = [("email", f"{a}{b}@x.io") for a in "abcdefghij" for b in "0123456789"]
    found = pii.settle(spark.createDataFrame(forms, "kind string, form string"), b"key").collect()
    new = {r.new for r in found}
    assert len(found) == len(new) == 100 and not new & {f for _, f in forms}
    assert len({pii.surrogate("given f latin", n, b"key") for n in pii.GIVEN["f", "latin"]}) == len(pii.GIVEN["f", "latin"])


# --- 8 ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_permutation_index(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(base)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0], 0), (2080, [None] * 16, 0), (2100, rows[0][1], 0), (2101, [float("inf")] * 16, 0), (None, rows[1][1], 0), (2061, [2.0], 0), (2063, [-1.0], 0)]
    got = permutation_index.nearest(clashing(vectors(spark, rows)))
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and (i < 1500 or i == 2100)]
    ids, e = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    by_query: dict = {}
    for r in got.collect():
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by_query.pop(2060)) == [(1, 2061, 2.0), (2, 2063, -1.0)]  # vectors of one length are compared with each other
    hits = 0
    assert set(by_query) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in by_query.items():
        s = e @ e[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        assert [r for r, *_ in sorted(found)] == list(range(1, 21)) and all(math.isclose(sc, s[ids == v][0], rel_tol=1e-12) for _, v, sc in found)
        hits += len(best & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(by_query)


def test_permutation_index_of_few(spark):
    rows = [(i, [float(i), 1.0], 0) for i in (20, 1, 2, 2)]
    assert shown(permutation_index.nearest(vectors(spark, rows)), "query_id", "rank", "vec_id", "score") == [(20, 1, 2, 41.0), (20, 2, 1, 21.0)]
    assert permutation_index.nearest(vectors(spark, rows[:0])).count() == 0


# --- 9 ---


def components(rows, words=3):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group)), key=repr)


def test_simhash(docs, corpus):
    want = components(corpus)
    assert shown(simhash.near_duplicates(clashing(docs)), "doc_id", "fingerprint", "component_id") == want
    one = simhash.one_of_each(clashing(docs))
    assert one.columns == clashing(docs).columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted({c for *_, c in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_links_of_a_dense_bucket(spark):
    """A ball of near fingerprints and strangers, cut into many pieces."""
    rng = random.Random(8)
    center = rng.getrandbits(63)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), piece=20).collect()
    assert all(((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= 64 for r in edges)
    from sparkclean.operators.components import connected_components

    got: dict = {}
    for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(r.component, set()).add(r.node)
    order = sorted(signed)
    group = {f: f for f in order}
    for i, a in enumerate(order):
        for b in order[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 and group[a] != group[b]:
                x, y = group[a], group[b]
                group = {f: y if g == x else g for f, g in group.items()}
    want: dict = {}
    for f, g in group.items():
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


# --- 10 ---


@pytest.mark.parametrize("chunk", [1 << 14, 97])
def test_pieces(docs, corpus, chunk):
    path = registry.piece_model()
    model = piece_scan.pieces_of(path).model
    got = piece_scan.decoded(piece_scan.encoded(clashing(docs), path, chunk), path).collect()
    by_row: dict = {}
    for r in got:
        by_row.setdefault((r.doc_id, r.row), []).append((r.part, np.frombuffer(r.ids, "<i4").tolist(), r.text))
    found = Counter((d, tuple(k for _, ids, _ in sorted(p) for k in ids), "".join(t for *_, t in sorted(p))) for (d, _), p in by_row.items())
    assert found == Counter((i, tuple(model.encode(t or "")), t or "") for i, t, *_ in corpus)


def test_chunks_of_any_size():
    path = registry.piece_model()
    model = piece_scan.pieces_of(path)
    rng = random.Random(5)
    parts = [*"abcde  \n\t19.,é日x▁=-aaaa", "the ", "ing", "tion", "    "]
    for trial in range(200):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 90)))
        t = t.replace(" ", "") if trial % 4 == 0 else t  # also chunks without a word start
        whole, size, around = piece_scan.escaped(t), rng.choice([1, 2, 5, 17]), model.longest + 1
        n = len(whole)
        starts = [(b, max(0, b - around), min(b + size, n)) for b in range(0, n, size)]
        chunks = [piece_scan.Chunk(whole[o : e + around], b - o, e - o, b == 0, e == n, model) for b, o, e in starts]
        middles = [(*span, piece_scan.encode(c.text[slice(*span)], model)) for c in chunks for span in [c.inside()]]
        chunks = [c.without(a, b) for c, (a, b, _) in zip(chunks, middles)]
        matrices = [c.matrix() for c in chunks]
        total = matrices[0]
        for m in matrices[1:]:
            total = piece_scan.combined(total, m)
        path_ = piece_scan.states(matrices, 0, int(total[0].argmax()))
        assert np.frombuffer(b"".join(c.trace(a, b, at, ids) for c, a, b, (at, _, ids) in zip(chunks, path_, path_[1:], middles)), "<i4").tolist() == model.model.encode(t)
    for t in ("", " ", "  ", " lead", "trail ", "\n", " \n\t ", "é日本 x", "a  b", "▁", "a▁b"):
        assert np.frombuffer(piece_scan.encode(piece_scan.escaped(t), model), "<i4").tolist() == model.model.encode(t)


def test_word_factors_are_the_encoders_own():
    model, rng = piece_scan.pieces_of(registry.piece_model()), random.Random(6)
    parts = [*"abcdefgh  \n\t19.,é日x=-aaaa", "the ", "ing", "tion", "Ünder", "    "]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids, score = model.product(piece_scan.words(piece_scan.escaped(t)))
        assert ids == piece_scan.encode(piece_scan.escaped(t), model) and score == pytest.approx(model.score_of[np.frombuffer(ids, "<i4")].sum())


def test_models_that_change_texts_are_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text, *a: text.lower())
    with pytest.raises(ValueError, match="leave them alone"):
        piece_scan.Pieces(registry.piece_model())


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs]
    for k, (_, step) in enumerate(pipeline.STAGES):
        step(spark, seen[-1], data).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    kept, single, cut, changed, packed = seen[1:]
    assert all(d.columns == pipeline.COLUMNS for d in (kept, single, cut, changed))
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    whole = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    model = quality.fitted([(t, labels[i] == 1) for i, t in whole if t is not None and labels.get(i) is not None and len(t) <= quality.SAMPLE_CHARS])
    assert sorted(i for i, _ in rows) == [i for i, t in whole if quality.judge(t, model)[-1]]
    assert sorted((r.doc_id for r in single.collect()), key=repr) == first_of_each(rows)
    before = [tuple(r) for r in single.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted((i, rest.decode("utf-8", "ignore")) for i, rest in remaining(before, 200))
    assert changed.count() == cut.count() and not any("@mail" in r.text and ".example.com" in r.text for r in changed.collect())
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0] and packed.select("doc_id").distinct().count() == changed.count()
    assert pipeline.run(spark, data).count() == packed.count()
