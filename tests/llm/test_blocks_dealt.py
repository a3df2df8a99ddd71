"""Blocks of chunks, and stretches of an anchor, stay together behind a join that adaptive execution turns into a broadcast."""

import random
from contextlib import contextmanager

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from sparkclean.llm import piece_scan, registry, suffix_dedup  # noqa: E402
from sparkclean.storage import stage  # noqa: E402


@contextmanager
def broadcast_below(spark, size):
    names = {"spark.sql.autoBroadcastJoinThreshold": size, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_blocks_of_chunks(spark):
    rng, path = random.Random(8), registry.piece_model()
    words = ["".join(rng.choice("abcdefghiklmnoprstuwé") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=160)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    with broadcast_below(spark, "40k"):
        got = piece_scan.encoded(df, path, 32).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.part)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<i4").tolist())
    model = piece_scan.pieces_of(path).model
    assert len(got) > 5000 and ids == {k: model.encode(t) for k, t in enumerate(texts)}


def test_stretches_of_an_anchor(spark):
    """Anchors of five stretches are hot here; every other anchor has two that share their first 40 bytes."""
    rng = random.Random(9)
    drawn = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    rows = []
    for anchor in range(2000):
        head = drawn(40)
        rows += [(anchor, k, 1, head + drawn(20)) for k in range(5 if anchor < 1000 else 2)]
    texts = stage(spark.createDataFrame(rows, "anchor long, stretch long, n long, text binary").repartition(6))
    with broadcast_below(spark, "60k"):
        got = suffix_dedup._marks(texts, 40, 6, 4).collect()
    assert sorted((r.anchor, r.stretch) for r in got if r.spans) == sorted((a, s) for a, s, *_ in rows)
