"""What a task holds at once."""

import tracemalloc

import numpy as np
import zstandard

from sparkclean.llm import context_mixing


def test_sums_of_slots_are_packed_a_few_at_a_time():
    span = context_mixing._SPAN
    counts = lambda k: np.full(span, k << 26, np.uint64)
    tracemalloc.start()
    got = {}
    for batch in context_mixing._arrays((k, counts(k)) for k in range(200)):
        got |= dict(zip(batch.column("part").to_pylist(), batch.column("z").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got) == list(range(1, 200)) and peak < 32 << 20
    for k, z in got.items():
        raw = zstandard.ZstdDecompressor().decompress(z)
        assert (np.frombuffer(raw, np.uint32 if len(raw) == 4 * span else np.uint64) == counts(k)).all()
