"""The pieces of short texts, and words and texts by the batch."""

import random

import numpy as np
import pyarrow as pa

from sparkclean.llm import piece_scan, registry


def plainly_merged(text, scores):
    symbols = list(text)
    while len(symbols) > 1:
        known = [(scores[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not known:
            break
        k = -max(known)[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols


class Asked(dict):
    """Scores that count how often they are asked for."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


def test_a_join_asks_for_its_own_neighbours_only():
    model = piece_scan.Pieces(registry.piece_model())
    rng = random.Random(5)
    model.scores = scores = Asked(model.scores)
    for n in (1, 2, 7, 30, 80):
        text = "".join(rng.choice("▁theinganderx") for _ in range(n))
        want, scores.asked = plainly_merged(text, dict(scores)), 0
        assert model.merged(text) == want and scores.asked <= 3 * n


def test_words_without_a_search_for_blanks():
    for text in ("", " ", "  ", " a", " a b", " a  b", " a ", "a b", " a\n\tb c", "▁a▁▁b", "▁a▁b"):
        assert piece_scan.words(text) == piece_scan._WORD.findall(text.replace("▁", " "))


def test_texts_of_ids_by_the_batch():
    path = registry.piece_model()
    model = piece_scan.pieces_of(path)
    kept = []
    piece_scan.decoded(type("Parts", (), {"mapInArrow": lambda self, f, kind: kept.append(f)})(), path)
    texts = ["a b", "", "é  日本 x", "\x00퟿ 𝔘"]
    ids = [piece_scan.encode(piece_scan.escaped(t), model) for t in texts] + [np.array([model.bytes[0xFF]], "<i4").tobytes()]
    columns = [pa.array(range(5), pa.int64()), pa.array(range(5), pa.int64()), pa.array([0, 0, 0, 0, 1], pa.int64()), pa.array(ids, pa.binary())]
    (out,) = kept[0](iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "part", "ids"])]))
    assert out.column("text").to_pylist() == [*texts, "�"]
    assert [np.array(x, "<i4").tobytes() for x in out.column("numbers").to_pylist()] == ids
