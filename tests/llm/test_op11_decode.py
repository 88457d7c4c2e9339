"""Decoding of ids with bytes, unknown and control pieces among them."""

import random
import time

import pytest

from linklens.llm import op11_prefix_tokens as P


@pytest.fixture(scope="module")
def pieces():
    return P.Pieces()


def test_odd_ids_as_the_library(pieces):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    rng = random.Random(5)
    some = [*(pieces.byte[b] for b in (0x0A, 0x20, 0x41, 0x7F, 0x80, 0x9F, 0xC3, 0xA9, 0xE2, 0x96, 0x82, 0xF0, 0xFF)), pieces.unknown, pieces.end, *sorted(pieces.blank)[:2], *sorted(pieces.id.values())[:5]]
    for _ in range(2000):
        ids = [rng.choice(some) for _ in range(rng.randint(0, 8))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_line_ends_cost_little(pieces):
    plain = pieces.encode("the house of the river " * 8000)
    broken = pieces.encode("the house of the river\n" * 8000)

    def seconds(ids):
        took = []
        for _ in range(7):
            start = time.perf_counter()
            pieces.decode(ids)
            took.append(time.perf_counter() - start)
        return min(took) / len(ids)
    assert seconds(broken) < 2.5 * seconds(plain)
