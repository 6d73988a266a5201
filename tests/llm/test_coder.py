from __future__ import annotations

import numpy as np
import pytest

from waybook.llm import coder


@pytest.mark.parametrize("vocabulary", [300, 50_000, 100_000])
def test_round_trip(vocabulary):
    rnd = np.random.default_rng(vocabulary)
    zipf = np.minimum(rnd.zipf(1.3, 30_000), vocabulary - 1)
    blocks = [zipf[:8192], zipf[8192:9000], rnd.integers(0, vocabulary, 3000), np.zeros(5000, int), np.array([], int), np.array([vocabulary - 1]), np.tile(rnd.integers(0, vocabulary, 50), 60)]
    coded = coder.encode(blocks, vocabulary)
    back = coder.decode(coded, [len(b) for b in blocks], vocabulary)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    assert len(coded[3]) < 300 and len(coded[6]) < 600  # repeated contexts cost next to nothing
    assert len(coded[0]) < 2 * 8192 * 0.6
    assert coder.encode([blocks[2]], vocabulary) == [coded[2]]  # lanes do not depend on each other
