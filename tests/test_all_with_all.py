"""Fingerprints near any of many others: in blocks of all with all, and under keys."""

import numpy as np
import pytest

from leafsieve.operators import similarity


@pytest.mark.parametrize("ease, square", [(4, 70), (4, 1 << 15), (0, 70)])
def test_equal_to_brute_force(spark, monkeypatch, ease, square):
    """With an ease of 0 all goes under keys; else no key is dealt out at a threshold at which keys tell little."""
    for name, value in (("FEW_TARGETS", 10), ("EASE", ease), ("SQUARE", square), ("BLOCK", 40), ("PART", 200)):
        monkeypatch.setattr(similarity, name, value)
    if ease:
        monkeypatch.setattr(similarity, "_both", None)
    rng = np.random.default_rng(5)
    targets = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    left = np.concatenate((rng.integers(0, 1 << 64, 300, dtype=np.uint64), *(targets[:60] ^ np.uint64((1 << n) - 1) for n in (0, 12, 13))))
    near = {int(x) for x in left.view(np.int64)[(np.bitwise_count(left[:, None] ^ targets) <= 12).any(axis=1)]}
    frame = lambda h: spark.createDataFrame([(int(x),) for x in h.view(np.int64)] + [(None,)], "h long")
    got = [r.dhash for r in similarity.near_any(frame(left), frame(targets), 12).collect()]
    assert len(got) == len(near) >= 120 and set(got) == near
