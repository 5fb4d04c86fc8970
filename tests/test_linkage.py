"""Clusters without pairs: links in a part, in blocks of a large part, in one round and in two, and between old and new ones."""

import numpy as np
import pyarrow as pa
import pytest
from tests.test_similarity import union

from leafsieve.functions.hashing import bands
from leafsieve.operators import linkage, similarity


def dense(seed, n, centres=3, low=20):
    """Fingerprints that differ in few of their low bits, as those of like texts do, and some that are near nothing."""
    rng = np.random.default_rng(seed)
    some = rng.integers(0, 1 << 64, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(low):
        some ^= (rng.random(n) < 0.17).astype(np.uint64) << np.uint64(rng.integers(0, 64))
    return np.unique(np.concatenate((some, rng.integers(0, 1 << 64, n // 4, dtype=np.uint64))))


def near(h, threshold):
    return {(int(h[x]), int(h[y])) for x, y in zip(*np.nonzero(np.bitwise_count(h[:, None] ^ h) <= threshold), strict=True) if x < y}


def frame(spark, h):
    return spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "dhash long")


def roots(found):
    return {r.dhash % (1 << 64): r.root % (1 << 64) for r in found.collect()}


def test_dense_fingerprints_make_no_pairs(spark, monkeypatch):
    """What is handed on grows with the fingerprints and not with their square."""
    h, seen = dense(1, 900, centres=1), []

    def counted(edges, *names):
        seen.append(edges.count())
        return similarity.connected_components.__wrapped__(edges, *names)

    counted.__wrapped__ = similarity.connected_components
    monkeypatch.setattr(similarity, "connected_components", counted)
    pairs = near(h, 6)
    assert roots(similarity.clusters(frame(spark, h), 6)) == union(pairs, [int(x) for x in h])
    assert len(pairs) > 50 * len(h) and sum(seen) <= 7 * len(h)


@pytest.mark.parametrize("one_round, block, part", [(1 << 16, 1 << 14, 8192), (0, 1 << 14, 300), (0, 20, 300), (1 << 16, 30, 8192)])
@pytest.mark.parametrize("threshold", [1, 3, 6])
def test_equal_to_brute_force(spark, monkeypatch, one_round, block, part, threshold):
    for name, value in (("ONE_ROUND", one_round), ("LINK_BLOCK", block), ("PART", part)):
        monkeypatch.setattr(similarity, name, value)
    h = dense(2, 400)
    assert roots(similarity.clusters(frame(spark, h), threshold)) == union(near(h, threshold), [int(x) for x in h])


@pytest.mark.parametrize("small, large, at_once", [(48, 64, (256, 256)), (0, 1, (3, 5)), (0, 8, (256, 256)), (5, 1 << 20, (7, 2)), (1 << 20, 64, (256, 256))])
@pytest.mark.parametrize("kinds", ["one side", "two sides", "old", "old on two sides"])
def test_links_of_a_part(monkeypatch, small, large, at_once, kinds):
    """Whatever way a bucket goes, labels are linked as by all pairs that share a key and may meet."""
    for name, value in (("SMALL", small), ("LARGE", large), ("AT_ONCE", at_once)):
        monkeypatch.setattr(linkage, name, value)
    rng, threshold = np.random.default_rng(3), 6
    h = dense(4, 500)
    n = len(h)
    label = np.arange(n)
    label[rng.random(n) < 0.3] = 7
    old = rng.random(n) < 0.5 if "old" in kinds else np.zeros(n, dtype=bool)
    side = rng.integers(0, 2, n) if "two" in kinds else np.full(n, -1)
    for band, (offset, width) in enumerate(bands(threshold)):
        key = (h >> np.uint64(offset)) & np.uint64((1 << width) - 1)
        meet = (np.bitwise_count(h[:, None] ^ h) <= threshold) & (key[:, None] == key) & ~(old[:, None] & old) & ((side[:, None] < 0) | (side[:, None] != side))
        want = union([(int(label[x]), int(label[y])) for x, y in zip(*np.nonzero(meet), strict=True)], [int(x) for x in set(label)])
        table = pa.table({"a": h.view(np.int64), "label": label, "old": old, "side": side.astype(np.int32)})
        got = linkage.link_part(threshold, threshold, 1)((pa.scalar(band),), table).to_pydict()
        assert len(got["x"]) < len(want)
        assert union(list(zip(got["x"], got["y"], strict=True)), list(want)) == want
