import random
from math import comb

import pytest

from leafsieve.functions.hashing import bands
from leafsieve.operators import components, similarity
from leafsieve.operators.components import connected_components
from leafsieve.operators.similarity import bands_to_agree, clusters, near_any, similar_pairs


def clustered(seed=7, n=300, near=150):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(near):
        h = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 8)):
            h ^= 1 << b
        out.append(h)
    return sorted(set(out))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def frame(spark, hashes):
    return spark.createDataFrame([(signed(h),) for h in hashes], "dhash long")


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("threshold", [1, 2, 3, 4, 6, 8, 10, 12, 14, 16])
@pytest.mark.parametrize("agree", [None, 1, 2, 3])
def test_pairs_equal_brute_force(spark, threshold, agree, monkeypatch):
    if agree == 3 and threshold > 8:
        agree = bands_to_agree(threshold, 10**9)  # of many fingerprints
    monkeypatch.setattr(similarity, "BLOCK", 64)
    monkeypatch.setattr(similarity, "PART", 100)
    hashes = clustered()
    want = {(a, b): (a ^ b).bit_count() for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (a ^ b).bit_count() <= threshold}
    rows = [(r.a % (1 << 64), r.b % (1 << 64), r.distance) for r in similar_pairs(frame(spark, hashes), threshold, agree).collect()]
    assert len(rows) == len(set(rows)) and {(a, b): d for a, b, d in rows} == want


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 10)
    base = random.Random(3).getrandbits(64)
    hashes = sorted({base ^ 1 << i ^ 1 << j for i in range(12) for j in range(12)})
    rows = [(r.a % (1 << 64), r.b % (1 << 64)) for r in similar_pairs(frame(spark, hashes), 2, 1).collect()]
    want = {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("threshold", [0, 3, 8])
def test_clusters(spark, threshold):
    hashes = clustered(9)
    pairs = [(a, b) for a in hashes for b in hashes if a < b and (a ^ b).bit_count() <= threshold]
    got = {r.dhash % (1 << 64): r.root % (1 << 64) for r in clusters(frame(spark, hashes), threshold).collect()}
    assert got == union(pairs if threshold else [], hashes)


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_components_of_chains_hubs_and_loops(spark, at_once, monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 299), (None, 5)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    good = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union(good, {n for e in good for n in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 14])
@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 4, 6, 8, 10, 11, 12, 14, 16])
def test_near_any(spark, threshold, few, monkeypatch):
    """Targets that are sent to all tasks, and targets that are dealt out, in parts that must be split."""
    for name, size in (("FEW_TARGETS", few), ("BLOCK", 32), ("PART", 100)):
        monkeypatch.setattr(similarity, name, size)
    hashes, targets = clustered(1), clustered(1)[::7] + clustered(2)[:5]
    got = [r.dhash % (1 << 64) for r in near_any(frame(spark, [*hashes, *hashes[:9]]), frame(spark, targets * 2), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == {h for h in hashes if any((h ^ t).bit_count() <= threshold for t in targets)}
    if threshold in (2, 14):
        assert near_any(frame(spark, hashes), frame(spark, []), threshold).count() == 0 and near_any(frame(spark, []), frame(spark, targets), threshold).count() == 0
        nulls = spark.createDataFrame([(None,), (signed(hashes[0]),)], "dhash long")
        assert near_any(nulls, nulls, threshold).count() == 1


@pytest.mark.parametrize("skewed", ["left", "right", "both"])
def test_near_any_with_half_of_all_rows_in_a_bucket(spark, skewed, monkeypatch):
    """Fingerprints that agree in all bits but a few: every block is compared, by whichever side is large."""
    for name, size in (("FEW_TARGETS", 0), ("BLOCK", 40), ("PART", 200)):
        monkeypatch.setattr(similarity, name, size)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    dense = sorted({base ^ rng.getrandbits(14) << 50 for _ in range(900)})
    spread = [rng.getrandbits(64) for _ in range(300)]
    left, right = ([*dense[::2], *spread] if skewed != "right" else [*dense[:5], *spread]), ([*dense[1::2], *spread[:50]] if skewed != "left" else [*dense[-5:], *spread[:50]])
    for threshold in (1, 3):
        got = {r.dhash % (1 << 64) for r in near_any(frame(spark, left), frame(spark, right), threshold).collect()}
        assert got == {h for h in left if any((h ^ t).bit_count() <= threshold for t in right)}


def test_bands_cover_all_bits():
    for t in range(17):
        cuts = bands(t)
        assert len(cuts) == t + 1 and cuts[0][0] == 0 and sum(w for _, w in cuts) == 64
        assert all(a[0] + a[1] == b[0] and a[1] - b[1] in (0, 1) for a, b in zip(cuts, cuts[1:]))


def test_keys_grow_with_the_fingerprints():
    """Buckets stay small however many fingerprints there are, and keys a fingerprint stay bounded."""
    assert bands_to_agree(6, 50_000) == 1
    for threshold in range(1, 9):
        for rows in (10**6, 10**8, 10**10):
            agree = bands_to_agree(threshold, rows)
            assert comb(threshold + agree, agree) <= similarity.MOST_KEYS and rows / 2 ** (64 * agree / (threshold + agree)) < max(20_000, rows / 10**5)


def test_tables_of_a_stretch_of_work_go(spark):
    from leafsieve.runtime import materialize, scratch

    with scratch() as keep:
        first = materialize(spark.range(3), "first")
        second = keep(materialize(first.where("id > 0"), "second"))
    assert second.count() == 2
    path = first._leafsieve_path.removeprefix("file://")
    assert not __import__("os").path.exists(path)
