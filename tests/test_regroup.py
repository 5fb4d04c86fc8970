"""Clusters that go on from the last run, against clusters from scratch."""

import random

from tests.test_similarity import frame, signed, union

from leafsieve.operators import regroup
from leafsieve.operators.similarity import near_pairs


def want(hashes, threshold):
    hashes = sorted(hashes)
    pairs = [(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (a ^ b).bit_count() <= threshold]
    return union(pairs, hashes)


def roots(found):
    return {r.dhash % (1 << 64): r.root % (1 << 64) for r in found.roots().collect()}


def labels(found):
    return {r.node % (1 << 64): r.component % (1 << 64) for r in found.labels.collect()}


def test_ten_batches(spark):
    """Chains and hubs that grow together and fall apart; rows that are told as changed are those that differ, and no others."""
    rng, threshold = random.Random(8), 3

    def near(h):
        for b in rng.sample(range(64), rng.randint(1, 3)):
            h ^= 1 << b
        return h

    now = {rng.getrandbits(64) for _ in range(30)}
    made = regroup.start(frame(spark, sorted(now) + sorted(now)[:3]), threshold)
    assert roots(made) == want(now, threshold)
    for batch in range(10):
        known = sorted(now)
        added = {near(rng.choice(known)) for _ in range(18)} | {rng.getrandbits(64) for _ in range(3)} | set(known[:2])
        gone = set(rng.sample(known, min(len(known), [0, 6, 25][batch % 3]))) | {rng.getrandbits(64)}
        if batch == 7:
            gone = set(known)
        change = regroup.advance(made, frame(spark, sorted(added)), frame(spark, sorted(gone)), threshold)
        before, now = labels(made), (now - gone) | added
        made = change.clusters
        after = labels(made)
        assert roots(made) == want(now, threshold)
        assert {r.node % (1 << 64): r.component % (1 << 64) for r in change.changed.collect()} == {n: c for n, c in after.items() if before.get(n) != c}
        assert {r.node % (1 << 64) for r in change.left.collect()} == set(before) - set(after)
        assert (change.rows_changed, change.rows_left) == (change.changed.count(), change.left.count())
        assert {(r.a % (1 << 64), r.b % (1 << 64)) for r in made.edges.collect()} == {(a, b) for a in now for b in now if a < b and (a ^ b).bit_count() <= threshold}
    idle = regroup.advance(made, frame(spark, []), frame(spark, []), threshold)
    assert (idle.rows_changed, idle.rows_left) == (0, 0) and roots(idle.clusters) == roots(made)


def test_pairs_of_two_sides(spark):
    rng = random.Random(2)
    right = sorted({rng.getrandbits(64) for _ in range(80)})
    left = sorted({r ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for r in right for _ in range(3)} | set(right[:9]))
    for threshold in (1, 2, 5, 9):
        got = [(r.a, r.b, r.distance) for r in near_pairs(frame(spark, left), frame(spark, right), threshold).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(signed(a), signed(b), (a ^ b).bit_count()) for a in left for b in right if (a ^ b).bit_count() <= threshold}
