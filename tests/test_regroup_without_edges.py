"""Clusters that go on without their edges, against clusters from scratch."""

import random

from tests.test_linkage import dense
from tests.test_regroup import labels, roots, want
from tests.test_similarity import frame

from leafsieve.operators import regroup, similarity


def test_batches(spark, monkeypatch):
    """Rows that are told as changed are those that differ; no pair is made."""
    for name in ("similar_pairs", "near_pairs"):
        monkeypatch.setattr(regroup, name, None)
    monkeypatch.setattr(similarity, "ONE_ROUND", 150)
    rng, threshold, h = random.Random(5), 4, dense(6, 250, low=16)
    all_ = [int(x) for x in h]
    rng.shuffle(all_)
    now = set(all_[:150])
    made = regroup.start(frame(spark, sorted(now)), threshold, edges=False)
    assert roots(made) == want(now, threshold) and made.edges is None
    for added, lost in ((all_[150:220], 0), ([], 60), (all_[200:], 40), (all_[:20], 500)):
        gone = set(rng.sample(sorted(now), min(lost, len(now))))
        change = regroup.advance(made, frame(spark, added), frame(spark, sorted(gone)), threshold)
        before, now = labels(made), (now - gone) | set(added)
        made = change.clusters
        after = labels(made)
        assert roots(made) == want(now, threshold)
        assert {r.node % (1 << 64): r.component % (1 << 64) for r in change.changed.collect()} == {n: c for n, c in after.items() if before.get(n) != c}
        assert {r.node % (1 << 64) for r in change.left.collect()} == set(before) - set(after)
        assert (change.rows_changed, change.rows_left) == (change.changed.count(), change.left.count())
