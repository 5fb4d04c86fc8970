"""Clusters that grow by a stream: batches that are tried again, and all batches together against one run."""

import random
import uuid

import pytest
from tests.test_regroup import want
from tests.test_similarity import frame

from leafsieve.streaming.watch import KeptClusters, watch_clusters


def batches(seed=6):
    rng, known, out = random.Random(seed), [], []
    for _ in range(4):
        new = [rng.getrandbits(64) for _ in range(12)] + [h ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for h in rng.sample(known, min(len(known), 14))]
        out.append(new)
        known += new
    return out


def roots(kept):
    return {r.dhash % (1 << 64): r.root % (1 << 64) for r in kept.clusters().roots().collect()}


def test_stream(spark, tmp_path):
    parts, threshold = batches(), 3
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={k}"))
    pages = spark.readStream.schema("dhash long, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept, handed, name = KeptClusters(spark, f"file://{tmp_path}/kept", threshold, 4), {}, uuid.uuid4().hex

    def sink(rows, number):
        found = {(r.node, r.component) for r in rows.collect()}
        if number == 2 and number not in handed:
            handed[number] = found
            raise RuntimeError("the sink is not there")
        assert handed.get(number, found) == found  # tried again, the same rows
        handed[number] = found

    with pytest.raises(Exception, match="the sink is not there"):
        watch_clusters(pages, kept, sink, name).awaitTermination()
    again = KeptClusters(spark, f"file://{tmp_path}/kept", threshold, 4)
    versions = again._state()
    assert versions[0] == 2
    watch_clusters(pages, again, sink, name).awaitTermination()
    assert sorted(handed) == [0, 1, 2, 3] and roots(again) == want({h for p in parts for h in p}, threshold)
    before = again._state()
    assert {(r.node, r.component) for r in again.add(frame(spark, parts[3]), 3).collect()} == handed[3] and again._state() == before


def test_a_batch_that_failed_on_its_way(spark, tmp_path, monkeypatch):
    """Tables were written and the state was not: the batch is begun again on what was before it."""
    parts, kept = batches(2), KeptClusters(spark, f"file://{tmp_path}/kept", 3, 4)
    kept.add(frame(spark, parts[0]), 0)
    state, real = kept.tables["state"], type(kept.tables["state"]).overwrite
    monkeypatch.setattr(type(state), "overwrite", lambda self, rows: (_ for _ in ()).throw(OSError("gone")) if self is state else real(self, rows))
    with pytest.raises(OSError):
        kept.add(frame(spark, parts[1]), 1)
    monkeypatch.undo()
    assert roots(kept) == want(parts[0], 3)
    kept.add(frame(spark, parts[1]), 1)
    assert roots(kept) == want({*parts[0], *parts[1]}, 3)
