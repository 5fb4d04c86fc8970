"""Planes in columns against the decoder's arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafsieve.functions import imaging, planes

SIZES = [(1, 1), (8, 8), (9, 8), (9, 1), (40, 25), (7, 90), (64, 64), (200, 120), (33, 32), (32, 32), (3, 5)]


def test_equal_to_arrays(spark):
    """Fingerprint, flatness and difference of pictures of all sizes, also of gradients, which have many ties."""
    rng, rows = np.random.default_rng(1), []
    for k, (w, h) in enumerate([s for s in SIZES for _ in range(3)]):
        kinds = (rng.integers(0, 256, (h, w)), np.clip(np.add.outer(np.arange(h) * 3, np.arange(w) * 5), 0, 255), 100 + rng.integers(0, 21, (h, w)))
        a, b = kinds[k % 3], rng.integers(0, 256, (max(1, h // 2 + 1), w + 3 * (k % 2)))
        rows.append((k, w, h, a.reshape(-1).tolist(), b.shape[1], b.shape[0], b.reshape(-1).tolist()))
    c = F.col
    one, other = (c("p"), c("w"), c("h")), (c("p2"), c("w2"), c("h2"))
    df = spark.createDataFrame(rows, "id int, w int, h int, p array<int>, w2 int, h2 int, p2 array<int>").repartition(4)
    seen = set()
    for r in df.select("*", planes.dhash(*one).alias("bits"), planes.flat(*one).alias("flat"), planes.difference_ratio(one, other).alias("ratio")).collect():
        a, b = np.array(r.p).reshape(r.h, r.w), np.array(r.p2).reshape(r.h2, r.w2)
        bits, flat = imaging.fingerprint(a[:, :, None])
        assert (r.bits % (1 << 64), r.flat) == (bits, flat), (r.w, r.h)
        assert r.ratio == pytest.approx((np.abs(a - imaging.shrink(b, r.w, r.h, imaging.BILINEAR)) > imaging.CHANGED).mean(), abs=1e-12)
        seen.add(flat)
    assert seen == {True, False}


def test_no_picture(spark):
    """Null and empty planes, and planes that are not as large as they say, have no digest."""
    rows = [(None, None, None), ([], 0, 0), ([1, 2, 3], 2, 2), ([1, 2], 2, None), ([], 3, 0)]
    df = spark.createDataFrame(rows, "p array<int>, w int, h int")
    one = (F.col("p"), F.col("w"), F.col("h"))
    whole = (F.expr("array(1, 2)"), F.lit(2), F.lit(1))
    out = df.select(planes.dhash(*one).alias("a"), planes.flat(*one).alias("b"), planes.difference_ratio(one, whole).alias("c"), planes.difference_ratio(whole, one).alias("d"))
    assert [tuple(r) for r in out.collect()] == [(None, None, None, None)] * len(rows)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([([1, 2], 2, 1)], "p array<int>, w int, h int").select(planes.dhash(F.col("p"), F.col("w"), F.col("h")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
