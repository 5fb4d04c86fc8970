"""Joins of fingerprints within a Hamming distance, as equi-joins that Spark can deal out.

Of ``threshold + agree`` bands of the bits, fingerprints within the threshold agree in at least ``agree``.
So they meet under the key of some combination of that many bands. More bands in a combination make more keys and
fewer fingerprints under each; what is cheapest goes by the number of fingerprints.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsieve.functions.hashing import bands, hamming, ordered
from leafsieve.operators.components import connected_components
from leafsieve.operators.linkage import cut, link_part
from leafsieve.options import BITS
from leafsieve.runtime import materialize, measured, ship

#: About the cost of dealing out a key, in comparisons, and the most keys of a fingerprint.
DEAL, MOST_KEYS = 150, 300
#: Fingerprints that are compared in a part, and in a block of a part of more than four blocks.
PART, BLOCK = 8192, 4096
#: The same where clusters are linked, and fingerprints that are linked in one round; of more a first one finds most links under the few keys of half the threshold.
LINK_BLOCK, ONE_ROUND = 1 << 14, 1 << 16
#: Comparisons of all with all that take as long as one under a key, the fingerprints of a side that are so compared in a task, and those at once.
EASE, SQUARE, AT_ONCE = 4, 1 << 15, (64, 1024)
#: Rows of a table of large parts that may be broadcast, and targets that are sent to all tasks (8 bytes each).
FEW_PARTS, FEW_TARGETS = 10_000, 1 << 14


def _work(threshold: int, agree: int, rows: int, others: int | None = None) -> float:
    """About how many comparisons fingerprints cost under keys of so many bands."""
    meet = 2 ** (BITS * agree / (threshold + agree))
    each = rows * (DEAL + rows / meet) if others is None else (rows + others) * DEAL + 2 * rows * others / meet
    return comb(threshold + agree, agree) * each


def bands_to_agree(threshold: int, rows: int, others: int | None = None) -> int:
    """How many bands make a key, for the least work with so many fingerprints, among themselves or against others."""
    return min((k for k in range(1, 9) if k == 1 or comb(threshold + k, k) <= MOST_KEYS), key=lambda k: _work(threshold, k, rows, others))


def _keys(h: Column, threshold: int, agree: int) -> Column:
    """array<struct<band, key>>: the number of each combination of bands, and its bits."""
    cuts = bands(threshold + agree - 1)

    def key(chosen: tuple[int, ...]) -> Column:
        out = None
        for k in chosen:
            offset, width = cuts[k]
            part = F.shiftrightunsigned(h, offset).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))
            out = part if out is None else F.shiftleft(out, width).bitwiseOR(part)
        return out

    return F.array(*(F.struct(F.lit(n).alias("band"), key(chosen).alias("key")) for n, chosen in enumerate(combinations(range(len(cuts)), agree))))


def _keyed(df: DataFrame, threshold: int, agree: int) -> DataFrame:
    """A row per key of a frame whose first column is the fingerprint."""
    return df.select("*", F.explode(_keys(F.col(df.columns[0]), threshold, agree)).alias("k")).select(*df.columns, "k.band", "k.key")


def _deal(keyed: DataFrame, parts: int, size: int | None = None) -> DataFrame:
    """``keyed`` (a, right, band, key) with what compares a row: a part, which has some of the keys of a combination, or of a large part two blocks.

    Parts are counted exactly, by sums that are made before the shuffle; those of over four blocks of ``size`` rows are large. Without ``right`` all rows
    are compared with one another, else the left ones with the right ones.
    """
    size = size or BLOCK
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("band", "part").agg(F.count_if(~F.col("right")).alias("l"), F.count_if("right").alias("r"))
    sizes = sizes.where(F.col("l") + F.col("r") > 4 * size)
    whole = {"block": F.lit(-1).cast("long"), "side": F.lit(-1)}
    if sizes.isEmpty():  # nearly always; then nothing is written
        return dealt.withColumns(whole)
    large, (count,) = measured(sizes, "large", F.count("*"))
    large = F.broadcast(large) if count <= FEW_PARTS else large
    plain = dealt.join(large, ["band", "part"], "left_anti").withColumns(whole)
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    split = dealt.join(large, ["band", "part"]).withColumns({"l": blocks("l"), "r": F.when(F.col("r") > 0, blocks("r"))})
    # Among themselves rows meet in pairs of blocks of one side, else each left block meets each right one.
    mine, theirs = (F.when(F.col("right"), F.col(x)).otherwise(F.col(y)) for x, y in (("r", "l"), ("l", "r")))
    split = split.withColumn("own", F.pmod(F.xxhash64("a"), mine).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.col("l")) - 1)))
    low, high = (F.when(F.col("r").isNull(), f("own", "other")).when(F.col("right"), x).otherwise(y) for f, x, y in ((F.least, F.col("other"), F.col("own")), (F.greatest, F.col("own"), F.col("other"))))
    side = F.when(F.col("r").isNull() & (F.col("own") != F.col("other")), F.col("own")).otherwise(-1)
    split = split.withColumns({"block": low.cast("long") * (1 << 31) + high, "side": side})
    return plain.unionByName(split.select(*plain.columns))


def _compare(threshold: int, agree: int):
    """Compares the fingerprints of some buckets of one combination, each pair in the first combination in which it agrees."""
    cuts = bands(threshold + agree - 1)
    chosen = list(combinations(range(len(cuts)), agree))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        last = chosen[key[0].as_py()][-1]
        keys, h = table.column("key").to_numpy(), table.column("a").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, h, side = keys[order], h[order], side[order]
        found, shift, live = [], 1, np.arange(len(h))
        while True:  # each place against the one ``shift`` further on, while that is in the same bucket
            live = live[live + shift < len(h)]
            live = live[keys[live] == keys[live + shift]]
            if not len(live):
                break
            other = h[live] ^ h[live + shift]
            # Two blocks of a large bucket are compared with one another only; elsewhere the side is -1.
            near = np.flatnonzero((np.bitwise_count(other) <= threshold) & ((side[live] < 0) | (side[live] != side[live + shift])))
            # The first bands that agree are these if no other does up to the last of them.
            same = np.zeros(len(near), dtype=np.int64)
            for offset, width in cuts[: last + 1]:
                same += ((other[near] >> np.uint64(offset)) & np.uint64((1 << width) - 1)) == 0
            near = near[same == agree]
            found.append(np.stack((h[live[near]], h[live[near] + shift])))
            shift += 1
        x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.uint64)
        a, b = np.minimum(x, y), np.maximum(x, y)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64), "distance": np.bitwise_count(a ^ b).astype(np.int32)})

    return run


def similar_pairs(hashes: DataFrame, threshold: int, agree: int | None = None) -> DataFrame:
    """(a, b, distance) of distinct fingerprints ``hashes`` (one column) within ``threshold``; a < b as unsigned.

    Exact with any number of bands that ``agree``, which is chosen by the count of fingerprints.
    """
    return _pairs(*measured(hashes.toDF("a"), "hashes", F.count("*")), threshold, agree)


def _pairs(table: DataFrame, counted: list[int], threshold: int, agree: int | None = None) -> DataFrame:
    """Pairs of a table of fingerprints (a), so many as were counted."""
    ship(table.sparkSession)
    (rows,) = counted
    agree = agree or bands_to_agree(threshold, rows)
    dealt = _deal(_keyed(table, threshold, agree).withColumn("right", F.lit(False)), -(-rows // PART) or 1)
    return dealt.groupBy("band", "part", "block").applyInArrow(_compare(threshold, agree), "a long, b long, distance int")


def _near(h: np.ndarray, keys: np.ndarray, targets: np.ndarray, target_keys: np.ndarray, threshold: int) -> np.ndarray:
    """Places of those of ``h`` that are near a target of their key; targets are sorted by key."""
    first, stop = (np.searchsorted(target_keys, keys, side=s) for s in ("left", "right"))
    live, found, shift = np.flatnonzero(first < stop), [], 0
    while len(live):
        near = np.bitwise_count(h[live] ^ targets[first[live] + shift]) <= threshold
        found.append(live[near])
        live, shift = live[~near], shift + 1
        live = live[first[live] + shift < stop[live]]
    return np.concatenate(found) if found else live


def _meet(threshold: int):
    """The left ones of a part that are near a right one."""

    def run(table: pa.Table) -> pa.Table:
        right = table.column("right").to_numpy()
        h, keys = table.column("a").to_numpy().view(np.uint64), table.column("key").to_numpy()
        order = np.flatnonzero(right)
        order = order[np.argsort(keys[order], kind="stable")]
        near = _near(h[~right], keys[~right], h[order], keys[order], threshold)
        return pa.table({"dhash": h[~right][near].view(np.int64)})

    return run


def _meet_all(threshold: int):
    """The left ones of two blocks that are near a right one, all compared with all; who has met one is compared no more."""

    def run(table: pa.Table) -> pa.Table:
        right, h = table.column("right").to_numpy(), table.column("a").to_numpy().view(np.uint64)
        live, targets, found = h[~right], h[right], []
        for at in range(0, len(targets), AT_ONCE[1]):
            some = targets[at : at + AT_ONCE[1]]
            near = np.zeros(len(live), dtype=bool)
            for low in range(0, len(live), AT_ONCE[0]):
                near[low : low + AT_ONCE[0]] = (np.bitwise_count(live[low : low + AT_ONCE[0], None] ^ some) <= threshold).any(axis=1)
            found.append(live[near])
            live = live[~near]
        return pa.table({"dhash": (np.concatenate(found) if found else live[:0]).view(np.int64)})

    return run


def _squares(left: DataFrame, right: DataFrame, n: int, m: int) -> DataFrame:
    """Two sides (a), so many as were counted, dealt out in blocks, each left one with each right one: (a, right, x, y)."""
    x, y = (max(1, -(-k // SQUARE)) for k in (n, m))
    own = lambda k: F.pmod(F.xxhash64("a"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    ours = left.select("a", F.lit(False).alias("right"), own(x).alias("x"), every(y).alias("y"))
    return ours.unionByName(right.select("a", F.lit(True).alias("right"), own(y).alias("y"), every(x).alias("x")))


def _pair_up(threshold: int, agree: int):
    """Pairs of a left and a right one of a part, each in the first combination in which it agrees."""
    cuts = bands(threshold + agree - 1)
    chosen = list(combinations(range(len(cuts)), agree))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        last = chosen[key[0].as_py()][-1]
        right, keys = table.column("right").to_numpy(), table.column("key").to_numpy()
        h = table.column("a").to_numpy().view(np.uint64)
        order = np.flatnonzero(right)
        order = order[np.argsort(keys[order], kind="stable")]
        left, left_keys, targets = h[~right], keys[~right], h[order]
        first, stop = (np.searchsorted(keys[order], left_keys, side=s) for s in ("left", "right"))
        live, found, shift = np.flatnonzero(first < stop), [], 0
        while len(live):
            other = left[live] ^ targets[first[live] + shift]
            near = np.flatnonzero(np.bitwise_count(other) <= threshold)
            same = np.zeros(len(near), dtype=np.int64)
            for offset, width in cuts[: last + 1]:
                same += ((other[near] >> np.uint64(offset)) & np.uint64((1 << width) - 1)) == 0
            near = live[near[same == agree]]
            found.append(np.stack((left[near], targets[first[near] + shift])))
            shift += 1
            live = live[first[live] + shift < stop[live]]
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.uint64)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64), "distance": np.bitwise_count(a ^ b).astype(np.int32)})

    return run


#: Slots of the bit table that most fingerprints end at, as a power of two, and what spreads keys over them.
_SLOTS, _SPREAD = 16, np.uint64(0x9E3779B97F4A7C15)


def _sift(targets: list[int], threshold: int, agree: int):
    """Those of a task's fingerprints that are near one of few targets; nothing is shuffled."""
    cuts = bands(threshold + agree - 1)
    combined = list(combinations(range(len(cuts)), agree))
    wanted = np.array(targets, dtype=np.int64).view(np.uint64)

    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD) >> np.uint64(64 - _SLOTS)

    def run(batches):
        tables = []
        for chosen in combined:
            keys = cut(wanted, chosen, cuts)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << _SLOTS, dtype=bool)
            bits[slot(keys)] = True
            tables.append((chosen, bits, wanted[order], keys[order]))
        for batch in batches:
            h = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False)).view(np.uint64)
            rest, found = h, []
            for chosen, bits, sorted_, sorted_keys in tables:
                keys = cut(rest, chosen, cuts)
                some = np.flatnonzero(bits[slot(keys)])
                near = some[_near(rest[some], keys[some], sorted_, sorted_keys, threshold)]
                found.append(rest[near])
                rest = np.delete(rest, near)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["dhash"])

    return run


def near_any(hashes: DataFrame, targets: DataFrame, threshold: int) -> DataFrame:
    """The distinct ones of ``hashes`` (one column, dhash) within ``threshold`` of any of ``targets`` (one column); nulls are near nothing.

    Few targets are sent to all tasks, and no fingerprint that is not near is shuffled. Many are dealt out with the fingerprints, under as many
    combinations of bands as are cheapest for both sides; parts that are large, by whichever side, are compared block by block. Where keys
    tell so little that comparing all with all costs less, blocks of both sides are compared so.
    """
    left, right = hashes.toDF("dhash"), targets.toDF("target").where("target is not null").distinct()
    if threshold <= 0:
        return left.distinct().join(right, F.col("dhash") == F.col("target"), "left_semi")
    ship(left.sparkSession)
    few = [r.target for r in right.limit(FEW_TARGETS + 1).collect()]
    if len(few) <= FEW_TARGETS:
        # A look-up costs less than dealing out a key, so few bands make a key.
        agree = min((k for k in (1, 2) if comb(threshold + k, k) <= 78), key=lambda k: comb(threshold + k, k) * (8 + len(few) / 2 ** (BITS * k / (threshold + k))))
        return left.mapInArrow(_sift(few, threshold, agree), "dhash long").distinct()
    table, (n,) = measured(left.where("dhash is not null").distinct().toDF("a"), "left", F.count("*"))
    other, (m,) = measured(right.toDF("a"), "right", F.count("*"))
    if n * m <= EASE * _work(threshold, bands_to_agree(threshold, n, m), n, m):
        return _squares(table, other, n, m).groupBy("x", "y").applyInArrow(_meet_all(threshold), "dhash long").distinct()
    dealt, _ = _both(table, other, threshold, n, m)
    return dealt.groupBy("band", "part", "block").applyInArrow(_meet(threshold), "dhash long").distinct()


def near_pairs(hashes: DataFrame, others: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance) of a fingerprint of ``hashes`` and one of ``others`` (one column each, distinct, without nulls) within ``threshold``; each pair once."""
    ship(hashes.sparkSession)
    table, (n,) = measured(hashes.toDF("a"), "left", F.count("*"))
    other, (m,) = measured(others.toDF("a"), "right", F.count("*"))
    dealt, agree = _both(table, other, threshold, n, m)
    return dealt.groupBy("band", "part", "block").applyInArrow(_pair_up(threshold, agree), "a long, b long, distance int")


def _both(left: DataFrame, right: DataFrame, threshold: int, n: int, m: int) -> tuple[DataFrame, int]:
    """Two sides (a), so many as were counted, dealt out, and how many bands make a key."""
    agree = bands_to_agree(threshold, n, m)
    both = _keyed(left, threshold, agree).withColumn("right", F.lit(False)).unionByName(_keyed(right, threshold, agree).withColumn("right", F.lit(True)))
    return _deal(both, -(-(n + m) // PART) or 1), agree


def linked(points: DataFrame, rows: int, threshold: int) -> DataFrame:
    """(a, label) of distinct fingerprints after all within ``threshold`` are linked; given are (a, label, old), so many as were counted.

    Those that share a label are linked already, and old ones near each other too. A label is left as it is, or led to the least that it is linked with.
    """
    ship(points.sparkSession)
    for reach in [threshold // 2, threshold] if rows > ONE_ROUND and threshold > 1 else [threshold]:
        # Keys for a shorter reach find all links up to it and most up to the threshold.
        agree = bands_to_agree(reach, rows)
        keyed = _keyed(points.where("a is not null").select("a", "label", "old"), reach, agree).withColumn("right", F.lit(False))
        dealt = _deal(keyed, -(-rows // PART) or 1, LINK_BLOCK).select("a", "label", "old", "side", "band", "part", "block")
        edges = dealt.groupBy("band", "part", "block").applyInArrow(link_part(threshold, reach, agree), "x long, y long")
        found = connected_components(edges, "x", "y").toDF("label", "found")
        points = points.join(found, "label", "left").select("a", F.coalesce("found", "label").alias("label"), "old")
        if reach < threshold:
            points = materialize(points, "linked")
    return points.select("a", "label")


def clusters(hashes: DataFrame, threshold: int) -> DataFrame:
    """(dhash, root) by single linkage; the root is the least (unsigned) fingerprint of the cluster."""
    hashes = hashes.toDF("dhash").distinct()
    if threshold <= 0:
        return hashes.select("dhash", F.col("dhash").alias("root"))
    # Labels are shifted into unsigned order. A fingerprint that is null is near nothing.
    table, (rows,) = measured(hashes.select(F.col("dhash").alias("a"), ordered(F.col("dhash")).alias("label"), F.lit(False).alias("old")), "hashes", F.count("a"))
    return linked(table, rows, threshold).select(F.col("a").alias("dhash"), ordered(F.col("label")).alias("root"))
