"""SimHash near-duplicates: fingerprints joined by vantage-point trees.

Random fingerprints lie about 32 bits from every vantage point, so a tree over whole
fingerprints can prune little at radius 4. The trees here are over thirds of the bits: two
fingerprints at most 4 bits apart differ by at most one bit in some third. A third's trees
split by the Hamming distance to vantage points; with radius 1 only the points on a boundary
shell (about a sixth) go to both sides. The upper levels use fixed vantage points and name
the shards that are dealt out; each task then goes on with points of its own, where a third no
longer tells points apart with those of the other thirds, and compares
whole fingerprints in the leaves, so the pairs found are exact. A task returns links that
span what it found, and components come from those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.rows import keep_rows, row_key
from leafsieve.llm.textwork import slices, tidy
from leafsieve.operators.components import connected_components
from leafsieve.runtime import materialize, ship

#: Fingerprints link at so many differing bits or fewer.
RADIUS = 4
WORDS = 4
SEED = 42
#: (offset, width) of each third; RADIUS bits over three leave one with at most one.
THIRDS = ((0, 22), (22, 21), (43, 21))
WITHIN = RADIUS // len(THIRDS)
#: Fingerprints that a shard is meant to hold, and a leaf.
SHARD, LEAF = 40_000, 256


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of the shingles of a text in UTF-8; 0 without a word."""
    split = data.lower().split()  # of bytes: A-Z only, and [\x20\x09-\x0D] only
    if not split:
        return 0
    joined = b" ".join(split)
    if len(split) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, count = xxhash.xxh64_intdigest, len(split) - words + 1
    spans = zip(starts[:count].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    found = [fingerprint(data) for _, held in slices(texts.to_pylist()) for data in held]
    tidy()
    return pa.array(np.array(found, dtype=np.uint64).view(np.int64), type=pa.int64())


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; a null text has fingerprint 0, as an empty one."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(_fingerprints, "long")(F.col(text_col)))


def _vantages(third: int, levels: int) -> list[int]:
    """Fixed vantage points of a third's upper levels: hashes, so that they are spread evenly."""
    return [xxhash.xxh64_intdigest(f"{third}:{k}".encode(), SEED) % (1 << THIRDS[third][1]) for k in range(levels)]


def deal(points: DataFrame, levels: int) -> DataFrame:
    """``points`` (fp, …), once for each third and for each shard that its ball of radius ``WITHIN`` touches."""
    shards = []
    for k, (offset, width) in enumerate(THIRDS):
        near = f"bit_count(((shiftrightunsigned(fp, {offset}) & {(1 << width) - 1}L)) ^ v)"
        # A shell at the middle belongs to both sides: for radius 1 a pair then meets on one of them.
        middle = width // 2
        vantages = "array(" + ", ".join(f"{v}L" for v in _vantages(k, levels)) + ")" if levels else "cast(array() as array<bigint>)"
        shards.append(
            f"""transform(aggregate({vantages}, array(0L), (acc, v) -> concat(
                if({near} <= {middle}, transform(acc, s -> 2 * s), cast(array() as array<bigint>)),
                if({near} >= {middle - WITHIN + 1}, transform(acc, s -> 2 * s + 1), cast(array() as array<bigint>)))),
                s -> {k} + {len(THIRDS)} * s)"""
        )
    return points.select("*", F.explode(F.expr(f"concat({', '.join(shards)})")).alias("shard"))


def _leaf(fps: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Links among the points of a leaf: all pairs if they are few, else a forest with the same components."""
    n = len(ids)
    if n <= 4 * LEAF:
        x, y = np.nonzero(np.triu(np.bitwise_count(fps[ids][:, None] ^ fps[ids][None, :]) <= RADIUS, 1))
        if len(x) <= 4 * n:
            yield np.stack((ids[x], ids[y]), axis=1)
            return
    pool = ids
    while len(pool) > 1:  # grow one component after the other; what it has reached leaves the pool
        front, pool = pool[:1], pool[1:]
        while len(front) and len(pool):
            step = max(1, (1 << 22) // len(pool))
            head, front = front[:step], front[step:]
            near = np.bitwise_count(fps[pool][:, None] ^ fps[head][None, :]) <= RADIUS
            reached = near.any(axis=1)
            yield np.stack((pool[reached], head[near[reached].argmax(axis=1)]), axis=1)
            front = np.concatenate((front, pool[reached]))
            pool = pool[~reached]


def _trees(fps: np.ndarray, ids: np.ndarray, third: int, within: int, others: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Links among points whose ``third`` differs by at most ``within`` bits.

    Points that no vantage point divides lie within few bits of one another there; many of them are divided by the ``others``,
    in one of which a pair then differs by at most half of RADIUS.
    """
    offset, width = THIRDS[third]
    part = (fps >> np.uint64(offset)) & np.uint64((1 << width) - 1)
    rng, stack = np.random.default_rng(SEED), [ids]
    while stack:
        ids = stack.pop()
        if len(ids) > LEAF:
            best = None
            for vantage in part[rng.choice(ids, 4)]:
                far = np.bitwise_count(part[ids] ^ vantage)
                middle = int(np.median(far))
                for m in (middle - within, middle):  # pairs within ``within`` lie both in far <= m + within or both beyond m
                    larger = max(np.count_nonzero(far <= m + within), np.count_nonzero(far > m))
                    if best is None or larger < best[0]:
                        best = larger, far, m
            larger, far, m = best
            if larger <= 0.9 * len(ids):
                stack += [ids[far <= m + within], ids[far > m]]
                continue
        if others and len(ids) > 16 * LEAF:
            for other in others:
                yield from _trees(fps, ids, other, RADIUS // len(others), ())
        else:
            yield from _leaf(fps, ids)


def tree_links(fps: np.ndarray, third: int) -> np.ndarray:
    """Index pairs that link the points within RADIUS whose ``third`` differs by at most WITHIN bits; components are complete."""
    others = tuple(t for t in range(len(THIRDS)) if t != third)
    found = list(_trees(fps, np.arange(len(fps)), third, WITHIN, others))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def _shard_links(table: pa.Table) -> pa.Table:
    third = table.column("shard")[0].as_py() % len(THIRDS)
    fps = table.column("fp").to_numpy()
    links = np.unique(np.sort(fps[tree_links(fps.view(np.uint64), third)], axis=1), axis=0)
    return pa.table({"a": links[:, 0], "b": links[:, 1]})


def near_components(points: DataFrame) -> DataFrame:
    """(node, component) of the linked ones among distinct fingerprints ``points`` (fp); a component is named by its least fingerprint as a signed number."""
    # A level halves a shard but for its shell: about a sixth of the points go to both sides.
    levels = math.ceil(math.log(max(points.count() / SHARD, 1)) / math.log(2 / (1 + 1 / 6)))
    links = deal(points, levels).groupBy("shard").applyInArrow(_shard_links, "a long, b long")
    return connected_components(links)


def _components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row, fp; named: a row per fp with the component's least id, and the least text of that id there)."""
    prints = docs.select(F.col(id_col).alias("doc_id"), row_key(text_col).alias("row"), F.col(text_col).alias("text"))
    prints = materialize(with_fingerprint(prints).select("doc_id", "row", "fp"), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    points = materialize(prints.groupBy("fp").agg(F.min(first).alias("first")), "points")
    linked = points.join(near_components(points.select("fp")).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = materialize(linked, "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    return prints, materialize(linked.join(least, "component").select("fp", "least"), "named")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least id that links lead to, itself included).

    Null, empty and blank texts share fingerprint 0 and link like any other. Repeated rows
    each give a row; a row with a null id gets its component, which is null if all its ids are. An empty
    table gives no row; further columns are ignored.
    """
    prints, named = _components(docs, id_col, text_col)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the least id (a null id comes last), with all columns.

    Rows are told apart by id and text: of a component's rows with the least id the least text by its SHA-256 stays, and a row
    never goes because another one of its id does. Of rows that repeat an id and its text one stays.
    """
    prints, named = _components(docs, id_col, text_col)
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    return keep_rows(docs, prints.join(named, "fp").select("doc_id", "row", kept.alias("kept")), id_col, text_col)
