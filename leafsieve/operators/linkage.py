"""Single linkage of fingerprints without their pairs.

Where texts are alike, fingerprints lie so densely that pairs within a distance grow with the square of the rows. Clusters need fewer: what is linked
already is not compared again. A bucket of fingerprints that share a key starts from the clusters found so far; the largest of them is compared with the
rest, what it meets joins it and is compared in turn, and so on until nothing is near it. So each pair is compared at most once, none within
a cluster, and a task hands on at most an edge for each cluster that it joins to another.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa

from leafsieve.functions.hashing import bands
from leafsieve.operators.components import forest
from leafsieve.options import BITS

#: Buckets up to this size are compared place by place, many at once; clusters from this size on are compared with the rest of their bucket.
SMALL, LARGE = 48, 64
#: Fingerprints that are compared at once with how many others.
AT_ONCE = (256, 256)


def cut(h: np.ndarray, chosen: tuple[int, ...], cuts: list[tuple[int, int]]) -> np.ndarray:
    """The bits of some bands, put together as keys are."""
    out = np.zeros(len(h), dtype=np.uint64)
    for k in chosen:
        offset, width = cuts[k]
        out = (out << np.uint64(width % BITS)) | ((h >> np.uint64(offset)) & np.uint64((1 << width) - 1))
    return out


def _hits(h: np.ndarray, kind: np.ndarray, meets: np.ndarray, rest: np.ndarray, wave: np.ndarray, threshold: int) -> np.ndarray:
    """Which of ``rest`` are near one of ``wave`` (both places in ``h``); who has met one is compared no more."""
    hit = np.zeros(len(rest), dtype=bool)
    for k in np.unique(kind[wave]):
        targets = h[wave[kind[wave] == k]]
        live = np.flatnonzero(meets[k][kind[rest]] & ~hit)
        for at in range(0, len(targets), AT_ONCE[1]):
            if not len(live):
                break
            some, near = targets[at : at + AT_ONCE[1]], np.zeros(len(live), dtype=bool)
            for low in range(0, len(live), AT_ONCE[0]):
                near[low : low + AT_ONCE[0]] = (np.bitwise_count(h[rest[live[low : low + AT_ONCE[0]]], None] ^ some) <= threshold).any(axis=1)
            hit[live[near]] = True
            live = live[~near]
    return hit


def _merge(to: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lead the labels x and y, pair by pair, to the same one in ``to``."""
    while True:
        low, high = np.minimum(to[x], to[y]), np.maximum(to[x], to[y])
        if (low == high).all():
            return
        np.minimum.at(to, high, low)
        while (to != to[to]).any():
            to[:] = to[to]


def _link_bucket(h: np.ndarray, label: np.ndarray, kind: np.ndarray, meets: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, label it is led to) of a bucket whose fingerprints have labels from 0 on."""
    to, live = np.arange(label.max() + 1), np.arange(len(h))
    while True:
        root = to[label[live]]
        sizes = np.bincount(root)
        top = sizes.argmax()
        if sizes[top] == len(live):
            break
        if sizes[top] >= LARGE:  # all that is linked to the largest one, and then it is done with
            mine = root == top
            rest, waves = live[~mine], [live[mine]]
            while waves and len(rest):
                hit = _hits(h, kind, meets, rest, waves.pop(), threshold)
                if hit.any():
                    root = to[label[rest]]
                    joined = np.unique(root[hit])
                    more = np.isin(root, joined)
                    _merge(to, joined, np.full(len(joined), to[top]))
                    waves.append(rest[more])
                    rest = rest[~more]
            live = rest
        else:  # some with all that are left
            some = live[:LARGE]
            x, y = np.nonzero(np.bitwise_count(h[some, None] ^ h[live]) <= threshold)
            far = meets[kind[some[x]], kind[live[y]]]
            _merge(to, label[some[x[far]]], label[live[y[far]]])
            live = live[LARGE:]
        if not len(live):
            break
    led = np.flatnonzero(to != np.arange(len(to)))
    return led, to[led]


def link_part(threshold: int, reach: int, agree: int):
    """Edges (x, y) of labels between which some fingerprints of a part, that share a key, are near."""
    cuts = bands(reach + agree - 1)
    chosen = list(combinations(range(len(cuts)), agree))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, old = table.column("a").to_numpy().view(np.uint64), table.column("old").to_numpy(zero_copy_only=False)
        names, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        side, keys = table.column("side").to_numpy(), cut(h, chosen[key[0].as_py()], cuts)
        # Old ones have been compared with one another, and of two blocks each is compared with the other.
        last = side.max(initial=-1)
        kind = 2 * ((side == last) & (last >= 0)) + old
        sides, olds = np.arange(4) // 2, np.arange(4) % 2
        meets = ((sides[:, None] != sides) | (last < 0)) & ~((olds[:, None] == 1) & (olds == 1))
        order = np.lexsort((label, keys))
        h, label, kind, keys = h[order], label[order], kind[order], keys[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        mixed = label[starts] != label[starts + sizes - 1]
        found = []
        for start, size in zip(starts[mixed & (sizes > SMALL)], sizes[mixed & (sizes > SMALL)], strict=True):
            here = slice(start, start + size)
            own, inside = np.unique(label[here], return_inverse=True)
            led, at = _link_bucket(h[here], inside, kind[here], meets, threshold)
            found.append((own[led], own[at]))
        small = mixed & (sizes <= SMALL)
        stop = np.repeat(np.where(small, starts + sizes, 0), sizes)
        live, shift = np.flatnonzero(stop), 1
        while True:
            live = live[live + shift < stop[live]]
            if not len(live):
                break
            near = live[(label[live] != label[live + shift]) & (np.bitwise_count(h[live] ^ h[live + shift]) <= threshold)]
            near = near[meets[kind[near], kind[near + shift]]]
            found.append((label[near], label[near + shift]))
            shift += 1
        x, y = (np.concatenate(ends) for ends in zip(*found, strict=True)) if found else np.zeros((2, 0), dtype=np.int64)
        nodes, roots = forest(x, y)
        return pa.table({"x": names[nodes], "y": names[roots]})

    return run
