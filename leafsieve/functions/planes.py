"""Pictures as columns: planes of grey values resampled and compared by array expressions, without Python workers.

A plane is an array of whole numbers from 0 to 255, row after row, with its width and height; all three may differ
from row to row. Resampling is separable: weights of a side are found once for a picture, rows are brought to the new
width, then columns to the new height, in the fixed point of :mod:`leafsieve.functions.imaging`, so both give the same
numbers. Null or empty planes give nulls.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafsieve.functions.imaging import CHANGED, FLAT_DEVIATION, GRID, POINT

#: Side of the sample by which a plane is judged flat.
SAMPLE = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is found once, also where the body uses it within lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def _count(n: Column | int) -> Column:
    """The numbers from 0 to below n."""
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def triangle(x: Column) -> Column:
    return F.greatest(1 - F.abs(x), F.lit(0.0))


def lanczos(x: Column) -> Column:
    def sinc(y: Column) -> Column:
        return F.when(y == 0, 1.0).otherwise(F.sin(math.pi * y) / (math.pi * y))

    return F.when(F.abs(x) < 3, sinc(x) * sinc(x / 3)).otherwise(0.0)


#: Filters by their curve and reach.
BILINEAR, LANCZOS = (triangle, 1.0), (lanczos, 3.0)


def weights(size: Column, cells: Column | int, kind) -> Column:
    """array<struct<low, taps>>: for each of ``cells`` the first place of a side that counts, and the weights from there on."""
    curve, reach = kind
    cells = F.lit(cells) if isinstance(cells, int) else cells
    scale = size.cast("double") / cells
    stretch = F.greatest(scale, F.lit(1.0))

    def cell(c: Column) -> Column:
        centre = (c + 0.5) * scale
        low = F.greatest((centre - reach * stretch + 0.5).cast("int"), F.lit(0))
        high = F.least((centre + reach * stretch + 0.5).cast("int"), size)
        raw = F.transform(F.sequence(low, high - 1), lambda k: curve((k - centre + 0.5) / stretch))
        total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
        fixed = lambda w: (w * (1 << POINT) + F.when(w < 0, -0.5).otherwise(0.5)).cast("bigint")
        taps = _let(raw, lambda r: _let(total(r), lambda t: F.transform(r, lambda w: fixed(w / t))))
        same = F.struct(c.cast("int").alias("low"), F.array(F.lit(1 << POINT).cast("bigint")).alias("taps"))
        return F.when(size == cells, same).otherwise(F.struct(low.alias("low"), taps.alias("taps")))

    return F.transform(_count(cells), cell)


def _mixed(values: Column, at: Column, taps: Column) -> Column:
    """The value of a new cell, of those from ``at`` on."""
    products = F.zip_with(F.slice(values, at + 1, F.size(taps)), taps, lambda v, w: v * w)
    total = F.aggregate(products, F.lit(1 << POINT - 1).cast("bigint"), lambda a, x: a + x)
    return F.least(F.greatest(F.shiftright(total, POINT), F.lit(0)), F.lit(255)).cast("int")


def resample(plane: Column, width: Column, height: Column, new_width: Column | int, new_height: Column | int, kind=LANCZOS) -> Column:
    """The plane in another size, row after row."""
    # Column after column, so that those of a column lie together for the second step.
    columns = _let(weights(width, new_width, kind), lambda wx: F.flatten(F.transform(wx, lambda x: F.transform(
        _count(height), lambda r: _mixed(plane, r * width + x["low"], x["taps"])))))
    found = _let(columns, lambda mid: _let(weights(height, new_height, kind), lambda wy: F.flatten(F.transform(wy, lambda y: F.transform(
        _count(new_width), lambda c: _mixed(mid, c * height + y["low"], y["taps"]))))))
    sized = [n > 0 for n in (new_width, new_height) if isinstance(n, Column)]
    return F.when(functools.reduce(Column.__and__, sized, _whole(plane, width, height)), found)


def _whole(plane: Column, width: Column, height: Column) -> Column:
    return (width > 0) & (height > 0) & (F.size(plane) == width * height)


def dhash(plane: Column, width: Column, height: Column) -> Column:
    """Whether each cell of a grid of 9 by 8 is darker than the next, as 64 bits, the first highest."""
    small = resample(plane, width, height, GRID + 1, GRID, LANCZOS)

    def bits(p: Column) -> Column:
        def bit(k: Column) -> Column:
            at = k + F.floor(k / GRID)  # a row has a cell more than bits
            return (F.get(p, at + 1) > F.get(p, at)).cast("int").cast("bigint")

        return F.aggregate(_count(GRID * GRID), F.lit(0).cast("bigint"), lambda a, k: F.shiftleft(a, 1).bitwiseOR(bit(k)))

    return _let(small, lambda p: F.when(p.isNotNull(), bits(p)))


def flat(plane: Column, width: Column, height: Column) -> Column:
    """Whether the deviation of a sample of 32 by 32 is below FLAT_DEVIATION, by whole numbers."""
    n = SAMPLE * SAMPLE
    summed = lambda p, f: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + f(x.cast("bigint")))
    return _let(
        resample(plane, width, height, SAMPLE, SAMPLE, BILINEAR),
        lambda p: n * summed(p, lambda x: x * x) - F.pow(summed(p, lambda x: x), F.lit(2)).cast("bigint") < int(FLAT_DEVIATION**2) * n * n,
    )


def difference_ratio(one: tuple[Column, Column, Column], other: tuple[Column, Column, Column]) -> Column:
    """The share of places at which two planes differ by more than CHANGED; the other is brought to the size of the one.

    Each is (plane, width, height).
    """
    plane, width, height = one
    sized = resample(*other, width, height, BILINEAR)
    far = lambda p: F.size(F.filter(F.zip_with(plane, p, lambda a, b: F.abs(a - b) > CHANGED), lambda x: x))
    return _let(sized, lambda p: F.when(_whole(plane, width, height) & p.isNotNull(), far(p) / F.size(plane)))
