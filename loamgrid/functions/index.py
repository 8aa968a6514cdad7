"""Ordering keys: quantising, Hilbert distances and tile ids, as column expressions.

Over a grid of a fixed order the curve is walked in compiled arithmetic, a lookup in one 64-bit number for
each bit; where the order is a column, and back from a distance, by an Arrow function over whole batches, bit by
bit. Keys that cannot be computed are null and sort last.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.functions.measure import finite

ORDER = 16
MAX_ZOOM = 31
CELL = T.StructType([T.StructField(n, T.LongType()) for n in "xy"])
TILE = T.StructType([T.StructField("z", T.IntegerType()), *CELL])


def hilbert(x: Column, y: Column, order: int | Column = ORDER) -> Column:
    """Distance along the Hilbert curve over a grid of 2**order cells to a side."""
    if isinstance(order, int):
        return _compiled(x, y, order)
    return _distances(x.cast("long"), y.cast("long"), order.cast("long"))


def _numbers(*columns: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns as arrays of their own, and which rows have a null in none."""
    valid = np.logical_and.reduce([np.asarray(c.is_valid()) for c in columns])
    return [np.array(c.fill_null(0), np.int64) for c in columns], valid


@F.arrow_udf(T.LongType())
def _distances(x: pa.Array, y: pa.Array, order: pa.Array) -> pa.Array:
    (x, y, n), valid = _numbers(x, y, order)
    n = np.clip(n, 0, MAX_ZOOM)
    x, y, d = x & (1 << n) - 1, y & (1 << n) - 1, np.zeros(len(x), np.int64)
    for k in range(int(n.max(initial=0)) - 1, -1, -1):
        rx, ry, mask = x >> k & 1, y >> k & 1, (1 << k) - 1
        d += (3 * rx ^ ry) << 2 * k
        x, y = x & mask, y & mask
        flip, turn = (ry == 0) & (rx == 1), (ry == 0) & (n > k)
        x, y = np.where(flip, mask - x, x), np.where(flip, mask - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return pa.array(d, pa.int64(), mask=~valid)


def _turns() -> int:
    """For each of four states of the curve and each pair of bits, four bits: the quadrant's place and the next state.

    A state says whether the coordinates below are complemented (2) and exchanged (1).
    """
    out = 0
    for state in range(4):
        for bits in range(4):
            rx, ry = (bits >> 1) ^ (state >> 1), (bits & 1) ^ (state >> 1)
            rx, ry = (ry, rx) if state & 1 else (rx, ry)
            below = state if ry else state ^ (2 * rx) ^ 1
            out |= ((3 * rx ^ ry) << 2 | below) << 4 * (4 * state + bits)
    return out - (1 << 64) if out >> 63 else out


def _compiled(x: Column, y: Column, order: int) -> Column:
    """The same for a fixed order; null if a coordinate is."""
    turns, total = F.lit(_turns()).cast("long"), F.lit(0).cast("long")
    bit = lambda v, k: F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long")).cast("int")
    state = F.lit(0)
    for k in range(order - 1, -1, -1):
        found = F.call_function("shiftrightunsigned", turns, state * 16 + bit(x, k) * 8 + bit(y, k) * 4).bitwiseAND(F.lit(15).cast("long"))
        total = total + F.shiftleft(F.shiftright(found, 2), 2 * k)
        state = found.bitwiseAND(F.lit(3).cast("long")).cast("int")
    return total + (x.cast("long") + y.cast("long")) * 0


def _cells(d: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of distances."""
    t, x, y = d.copy(), np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
    for k in range(int(order.max(initial=0))):
        rx = t >> 1 & 1
        ry = (t ^ rx) & 1
        on, mask = order > k, (1 << k) - 1
        flip, turn = on & (ry == 0) & (rx == 1), on & (ry == 0)
        x, y = np.where(flip, mask - x, x), np.where(flip, mask - y, y)
        x, y = np.where(turn, y, x) + np.where(on, rx << k, 0), np.where(turn, x, y) + np.where(on, ry << k, 0)
        t >>= 2
    return x, y


@F.arrow_udf(CELL)
def _places(d: pa.Array, order: pa.Array) -> pa.Array:
    (d, n), valid = _numbers(d, order)
    x, y = _cells(d, np.clip(n, 0, MAX_ZOOM))
    return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"], mask=pa.array(~valid))


def hilbert_inverse(d: Column, order: Column) -> Column:
    """struct<x, y> of a distance."""
    return _places(d.cast("long"), order.cast("long"))


def quantize(v: Column, low: Column, high: Column, order: int = ORDER) -> Column:
    """0 .. 2**order - 1, clamped and truncated; null for values or widths that are not finite and positive."""
    width = high - low
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / F.nullif(width, F.lit(0.0))))
    return F.when(finite(v) & finite(width) & (width > 0), F.floor(share * float(2**order - 1)).cast("int"))


def hilbert_key(x: Column, y: Column, extent: tuple[Column, Column, Column, Column], order: int = ORDER) -> Column:
    """The key of a point in an extent; null, so last, where either coordinate has no place."""
    qx, qy = quantize(x, extent[0], extent[2], order), quantize(y, extent[1], extent[3], order)
    return hilbert(qx, qy, order)


def _below(z: Column) -> Column:
    """Number of tiles on all levels below z: (4**z - 1) / 3."""
    return F.call_function("div", F.call_function("shiftleft", F.lit(1).cast("long"), z * 2) - 1, F.lit(3).cast("long"))


def tile_id(z: Column | int, x: Column, y: Column) -> Column:
    """Tiles of lower levels, then the Hilbert distance; null for a level above 31 or a place outside it. A number for z is compiled."""
    if isinstance(z, int):
        inside = (x >= 0) & (y >= 0) & (x < 1 << z) & (y < 1 << z) if 0 <= z <= MAX_ZOOM else F.lit(False)
        return hilbert(F.when(inside, x), y, max(0, min(z, MAX_ZOOM))) + ((1 << 2 * max(z, 0)) - 1) // 3
    side = F.call_function("shiftleft", F.lit(1).cast("long"), z)
    good = (z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < side) & (y < side)
    return F.when(good, _below(z) + hilbert(x, y, z))


@F.arrow_udf(TILE)
def _tiles(i: pa.Array) -> pa.Array:
    (i,), valid = _numbers(i)
    below = np.array([((1 << 2 * z) - 1) // 3 for z in range(MAX_ZOOM + 1)], np.int64)
    valid &= (i >= 0) & (i < below[-1] + (1 << 2 * MAX_ZOOM))
    z = np.searchsorted(below, np.where(valid, i, 0), "right") - 1
    x, y = _cells(np.where(valid, i, 0) - below[z], z)
    return pa.StructArray.from_arrays([pa.array(z, pa.int32()), pa.array(x), pa.array(y)], ["z", "x", "y"], mask=pa.array(~valid))


def tile_of_id(i: Column) -> Column:
    """struct<z, x, y> of a tile id; null for numbers that are none."""
    return _tiles(i.cast("long"))
