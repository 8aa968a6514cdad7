"""Many geometries at once: points, lines and polygons of an Arrow array as flat arrays.

A walk over the rings goes by their number in a geometry: the first rings of all rows in one step, then the
second ones. Rows that are anything else (collections, other byte orders, malformed bytes) are named in
``others`` and are for the caller to read one by one.
"""

import numpy as np
import pyarrow as pa

from loamgrid.core import geometry as G

HEAD = {G.POINT: b"\x01\x01\x00\x00\x00", G.LINESTRING: b"\x01\x02\x00\x00\x00", G.POLYGON: b"\x01\x03\x00\x00\x00"}
MAX_RINGS = 64  #: rows of more are read one by one


def raw_of(wkb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array."""
    wide = pa.types.is_large_binary(wkb.type)
    at = np.frombuffer(wkb.buffers()[1], np.int64 if wide else np.int32)[wkb.offset : wkb.offset + len(wkb) + 1].astype(np.int64)
    return np.frombuffer(wkb.buffers()[2] or b"", np.uint8), at


def gather(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """(n, width) bytes at places."""
    return raw[at[:, None] + np.arange(width)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] places each."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def slices(wkb: pa.Array, limit: int = 4 << 20) -> list[pa.Array]:
    """The array in parts of a few megabytes, or of one row; one part at least."""
    if not len(wkb):
        return [wkb]
    at = raw_of(wkb)[1]
    cuts, low = [0], 0
    while low < len(wkb):
        low = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        cuts.append(min(low, len(wkb)))
    return [wkb.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def holds(xy: np.ndarray, ring_n: np.ndarray, ring_row: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the rings of each row hold its point: even-odd rule, and not on an edge."""
    ends, some = np.cumsum(ring_n), ring_n > 0
    after = np.arange(1, len(xy) + 1)
    after[ends[some] - 1] = (ends - ring_n)[some]  # rings are closed whether or not their last vertex is the first one
    row = np.repeat(ring_row, ring_n)
    a, b, px, py = xy, xy[after], x[row], y[row]
    with np.errstate(all="ignore"):
        crossed = (a[:, 1] > py) != (b[:, 1] > py)
        at = (b[:, 0] - a[:, 0]) * (py - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        level = (a[:, 1] == py) & (b[:, 1] == py) & (np.minimum(a[:, 0], b[:, 0]) <= px) & (px <= np.maximum(a[:, 0], b[:, 0]))
        on = level | ((a[:, 0] == px) & (a[:, 1] == py)) | (crossed & (px == at))
    turns = np.bincount(row[crossed & (px < at)], minlength=len(x))
    return (turns % 2 == 1) & (np.bincount(row[on], minlength=len(x)) == 0)


class Flat:
    """``kind`` of each row (0 for others and nulls); ``xy`` of all rings; ``ring_row`` and ``ring_n``; rings in the order of their rows."""

    def __init__(self, wkb: pa.Array):
        n = len(wkb)
        self.valid = np.asarray(wkb.is_valid())
        raw, at = raw_of(wkb) if n else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        start, size = at[:-1], at[1:] - at[:-1]
        self.kind = np.zeros(n, np.int64)
        long = np.flatnonzero(self.valid & (size >= 9))
        head = gather(raw, start[long], 9) if len(long) else np.zeros((0, 9), np.uint8)
        plain = (head[:, 0] == 1) & (head[:, 3:5] == 0).all(axis=1) & (head[:, 2] == 0) & np.isin(head[:, 1], list(HEAD))
        long, head = long[plain], head[plain]
        code, count = head[:, 1].astype(np.int64), np.ascontiguousarray(head[:, 5:9]).view("<u4").ravel().astype(np.int64)
        rows, places, counts = [], [], []
        point = long[(code == G.POINT) & (size[long] == 21)]
        rows.append(point), places.append(start[point] + 5), counts.append(np.ones(len(point), np.int64))
        line = (code == G.LINESTRING) & (size[long] == 9 + 16 * count)
        rows.append(long[line]), places.append(start[long[line]] + 9), counts.append(count[line])
        self.kind[point], self.kind[long[line]] = G.POINT, G.LINESTRING
        polygon = (code == G.POLYGON) & (count <= MAX_RINGS)
        own, rings = long[polygon], count[polygon]
        cursor, end = start[own] + 9, at[own + 1]
        good = np.ones(len(own), bool)
        found = []
        for k in range(int(rings.max()) if len(rings) else 0):
            here = np.flatnonzero(good & (rings > k))
            fits = cursor[here] + 4 <= end[here]
            good[here[~fits]] = False
            here = here[fits]
            m = np.ascontiguousarray(gather(raw, cursor[here], 4)).view("<u4").ravel().astype(np.int64)
            fits = cursor[here] + 4 + 16 * m <= end[here]
            good[here[~fits]] = False
            here, m = here[fits], m[fits]
            found.append((here, cursor[here] + 4, m))
            cursor[here] += 4 + 16 * m
        good &= cursor == end
        self.kind[own[good]] = G.POLYGON
        for here, place, m in found:
            keep = good[here]
            rows.append(own[here[keep]]), places.append(place[keep]), counts.append(m[keep])
        row, place, self.ring_n = (np.concatenate(x) for x in (rows, places, counts))
        order = np.argsort(row, kind="stable")  # rings of a row are in their order already
        self.ring_row, place, self.ring_n = row[order], place[order], self.ring_n[order]
        self.at = spread(place, 16 * self.ring_n)  # of each byte of a coordinate
        self.xy = raw[self.at].view("<f8").reshape(-1, 2) if len(self.at) else np.zeros((0, 2))
        self.others = np.flatnonzero(self.valid & (self.kind == 0))
        self.raw, self.starts, self.ends = raw, start, at[1:]

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()

    @property
    def point_ring(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ring_n)), self.ring_n)

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums by row of a value for each ring."""
        return np.bincount(self.ring_row, values, len(self.kind))

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each polygon holds the point of its row; of no meaning for other kinds."""
        return holds(self.xy, self.ring_n, self.ring_row, x, y)

    def nowhere(self) -> np.ndarray:
        """Whether each coordinate is the NaN pair of an empty point."""
        return np.isnan(self.xy).all(axis=1) & (self.kind[self.ring_row] == G.POINT)[self.point_ring]

    def counts(self) -> np.ndarray:
        return np.bincount(self.ring_row[self.point_ring], ~self.nowhere(), len(self.kind)).astype(np.int64)

    def first_counts(self) -> np.ndarray:
        """Coordinates of each row's first ring."""
        out = np.zeros(len(self.kind), np.int64)
        first = np.flatnonzero(np.diff(self.ring_row, prepend=-1))
        out[self.ring_row[first]] = np.bincount(self.point_ring, ~self.nowhere(), len(self.ring_n))[first]
        return out

    def boxes(self) -> np.ndarray:
        """(rows, 4): the envelope of the finite coordinates; NaN without any."""
        out = np.full((len(self.kind), 4), np.nan)
        good = np.isfinite(self.xy).all(axis=1)
        xy, row = self.xy[good], self.ring_row[self.point_ring][good]
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] = np.hstack([np.minimum.reduceat(xy, first), np.maximum.reduceat(xy, first)])
        return out

    def lengths(self) -> np.ndarray:
        """Of lines; other kinds have none."""
        if len(self.xy) < 2:
            return np.zeros(len(self.kind))
        step = np.sqrt((np.diff(self.xy, axis=0) ** 2).sum(axis=1))
        ring = self.point_ring
        own = (ring[1:] == ring[:-1]) & (self.kind[self.ring_row] == G.LINESTRING)[ring[1:]]
        return np.bincount(self.ring_row[ring[1:]][own], step[own], len(self.kind))

    def areas(self) -> np.ndarray:
        """Exteriors less holes, 0 at least; lines and points have none."""
        if not len(self.xy):
            return np.zeros(len(self.kind))
        ring, last = self.point_ring, np.cumsum(self.ring_n) - 1
        following = np.arange(len(self.xy)) + 1
        full = self.ring_n > 0
        following[last[full]] = last[full] - self.ring_n[full] + 1
        b = self.xy[following]
        with np.errstate(invalid="ignore", over="ignore"):
            twice = np.bincount(ring, self.xy[:, 0] * b[:, 1] - b[:, 0] * self.xy[:, 1], len(self.ring_n))
        each = np.where((self.ring_n >= 3) & (self.kind[self.ring_row] == G.POLYGON), np.abs(twice) / 2, 0.0)
        outer = np.diff(self.ring_row, prepend=-1) > 0
        return np.fmax(0.0, self.per_row(np.where(outer, each, -each)))

    def moved(self, change) -> np.ndarray:
        """All bytes with the coordinates changed; empty points and other rows are as they were."""
        out = self.raw.copy()
        if len(self.xy):
            there = ~self.nowhere()
            xy = self.xy.copy()
            xy[there] = change(self.xy[there])
            out[self.at] = np.ascontiguousarray(xy, "<f8").view(np.uint8).ravel()
        return out


def binary(raw: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """An array of rows of so many bytes each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    kind, width = (pa.binary(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(sizes), [mask, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(raw.tobytes())])


def _xy(points: pa.Array) -> np.ndarray:
    """(n, 16) bytes of an array of structs x, y."""
    x, y = (c.to_numpy(zero_copy_only=False).astype("<f8") for c in points.flatten()[:2])
    return np.column_stack([x, y]).view(np.uint8).reshape(-1, 16)


def _offsets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(validity, first, count) of each list in the values behind it."""
    valid = np.asarray(lists.is_valid())
    at = lists.offsets.to_numpy().astype(np.int64)
    return valid, at[:-1], np.where(valid, np.diff(at), 0)


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray) -> None:
    if len(at):
        out[at[:, None] + np.arange(data.shape[1])] = data


def _number(n: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(n, "<u4").view(np.uint8).reshape(-1, 4)


def points(x: pa.Array, y: pa.Array) -> pa.Array:
    raw = np.empty((len(x), 21), np.uint8)
    raw[:, :5] = np.frombuffer(HEAD[G.POINT], np.uint8)
    raw[:, 5:] = np.column_stack([c.to_numpy(zero_copy_only=False).astype("<f8") for c in (x, y)]).view(np.uint8).reshape(len(x), 16)
    return binary(raw.ravel(), np.full(len(x), 21), np.asarray(x.is_valid()) & np.asarray(y.is_valid()))


def lines(lists: pa.Array) -> pa.Array:
    """Lists of points as lines."""
    valid, first, count = _offsets(lists)
    sizes = np.where(valid, 9 + 16 * count, 0)
    start = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    head = np.frombuffer(HEAD[G.LINESTRING], np.uint8)
    _put(out, start[valid], np.hstack([np.tile(head, (int(valid.sum()), 1)), _number(count[valid])]))
    if count.sum():
        _put(out, np.repeat(start + 9, count) + 16 * spread(np.zeros_like(count), count), _xy(lists.values)[spread(first, count)])
    return binary(out, sizes, valid)


def polygons(lists: pa.Array) -> pa.Array:
    """Lists of rings, which are lists of points, as polygons."""
    valid, first, rings = _offsets(lists)
    _, ring_first, ring_n = _offsets(lists.values)
    mine = spread(first, rings)
    ring_first, ring_n, row = ring_first[mine], ring_n[mine], np.repeat(np.arange(len(rings)), rings)
    inner = 4 + 16 * ring_n
    sizes = np.where(valid, 9 + np.bincount(row, inner, len(rings)).astype(np.int64), 0)
    start = np.cumsum(sizes) - sizes
    before = np.cumsum(inner) - inner
    base = before - np.repeat(np.bincount(row, inner, len(rings)).cumsum() - np.bincount(row, inner, len(rings)), rings).astype(np.int64)
    at = start[row] + 9 + base
    out = np.empty(int(sizes.sum()), np.uint8)
    _put(out, start[valid], np.hstack([np.tile(np.frombuffer(HEAD[G.POLYGON], np.uint8), (int(valid.sum()), 1)), _number(rings[valid])]))
    _put(out, at, _number(ring_n))
    if ring_n.sum():
        _put(out, np.repeat(at + 4, ring_n) + 16 * spread(np.zeros_like(ring_n), ring_n), _xy(lists.values.values)[spread(ring_first, ring_n)])
    return binary(out, sizes, valid)
