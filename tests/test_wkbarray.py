import struct

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgrid.core import geometry as G
from loamgrid.core import wkbarray as W
from loamgrid.operators import vector_tiles as VT

number = st.floats(-1e6, 1e6) | st.sampled_from([0.0, float("inf"), float("nan")])
pairs = st.lists(st.tuples(number, number), max_size=6)


def geometry(kind, rings):
    if kind == 1:
        return G.Geometry(G.POINT, G.array(rings[0][:1] if rings else []))
    if kind == 2:
        return G.Geometry(G.LINESTRING, G.array(rings[0] if rings else []))
    if kind == 3:
        return G.Geometry(G.POLYGON, [G.array(r) for r in rings])
    return G.Geometry(G.MULTILINESTRING, [G.array(r) for r in rings])


shapes = st.none() | st.builds(geometry, st.integers(1, 4), st.lists(pairs, max_size=4))


def same(a, b):
    return np.allclose(np.array(a, float), np.array(b, float), equal_nan=True, rtol=1e-9, atol=1e-6)


@settings(max_examples=150, deadline=None)
@given(st.lists(shapes, max_size=12), st.integers(0, 3))
def test_flat_arrays_agree_with_single_geometries(found, skip):
    wkb = pa.array([None if g is None else G.to_wkb(g) for g in found], pa.binary()).slice(skip)
    flat, own = W.Flat(wkb), [None if g is None else G.from_wkb(G.to_wkb(g)) for g in found][skip:]
    plain = [i for i, g in enumerate(own) if g is not None and g.kind < 4]
    assert sorted(set(range(len(own))) - set(plain)) == sorted([*flat.others, *np.flatnonzero(~flat.valid)])
    counts, boxes, lengths, areas, first = flat.counts(), flat.boxes(), flat.lengths(), flat.areas(), flat.first_counts()
    moved = flat.moved(lambda p: p + 1.5)
    for i in plain:
        g = own[i]
        assert counts[i] == G.coord_count(g) and (first[i] == 0) == G.is_empty(g)
        assert same(boxes[i], G.bbox(g) or [np.nan] * 4)
        assert same(lengths[i], G.length(g)) and (same(areas[i], G.area(g)) or not np.isfinite(G.area(g)))
        assert moved[flat.starts[i] : flat.ends[i]].tobytes() == G.to_wkb(G.with_coordinates(g, lambda p: p + 1.5))
    assert pa.concat_arrays(W.slices(wkb, 64)).equals(wkb) if len(wkb) else True


def lists(rows, depth):
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    made = lambda p: [{"x": x, "y": y} for x, y in p]
    if depth == 1:
        return pa.array([None if r is None else made(r) for r in rows], pa.list_(point))
    return pa.array([None if r is None else [made(p) for p in r] for r in rows], pa.list_(pa.list_(point)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | pairs, max_size=9), st.lists(st.none() | st.lists(pairs, max_size=3), max_size=9), st.integers(0, 2))
def test_lists_to_wkb(lines, polygons, skip):
    got = W.lines(lists(lines, 1).slice(skip)).to_pylist()
    assert got == [None if r is None else G.to_wkb(G.Geometry(G.LINESTRING, G.array(r))) for r in lines[skip:]]
    got = W.polygons(lists(polygons, 2).slice(skip)).to_pylist()
    assert got == [None if r is None else G.to_wkb(G.Geometry(G.POLYGON, [G.array(p) for p in r])) for r in polygons[skip:]]
    x = pa.array([None if r is None else float(len(r)) for r in lines], pa.float64())
    assert W.points(x, x).to_pylist() == [None if r is None else struct.pack("<BIdd", 1, 1, len(r), len(r)) for r in lines]


def test_bytes_that_are_no_plain_geometry_are_named():
    line = G.to_wkb(G.Geometry(G.LINESTRING, G.array([(0, 0), (1, 1)])))
    big = struct.pack(">BI2d", 0, 1, 3, 4)
    wkb = pa.array([line, line[:-1], big, b"", b"\x01", line + b"x", None, G.to_wkb(G.Geometry(G.POLYGON, [G.array([(0, 0)] * 3)] * 80))], pa.binary())
    flat = W.Flat(wkb)
    assert flat.others.tolist() == [1, 2, 3, 4, 5, 7] and flat.kind.tolist() == [2, 0, 0, 0, 0, 0, 0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(shapes, max_size=12), st.integers(0, 6))
def test_paths_of_many_rows_agree_with_single_ones(found, z):
    """The commands of plain points and lines, all at once; the other rows are left to the caller."""
    wkb = pa.array([None if g is None else G.to_wkb(g) for g in found], pa.binary())
    flat, own = W.Flat(wkb), [None if g is None else G.from_wkb(G.to_wkb(g)) for g in found]
    rows = np.arange(len(found))
    levels, x, y = np.full(len(found), z), rows % (1 << z), rows * 3 % (1 << z)
    paths = VT.flat_paths(flat, levels, x, y)
    plain = [i for i, g in enumerate(own) if g is not None and g.kind in (G.POINT, G.LINESTRING) and len(g.data) and np.isfinite(g.data).all()]
    assert sorted(paths) == plain
    assert all(paths[i] == VT.packed(VT.commands(own[i], z, int(x[i]), int(y[i]))) for i in plain)


def test_geometry_is_encoded_before_a_tile_meets_in_one_task(spark):
    """What is dealt to the tiles' tasks are encoded features; the tile is the one that a plain layer makes."""
    line = lambda k: G.Geometry(G.LINESTRING, G.array([(k, 1), (k + 1, 2), (k % 7, -3)]))
    rows = [(k, bytearray(G.to_wkb(line(k))), 0, 0, 0, f"n{k % 3}") for k in range(50)] + [(50, None, 0, 0, 0, "none"), (51, bytearray(G.to_wkb(G.Geometry(G.POLYGON, [line(1).data]))), 0, 0, 0, None)]
    tiles = VT.encode(spark.createDataFrame(rows, "fid long, geometry binary, z int, x long, y long, name string").coalesce(1), "lines")
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("MapInArrow") < plan.index("RepartitionByExpression") < plan.rindex("MapInArrow")
    one = tiles.collect()
    plain = VT.Layer("lines", 0, 0, 0)
    for fid, g, *_, name in rows:
        plain.add(None if g is None else G.from_wkb(bytes(g)), [("name", name)], fid)
    assert len(one) == 1 and one[0]["n_features"] == 51 and bytes(one[0]["data"]) == VT.tile_bytes([plain.finish()])
