"""Coordinate systems and point reprojection as column expressions.

Supported: geographic 4326 and 7844 (taken as equal, a difference of some 1.5 m), Web Mercator 3857, UTM
north 32601-32660 and south 32701-32760 on WGS84, and the GDA2020 map grid 7846-7859 on GRS80. A transform
goes through longitude and latitude. Transverse Mercator is the published Krueger series to the sixth
order in n: the easting has asinh in its auxiliary angle.

All of it is built-in SQL functions over literals, so that Catalyst folds constants and generates code;
the same formulas over arrays serve the geometry functions.
"""

import json
import math
import re
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.core.errors import CrsError

RADIUS = 6378137.0
MAX_LATITUDE = 85.05112877980659
#: Names that stand for a code when a definition has none.
COMMON_NAMES = (
    ("gda2020", 7844), ("gda_2020", 7844), ("gda94", 4283), ("gda_1994", 4283), ("wgs 84 / pseudo-mercator", 3857), ("web_mercator", 3857), ("web mercator", 3857), ("pseudo-mercator", 3857), ("wgs84", 4326), ("wgs 84", 4326), ("wgs_1984", 4326), ("nad83", 4269), ("north_american_1983", 4269), ("nad27", 4267), ("north_american_1927", 4267), ("british_national_grid", 27700), ("osgb 1936 / british national grid", 27700), ("osgb36", 27700),
)
FLATTENING = {"WGS84": 1 / 298.257223563, "GRS80": 1 / 298.257222101}


class Ellipsoid(NamedTuple):
    a: float
    f: float

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)


ELLIPSOIDS = {k: Ellipsoid(RADIUS, f) for k, f in FLATTENING.items()}


class Projection(NamedTuple):
    kind: str  #: geographic, mercator, tm
    ellipsoid: str = "WGS84"
    lon0: float = 0.0
    k0: float = 0.9996
    fe: float = 500000.0
    fn: float = 0.0


def utm(zone: int, south: bool, ellipsoid: str = "WGS84") -> Projection:
    return Projection("tm", ellipsoid, 6.0 * zone - 183, fn=10_000_000.0 if south else 0.0)


def projection(epsg: int) -> Projection:
    """The projection of a code; an unknown one is an error when the plan is made."""
    if epsg in (4326, 7844):
        return Projection("geographic")
    if epsg == 3857:
        return Projection("mercator")
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return utm(epsg % 100, epsg >= 32701)
    if 7846 <= epsg <= 7859:
        return utm(epsg - 7800, True, "GRS80")
    raise CrsError(f"EPSG:{epsg} cannot be transformed")


def parse_crs(text: str | int) -> int:
    """``EPSG:n``, ``epsg:n`` or ``n``."""
    found = re.fullmatch(r"(?:EPSG:)?(\d+)", str(text).strip(), re.I)
    if not found:
        raise CrsError(f"{text!r} is no EPSG code")
    return int(found[1])


def epsg_of(crs: Any) -> int | None:
    """The code of an EPSG number, a WKT text or a PROJJSON document; None if nothing says it.

    In WKT the authority of the outermost node counts, not that of its units or datum.
    """
    if crs is None or isinstance(crs, int):
        return crs
    if isinstance(crs, dict):
        own = crs.get("id") or {}
        if str(own.get("authority", "")).upper() == "EPSG":
            return int(own["code"])
        found = re.search(r"(?:EPSG:+|::)(\d+)$", str(crs.get("name", "")))
        return int(found[1]) if found else epsg_of_name(str(crs.get("name", "")))
    text = str(crs).strip()
    found = re.fullmatch(r"(?:urn:ogc:def:crs:)?EPSG:[\d.]*:?(\d+)", text, re.I)
    if found:
        return int(found[1])
    if re.search(r"CRS84$", text):
        return 4326
    depth, outer, quoted = 0, [], False
    for at, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "[(":
            depth += 1
        elif not quoted and c in "])":
            depth -= 1
        elif depth == 1 and not quoted and text[at - 1] in ",[ \n\t":
            hit = re.match(r"""(?:AUTHORITY|ID)\s*[\[(]\s*"EPSG"\s*,\s*"?(\d+)""", text[at:], re.I)
            if hit:
                outer.append(int(hit[1]))
    if outer:
        return outer[-1]
    name = re.match(r'\s*\w+\s*[\[(]\s*"([^"]*)"', text)
    return epsg_of_name(name[1] if name else text)


def epsg_of_name(name: str) -> int | None:
    low = name.strip().lower()
    zone = re.search(r"gda2020[ _/]+mga[ _]+zone[ _]+(\d+)", low)
    if zone:
        return 7800 + int(zone[1])
    zone = re.search(r"wgs[ _]?(?:19)?84[ _/]+utm[ _]+zone[ _]+(\d+)([ns])", low)
    if zone:
        return (32600 if zone[2] == "n" else 32700) + int(zone[1])
    bare = low.removeprefix("gcs_").removeprefix("d_")
    return next((code for known, code in COMMON_NAMES if bare == known or bare.startswith(known + "_")), None)


def projjson(epsg: int) -> dict:
    return {"id": {"authority": "EPSG", "code": epsg}}


class Series(NamedTuple):
    """Krueger's coefficients: forward, inverse, conformal to geodetic latitude, and the rectifying radius."""

    alpha: tuple[float, ...]
    beta: tuple[float, ...]
    delta: tuple[float, ...]
    radius: float


def series(n: float) -> Series:
    """The published expansions to the sixth order in the third flattening."""
    n2, n3, n4, n5, n6 = n**2, n**3, n**4, n**5, n**6
    alpha = (
        n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180 - 127 * n5 / 288 + 7891 * n6 / 37800,
        13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440 + 281 * n5 / 630 - 1983433 * n6 / 1935360,
        61 * n3 / 240 - 103 * n4 / 140 + 15061 * n5 / 26880 + 167603 * n6 / 181440,
        49561 * n4 / 161280 - 179 * n5 / 168 + 6601661 * n6 / 7257600,
        34729 * n5 / 80640 - 3418889 * n6 / 1995840,
        212378941 * n6 / 319334400,
    )
    beta = (
        n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360 - 81 * n5 / 512 + 96199 * n6 / 604800,
        n2 / 48 + n3 / 15 - 437 * n4 / 1440 + 46 * n5 / 105 - 1118711 * n6 / 3870720,
        17 * n3 / 480 - 37 * n4 / 840 - 209 * n5 / 4480 + 5569 * n6 / 90720,
        4397 * n4 / 161280 - 11 * n5 / 504 - 830251 * n6 / 7257600,
        4583 * n5 / 161280 - 108847 * n6 / 3991680,
        20648693 * n6 / 638668800,
    )
    delta = (
        2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45 + 26 * n5 / 45 - 2854 * n6 / 675,
        7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45 + 2704 * n5 / 315 + 2323 * n6 / 945,
        56 * n3 / 15 - 136 * n4 / 35 - 1262 * n5 / 105 + 73814 * n6 / 2835,
        4279 * n4 / 630 - 332 * n5 / 35 - 399572 * n6 / 14175,
        4174 * n5 / 315 - 144838 * n6 / 6237,
        601676 * n6 / 22275,
    )
    return Series(alpha, beta, delta, RADIUS / (1 + n) * (1 + n2 / 4 + n4 / 64 + n6 / 256))


class _Columns:
    """The functions that the formulas need, over columns."""

    sin, cos, tan, sinh, cosh, asinh, atanh, atan, atan2, exp, log, sqrt = (staticmethod(getattr(F, n)) for n in "sin cos tan sinh cosh asinh atanh atan atan2 exp log sqrt".split())
    radians, degrees = staticmethod(F.radians), staticmethod(F.degrees)

    @staticmethod
    def clamp(x: Column, low: float, high: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), x))


class _Arrays:
    """The same over numpy arrays."""

    sin, cos, tan, sinh, cosh, exp, log, sqrt, radians, degrees = (staticmethod(getattr(np, n)) for n in "sin cos tan sinh cosh exp log sqrt radians degrees".split())
    asinh, atanh, atan, atan2 = staticmethod(np.arcsinh), staticmethod(np.arctanh), staticmethod(np.arctan), staticmethod(np.arctan2)

    @staticmethod
    def clamp(x: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip(x, low, high)


class _Doubles:
    """The same over Python's floats, which go through the C library."""

    sin, cos, tan, sinh, cosh, asinh, atanh, atan, atan2, exp, log, sqrt, radians, degrees = (staticmethod(getattr(math, n)) for n in "sin cos tan sinh cosh asinh atanh atan atan2 exp log sqrt radians degrees".split())

    @staticmethod
    def clamp(x: float, low: float, high: float) -> float:
        return max(low, min(high, x))


def mercator_forward(lng: Any, lat: Any, m: Any = _Columns) -> tuple[Any, Any]:
    """Longitude and latitude to metres; the latitude is clamped to the square map."""
    return RADIUS * m.radians(lng), RADIUS * m.log(m.tan(math.pi / 4 + m.radians(m.clamp(lat, -MAX_LATITUDE, MAX_LATITUDE)) / 2))


def mercator_inverse(x: Any, y: Any, m: Any = _Columns) -> tuple[Any, Any]:
    return m.degrees(x / RADIUS), m.degrees(2 * m.atan(m.exp(y / RADIUS)) - math.pi / 2)


def tm_forward(p: Projection, lng: Any, lat: Any, m: Any = _Columns) -> tuple[Any, Any]:
    n = ELLIPSOIDS[p.ellipsoid].n
    s, e = series(n), 2 * math.sqrt(n) / (1 + n)
    sin_lat, away = m.sin(m.radians(lat)), m.radians(lng - p.lon0)
    t = m.sinh(m.atanh(sin_lat) - e * m.atanh(e * sin_lat))
    xi0, eta0 = m.atan2(t, m.cos(away)), m.asinh(m.sin(away) / m.sqrt(t * t + m.cos(away) * m.cos(away)))
    xi, eta = xi0, eta0
    for j, a in enumerate(s.alpha, 1):
        xi = xi + a * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
        eta = eta + a * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
    return p.fe + p.k0 * s.radius * eta, p.fn + p.k0 * s.radius * xi


def tm_inverse(p: Projection, x: Any, y: Any, m: Any = _Columns) -> tuple[Any, Any]:
    s = series(ELLIPSOIDS[p.ellipsoid].n)
    xi0, eta0 = (y - p.fn) / (p.k0 * s.radius), (x - p.fe) / (p.k0 * s.radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(s.beta, 1):
        xi = xi - b * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
        eta = eta - b * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
    chi = m.atan2(m.sin(xi), m.sqrt(m.sinh(eta) * m.sinh(eta) + m.cos(xi) * m.cos(xi)))  # conformal latitude
    lat = chi
    for j, d in enumerate(s.delta, 1):
        lat = lat + d * m.sin(2 * j * chi)
    return p.lon0 + m.degrees(m.atan2(m.sinh(eta), m.cos(xi))), m.degrees(lat)


def _leg(p: Projection, forward: bool, a: Any, b: Any, m: Any) -> tuple[Any, Any]:
    if p.kind == "geographic":
        return a, b
    if p.kind == "mercator":
        return (mercator_forward if forward else mercator_inverse)(a, b, m)
    return (tm_forward if forward else tm_inverse)(p, a, b, m)


def is_identity(source: int, target: int) -> bool:
    return source == target or projection(source).kind == projection(target).kind == "geographic"


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Point columns from one system to another; the columns themselves where nothing changes."""
    a, b = projection(source), projection(target)
    if is_identity(source, target):
        return x, y
    lng, lat = _leg(a, False, x, y, _Columns)
    if a.kind == "geographic" or b.kind == "geographic":
        return _leg(b, True, lng, lat, _Columns)
    # the place between the legs is bound once; put into the second leg it would be written out many times
    between = F.array(F.struct(lng.alias("x"), lat.alias("y")))
    moved = F.transform(between, lambda p: F.struct(*[v.alias(k) for k, v in zip("xy", _leg(b, True, p["x"], p["y"], _Columns), strict=True)]))[0]
    return moved["x"], moved["y"]


def transform_in_c(x: Column, y: Column, source: int, target: int) -> Column:
    """struct<x, y>: the transform by the C library's functions, as engines in C compute it; null where it fails.

    Java's differ from them in the last bits. Slow, one point at a time: for the rows that these bits decide.
    """
    a, b = projection(source), projection(target)

    def one(x: float | None, y: float | None) -> dict | None:
        try:
            return None if x is None or y is None else dict(zip("xy", _leg(b, True, *_leg(a, False, x, y, _Doubles), _Doubles), strict=True))
        except (ValueError, OverflowError, ZeroDivisionError):
            return None

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([one(*p) for p in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.struct({"x": pa.float64(), "y": pa.float64()}))

    return F.arrow_udf(run, "x double, y double")(x, y)


class Transformer(NamedTuple):
    """A pair of systems; both codes are checked when it is made."""

    source_crs: int
    target_crs: int

    @classmethod
    def of(cls, source: int | str, target: int | str) -> "Transformer":
        found = cls(parse_crs(source), parse_crs(target))
        projection(found.source_crs), projection(found.target_crs)
        return found

    @property
    def identity(self) -> bool:
        return is_identity(*self)

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        return transform(x, y, *self)


def transform_columns(df: DataFrame, x: str, y: str, source: int, target: int) -> DataFrame:
    """The frame with two of its columns moved to another system.

    Longitude and latitude are columns of a projection of their own between the legs: both legs run in
    generated code, and neither is written out twice.
    """
    a, b = projection(source), projection(target)
    if is_identity(source, target):
        return df
    lng, lat = _leg(a, False, F.col(x), F.col(y), _Columns)
    between = df.withColumns({x: lng, y: lat})
    e, n = _leg(b, True, F.col(x), F.col(y), _Columns)
    return between.withColumns({x: e, y: n})


def transform_array(xy: np.ndarray, source: int, target: int) -> np.ndarray:
    """(n, 2) coordinates from one system to another."""
    a, b = projection(source), projection(target)
    if is_identity(source, target):
        return xy
    with np.errstate(all="ignore"):
        lng, lat = _leg(a, False, xy[:, 0], xy[:, 1], _Arrays)
        return np.column_stack(_leg(b, True, lng, lat, _Arrays))


def transform_points(points: Column, source: int, target: int) -> Column:
    """An array of struct<x, y>, each point transformed in place."""
    if is_identity(source, target):
        return points
    return F.transform(points, lambda c: F.struct(*[v.alias(k) for k, v in zip("xy", transform(c["x"], c["y"], source, target), strict=True)]))


def metadata(crs: Any) -> dict:
    """What a geometry column's metadata holds of its system."""
    code = epsg_of(crs)
    return {"epsg": code, "crs": None if crs is None else crs if isinstance(crs, int) else json.dumps(crs) if isinstance(crs, dict) else str(crs)}
