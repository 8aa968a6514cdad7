"""Images with world files: PNG decoded here, eight bits to a channel; JPEG through Pillow if it is installed."""

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loamgrid.core.errors import ImageError, Unsupported
from loamgrid.sources.files import driver_bytes, exists, read_bytes
from loamgrid.sources.geotiff import SCHEMA

#: Endings of world files by that of the image.
SIDECARS = {"jpg": ("jgw", "jpgw", "wld"), "jpeg": ("jgw", "jpegw", "wld"), "png": ("pgw", "pngw", "wld"), "tif": ("tfw", "tifw", "wld"), "tiff": ("tfw", "tiffw", "wld")}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def parse_world(text: str) -> tuple[float, ...]:
    """Six numbers to a transform whose origin is the corner of the first pixel: half a pixel back from its centre, along both axes."""
    try:
        a, d, b, e, c, f = (float(v.replace(",", ".")) for v in text.split()[:6])
    except ValueError as err:
        raise ImageError("a world file has six numbers") from err
    return c - (a + b) / 2, a, b, f - (d + e) / 2, d, e


def world_file(path: str) -> str | None:
    stem, _, ext = path.rpartition(".")
    for e in SIDECARS.get(ext.lower(), ("wld",)):
        for name in (f"{stem}.{e}", f"{stem}.{e.upper()}"):
            if exists(name):
                return name
    return None


def decode_png(data: bytes) -> list[np.ndarray]:
    """The channels of an eight-bit, not interlaced image; a palette is looked up."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ImageError("no PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if head is None:
        raise ImageError("no header")
    w, h, depth, color, _, _, interlaced = head
    if depth != 8 or interlaced or color not in CHANNELS:
        raise Unsupported("only eight bits to a channel, not interlaced")
    n = CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    if len(raw) < h * (w * n + 1):
        raise ImageError("the image is cut")
    raw = raw[: h * (w * n + 1)].reshape(h, w * n + 1)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int64)
    for i in range(h):
        out[i] = unfiltered(int(raw[i, 0]), raw[i, 1:].astype(np.int64), above, n)
        above = out[i].astype(np.int64)
    pixels = out.reshape(h, w, n)
    if color == 3:
        if palette is None:
            raise ImageError("no palette")
        pixels = palette[pixels[:, :, 0]]
    return [np.ascontiguousarray(pixels[:, :, k]) for k in range(pixels.shape[2])]


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above & 255
    if kind == 1:
        return (np.cumsum(row.reshape(-1, n), axis=0) & 255).ravel()
    out, line, up = [0] * len(row), row.tolist(), above.tolist()
    for i, v in enumerate(line):
        left, corner = (out[i - n], up[i - n]) if i >= n else (0, 0)
        if kind == 3:
            v += (left + up[i]) // 2
        elif kind == 4:
            p = left + up[i] - corner
            a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
            v += left if a <= b and a <= c else up[i] if b <= c else corner
        else:
            raise ImageError(f"filter {kind}")
        out[i] = v & 255
    return np.array(out)


def decode(data: bytes) -> list[np.ndarray]:
    if data[:3] == b"\xff\xd8\xff":
        try:
            import io

            from PIL import Image
        except ImportError as e:
            raise Unsupported("JPEG needs Pillow, which is not installed") from e
        pixels = np.asarray(Image.open(io.BytesIO(data)))
        return [np.ascontiguousarray(pixels[..., k]) for k in range(pixels.shape[2])] if pixels.ndim == 3 else [pixels]
    return decode_png(data)


#: Names of the channels by their number.
NAMES = {1: ("grey",), 2: ("grey", "alpha"), 3: ("red", "green", "blue"), 4: ("red", "green", "blue", "alpha")}


def read(spark: SparkSession, path: str, epsg: int | None = None) -> DataFrame:
    """The image as one tile of level 0. A world file is required; the system is unknown unless given."""
    sidecar = world_file(path)
    if sidecar is None:
        raise ImageError(f"no world file beside {path}")
    t = parse_world(read_bytes(sidecar).decode("latin-1"))
    planes = decode(driver_bytes(spark, path))
    names = NAMES.get(len(planes), tuple(f"band_{k + 1}" for k in range(len(planes))))
    bands = [(name, "U8", None, None, None, None, p.tobytes()) for name, p in zip(names, planes, strict=True)]
    h, w = planes[0].shape
    return spark.createDataFrame([(0, 0, 0, w, h, t, bands, epsg)], SCHEMA)
