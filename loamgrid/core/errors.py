"""Errors of the engine. Each format has its own class, so that a caller can tell whose data is at fault."""


class LoamError(Exception):
    """Anything that is wrong with data or a request."""


class Malformed(LoamError):
    """Bytes that do not follow their format."""


class Unsupported(LoamError):
    """A well-formed thing that this engine does not handle."""


class SchemaError(LoamError):
    """Columns or values that do not fit."""


class CrsError(LoamError):
    """A coordinate system that is unknown or cannot be transformed."""


class WkbError(Malformed):
    pass


class GeoJsonError(Malformed):
    pass


class GeoParquetError(Malformed):
    pass


class GdbError(Malformed):
    pass


class ShapefileError(Malformed):
    pass


class TiffError(Malformed):
    pass


class ImageError(Malformed):
    pass


class TileError(LoamError):
    pass


class PmTilesError(Malformed):
    pass


class ConvertError(LoamError):
    pass


class LayerAmbiguous(ConvertError):
    """A container with several layers, and none named."""
