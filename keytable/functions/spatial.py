"""Web-Mercator tiles and quadkeys as Column functions.

Pixel coordinates are truncated to whole numbers as early as the tile scheme does, so
results do not depend on the last bits of floating-point functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tile scheme.
EARTH_RADIUS = 6378137.0
MIN_LATITUDE, MAX_LATITUDE = -85.05112878, 85.05112878
MIN_LONGITUDE, MAX_LONGITUDE = -180.0, 180.0
TILE = 256
MAX_LEVEL = 23
KEY_WIDTH = 30


def _level(level: Column | int) -> Column:
    return F.lit(level) if isinstance(level, int) else level


def map_size(level: Column | int) -> Column:
    """Width and height of the map in pixels."""
    return F.lit(TILE).cast("long") * F.pow(F.lit(2.0), _level(level)).cast("long")


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, as_column(low)), as_column(high))


def ground_resolution(latitude: Column, level: Column | int) -> Column:
    """Metres per pixel at a latitude."""
    return F.cos(clip(latitude, MIN_LATITUDE, MAX_LATITUDE) * (math.pi / 180)) * (2 * math.pi * EARTH_RADIUS) / map_size(level)


def map_scale(latitude: Column, level: Column | int, dpi: float) -> Column:
    """The denominator of the map's scale on a screen."""
    return ground_resolution(latitude, level) * (dpi / 0.0254)


def resolution(level: Column | int) -> Column:
    """Metres per pixel at the equator."""
    return F.lit(2 * math.pi * EARTH_RADIUS) / map_size(level)


def pixel_x(longitude: Column, level: Column | int) -> Column:
    size = map_size(level)
    x = (clip(longitude, MIN_LONGITUDE, MAX_LONGITUDE) + 180.0) / 360.0
    return clip(x * size + 0.5, F.lit(0.0), (size - 1).cast("double")).cast("int")


def pixel_y(latitude: Column, level: Column | int) -> Column:
    size = map_size(level)
    sine = F.sin(clip(latitude, MIN_LATITUDE, MAX_LATITUDE) * math.pi / 180.0)
    y = 0.5 - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)
    return clip(y * size + 0.5, F.lit(0.0), (size - 1).cast("double")).cast("int")


def longitude_of(x: Column, level: Column | int) -> Column:
    size = map_size(level)
    return 360.0 * (clip(x.cast("double"), F.lit(0.0), (size - 1).cast("double")) / size - 0.5)


def latitude_of(y: Column, level: Column | int) -> Column:
    size = map_size(level)
    part = 0.5 - clip(y.cast("double"), F.lit(0.0), (size - 1).cast("double")) / size
    return 90.0 - 360.0 * F.atan(F.exp(-part * 2 * math.pi)) / math.pi


def pixels_to_metres(x: Column, level: Column | int) -> Column:
    """A pixel coordinate in metres from the map's centre."""
    return x * resolution(level) - math.pi * EARTH_RADIUS


def tile_of_pixel(p: Column) -> Column:
    return F.floor(p / TILE).cast("int")


def pixel_of_tile(t: Column) -> Column:
    return (t * TILE).cast("int")


def tile_extent(tx: Column, ty: Column, level: Column | int) -> Column:
    """minx, miny, maxx, maxy of a tile in degrees."""
    return F.struct(
        longitude_of(pixel_of_tile(tx), level).alias("minx"), latitude_of(pixel_of_tile(ty + 1), level).alias("miny"),
        longitude_of(pixel_of_tile(tx + 1), level).alias("maxx"), latitude_of(pixel_of_tile(ty), level).alias("maxy"),
    )


def quadkey(tx: Column, ty: Column, level: Column | int) -> Column:
    """One digit per level: the bit of x plus twice the bit of y, highest first; level 0
    is empty."""
    lv = _level(level)
    digits = F.transform(F.sequence(lv, F.lit(1), F.lit(-1)), lambda i: (F.call_function("shiftright", tx, (i - 1).cast("int")) % 2 + 2 * (F.call_function("shiftright", ty, (i - 1).cast("int")) % 2)).cast("string"))
    return F.when(lv < 1, F.lit("")).otherwise(F.array_join(digits, ""))


def _bits(key: Column, weight: int) -> Column:
    good = key.rlike("^[0-3]*$")
    digits = F.filter(F.split(key, ""), lambda d: d != "")
    value = F.aggregate(digits, F.lit(0).cast("int"), lambda a, d: (a * 2 + F.call_function("shiftright", d.cast("int"), F.lit(weight)) % 2).cast("int"))
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit("not a quadkey: "), key)).cast("int"))


def tile_x(key: Column) -> Column:
    """The x of a quadkey's tile; another digit than 0 to 3 fails."""
    return _bits(key, 0)


def tile_y(key: Column) -> Column:
    return _bits(key, 1)


def _tile_at(coordinate: Column, level: Column, axis: str) -> Column:
    return tile_of_pixel(pixel_x(coordinate, level) if axis == "x" else pixel_y(coordinate, level))


def extent_level(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The deepest level up to 23 at which all corners share a tile, above the first one
    at which they do not; points have 23, what straddles the first split 0."""
    apart = F.filter(
        F.sequence(F.lit(1), F.lit(MAX_LEVEL)),
        lambda z: (_tile_at(minx, z, "x") != _tile_at(maxx, z, "x")) | (_tile_at(miny, z, "y") != _tile_at(maxy, z, "y")),
    )
    return F.coalesce(F.get(apart, F.lit(0)) - 1, F.lit(MAX_LEVEL))


def extent_quadkey(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The quadkey of the deepest tile that holds an extent ('' is the whole map)."""
    level = extent_level(minx, miny, maxx, maxy)
    return F.transform(F.array(level), lambda z: quadkey(_tile_at(minx, z, "x"), _tile_at(maxy, z, "y"), z))[0]


def padded_quadkey(key: Column, width: int = KEY_WIDTH) -> Column:
    """A key at its stored width."""
    return F.rpad(key, width, "_")


def ancestors(key: Column) -> Column:
    """All shorter prefixes of a quadkey, the root first."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(key)), lambda n: n < F.length(key)), lambda n: F.substr(key, F.lit(1), n))
