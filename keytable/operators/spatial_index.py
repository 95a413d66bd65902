"""Quad-tree index: entities by the tile that holds them, and intersection search."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytable.functions import geojson, spatial
from keytable.functions.spatial import KEY_WIDTH, MAX_LEVEL

TILE_COLUMN = "tile"
Extent = tuple[float, float, float, float]


def derive(base: DataFrame, extent: Column, *, keys: Column | None = None) -> DataFrame:
    """The index rows: ``tile`` (the deepest tile of the extent, padded to its stored
    width; with ``keys``, an array column, one row per key) and the base columns. Extents
    that are null have no row."""
    rows = base.withColumn("__extent", extent).where(F.col("__extent").isNotNull() & F.col("__extent.minx").isNotNull())
    # bound by a lambda, so that the optimizer does not repeat the extent in every term
    once = F.transform(F.array("__extent"), lambda e: spatial.extent_quadkey(e["minx"], e["miny"], e["maxx"], e["maxy"]))[0]
    own = F.explode(F.array_distinct(keys)) if keys is not None else once
    return rows.withColumn("__key", own).select(spatial.padded_quadkey(F.col("__key")).alias(TILE_COLUMN), *base.columns)


def candidates(index: DataFrame, query: Extent) -> DataFrame:
    """Index rows whose tile is the query's, below it, or above it. The conditions are
    on the stored tile, so they reach the scan."""
    key = query_key(query)
    above = [key[:n].ljust(KEY_WIDTH, "_") for n in range(len(key))]
    hit = F.col(TILE_COLUMN).startswith(key) if key else F.lit(True)
    return index.where(hit | F.col(TILE_COLUMN).isin(above) if above else hit)


def search(index: DataFrame, keys: Sequence[str], query: str, geometry: str) -> DataFrame:
    """The rows, each key once, whose geometry column intersects the query geometry."""
    wanted = geojson.read(query)
    if wanted is None:
        raise ValueError("the query is no geometry")
    found = candidates(index, geojson.extent(wanted)).dropDuplicates(list(keys))
    return found.where(geojson.intersects_column(F.col(geometry), query)).drop(TILE_COLUMN)


def join_overlapping(left: DataFrame, right: DataFrame, left_extent: Column, right_extent: Column) -> DataFrame:
    """Pairs of rows of two tables (columns named differently) whose extents overlap. Equal
    rows make a pair each; extents that are null make none.

    Tiles of two levels need not hold one another where their extents overlap (pixels are
    rounded at each level), so the join has grids of its own: 2^level cells a side, an extent
    at the deepest level whose cells are as large as it. The extent of the deeper level is
    looked for at the other's level, and a pair is made only in the cell of the lowest
    corner that both have."""
    a, b = _gridded(left, left_extent, "__a"), _gridded(right, right_extent, "__b")
    # by merging: a side has more and wider rows than the table whose size Spark knows, too many to broadcast
    above = lambda name, own: F.filter("__levels", lambda z: z <= F.col(f"{name}_level") if own else z < F.col(f"{name}_level"))
    at_right = _cells(_with_levels(a, "__a", b, "__b"), "__a", above("__a", True)).join(_cells(b, "__b", F.array("__b_level")).hint("merge"), "__cell")
    at_left = _cells(a, "__a", F.array("__a_level")).join(_cells(_with_levels(b, "__b", a, "__a"), "__b", above("__b", False)).hint("merge"), "__cell")
    lowest = F.col("__a_low").bitwiseOR(F.col("__b_low")) == 3
    overlap = F.expr("__a.minx <= __b.maxx and __b.minx <= __a.maxx and __a.miny <= __b.maxy and __b.miny <= __a.maxy")
    columns = [*left.columns, *right.columns]
    return at_right.where(lowest & overlap).select(columns).unionByName(at_left.where(lowest & overlap).select(columns))


def join_intersecting(left: DataFrame, right: DataFrame, geometries: tuple[str, str]) -> DataFrame:
    """Pairs of rows of two tables (columns named differently) whose geometry columns
    intersect: by their extents, then exactly. A box is its extent, so for two boxes no
    text is read, and texts of boxes are not carried along."""
    names = ("__left", "__right")
    sides = [rows.withColumn(n, geojson.extent_column(F.col(g))).withColumn(f"{n}_text", F.when(~geojson.is_box(F.col(g)), F.col(g))) for rows, g, n in zip((left, right), geometries, names, strict=True)]
    pairs = join_overlapping(*sides, *map(F.col, names))
    boxes = F.col("__left_text").isNull() & F.col("__right_text").isNull()
    exact = geojson.pair_intersects(*[F.when(~boxes, F.coalesce(F.col(f"{n}_text"), geojson.box_text(F.col(n)))) for n in names])
    return pairs.where(boxes | exact).select(*left.columns, *right.columns)


def _cell(coordinate: Column, level: Column) -> Column:
    """The number of a coordinate's cell, which never falls as the coordinate rises."""
    return F.floor((spatial.clip(coordinate, -180.0, 180.0) + 180.0) * F.call_function("shiftleft", F.lit(1), level) / 360.0)


def _gridded(rows: DataFrame, extent: Column, name: str) -> DataFrame:
    """With the extent and its level, null where there is none. A filter instead would work
    the extent out again for each of its terms."""
    at = lambda side: spatial.clip(F.col(f"{name}.{side}"), -180.0, 180.0)
    size = F.greatest(F.abs(at("maxx") - at("minx")), F.abs(at("maxy") - at("miny")), F.lit(360.0 / (1 << MAX_LEVEL)))
    whole = F.expr(" and ".join(f"{name}.{side} is not null" for side in ("minx", "miny", "maxx", "maxy")))
    return rows.withColumn(name, extent).withColumn(f"{name}_level", F.when(whole, F.floor(F.log2(F.lit(360.0) / size)).cast("int")))


def _with_levels(rows: DataFrame, name: str, other: DataFrame, other_name: str) -> DataFrame:
    """With the levels of the other side, an array of 24 at most: one row, sent to all."""
    levels = other.groupBy((F.col(f"{other_name}_level") >= 0).alias("__all")).agg(F.collect_set(f"{other_name}_level").alias("__levels"))
    return rows.withColumn("__all", F.col(f"{name}_level") >= 0).join(F.broadcast(levels), "__all").drop("__all")


def _cells(rows: DataFrame, name: str, levels: Column) -> DataFrame:
    """A row for each cell that the extent touches at each level; ``low`` has bit 1 in the
    lowest cells by x and bit 2 in the lowest by y."""
    out, z = rows.withColumn("__z", F.explode(levels)).where("__z is not null").drop("__levels"), F.col("__z")
    for axis in "xy":
        ends = F.col(f"{name}.min{axis}"), F.col(f"{name}.max{axis}")
        out = out.withColumn(f"__{axis}0", _cell(F.least(*ends), z)).withColumn(f"__{axis}", F.explode(F.sequence(f"__{axis}0", _cell(F.greatest(*ends), z))))
    low = (F.col("__x") == F.col("__x0")).cast("int") + 2 * (F.col("__y") == F.col("__y0")).cast("int")
    cell = (z.cast("long") * (1 << 24) + F.col("__x")) * (1 << 24) + F.col("__y")
    return out.withColumn("__cell", cell).withColumn(f"{name}_low", low).drop("__z", "__x0", "__x", "__y0", "__y", f"{name}_level")


# --- the same tile arithmetic for single values ------------------------------


def tile_of(longitude: float, latitude: float, level: int) -> tuple[int, int]:
    size = 256 << level
    x = (min(max(longitude, -180.0), 180.0) + 180) / 360
    sine = math.sin(min(max(latitude, spatial.MIN_LATITUDE), spatial.MAX_LATITUDE) * math.pi / 180)
    y = 0.5 - math.log((1 + sine) / (1 - sine)) / (4 * math.pi)
    px, py = (int(min(max(v * size + 0.5, 0), size - 1)) for v in (x, y))
    return px // 256, py // 256


def key_of_tile(tx: int, ty: int, level: int) -> str:
    return "".join(str((tx >> i & 1) + 2 * (ty >> i & 1)) for i in range(level - 1, -1, -1))


def query_key(query: Extent) -> str:
    """The quadkey of the deepest tile that holds an extent."""
    minx, miny, maxx, maxy = query
    level = 0
    while level < MAX_LEVEL and tile_of(minx, miny, level + 1) == tile_of(maxx, maxy, level + 1):
        level += 1
    return key_of_tile(*tile_of(minx, maxy, level), level)


def split_keys(extent: Column, should_split: Callable[[str, Extent], bool], *, max_level: int = MAX_LEVEL) -> Column:
    """Quadkeys that cover an extent: its tile, or where ``should_split(key, extent)``
    says so the children that overlap it, and so on down. For keys of a split index."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def cover(minx, miny, maxx, maxy):
        return pd.Series([None if any(v is None or v != v for v in e) else cover_extent(e, should_split, max_level) for e in zip(minx, miny, maxx, maxy, strict=True)])

    return cover(extent["minx"], extent["miny"], extent["maxx"], extent["maxy"])


def cover_extent(extent: Extent, should_split: Callable[[str, Extent], bool], max_level: int = MAX_LEVEL) -> list[str]:
    out, open_keys = [], [query_key(extent)]
    while open_keys:
        key = open_keys.pop()
        if len(key) >= max_level or not should_split(key, extent):
            out.append(key)
            continue
        level = len(key) + 1
        (x0, y1), (x1, y0) = tile_of(extent[0], extent[1], level), tile_of(extent[2], extent[3], level)
        for digit in "0123":
            child = key + digit
            tx, ty = (int("".join(str(int(d) >> b & 1) for d in child), 2) for b in (0, 1))
            if x0 <= tx <= x1 and y0 <= ty <= y1:
                open_keys.append(child)
    return sorted(out)
