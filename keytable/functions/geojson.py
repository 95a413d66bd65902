"""GeoJSON geometries: reading, writing, extents, exact intersection.

A geometry is read into (kind, parts): ``parts`` is a list of (shape, coordinates) with
shape point, line or polygon. Input that is no geometry gives None, not an error.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Position = tuple[float, ...]
Part = tuple[str, list]

_NUMBER = "-?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?"
_POSITION = f"\\[\\s*({_NUMBER})\\s*,\\s*({_NUMBER})"
_CORNER = r"\[-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?,-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?\]"
_BOX = rf'^\{{"type":"Polygon","coordinates":\[\[{_CORNER}(?:,{_CORNER}){{4}}\]\]\}}\z'


def _position(value: object) -> Position:
    if not isinstance(value, Sequence) or isinstance(value, str) or len(value) < 2 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value):
        raise ValueError("a position has two numbers at least")
    return tuple(float(x) for x in value[:3])


def _line(value: Sequence) -> list[Position]:
    found = [_position(p) for p in value]
    if len(found) < 2:
        raise ValueError("a line has two positions at least")
    return found


def _polygon(value: Sequence) -> list[list[Position]]:
    rings = [[_position(p) for p in ring] for ring in value]
    if not rings or any(len(r) < 4 for r in rings):
        raise ValueError("a polygon has one ring of four positions at least")
    return rings


def _parts(node: dict) -> list[Part]:
    fields = {str(k).lower(): v for k, v in node.items()}
    kind = str(fields.get("type", "")).lower()
    c = fields.get("coordinates")
    if kind == "point":
        return [("point", _position(c))]
    if kind == "multipoint":
        return [("point", _position(p)) for p in c]
    if kind == "linestring":
        return [("line", _line(c))]
    if kind == "multilinestring":
        return [("line", _line(x)) for x in c]
    if kind == "polygon":
        return [("polygon", _polygon(c))]
    if kind == "multipolygon":
        return [("polygon", _polygon(x)) for x in c]
    if kind == "geometrycollection":
        return [p for g in fields["geometries"] for p in _parts(g)]
    if kind == "feature":
        return _parts(fields["geometry"])
    if kind == "featurecollection":
        return [p for f in fields["features"] for p in _parts(f)]
    raise ValueError(f"no geometry type: {kind}")


def read(text: str | bytes | None) -> list[Part] | None:
    """The simple shapes of a geometry, feature or collection."""
    if text is None:
        return None
    try:
        node = json.loads(text.decode("utf-8-sig") if isinstance(text, bytes) else text.lstrip("﻿"))
        return _parts(node) if isinstance(node, dict) else None
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


def write(parts: Sequence[Part]) -> str:
    """GeoJSON of shapes: a single geometry, a multi-geometry, or a collection."""
    names = {"point": "Point", "line": "LineString", "polygon": "Polygon"}

    def one(part: Part) -> dict:
        return {"type": names[part[0]], "coordinates": part[1]}

    kinds = {shape for shape, _ in parts}
    if len(parts) == 1:
        node = one(parts[0])
    elif len(kinds) == 1:
        node = {"type": "Multi" + names[kinds.pop()], "coordinates": [c for _, c in parts]}
    else:
        node = {"type": "GeometryCollection", "geometries": [one(p) for p in parts]}
    return json.dumps(node, separators=(",", ":"))


def extent(parts: Sequence[Part]) -> tuple[float, float, float, float]:
    """minx, miny, maxx, maxy."""
    positions = [p for shape, c in parts for p in ([c] if shape == "point" else c if shape == "line" else c[0])]
    xs, ys = [p[0] for p in positions], [p[1] for p in positions]
    return min(xs), min(ys), max(xs), max(ys)


def extent_column(geometry: Column) -> Column:
    """The extent of GeoJSON text as a struct, from its positions, whatever its type."""
    numbers = lambda g: F.transform(F.regexp_extract_all(geometry, F.lit(_POSITION), F.lit(g)), lambda x: x.cast("double"))
    xs, ys = numbers(1), numbers(2)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def is_box(geometry: Column) -> Column:
    """Whether GeoJSON text is a plain polygon whose one ring is the border of its extent;
    false too for a box written in a less plain way."""
    plain = F.regexp_like(geometry, F.lit(_BOX))
    numbers = lambda g: F.transform(F.regexp_extract_all(F.when(plain, geometry), F.lit(_POSITION), F.lit(g)), lambda x: x.cast("double"))
    same = lambda c, i, j: F.get(c, F.lit(i)) == F.get(c, F.lit(j))
    turns = lambda c, d: same(c, 0, 1) & same(c, 2, 3) & same(d, 1, 2) & same(d, 0, 3)
    # bound by a lambda, so that the numbers are read once
    border = F.transform(F.array(F.struct(numbers(1).alias("x"), numbers(2).alias("y"))), lambda p: same(p["x"], 0, 4) & same(p["y"], 0, 4) & (turns(p["x"], p["y"]) | turns(p["y"], p["x"])))[0]
    return F.coalesce(border, F.lit(False))


def box_text(extent: Column) -> Column:
    """An extent as GeoJSON text."""
    corner = lambda x, y: F.concat(F.lit("["), extent[x].cast("string"), F.lit(","), extent[y].cast("string"), F.lit("]"))
    ring = [corner(*c) for c in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))]
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *ring), F.lit("]]}"))


# --- intersection ------------------------------------------------------------


def _turn(a: Position, b: Position, c: Position) -> int:
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def _between(a: Position, b: Position, p: Position) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(a: Position, b: Position, c: Position, d: Position) -> bool:
    """Whether two segments have a point in common."""
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if t1 != t2 and t3 != t4:
        return True
    return t1 == 0 and _between(a, b, c) or t2 == 0 and _between(a, b, d) or t3 == 0 and _between(c, d, a) or t4 == 0 and _between(c, d, b)


def _on_line(line: Sequence[Position], p: Position) -> bool:
    return any(_turn(a, b, p) == 0 and _between(a, b, p) for a, b in zip(line, line[1:], strict=False))


def _in_ring(ring: Sequence[Position], p: Position) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:], strict=False):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _in_polygon(rings: Sequence[Sequence[Position]], p: Position) -> bool:
    """Inside or on the border."""
    if any(_on_line(r, p) for r in rings):
        return True
    return _in_ring(rings[0], p) and not any(_in_ring(r, p) for r in rings[1:])


def _lines(part: Part) -> list[Sequence[Position]]:
    return [] if part[0] == "point" else [part[1]] if part[0] == "line" else part[1]


def _meet(a: Part, b: Part) -> bool:
    if a[0] == "point" and b[0] == "point":
        return a[1][:2] == b[1][:2]
    for p, other in ((a, b), (b, a)):
        at = p[1] if p[0] == "point" else p[1][0] if p[0] == "line" else p[1][0][0]
        if other[0] == "polygon" and _in_polygon(other[1], at) or p[0] == "point" and other[0] == "line" and _on_line(other[1], at):
            return True
    return any(_cross(s, t, u, v) for x in _lines(a) for s, t in zip(x, x[1:], strict=False) for y in _lines(b) for u, v in zip(y, y[1:], strict=False))


def intersects(a: Sequence[Part], b: Sequence[Part]) -> bool:
    """Whether two geometries have a point in common; collections by their members."""
    (ax, ay, ax2, ay2), (bx, by, bx2, by2) = extent(a), extent(b)
    if ax > bx2 or bx > ax2 or ay > by2 or by > ay2:
        return False
    return any(_meet(p, q) for p in a for q in b)


def intersects_column(geometry: Column, query: str) -> Column:
    """Whether each GeoJSON text intersects the query geometry; unreadable ones do not."""
    import pandas as pd

    wanted = read(query)
    if wanted is None:
        raise ValueError("the query is no geometry")

    @F.pandas_udf("boolean")
    def test(texts):
        return pd.Series([(g := read(t)) is not None and intersects(g, wanted) for t in texts], dtype=bool)

    return test(geometry)


def to_binary(geometry: Column) -> Column:
    """GeoJSON text as it is stored: its bytes; null where the text is no geometry."""
    return F.when(F.get_json_object(geometry, "$.type").isNotNull(), F.encode(geometry, "utf-8"))


def from_binary(stored: Column) -> Column:
    """Stored geometry bytes as GeoJSON text, without a byte order mark."""
    return F.regexp_replace(F.decode(stored, "utf-8"), "^\uFEFF", "")


def pair_intersects(left: Column, right: Column) -> Column:
    """Row by row; a text that many rows of a batch have is read once."""
    import pandas as pd

    @F.pandas_udf("boolean")
    def test(a, b):
        known = functools.cache(read)
        return pd.Series([(x := known(s)) is not None and (y := known(t)) is not None and intersects(x, y) for s, t in zip(a, b, strict=True)], dtype=bool)

    return test(left, right)
