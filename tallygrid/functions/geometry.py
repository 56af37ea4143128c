"""Places of a request: points, lines and polygons in degrees, read when the plan is made, and the nearness of stored points.

Shapes come as a pair of numbers, as well-known text or as GeoJSON, a dict or text. Their edges become one constant array, so the distance
of a row is one expression whatever their number; a box around the shape comes first and reaches the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
EDGES = "array<struct<x:double,y:double,dx:double,dy:double>>"
# The types of shapes, and how deep the lists of their points are.
DEPTHS = {"POINT": 0, "LINESTRING": 1, "MULTIPOINT": 1, "POLYGON": 2, "MULTILINESTRING": 2, "MULTIPOLYGON": 3}

_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


@dataclass
class Shape:
    """Edges are pairs of points, a lone point being an edge from itself to itself; ``rings`` are the closed lines of polygons."""

    edges: list[tuple[Point, Point]] = field(default_factory=list)
    rings: list[list[Point]] = field(default_factory=list)

    def add(self, kind: str, points) -> None:
        if kind == "POINT":
            self.edges.append((_point(points), _point(points)))
        elif kind == "LINESTRING":
            line = [_point(p) for p in points]
            if len(line) < 2:
                raise ValueError("a line has two points or more")
            self.edges += pairwise(line)
        elif kind == "POLYGON":
            if not points:
                raise ValueError("a polygon has a ring")
            for ring in points:
                ring = [_point(p) for p in ring]
                if len(ring) < 4 or ring[0] != ring[-1]:
                    raise ValueError("a ring has four points or more and ends where it begins")
                self.rings.append(ring)
                self.edges += pairwise(ring)
        else:
            if not points:
                raise ValueError("a shape without points")
            for part in points:
                self.add(kind.removeprefix("MULTI"), part)


def _point(numbers) -> Point:
    try:
        lon, lat = (float(v) for v in numbers)
    except (TypeError, ValueError) as error:
        raise ValueError("a place is a pair of numbers, longitude and latitude") from error
    return lon, lat


def _tokens(text: str) -> Iterator[str]:
    at = 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"not a shape: {text!r}")
        yield found.group(1)
        at = found.end()


def _lists(tokens: list[str], depth: int):
    """The numbers of a bracket, in lists of so much depth; points are without brackets of their own, or with them."""
    if not tokens or tokens.pop(0) != "(":
        raise ValueError("a bracket is missing")
    if depth == 0:
        found = []
        while tokens and tokens[0] not in "(),":
            found.append(tokens.pop(0))
    else:
        found = []
        while True:
            if depth == 1 and tokens and tokens[0] != "(":
                point = []
                while tokens and tokens[0] not in "(),":
                    point.append(tokens.pop(0))
                found.append(point)
            else:
                found.append(_lists(tokens, depth - 1))
            if not tokens or tokens[0] != ",":
                break
            tokens.pop(0)
    if not tokens or tokens.pop(0) != ")":
        raise ValueError("a bracket is missing")
    return found


def shape_of(value) -> Shape:
    """The shape of a pair, of GeoJSON or of well-known text."""
    found = Shape()
    if isinstance(value, str) and value.lstrip().startswith("{"):
        try:
            value = json.loads(value)
        except ValueError as error:
            raise ValueError(f"not a shape: {value!r}") from error
    if isinstance(value, dict):
        kind, points = str(value.get("type", "")).upper(), value.get("coordinates")
        if kind not in DEPTHS or points is None:
            raise ValueError(f"no such shape: {value.get('type')!r}")
        found.add(kind, points)
    elif isinstance(value, str):
        tokens = list(_tokens(value))
        kind = tokens.pop(0).upper() if tokens else ""
        if kind not in DEPTHS:
            raise ValueError(f"no such shape: {value!r}")
        found.add(kind, _lists(tokens, DEPTHS[kind]))
        if tokens:
            raise ValueError(f"not a shape: {value!r}")
    else:
        found.add("POINT", value)
    return found


def _constant(edges: list[tuple[Point, Point]]) -> Column:
    rows = [{"x": a[0], "y": a[1], "dx": b[0] - a[0], "dy": b[1] - a[1]} for a, b in edges]
    return F.from_json(F.lit(json.dumps(rows)), EDGES)


def near(column: Column, shape: Shape, limit: float) -> Column:
    """Whether a point ``(lon, lat)`` is less than so many degrees from the shape; within a polygon the distance is 0."""
    lon, lat = column["lon"], column["lat"]
    xs, ys = zip(*[point for edge in shape.edges for point in edge])
    box = ((lon >= min(xs) - limit) & (lon <= max(xs) + limit) & (lat >= min(ys) - limit) & (lat <= max(ys) + limit))

    def close(edge: Column) -> Column:
        across, along = lon - edge["x"], lat - edge["y"]
        length = edge["dx"] * edge["dx"] + edge["dy"] * edge["dy"]
        part = F.coalesce(F.try_divide(across * edge["dx"] + along * edge["dy"], length), F.lit(0.0))
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
        return F.hypot(across - part * edge["dx"], along - part * edge["dy"]) < limit

    found = F.exists(_constant(shape.edges), close)
    if shape.rings:
        sides = _constant([edge for ring in shape.rings for edge in pairwise(ring)])

        def crossed(edge: Column) -> Column:
            at = edge["x"] + F.try_divide(edge["dx"] * (lat - edge["y"]), edge["dy"])
            return ((edge["y"] > lat) != (edge["y"] + edge["dy"] > lat)) & F.coalesce(lon < at, F.lit(False))

        # A ray from a point within crosses an odd number of sides, those of holes included.
        found = found | (F.size(F.filter(sides, crossed)) % 2 == 1)
    return box & found
