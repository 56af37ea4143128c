"""Shapes of requests and the nearness of stored points, against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallygrid.checks.queries import LINE, POLYGON
from tallygrid.functions.geometry import near, shape_of
from tallygrid.functions.predicates import Spec, per_table


def apart(p, a, b):
    (x, y), (dx, dy) = (p[0] - a[0], p[1] - a[1]), (b[0] - a[0], b[1] - a[1])
    size = dx * dx + dy * dy
    t = max(0, min(1, (x * dx + y * dy) / size)) if size else 0
    return math.hypot(x - t * dx, y - t * dy)


def within(p, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def distance(p, edges, polygons=()):
    """Polygons are an outer ring and its holes."""
    if any(within(p, outer) and not any(within(p, hole) for hole in holes) for outer, *holes in polygons):
        return 0
    return min(apart(p, a, b) for a, b in edges)


def edges_of(*lines):
    return [edge for line in lines for edge in zip(line, line[1:])]


SQUARE, HOLE = [(1, 1), (5, 1), (5, 5), (1, 5), (1, 1)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
BENT, FAR = [(0, 0), (3, 1), (3, 1), (6, 0)], [(8, 8), (9, 8), (9, 9), (8, 8)]
SHAPES = [
    ("point ( 1.5 -2e0)", [((1.5, -2), (1.5, -2))], []),
    ([1.5, -2], [((1.5, -2), (1.5, -2))], []),
    ("LINESTRING(0 0, 3 1,3 1,6 0)", edges_of(BENT), []),
    ("MULTIPOINT (1 1, 2.5 2)", [((1, 1), (1, 1)), ((2.5, 2), (2.5, 2))], []),
    ("MULTIPOINT ((1 1), (2.5 2))", [((1, 1), (1, 1)), ((2.5, 2), (2.5, 2))], []),
    ("MultiLineString ((0 0, 3 1, 3 1, 6 0), (8 8, 9 8, 9 9, 8 8))", edges_of(BENT, FAR), []),
    ("POLYGON ((1 1, 5 1, 5 5, 1 5, 1 1), (2 2, 4 2, 4 4, 2 4, 2 2))", edges_of(SQUARE, HOLE), [(SQUARE, HOLE)]),
    ({"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [FAR]]}, edges_of(SQUARE, HOLE, FAR), [(SQUARE, HOLE), (FAR,)]),
    ('{"type": "LineString", "coordinates": [[0, 0], [3, 1], [6, 0]]}', edges_of([(0, 0), (3, 1), (6, 0)]), []),
]


@pytest.mark.parametrize("value, edges, polygons", SHAPES)
def test_nearness_is_that_of_plain_geometry(spark, value, edges, polygons):
    rng = random.Random(3)
    points = [(rng.uniform(-2, 11), rng.uniform(-3, 11)) for _ in range(800)] + [(3.0, 3.0), (1.0, 1.0), (1.5, 1.5), (2.0, 3.0)]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(points)] + [(9999, None)], "id int, place struct<lon:double,lat:double>")
    found = {r.id for r in frame.where(near(F.col("place"), shape_of(value), 0.7)).collect()}
    expected = {i for i, p in enumerate(points) if distance(p, edges, polygons) < 0.7}
    assert found == expected and 0 < len(found) < len(points)


@pytest.mark.parametrize("value", [
    "CIRCLE (1 2)", "POINT (1 2", "POINT 1 2", "LINESTRING (1 1)", "POLYGON ((0 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 1))",
    "POINT (1 2) 3", "POINT (1 x)", "POINT (1 2 3)", "", "MULTIPOINT ()", {"type": "Point"}, {"coordinates": [1, 2]}, "{", (1,), None, 7, ("a", 1),
])
def test_bad_shapes(value):
    with pytest.raises(ValueError):
        shape_of(value)


def test_the_box_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "struct(id / 10.0D lon, id / 20.0D lat) place").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for value in (LINE, POLYGON, (0.5, 0.25)):
        found = stored.where(per_table({"place": Spec("geometry")}, {"place": value})[""])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(place.lon" in plan and "Python" not in plan
    assert [r.id for r in found.collect()] == [5]


def test_many_edges_are_one_expression(spark):
    circle = [[math.cos(2 * math.pi * (i % 5000) / 5000), math.sin(2 * math.pi * (i % 5000) / 5000)] for i in range(5001)]
    frame = spark.createDataFrame([((0.5, 0.5),), ((1.0, 1.0),), ((1.0005, 0.0),)], "place struct<lon:double,lat:double>")
    condition = per_table({"place": Spec("geometry")}, {"place": {"type": "Polygon", "coordinates": [circle]}})[""]
    assert [tuple(r.place) for r in frame.where(condition).collect()] == [(0.5, 0.5), (1.0005, 0.0)]


def test_errors_name_bad_shapes():
    with pytest.raises(ValueError, match="shape"):
        per_table({"place": Spec("geometry")}, {"place": "CIRCLE (1 1)"})
