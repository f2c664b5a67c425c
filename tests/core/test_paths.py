"""Paths: bounds and coverage against plain arithmetic; hits along a row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import paths, raster

SCHEMA = "doc_id long, page_index int, seq int, type string, matrix struct<a:double,b:double,c:double,d:double,e:double,f:double>, segments array<struct<op:string,pts:array<double>>>"
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def table(spark, shapes, matrix=UNIT):
    return spark.createDataFrame([(1, 0, k, "path", matrix, s) for k, s in enumerate(shapes)], SCHEMA)


def polygon(points):
    return [("m", list(points[0]))] + [("l", list(p)) for p in points[1:]]


def shoelace(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def test_segments_of_odd_paths(spark):
    shapes = [
        [("l", [1.0, 1.0])], [("h", [])], [("m", [1.0])], [], [("m", [0.0, 0.0]), ("l", [4.0, 0.0]), ("h", []), ("l", [0.0, 9.0])],
        [("m", [0.0, 0.0]), ("v", [1.0, 2.0, 3.0, 0.0]), ("y", [4.0, 5.0, 6.0, 0.0])], [("m", [0.0, 0.0]), ("l", [1.0, 1.0]), ("m", [5.0, 5.0]), ("l", [6.0, 6.0]), ("h", [])],
    ]
    got = {}
    for r in paths.segments(table(spark, shapes)).orderBy("seq", "k").collect():
        got.setdefault(r.seq, []).append((r.op, *[round(r[f"{a}{i}"], 6) for i in range(4) for a in "xy"]))
    assert got == {
        4: [("l", 0, 0, 0, 0, 4, 0, 4, 0), ("h", 4, 0, 4, 0, 0, 0, 0, 0), ("l", 0, 0, 0, 0, 0, 9, 0, 9)],
        5: [("v", 0, 0, 0, 0, 1, 2, 3, 0), ("y", 3, 0, 4, 5, 6, 0, 6, 0)],
        6: [("l", 0, 0, 0, 0, 1, 1, 1, 1), ("l", 5, 5, 5, 5, 6, 6, 6, 6), ("h", 6, 6, 6, 6, 5, 5, 5, 5)],
    }


def test_bounds_of_curves(spark):
    r = random.Random(1)
    shapes = [[("m", [r.uniform(-9, 9), r.uniform(-9, 9)]), ("c", [r.uniform(-9, 9) for _ in range(6)])] for _ in range(60)]
    shapes += [[("m", [0.0, 0.0]), ("c", [1.0, 1.0, 2.0, 2.0, 3.0, 3.0])], [("m", [0.0, 0.0]), ("c", [0.0, 4.0, 0.0, 4.0, 0.0, 0.0])], [("m", [2.0, 2.0]), ("c", [2.0] * 6)], [("m", [0.0, 0.0]), ("c", [1.0, 0.0, 1.0, 0.0, 0.0, 5.0])]]
    boxes = {x.seq: x.box for x in paths.exact_bounds(table(spark, shapes)).collect()}
    for k, s in enumerate(shapes):
        p = [*s[0][1], *s[1][1]]
        for axis, names in ((0, ("left", "right")), (1, ("top", "bottom"))):
            v = [sum(c * t**i * (1 - t) ** (3 - i) * w for i, (c, w) in enumerate(zip(p[axis::2], (1, 3, 3, 1), strict=True))) for t in (n / 4000 for n in range(4001))]
            assert math.isclose(boxes[k][names[0]], min(v), abs_tol=1e-4) and math.isclose(boxes[k][names[1]], max(v), abs_tol=1e-4)


@pytest.mark.parametrize("matrix", [UNIT, (0.0, 2.0, -1.0, 0.5, 3.0, -4.0)])
def test_areas(spark, matrix):
    r = random.Random(2)
    shapes = [[(r.uniform(-30, 30), r.uniform(-30, 30)) for _ in range(r.randrange(3, 8))] for _ in range(40)]
    found = paths.cells(paths.edges(table(spark, [polygon(s) for s in shapes], matrix)))
    areas = {x.seq: x.area for x in paths.filled_area(found).collect()}
    by_span = {x.seq: x.a for x in paths.spans(found).groupBy("seq").agg((F.sum(F.col("n") * F.col("units")) / 131072).alias("a")).collect()}
    a, b, c, d, e, f = matrix
    for k, s in enumerate(shapes):
        moved = [(a * x + c * y + e, b * x + d * y + f) for x, y in s]
        assert math.isclose(abs(areas[k]), abs(shoelace(moved)), abs_tol=1.0) and math.isclose(areas[k], by_span[k], abs_tol=1e-9)


def test_coverage_of_pixels(spark):
    box = polygon([(1.25, 1.5), (4.0, 1.5), (4.0, 3.25), (1.25, 3.25)])
    found = {(x.y, x.x + i): x.units / 131072 for x in paths.spans(paths.cells(paths.edges(table(spark, [box])))).collect() for i in range(x.n)}
    expected = {}
    for y in range(5):
        for x in range(6):
            part = max(0.0, min(x + 1, 4.0) - max(x, 1.25)) * max(0.0, min(y + 1, 3.25) - max(y, 1.5))
            if part:
                expected[y, x] = part
    assert {k: abs(v) for k, v in found.items()} == expected
    circle = [("m", [30.0, 10.0]), ("c", [30.0, 21.0457, 21.0457, 30.0, 10.0, 30.0]), ("c", [-1.0457, 30.0, -10.0, 21.0457, -10.0, 10.0]), ("c", [-10.0, -1.0457, -1.0457, -10.0, 10.0, -10.0]), ("c", [21.0457, -10.0, 30.0, -1.0457, 30.0, 10.0])]
    assert math.isclose(abs(paths.filled_area(paths.cells(paths.edges(table(spark, [circle])))).first().area), math.pi * 400, rel_tol=3e-3)


def test_hits_and_empty_tables(spark):
    r = random.Random(3)
    cells = [(r.randrange(3), r.randrange(3), r.randrange(8), r.randrange(-2, 3)) for _ in range(100)]
    points = [(r.randrange(4), r.randrange(4), r.randrange(-1, 10), k) for k in range(80)] + [(0, 0, 3, 1), (0, 0, 3, 1)]
    c, p = spark.createDataFrame(cells, "img_id long, y int, x int, cover int"), spark.createDataFrame(points, "img_id long, y int, x int, more int")
    got = sorted(tuple(x) for x in raster.hit_test(c, p).collect())
    assert got == sorted((i, y, x, m, sum(v for j, b, a, v in cells if (j, b) == (i, y) and a <= x) != 0) for i, y, x, m in points)
    none = table(spark, [])
    assert paths.exact_bounds(none).count() == paths.spans(paths.cells(paths.edges(none))).count() == 0
