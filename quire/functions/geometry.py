"""Points, rectangles and 2x3 affine matrices as struct columns.

A rectangle is struct<left, top, right, bottom>, closed on all sides unless said otherwise; a matrix is
struct<a, b, c, d, e, f> acting on row vectors: x' = a x + c y + e, y' = b x + d y + f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("left", "top", "right", "bottom")
CELLS = ("a", "b", "c", "d", "e", "f")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: without this, nested matrices would copy their terms again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"]


def cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - p["y"] * q["x"]


def lerp(p: Column, q: Column, t) -> Column:
    return point(p["x"] + (q["x"] - p["x"]) * _c(t), p["y"] + (q["y"] - p["y"]) * _c(t))


def unit(p: Column) -> Column:
    """Of length 1; the zero vector stays."""
    n = F.hypot(p["x"], p["y"])
    return F.when(n == 0, p).otherwise(point(p["x"] / n, p["y"] / n))


def rect(left, top, right, bottom) -> Column:
    return F.struct(*[_c(v).cast("double").alias(n) for n, v in zip(EDGES, (left, top, right, bottom), strict=True)])


def rect_from_size(left, top, width, height) -> Column:
    return rect(left, top, _c(left) + _c(width), _c(top) + _c(height))


def normalized(r: Column) -> Column:
    return rect(F.least(r["left"], r["right"]), F.least(r["top"], r["bottom"]), F.greatest(r["left"], r["right"]), F.greatest(r["top"], r["bottom"]))


def width(r: Column) -> Column:
    return r["right"] - r["left"]


def height(r: Column) -> Column:
    return r["bottom"] - r["top"]


def center(r: Column) -> Column:
    return point((r["left"] + r["right"]) / 2, (r["top"] + r["bottom"]) / 2)


def inflated(r: Column, dx, dy) -> Column:
    return rect(r["left"] - _c(dx), r["top"] - _c(dy), r["right"] + _c(dx), r["bottom"] + _c(dy))


def shifted(r: Column, dx, dy) -> Column:
    return rect(r["left"] + _c(dx), r["top"] + _c(dy), r["right"] + _c(dx), r["bottom"] + _c(dy))


def contains(r: Column, x, y) -> Column:
    return _c(x).between(r["left"], r["right"]) & _c(y).between(r["top"], r["bottom"])


def contains_half_open(r: Column, x, y) -> Column:
    return (_c(x) >= r["left"]) & (_c(x) < r["right"]) & (_c(y) >= r["top"]) & (_c(y) < r["bottom"])


def contains_rect(r: Column, s: Column) -> Column:
    return (r["left"] <= s["left"]) & (r["top"] <= s["top"]) & (r["right"] >= s["right"]) & (r["bottom"] >= s["bottom"])


def intersects(r: Column, s: Column) -> Column:
    """Strict overlap: touching edges don't count."""
    return (r["left"] < s["right"]) & (s["left"] < r["right"]) & (r["top"] < s["bottom"]) & (s["top"] < r["bottom"])


def intersection(r: Column, s: Column) -> Column:
    """Null if they don't overlap."""
    both = rect(F.greatest(r["left"], s["left"]), F.greatest(r["top"], s["top"]), F.least(r["right"], s["right"]), F.least(r["bottom"], s["bottom"]))
    return F.when(intersects(r, s), both)


def union(r: Column, s: Column) -> Column:
    return rect(F.least(r["left"], s["left"]), F.least(r["top"], s["top"]), F.greatest(r["right"], s["right"]), F.greatest(r["bottom"], s["bottom"]))


def union_agg(r: Column) -> Column:
    """Aggregate: the bounding box of rectangles; four built-in aggregates."""
    return F.struct(F.min(r["left"]).alias("left"), F.min(r["top"]).alias("top"), F.max(r["right"]).alias("right"), F.max(r["bottom"]).alias("bottom"))


def bounds_agg(x: Column, y: Column) -> Column:
    """Aggregate: the bounding box of points."""
    return F.struct(F.min(x).alias("left"), F.min(y).alias("top"), F.max(x).alias("right"), F.max(y).alias("bottom"))


def bounds_of_points(points: Column) -> Column:
    """Of array<struct<x, y>>; null if empty."""

    def bounds(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return F.when(F.size(points) > 0, rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))

    return let(points, bounds)


def outward(r: Column) -> Column:
    """To whole numbers, floor and ceiling."""
    return F.struct(F.floor(r["left"]).alias("left"), F.floor(r["top"]).alias("top"), F.ceil(r["right"]).alias("right"), F.ceil(r["bottom"]).alias("bottom"))


def quad(r: Column) -> Column:
    """Corners: top left, top right, bottom left, bottom right."""
    return F.array(point(r["left"], r["top"]), point(r["right"], r["top"]), point(r["left"], r["bottom"]), point(r["right"], r["bottom"]))


def matrix(a=1.0, b=0.0, c=0.0, d=1.0, e=0.0, f=0.0) -> Column:
    return F.struct(*[_c(v).cast("double").alias(n) for n, v in zip(CELLS, (a, b, c, d, e, f), strict=True)])


def translation(dx, dy) -> Column:
    return matrix(e=dx, f=dy)


def scaling(sx, sy) -> Column:
    return matrix(a=sx, d=sy)


def rotation(degrees) -> Column:
    t = F.radians(_c(degrees))
    return matrix(F.cos(t), F.sin(t), -F.sin(t), F.cos(t))


def skewing(x_degrees, y_degrees) -> Column:
    return matrix(b=F.tan(F.radians(_c(y_degrees))), c=F.tan(F.radians(_c(x_degrees))))


def reflection(degrees) -> Column:
    """In the line through the origin at this angle."""
    t = F.radians(2 * _c(degrees))
    return matrix(F.cos(t), F.sin(t), F.sin(t), -F.cos(t))


def shearing(x, y) -> Column:
    """By factors, where ``skewing`` takes angles."""
    return matrix(b=y, c=x)


def parallelogram(p, q, r) -> Column:
    """The map of the unit square to a parallelogram: (0, 0) to p, (1, 0) to q, (1, 1) to r (points)."""
    return matrix(q["x"] - p["x"], q["y"] - p["y"], r["x"] - q["x"], r["y"] - q["y"], p["x"], p["y"])


def between_parallelograms(source: tuple, target: tuple) -> Column:
    """The map of one parallelogram (three points, as above) to another; null if the first has no area."""
    return multiply(inverse(parallelogram(*source)), parallelogram(*target))


def rounded_away(x) -> Column:
    """To the nearest whole number, halves away from zero."""
    x = _c(x)
    return F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)).cast("long")


def saturated(x, limit) -> Column:
    """Rounded as by ``rounded_away``, and kept within the limit on both sides."""
    x, limit = _c(x), _c(limit)
    return F.when(x < -limit, -limit).when(x > limit, limit).otherwise(rounded_away(x)).cast("long")


def multiply_one(a, b, bits: int) -> Column:
    """Product of two numbers of so many bits, of which the greatest stands for one."""
    q = _c(a).cast("long") * _c(b).cast("long") + (1 << (bits - 1))
    return F.shiftright(q + F.shiftright(q, bits), bits)


def nearly(x, y, epsilon) -> Column:
    """Equal but for a share of one plus the size; of unlike signs, both within epsilon of zero."""
    x, y = _c(x), _c(y)
    unlike = (x < 0) != (y < 0)
    return F.when(unlike, (F.abs(x) < epsilon) & (F.abs(y) < epsilon)).otherwise(F.abs(x - y) < epsilon * (1 + F.abs(x)))


def touches(r: Column, s: Column) -> Column:
    """Overlap where common edges count, as ``intersects`` doesn't."""
    return (r["left"] <= s["right"]) & (s["left"] <= r["right"]) & (r["top"] <= s["bottom"]) & (s["top"] <= r["bottom"])


def meet(r: Column, s: Column) -> Column:
    """What both have; inverted if they lie apart, where ``intersection`` is null."""
    return rect(F.greatest(r["left"], s["left"]), F.greatest(r["top"], s["top"]), F.least(r["right"], s["right"]), F.least(r["bottom"], s["bottom"]))


def clipped(r: Column, s: Column) -> Column:
    """The part of the first within the second; null if they don't even touch."""
    return F.when(touches(r, s), meet(r, s))


def _product(m: Column, n: Column) -> Column:
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def multiply(m: Column, n: Column) -> Column:
    """Applies ``m`` first, then ``n``."""
    return let(F.struct(m.alias("m"), n.alias("n")), lambda p: _product(p["m"], p["n"]))


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def inverse(m: Column) -> Column:
    """Null if the determinant is within 1e-10 of zero."""

    def inverted(m: Column) -> Column:
        k = determinant(m)
        made = matrix(m["d"] / k, -m["b"] / k, -m["c"] / k, m["a"] / k, (m["c"] * m["f"] - m["d"] * m["e"]) / k, (m["b"] * m["e"] - m["a"] * m["f"]) / k)
        return F.when(F.abs(k) > 1e-10, made)

    return let(m, inverted)


def transform_point(m: Column, x, y) -> Column:
    x, y = _c(x), _c(y)
    return let(m, lambda m: point(m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]))


def transform_vector(m: Column, x, y) -> Column:
    x, y = _c(x), _c(y)
    return point(m["a"] * x + m["c"] * y, m["b"] * x + m["d"] * y)


def transform_rect(m: Column, r: Column) -> Column:
    """The bounding box of the four corners."""
    return bounds_of_points(F.transform(quad(r), lambda p: transform_point(m, p["x"], p["y"])))


def unit_box(m: Column, device: Column | None = None) -> Column:
    """The box that an image takes: the unit square under its matrix, and then under the device's."""
    return transform_rect(m if device is None else multiply(m, device), rect(0, 0, 1, 1))


def decomposed(m: Column) -> Column:
    """struct<x_unit, y_unit, rotation>; rotation in radians."""
    return F.struct(F.hypot(m["a"], m["b"]).alias("x_unit"), F.hypot(m["c"], m["d"]).alias("y_unit"), F.atan2(m["b"], m["a"]).alias("rotation"))


def display_matrix(box: Column, device_width, device_height, quarter_turns) -> Column:
    """Page space, y up, to device pixels, y down: one scale for both axes that makes the turned page fit; quarter turns clockwise."""
    w, h, q = width(box), height(box), F.pmod(_c(quarter_turns), F.lit(4))
    turned = q % 2 == 1
    s = F.least(_c(device_width) / F.when(turned, h).otherwise(w), _c(device_height) / F.when(turned, w).otherwise(h))
    home = translation(-box["left"], -box["top"])

    def placed(a, b, c, d, e, f) -> Column:
        return multiply(home, matrix(a, b, c, d, e, f))

    upright, right, down, left = placed(s, 0, 0, -s, 0, h * s), placed(0, s, s, 0, 0, 0), placed(-s, 0, 0, s, w * s, 0), placed(0, -s, -s, 0, h * s, w * s)
    return F.when(q == 0, upright).when(q == 1, right).when(q == 2, down).otherwise(left)


def triangle_contains(x1, y1, x2, y2, x3, y3, x, y) -> Column:
    """Whether a point is on the same side of all three edges."""

    def side(ax, ay, bx, by) -> Column:
        return ((_c(x) - _c(bx)) * (_c(by) - _c(ay)) - (_c(y) - _c(by)) * (_c(bx) - _c(ax))) < 0

    one, two, three = side(x1, y1, x2, y2), side(x2, y2, x3, y3), side(x3, y3, x1, y1)
    return (one == two) & (two == three)


def segments_cross(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    def side(ax, ay, bx, by, px, py) -> Column:
        return ((_c(px) - _c(bx)) * (_c(by) - _c(ay)) - (_c(py) - _c(by)) * (_c(bx) - _c(ax))) < 0

    return (side(x1, y1, x2, y2, x3, y3) != side(x1, y1, x2, y2, x4, y4)) & (side(x3, y3, x4, y4, x1, y1) != side(x3, y3, x4, y4, x2, y2))


def point_line_distance(x1, y1, x2, y2, x, y) -> Column:
    """Signed; the distance to the first point if the line is one."""
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    n = F.hypot(dx, dy)
    return F.when(n == 0, F.hypot(_c(x) - _c(x1), _c(y) - _c(y1))).otherwise(((_c(x) - _c(x2)) * dy - (_c(y) - _c(y2)) * dx) / n)


def triangle_area(x1, y1, x2, y2, x3, y3) -> Column:
    return (_c(x1) * _c(y2) - _c(x2) * _c(y1) + _c(x2) * _c(y3) - _c(x3) * _c(y2) + _c(x3) * _c(y1) - _c(x1) * _c(y3)) / 2


def polygon_area(points: Column) -> Column:
    """Signed area of array<struct<x, y>> by the shoelace formula; the last point joins the first."""
    n = F.size(points)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + cross(F.get(points, k), F.get(points, (k + 1) % n))) / 2


def fixed_from_double(x, bits: int = 16) -> Column:
    return F.round(_c(x) * (1 << bits)).cast("long")


def fixed_multiply(a, b, bits: int = 16) -> Column:
    """Product of two fixed-point numbers, rounded half away from zero."""
    p = _c(a).cast("long") * _c(b).cast("long")
    half = F.lit(1 << (bits - 1))
    return F.signum(p.cast("double")).cast("long") * F.shiftright(F.abs(p) + half, bits)


def fixed_divide(a, b, bits: int = 16) -> Column:
    """Quotient of two fixed-point numbers, rounded half away from zero; the greatest number if the divisor is zero."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    size = F.shiftright(F.shiftleft(F.abs(a), bits + 1) + F.abs(b), 1)
    quotient = F.floor(size / F.abs(b)).cast("long")
    return F.when(b == 0, F.lit(0x7FFFFFFF).cast("long")).otherwise(F.signum(a.cast("double")).cast("long") * F.signum(b.cast("double")).cast("long") * quotient)


def snapped(x, unit_bits: int = 6, how: str = "round") -> Column:
    """A 26.6 number brought to whole pixels: the nearest one, or the one below (floor) or above (ceil)."""
    one = 1 << unit_bits
    more = {"round": one // 2, "floor": 0, "ceil": one - 1}[how]
    return F.shiftleft(F.shiftright(_c(x).cast("long") + more, unit_bits), unit_bits)


def fixed_transform(xx, xy, yx, yy, x, y) -> Column:
    """struct<x, y>: a vector under a matrix of 16.16 numbers."""
    return F.struct((fixed_multiply(xx, x) + fixed_multiply(xy, y)).alias("x"), (fixed_multiply(yx, x) + fixed_multiply(yy, y)).alias("y"))


def fixed_inverse(xx, xy, yx, yy) -> Column:
    """struct<xx, xy, yx, yy>: the inverse of a matrix of 16.16 numbers; null if it has none."""
    k = fixed_multiply(xx, yy) - fixed_multiply(xy, yx)

    def over(k: Column) -> Column:
        cells = (fixed_divide(yy, k), -fixed_divide(xy, k), -fixed_divide(yx, k), fixed_divide(xx, k))
        return F.when(k != 0, F.struct(*[c.alias(n) for c, n in zip(cells, ("xx", "xy", "yx", "yy"), strict=True)]))

    return let(k, over)
