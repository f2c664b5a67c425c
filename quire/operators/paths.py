"""Paths as rows: segments with their start points, exact bounds, edges, coverage cells, spans.

All of it is expressions, ``explode`` and sums by key. Device space is cut into pixels of 256 x 256 units (24.8 fixed point); an edge adds to each cell that it crosses
its height there (``cover``) and twice the area to its left (``area``). Filling is then a running sum along each row, ``raster.coverage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "page_index", "seq"]
#: Straight pieces that a curve is cut into for filling.
PIECES = 16
UNIT = 256


def segments(objects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys, k, sub, op, x0, y0 ... x3, y3: lines and curves (the control points of a cubic) with their start points; ``h`` is a line to its subpath's first point.

    Segments without a current point, or with too few numbers, draw nothing.
    """
    keys = keys or KEYS
    rows = objects.where("type = 'path'").select(*keys, F.posexplode("segments").alias("k", "s")).select(*keys, "k", F.col("s.op").alias("op"), F.col("s.pts").alias("p"))
    n = F.when(F.col("op").isin("m", "l"), 2).when(F.col("op") == "c", 6).when(F.col("op").isin("v", "y"), 4).otherwise(0)
    rows = rows.withColumn("n", n).where(F.size("p") >= F.col("n"))
    end = lambda c: F.when(F.col("n") > 0, F.get("p", F.col("n") - 2 + c))
    along = Window.partitionBy(*keys).orderBy("k")
    rows = rows.withColumns({"ex": end(0), "ey": end(1), "sub": F.sum((F.col("op") == "m").cast("int")).over(along)})
    inside = Window.partitionBy(*keys, "sub").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"fx": F.first("ex", True).over(inside), "fy": F.first("ey", True).over(inside)})
    rows = rows.withColumns({"ex": F.coalesce("ex", "fx"), "ey": F.coalesce("ey", "fy")}).withColumns({"x0": F.lag("ex").over(along), "y0": F.lag("ey").over(along)})
    p, op = (lambda k: F.get("p", F.lit(k))), F.col("op")
    made = {}
    for c, (start, stop) in enumerate((("x0", "ex"), ("y0", "ey"))):
        axis = "xy"[c]
        made[f"{axis}1"] = F.when(op.isin("c", "y"), p(c)).otherwise(F.col(start))
        made[f"{axis}2"] = F.when(op == "c", p(2 + c)).when(op == "v", p(c)).otherwise(F.col(stop))
        made[f"{axis}3"] = F.col(stop)
    return rows.withColumns(made).where("op <> 'm' AND x0 IS NOT NULL AND x3 IS NOT NULL").select(*keys, "k", "sub", "op", *[f"{a}{i}" for i in range(4) for a in "xy"])


def _bezier(p: list[Column], t: Column) -> Column:
    u = 1 - t
    return u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3]


def extremes(p: list[Column]) -> Column:
    """array<double>: a cubic's values at its ends and where its derivative is zero between them."""
    a, b, c = -p[0] + 3 * p[1] - 3 * p[2] + p[3], 2 * (p[0] - 2 * p[1] + p[2]), p[1] - p[0]
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    # The root of the sum that doesn't cancel gives the other one too; a zero leading term leaves the straight derivative's root.
    q = -0.5 * (b + F.when(b < 0, -root).otherwise(root))
    times = F.array(F.try_divide(q, a), F.try_divide(c, q))
    inner = F.filter(times, lambda t: t.isNotNull() & (t > 0) & (t < 1) & (b * b >= 4 * a * c))
    return F.concat(F.array(p[0], p[3]), F.transform(inner, lambda t: _bezier(p, t)))


def exact_bounds(objects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, box) of the curves themselves, not of their control points. A path that draws nothing has no row."""
    keys = keys or KEYS
    found = segments(objects, keys)
    xs, ys = (extremes([F.col(f"{a}{i}") for i in range(4)]) for a in "xy")
    each = found.select(*keys, F.array_min(xs).alias("l"), F.array_min(ys).alias("t"), F.array_max(xs).alias("r"), F.array_max(ys).alias("b"))
    box = F.struct(F.min("l").alias("left"), F.min("t").alias("top"), F.max("r").alias("right"), F.max("b").alias("bottom"))
    return each.groupBy(*keys).agg(box.alias("box"))


def edges(objects: DataFrame, keys: list[str] | None = None, matrix: bool = True) -> DataFrame:
    """(keys, x1, y1, x2, y2) in 1/256 of a device pixel: straight edges of filled paths, curves cut into PIECES, subpaths closed, level ones left out.

    matrix: points go through the row's matrix first.
    """
    keys = keys or KEYS
    found = segments(objects, keys)
    ends = found.groupBy(*keys, "sub").agg(F.min_by(F.struct("x0", "y0"), "k").alias("a"), F.max_by(F.struct("x3", "y3"), "k").alias("b"))
    closing = ends.where("a.x0 <> b.x3 OR a.y0 <> b.y3").select(*keys, F.lit("h").alias("op"), *[F.col(f"b.{a}3").alias(f"{a}0") for a in "xy"], *[F.col(f"b.{a}3").alias(f"{a}1") for a in "xy"],
                                                               *[F.col(f"a.{a}0").alias(f"{a}{i}") for i in (2, 3) for a in "xy"])
    every = found.drop("k", "sub").unionByName(closing)
    if matrix:
        every = every.join(objects.where("type = 'path'").select(*keys, F.col("matrix").alias("m")), keys)
        m = F.col("m")
        moved = {f"{a}{i}": m["a" if a == "x" else "b"] * F.col(f"x{i}") + m["c" if a == "x" else "d"] * F.col(f"y{i}") + m["e" if a == "x" else "f"] for i in range(4) for a in "xy"}
        every = every.select(*keys, "op", *[v.alias(k) for k, v in moved.items()])
    curved = F.col("op").isin("c", "v", "y")
    at = every.withColumn("t", F.explode(F.when(curved, F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))))
    fixed = lambda v: F.floor(v * UNIT + 0.5).cast("long")
    xs, ys = ([F.col(f"{a}{i}") for i in range(4)] for a in "xy")
    out = {}
    for n, t in ((1, F.col("t") / PIECES), (2, (F.col("t") + 1) / PIECES)):
        for a, p in (("x", xs), ("y", ys)):
            out[f"{a}{n}"] = fixed(F.when(curved, _bezier(p, t)).otherwise(p[0] if n == 1 else p[3]))
    return at.select(*keys, *[v.alias(k) for k, v in out.items()]).where("y1 <> y2")


def _between(a: str, b: str, low: Column, high: Column, at: Column) -> Column:
    """The other axis where an edge passes ``at``, rounded: by its ends only, so that neighbouring rows and cells agree."""
    return F.col(a) + F.floor(((at - low) * (F.col(b) - F.col(a))).cast("double") / (high - low) + 0.5).cast("long")


def cells(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, y, x, cover, area) of the cells that edges cross: each edge is cut at rows, and within a row at columns.

    Not summed yet: ``raster.coverage`` does, with partial sums before its shuffle.
    """
    keys = keys or KEYS
    y1, y2 = F.col("y1"), F.col("y2")
    first, last = F.floor(F.least(y1, y2) / UNIT), F.floor((F.greatest(y1, y2) - 1) / UNIT)
    rows = lines.withColumn("y", F.explode(F.sequence(first, last)))
    near = lambda c: F.greatest(F.col("y") * UNIT, F.least((F.col("y") + 1) * UNIT, c))
    rows = rows.withColumns({"ya": near(y1), "yb": near(y2)})
    rows = rows.withColumns({"xa": _between("x1", "x2", y1, y2, F.col("ya")), "xb": _between("x1", "x2", y1, y2, F.col("yb"))})
    xa, xb = F.col("xa"), F.col("xb")
    low, high = F.least(xa, xb), F.greatest(xa, xb)
    left, right = F.floor(low / UNIT), F.floor(F.greatest(high - 1, low) / UNIT)
    cut = rows.withColumn("x", F.explode(F.sequence(left, right)))
    inside = lambda c: F.greatest(F.col("x") * UNIT, F.least((F.col("x") + 1) * UNIT, c))
    cut = cut.withColumns({"ca": inside(xa), "cb": inside(xb)})
    level = lambda c: F.when(xa == xb, F.when(F.lit(c == "ca"), F.col("ya")).otherwise(F.col("yb"))).otherwise(_between("ya", "yb", xa, xb, F.col(c)))
    cut = cut.withColumn("cover", level("cb") - level("ca"))
    area = (F.col("ca") + F.col("cb") - 2 * UNIT * F.col("x")) * F.col("cover")
    return cut.where("cover <> 0").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("cover").cast("long").alias("cover"), area.cast("long").alias("area"))


def spans(crossed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, y, x, n, units): runs of n pixels from x of equal signed coverage, in 1/131072 of a pixel: each crossed cell, and the stretch from it to the row's next one."""
    keys = keys or KEYS
    summed = crossed.groupBy(*keys, "y", "x").agg(F.sum("cover").alias("cover"), F.sum("area").alias("area"))
    along = Window.partitionBy(*keys, "y").orderBy("x")
    total = F.sum("cover").over(along.rowsBetween(Window.unboundedPreceding, 0)) * (2 * UNIT)
    at = summed.withColumns({"full": total, "next": F.lead("x").over(along)})
    runs = F.array(
        F.struct(F.col("x").alias("x"), F.lit(1).alias("n"), (F.col("full") - F.col("area")).alias("units")),
        F.struct((F.col("x") + 1).alias("x"), (F.coalesce("next", F.col("x") + 1) - F.col("x") - 1).cast("int").alias("n"), F.col("full").alias("units")),
    )
    return at.select(*keys, "y", F.inline(runs)).where("n > 0 AND units <> 0")


def filled_area(crossed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, area): signed, in pixels. A partial sum of cells: what a cell's cover adds to its row up to a bound that all rows share cancels out."""
    keys = keys or KEYS
    # Each cell covers what is to its right, so a closed path's sum of -x * cover, less the part left of the edges, is its area.
    units = F.sum(-F.col("area") - F.col("cover") * F.col("x") * (2 * UNIT))
    return crossed.groupBy(*keys).agg((units / (2.0 * UNIT * UNIT)).alias("area"))
