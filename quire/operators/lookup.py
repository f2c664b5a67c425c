"""Lookups as joins: ranges, pairs, overlaps, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


RADIX, TOP = 4, 12  # bits a level, levels: blocks of level n hold 16^n buckets


def _shift(x: Column, level: Column, up: bool = False) -> Column:
    """Blocks of a level: of the bucket x, or of the first one that begins at x or later."""
    bits = level * RADIX
    return F.call_function("shiftright", x + (F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1 if up else 0), bits)


def pieces(low: Column, high: Column) -> Column:
    """array<struct<level, block>>: the fewest blocks that make up the buckets from low to high (bigint, both included); at most 30 a level below the last."""

    def of(level: Column) -> Column:
        a, b, up_a, up_b = _shift(low, level, True), _shift(high + 1, level), _shift(low, level + 1, True), _shift(high + 1, level + 1)
        inner = (up_a < up_b) & (level < TOP)  # whole blocks of the next level are left to it

        def blocks(start: Column, end: Column) -> Column:
            some = F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(some, lambda k: F.struct(level.alias("level"), k.alias("block")))

        return F.when(inner, F.concat(blocks(a, F.shiftleft(up_a, RADIX)), blocks(F.shiftleft(up_b, RADIX), b))).otherwise(blocks(a, b))

    levels = F.when(low <= high, F.sequence(F.lit(0), F.lit(TOP))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(levels, of))


def _blocked(points: DataFrame, bucket: Column, levels: list[int]) -> DataFrame:
    of = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(bucket, RADIX * n).alias("block")) for n in levels]) if levels else F.array().cast("array<struct<level:int,block:bigint>>")
    return points.select("*", F.inline(of))


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, step: float, keys: tuple[str, ...] = (), hot: int = 1_000_000) -> DataFrame:
    """Rows of ``points`` with the ranges (of the same ``keys``) that hold their value, both ends included; a null value or end matches nothing.

    Values fall into buckets of width ``step``; a range is cut into few blocks of buckets, whose sizes are powers of 16, so that one over all values is a few
    rows too, and a point asks for its block of each size that occurs (a small aggregate of the ranges, 16 at most): an equi-join that hashes and
    spills. A bucket with more than ``hot`` points is dealt out to several keys, to each of which the ranges over it are copied.
    """
    bucket = lambda c: F.floor(F.col(c) / step).cast("long")
    cut = ranges.select("*", F.inline(pieces(bucket(low), bucket(high))))
    levels = sorted(r.level for r in cut.select("level").distinct().collect())
    placed = points.where(F.col(value).isNotNull()).withColumn("bucket", bucket(value))
    crowded = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).withColumn("salts", F.ceil(F.col("n") / hot).cast("int")).drop("n")
    salted = placed.join(crowded, [*keys, "bucket"], "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.floor(F.rand(7) * F.col("salts")).cast("int")).otherwise(0))
    over = _blocked(crowded, F.col("bucket"), levels).groupBy(*keys, "level", "block").agg(F.max("salts").alias("salts"))
    copied = cut.join(over, [*keys, "level", "block"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    joined = _blocked(salted.drop("salts"), F.col("bucket"), levels).join(copied, [*keys, "level", "block", "salt"])
    return joined.where(F.col(value).between(F.col(low), F.col(high))).drop("bucket", "level", "block", "salt")


def grouped_ranges(points: DataFrame, keys: list[str], value: str, ranges: DataFrame, answer: Column) -> DataFrame:
    """(keys, value, answer) of distinct whole-numbered points that some range (low, high, more columns; the same keys) holds; answer: an aggregate over the ranges."""
    found = range_join(points.distinct(), value, ranges, "low", "high", 1, tuple(keys))
    return found.groupBy(*keys, value).agg(answer)


def overlap_join(left: DataFrame, right: DataFrame, cell: float, cell_y: float | None = None) -> DataFrame:
    """Pairs of rectangles (struct columns ``l`` and ``r``) that overlap strictly.

    A rectangle is of the level whose cells (``cell`` times a power of two) are as wide and high as it, so it touches four of them at most. A pair meets in the
    grid of the coarser one, and is reported in the cell of its overlap's corner: an equi-join whatever the sizes. Each side is copied to the coarser levels that occur.
    cell_y: height of the cells where the axes have different scales, else they are square; cells as high as many rectangles would bring pairs together that lie far apart.
    """
    cell_y = cell if cell_y is None else cell_y

    def level(name: str) -> Column:
        size = F.greatest(F.expr(f"{name}.right - {name}.left") / cell, F.expr(f"{name}.bottom - {name}.top") / cell_y)
        return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1e-300)))).cast("int"))

    found = left.select(level("l").alias("n")).distinct().unionByName(right.select(level("r").alias("n")).distinct()).distinct().where("n IS NOT NULL")
    levels = sorted(r.n for r in found.collect())  # a few hundred powers of two at most

    def cells(df: DataFrame, name: str) -> DataFrame:
        own = df.withColumn(f"{name}_level", level(name))
        at = own.withColumn("grid", F.explode(F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n >= F.col(f"{name}_level"))))

        def span(a: str, b: str, size: float) -> Column:
            """Cells from the first side to the last place before the second one, which no overlap holds; times 1 - 2^-53 is the next number below."""
            width, end = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("grid")), F.col(f"{name}.{b}")
            first = F.floor(F.col(f"{name}.{a}") / width)
            return F.sequence(first, F.greatest(first, F.floor(F.when(end > 0, end * (1 - 2.0**-53)).otherwise(end) / width)))

        return at.withColumn("gx", F.explode(span("left", "right", cell))).withColumn("gy", F.explode(span("top", "bottom", cell_y)))

    both = cells(left, "l").join(cells(right, "r"), ["grid", "gx", "gy"]).where("grid = greatest(l_level, r_level)")
    strict = F.expr("l.left < r.right AND r.left < l.right AND l.top < r.bottom AND r.top < l.bottom")
    scale = F.pow(F.lit(2.0), F.col("grid"))
    corner = (F.col("gx") == F.floor(F.greatest("l.left", "r.left") / (F.lit(float(cell)) * scale))) & (F.col("gy") == F.floor(F.greatest("l.top", "r.top") / (F.lit(float(cell_y)) * scale)))
    return both.where(strict & corner).drop("grid", "gx", "gy", "l_level", "r_level")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the one with the greatest ``order``. A partial aggregate, no sort and no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_")).select(*keys, "_.*")


def unresolved(refs: DataFrame, objects: DataFrame, ref: str, key: str) -> DataFrame:
    """References to objects that don't exist."""
    return refs.join(objects.select(F.col(key).alias(ref)), ref, "left_anti")
