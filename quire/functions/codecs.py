"""Bits, sizes and orders that image formats and vector paths define, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values (PNG specification, interlace method 1): first column, first row, column step, row step of the seven passes.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Path commands and flags of a vertex source.
COMMANDS = {"stop": 0, "move_to": 1, "line_to": 2, "curve3": 3, "curve4": 4, "curve_n": 5, "catrom": 6, "ubspline": 7, "end_poly": 15}
COMMAND_MASK, CCW, CW, CLOSE = 0x0F, 0x10, 0x20, 0x40
#: Render options.
RENDER_FLAGS = {
    "annotations": 0x01, "lcd_text": 0x02, "no_native_text": 0x04, "grayscale": 0x08, "limit_image_cache": 0x200, "force_halftone": 0x400, "printing": 0x800, "no_smooth_text": 0x1000,
    "no_smooth_image": 0x2000, "no_smooth_path": 0x4000,
}
#: Fixed values (JPEG 2000, table A.16): what the progression orders run through, outermost first.
PROGRESSIONS = {0: ("layer", "resolution", "component", "precinct"), 1: ("resolution", "layer", "component", "precinct"), 2: ("resolution", "precinct", "component", "layer"), 3: ("precinct", "component", "resolution", "layer"), 4: ("component", "precinct", "resolution", "layer")}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def has_flag(flags, name: str, masks: dict[str, int] = RENDER_FLAGS) -> Column:
    return _c(flags).bitwiseAND(masks[name]) != 0


def flags_of(*names: str, masks: dict[str, int] = RENDER_FLAGS) -> int:
    return sum(masks[n] for n in set(names))


def chunk_bits(kind: Column) -> Column:
    """struct<critical, public, safe_to_copy> of a PNG chunk type: bit 5 of its first, second and fourth letter."""
    bit = lambda k: F.ascii(F.substring(kind, k, 1)).bitwiseAND(32)
    return F.struct((bit(1) == 0).alias("critical"), (bit(2) == 0).alias("public"), (bit(4) != 0).alias("safe_to_copy"))


def marker_class(marker: Column) -> Column:
    """Of a JPEG marker's second byte: SOF, RST, APP or null."""
    frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
    return F.when(frame, "SOF").when(marker.between(0xD0, 0xD7), "RST").when(marker.between(0xE0, 0xEF), "APP")


def adam7(width: Column, height: Column) -> Column:
    """array<struct<pass, columns, rows>> of the seven passes; empty passes have no columns or no rows."""

    def count(size: Column, first: int, step: int) -> Column:
        return F.greatest(F.ceil((size - first) / step), F.lit(0)).cast("long")

    return F.array(*[F.struct(F.lit(k).alias("pass"), count(width, x, dx).alias("columns"), count(height, y, dy).alias("rows")) for k, (x, y, dx, dy) in enumerate(ADAM7)])


def half_float(bits: Column) -> Column:
    """A 16-bit float from its bits; not a number is null."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    small, normal = sign * fraction * 2.0**-24, sign * (1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15)
    return F.when((exponent == 31) & (fraction != 0), None).when(exponent == 31, sign * float("inf")).when(exponent == 0, small).otherwise(normal)


def is_vertex(c: Column) -> Column:
    return c.between(COMMANDS["move_to"], COMMANDS["end_poly"] - 1)


def is_drawing(c: Column) -> Column:
    return c.between(COMMANDS["line_to"], COMMANDS["end_poly"] - 1)


def is_curve(c: Column) -> Column:
    return c.isin(COMMANDS["curve3"], COMMANDS["curve4"])


def is_end_poly(c: Column) -> Column:
    return c.bitwiseAND(COMMAND_MASK) == COMMANDS["end_poly"]


def is_close(c: Column) -> Column:
    """Ends a polygon that is closed and has no orientation."""
    return c.bitwiseAND(~(CW | CCW)) == COMMANDS["end_poly"] | CLOSE


def is_next_poly(c: Column) -> Column:
    return (c == COMMANDS["stop"]) | (c == COMMANDS["move_to"]) | is_end_poly(c)


def orientation(c: Column) -> Column:
    return F.when(c.bitwiseAND(CW) != 0, "cw").when(c.bitwiseAND(CCW) != 0, "ccw").otherwise("none")


def without_orientation(c: Column) -> Column:
    return c.bitwiseAND(~(CW | CCW))


def swapped_rgb(data: Column) -> Column:
    """Bytes 0 and 2 of each triple change places; what is left over at the end stays."""
    return F.unhex(F.regexp_replace(F.hex(data), "(..)(..)(..)", "$3$2$1"))


def upsampled(samples: DataFrame, keys: list[str], factor_x: int, factor_y: int, value: str = "v") -> DataFrame:
    """Chroma samples (keys, x, y, value) at full size, each repeated: an explode, no join."""
    xs, ys = (F.explode(F.sequence(F.col(c) * f, F.col(c) * f + f - 1)) for c, f in (("x", factor_x), ("y", factor_y)))
    return samples.select(*keys, xs.alias("x2"), "y", value).select(*keys, F.col("x2").alias("x"), ys.alias("y2"), value).select(*keys, "x", F.col("y2").alias("y"), value)


def upsampled_smooth(samples: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Twice as wide with triangle weights: each output is three quarters of the nearer sample and one of the next, edges repeated."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    left, right = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    pair = F.array(F.floor((3 * F.col(value) + left + 1) / 4), F.floor((3 * F.col(value) + right + 2) / 4))
    return samples.withColumn("pair", pair).select(*keys, F.col("x"), "y", F.posexplode("pair").alias("k", "out")).select(*keys, (2 * F.col("x") + F.col("k")).alias("x"), "y", F.col("out").cast("int").alias(value))


def scanlines(images: DataFrame, pitch: Column, data: str = "data") -> DataFrame:
    """A row (y, line) for each scanline of decoded data; a last line that is short stays short."""
    n = F.ceil(F.length(data) / pitch).cast("int")
    rows = images.withColumn("y", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return rows.withColumn("line", F.substring(F.col(data), (F.col("y") * pitch + 1).cast("int"), pitch.cast("int"))).drop(data)


def packets(tiles: DataFrame, keys: list[str], order: str = "progression") -> DataFrame:
    """tiles: keys, progression (0 to 4), layers, resolutions, components, precincts -> a row (seq, layer, resolution, component, precinct) for each packet, numbered in its tile's order."""
    out = tiles
    for name in ("layer", "resolution", "component", "precinct"):
        n = F.col(f"{name}s")
        out = out.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    ranks = []
    for k in range(4):
        rank = F.lit(0)
        for number, names in PROGRESSIONS.items():
            rank = F.when(F.col(order) == number, F.col(names[k])).otherwise(rank)
        ranks.append(rank)
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy(*ranks)) - 1
    return out.withColumn("seq", seq).select(*keys, "seq", "layer", "resolution", "component", "precinct")


def tile_rects(images: DataFrame, width: Column, height: Column, tile_width: Column, tile_height: Column) -> DataFrame:
    """A row (tile, x0, y0, x1, y1) for each tile of an image, row by row."""
    across, down = F.ceil(width / tile_width).cast("int"), F.ceil(height / tile_height).cast("int")
    out = images.withColumn("tile", F.explode(F.sequence(F.lit(0), across * down - 1)))
    x0, y0 = (F.col("tile") % across) * tile_width, F.floor(F.col("tile") / across) * tile_height
    return out.withColumn("x0", x0.cast("long")).withColumn("y0", y0.cast("long")).withColumn("x1", F.least(x0 + tile_width, width).cast("long")).withColumn("y1", F.least(y0 + tile_height, height).cast("long"))


def resolution_sizes(x0: Column, x1: Column, levels: int) -> Column:
    """array<long>: the length of an interval at each resolution, the smallest first: both ends divided by a power of two and rounded up."""
    return F.array(*[(F.ceil(x1 / float(1 << (levels - r))) - F.ceil(x0 / float(1 << (levels - r)))).cast("long") for r in range(levels + 1)])


def integer_root(n: Column) -> Column:
    """The whole part of a square root, exact for 52 bits."""
    r = F.floor(F.sqrt(n.cast("double")))
    return F.when(r * r > n, r - 1).when((r + 1) * (r + 1) <= n, r + 1).otherwise(r).cast("long")


def normalized_angle(a: Column) -> Column:
    """An angle in radians to 0 up to two pi."""
    turn = 6.283185307179586
    return a - F.floor(a / turn) * turn


def pitch(width: Column, components: Column | int, bits: Column | int, padded_to: int = 1) -> Column:
    """Bytes of a row of samples, padded to so many bytes."""
    whole = 8 * padded_to
    return (F.floor((width * components * bits + whole - 1) / whole) * padded_to).cast("long")


def vertex_bounds(vertices: DataFrame, keys: list[str], command: str = "cmd") -> DataFrame:
    """vertices: keys, x, y, command -> one box for each path, of its vertices only: ends of polygons have no place. Control points count."""
    at = is_vertex(F.col(command))
    sides = [f(F.when(at, F.col(c))).alias(n) for f, c, n in ((F.min, "x", "left"), (F.min, "y", "top"), (F.max, "x", "right"), (F.max, "y", "bottom"))]
    return vertices.groupBy(*keys).agg(*sides).where(F.col("left").isNotNull())


def bessel(order: int, x: Column, terms: int = 40) -> Column:
    """The Bessel function of the first kind of a whole order by its power series; null for arguments beyond 20 on either side, for which so many terms aren't enough."""
    half = x / 2
    first = F.pow(half, F.lit(order)) / float(math.factorial(order))
    step = lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (-s["term"] * half * half / ((k + 1) * (k + 1 + order))).alias("term"))
    start = F.struct(F.lit(0.0).alias("sum"), first.cast("double").alias("term"))
    return F.when(F.abs(x) <= 20, F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step)["sum"])
