"""Metrics, character sets, scripts and feature strings as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Character set codes and the font that stands in for each; others get DEFAULT_FONT.
CHARSET_FONTS = {128: "MS Gothic", 129: "Batang", 134: "SimSun", 136: "MingLiU", 161: "Arial", 162: "Arial", 177: "Arial", 178: "Arial", 204: "Arial", 222: "Tahoma"}
DEFAULT_FONT = "Helvetica"
#: Orderings of character collections, from 1.
ORDERINGS = ("GB1", "CNS1", "Japan1", "Korea1", "UCS")
#: Bits of a face's and a style's flags.
FACE_FLAGS = {"scalable": 0, "fixed_sizes": 1, "fixed_width": 2, "sfnt": 3, "horizontal": 4, "vertical": 5, "kerning": 6, "multiple_masters": 8, "glyph_names": 9, "hinter": 11, "cid_keyed": 12, "tricky": 13, "color": 14}
STYLE_FLAGS = {"italic": 0, "bold": 1}
#: First and last code point of the blocks that tell a script.
SCRIPTS = (
    ("Latn", 0x41, 0x5A), ("Latn", 0x61, 0x7A), ("Latn", 0xC0, 0x24F), ("Grek", 0x370, 0x3FF), ("Cyrl", 0x400, 0x52F), ("Armn", 0x530, 0x58F), ("Hebr", 0x590, 0x5FF), ("Arab", 0x600, 0x6FF),
    ("Syrc", 0x700, 0x74F), ("Deva", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F), ("Hang", 0x1100, 0x11FF), ("Hira", 0x3041, 0x309F), ("Kana", 0x30A0, 0x30FF), ("Hani", 0x4E00, 0x9FFF), ("Hang", 0xAC00, 0xD7A3),
)
RIGHT_TO_LEFT = ("Hebr", "Arab", "Syrc")


def scaled(value: Column, scale: Column, units: Column) -> Column:
    """Font units to a scale, rounded half away from zero; 0 without units."""
    return F.when(units == 0, F.lit(0)).otherwise(F.round(value * scale / units)).cast("long")


def unscaled(value: Column, scale: Column, units: Column) -> Column:
    return F.when(scale == 0, F.lit(0)).otherwise(F.round(value * units / scale)).cast("long")


def per_mille(value: Column, units: Column) -> Column:
    """A metric in thousandths of the em, cut; as it is without units."""
    return F.when(units == 0, value).otherwise((value * 1000 / units).cast("long"))


def extents(ascender: Column, descender: Column, gap: Column) -> Column:
    """struct<ascender, descender, line_gap, height>; the descender is below the line."""
    down = -F.abs(descender)
    return F.struct(ascender.alias("ascender"), down.alias("descender"), gap.alias("line_gap"), (ascender - down + gap).alias("height"))


def default_font(charset: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CHARSET_FONTS.items() for x in pair])
    return F.coalesce(known[charset], F.lit(DEFAULT_FONT))


def charset_of(ordering: Column) -> Column:
    """The number of a collection's ordering, from 1; 0 if it is unknown. Parentheses around it are left out."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ORDERINGS)), F.regexp_replace(ordering, r"^\(|\)$", "")), F.lit(0)).cast("int")


def has_flag(flags: Column, name: str, bits: dict[str, int] = FACE_FLAGS) -> Column:
    return flags.bitwiseAND(1 << bits[name]) != 0


def cid_transform(byte: Column) -> Column:
    """A signed byte to a factor: 127 is one."""
    return F.when(byte < 128, byte).otherwise(byte - 256) / 127.0


def script_of(code: Column) -> Column:
    """The script of a code point by its block, null for common ones."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(SCRIPTS):
        out = F.when(code.between(low, high), name).otherwise(out)
    return out


def guessed_script(text: Column) -> Column:
    """The script of the first character that has one, else null."""
    found = F.filter(F.transform(F.split(text, ""), lambda c: script_of(F.ascii(c))), lambda s: s.isNotNull())
    return F.get(found, F.lit(0))


def direction(script: Column) -> Column:
    return F.when(script.isin(*RIGHT_TO_LEFT), "rtl").otherwise("ltr")


def feature(text: Column) -> Column:
    """struct<tag, value> of ``kern``, ``+kern``, ``-liga``, ``ss01=2``, ``dlig=off``; null if it is none."""
    pattern = r"^([+-]?)([A-Za-z0-9 ]{4})(?:=(\d+|on|off))?$"
    sign, tag, value = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    number = F.when(value.isin("", "on"), F.when(sign == "-", 0).otherwise(1)).when(value == "off", 0).otherwise(value.cast("int"))
    return F.when(text.rlike(pattern), F.struct(tag.alias("tag"), number.alias("value")))


def variation(text: Column) -> Column:
    """struct<tag, value> of ``wght=700``; null if it is none."""
    pattern = r"^([A-Za-z0-9 ]{4})=(-?\d+(?:\.\d+)?)$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("tag"), F.regexp_extract(text, pattern, 2).cast("double").alias("value")))


def serialized(glyphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, buffer): ``[id=cluster@x,y+advance|...]`` of glyph rows (glyph, cluster, x, y, advance) in order."""
    at = F.when((F.col("x") != 0) | (F.col("y") != 0), F.concat(F.lit("@"), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"))).otherwise("")
    piece = F.concat(F.col("glyph").cast("string"), F.lit("="), F.col("cluster").cast("string"), at, F.lit("+"), F.col("advance").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), piece.alias("p"))))
    return glyphs.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["p"]), "|"), F.lit("]")).alias("buffer"))


def deserialized(buffers: DataFrame, keys: list[str], buffer: str = "buffer") -> DataFrame:
    """The glyph rows (keys, place, glyph, cluster, x, y, advance) of buffers."""
    pattern = r"^(\d+)=(\d+)(?:@(-?\d+),(-?\d+))?\+(-?\d+)$"
    inner = F.regexp_replace(F.col(buffer), r"^\[|\]$", "")
    rows = buffers.select(*keys, F.posexplode(F.split(inner, r"\|")).alias("place", "p")).where(F.col("p").rlike(pattern))
    one = [F.regexp_extract("p", pattern, k) for k in range(1, 6)]
    number = lambda c: F.when(c == "", 0).otherwise(c.cast("int"))
    return rows.select(*keys, "place", *[number(c).alias(n) for c, n in zip(one, ("glyph", "cluster", "x", "y", "advance"), strict=True)])


def clusters(glyphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``island``: the number of the run of equal clusters that a glyph is in."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col("cluster") != F.lag("cluster").over(w)).cast("int"), F.lit(0))
    return glyphs.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def by_cluster(glyphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``place``: the stable order by cluster."""
    return glyphs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("cluster", order)) - 1)


def code_points(texts: DataFrame, text: str) -> DataFrame:
    """A row (cluster, code) for each character of a text."""
    return texts.select("*", F.posexplode(F.split(text, "")).alias("cluster", "ch")).where("ch <> ''").withColumn("code", F.ascii("ch")).drop("ch")
