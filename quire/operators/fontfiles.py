"""Metrics and names in font files, as rows of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sniff import big_endian
from .images import sfnt_tables

#: Number of a name record and what it names.
NAMES = {1: "family", 2: "style", 4: "full", 6: "postscript"}
TABLES = ("head", "hhea", "maxp", "kern")


def signed(data: Column, at: int) -> Column:
    """A signed 16-bit number at a place; null past the end."""
    n = big_endian(data, at, 2)
    return F.when(n >= 0x8000, n - 0x10000).otherwise(n)


def names(tables: DataFrame) -> DataFrame:
    """tables: as ``sfnt_tables`` gives them -> (font_id, kind, text) of the ``name`` table, the first record of a kind that isn't empty.

    UTF-16 for Windows Unicode, Latin-1 for Macintosh, else what is printable ASCII. A record that points outside is left out.
    """
    table = F.col("table")
    n = F.coalesce(big_endian(table, 2, 2), F.lit(0))
    each = tables.where((F.col("tag") == "name") & (n > 0)).select("font_id", "table", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("k"))
    at = F.col("k") * 12 + 6
    fields = {name: big_endian(table, at + 2 * j, 2).alias(name) for j, name in enumerate(("platform", "encoding", "language", "number", "length", "place"))}
    start = F.col("place") + big_endian(table, 4, 2)
    found = each.select("font_id", "k", "table", *fields.values()).where(F.col("number").isin(*NAMES) & (start + F.col("length") <= F.length("table")))
    raw = F.substring("table", (start + 1).cast("int"), F.col("length").cast("int"))
    wide = (F.col("platform") == 3) & F.col("encoding").isin(1, 10)
    latin = F.decode(raw, "ISO-8859-1")
    text = F.when(wide, F.decode(F.substring(raw, F.lit(1), F.floor(F.col("length") / 2).cast("int") * 2), "UTF-16BE")).when((F.col("platform") == 1) & (F.col("encoding") == 0), latin)
    text = F.coalesce(text, F.regexp_replace(latin, r"[^\x20-\x7E]", ""))
    kind = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("number").cast("int")]
    rows = found.select("font_id", kind.alias("kind"), "k", text.alias("text")).where("text <> ''")
    return rows.groupBy("font_id", "kind").agg(F.min_by("text", "k").alias("text"))


def metrics(fonts: DataFrame) -> DataFrame:
    """fonts: font_id, data -> one row each: units of the em, box, ascent, descent, glyphs, names, kerning, bold, italic.

    One aggregate over the tables of each font and one of its names. What a table lacks has its usual value: 1,000 units, 800, -200, no glyphs.
    """
    tables = sfnt_tables(fonts)
    one = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("table"))).alias(tag)
    wide = tables.where(F.col("tag").isin(*TABLES)).groupBy("font_id").agg(*[one(t) for t in TABLES])
    named = names(tables).groupBy("font_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in NAMES.values()])
    head, hhea, maxp = (F.when(F.length(t) >= n, F.col(t)) for t, n in (("head", 54), ("hhea", 36), ("maxp", 6)))
    units = big_endian(head, 18, 2)
    style = F.lower("style")
    box = F.struct(*[signed(head, 36 + 2 * k).alias(side) for k, side in enumerate(("left", "bottom", "right", "top"))])
    return fonts.select("font_id").join(wide, "font_id", "left").join(named, "font_id", "left").select(
        "font_id", F.when(units > 0, units).otherwise(1000).cast("long").alias("units"), F.when(head.isNotNull(), box).alias("box"), F.coalesce(signed(hhea, 4), F.lit(800)).alias("ascent"),
        F.coalesce(signed(hhea, 6), F.lit(-200)).alias("descent"), F.coalesce(big_endian(maxp, 4, 2), F.lit(0)).alias("glyphs"), F.coalesce("family", F.lit("Unknown")).alias("family"),
        F.coalesce("style", F.lit("Regular")).alias("style"), "full", "postscript", F.col("kern").isNotNull().alias("kerning"), F.coalesce(style.contains("bold"), F.lit(False)).alias("bold"),
        F.coalesce(style.contains("italic") | style.contains("oblique"), F.lit(False)).alias("italic"),
    )


def type1_name(data: Column) -> Column:
    """The name that a Type 1 font gives itself in its first 4,096 bytes, else null."""
    found = F.regexp_extract(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), r"/FontName\s+/(\S+)", 1)
    return F.when(found != "", found)


def charmap(maps: Column, encoding: str) -> Column:
    """The place of the first character map (array of encodings) of an encoding; null if there is none."""
    at = F.array_position(maps, encoding)
    return F.when(at > 0, at - 1)
