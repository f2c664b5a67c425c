"""Search, regions and shaping over character tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


def hits(texts: DataFrame, text: str, what: str) -> DataFrame:
    """A row for each occurrence (column ``at``, 0-based, not overlapping) of a literal string."""
    return texts.withColumn("at", F.explode(T.all_hits(F.col(text), F.col(what))))


def hit_boxes(found: DataFrame, chars: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The bounding box of each hit. chars: keys, idx (place in the text), x, y, width, size."""
    joined = found.select(*keys, "at", F.length(what).alias("n")).withColumn("idx", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))).join(chars, [*keys, "idx"])
    box = G.rect(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("size"))
    return joined.groupBy(*keys, "at").agg(G.union_agg(box).alias("box"))


def indexed(chars: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of each character in its page's text."""
    return chars.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def in_region(chars: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    return chars.where(F.col("x").between(left, right) & F.col("y").between(top, bottom))


def kerned(glyphs: DataFrame, pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """glyphs: keys, order, glyph, advance; pairs: left, right, kern. Adds kern to the advance of the first glyph of each pair and the running x."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = glyphs.withColumn("right", F.lead("glyph").over(w)).withColumnRenamed("glyph", "left")
    joined = ahead.join(pairs, ["left", "right"], "left")
    moved = joined.withColumn("advance", F.col("advance") + F.coalesce("kern", F.lit(0)))
    x = F.coalesce(F.sum("advance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return moved.select(*keys, order, F.col("left").alias("glyph"), "advance", x.alias("x"))


def cmap_ranges(cmaps: DataFrame) -> DataFrame:
    """cmaps: font_id, body (text of a CMap) -> font_id, low, high, cid: its cidrange and cidchar entries."""
    number = "<([0-9A-Fa-f]+)>"

    def entries(block: str, pattern: str) -> DataFrame:
        blocks = cmaps.select("font_id", F.explode(F.regexp_extract_all("body", F.lit(rf"(?s)begin{block}(.*?)end{block}"), F.lit(1))).alias("b"))
        return blocks.select("font_id", F.explode(F.regexp_extract_all("b", F.lit(pattern), F.lit(0))).alias("e"))

    def code(pattern: str, k: int):
        return F.conv(F.regexp_extract("e", pattern, k), 16, 10).cast("long")

    r, c = rf"{number}\s*{number}\s*(\d+)", rf"{number}\s*(\d+)"
    ranges = entries("cidrange", r).select("font_id", code(r, 1).alias("low"), code(r, 2).alias("high"), F.regexp_extract("e", r, 3).cast("long").alias("cid"))
    chars = entries("cidchar", c).select("font_id", code(c, 1).alias("low"), code(c, 1).alias("high"), F.regexp_extract("e", c, 2).cast("long").alias("cid"))
    return ranges.unionByName(chars)


def cids(codes: DataFrame, ranges: DataFrame, step: int = 256) -> DataFrame:
    """codes: font_id, code -> with cid, 0 if no range has the code. An equi-join on font and bucket of codes, each code once; rows that repeat stay."""
    cut = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor(F.col("high") / step))))
    placed = codes.select("font_id", "code").distinct().withColumn("bucket", F.floor(F.col("code") / step))
    hit = F.col("code").between(F.col("low"), F.col("high"))
    joined = placed.join(cut, ["font_id", "bucket"], "left")
    best = joined.groupBy("font_id", "code").agg(F.max(F.when(hit, F.col("cid") + F.col("code") - F.col("low"))).alias("cid"))
    return codes.join(best, ["font_id", "code"], "left").select(*codes.columns, F.coalesce("cid", F.lit(0)).alias("cid"))
