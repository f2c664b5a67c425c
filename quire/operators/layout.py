"""Reading order, and the text of a page with its characters' places.

Characters come in drawing order, which need not be the order of reading. Lines are found from heights alone, columns from gaps that run through
lines, and the text that results, with the spaces and line ends it adds, keeps a table of which character stands where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.walk import scratch, written

PAGE = ["doc_id", "page_index"]
#: Shares of the size. Heights that are nearer are one line; a wider gap is a space; a gap between columns.
SAME_LINE, SPACE, GUTTER = 0.5, 0.3, 2.0


def line_bands(glyphs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``line``, from the top (the greatest y) down, whatever the order of the rows.

    A sweep over heights: a line's band reaches SAME_LINE of the size below its highest character, so a slow slope of many
    characters doesn't become one line, as it would if only neighbours were compared. Each distinct height of a page is a row of the sweep, which an expression
    folds; characters are joined to the bands.
    """
    keys = keys or PAGE
    heights = glyphs.groupBy(*keys, "y").agg(F.max("size").alias("size"))
    listed = heights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "size")), asc=False).alias("h"))  # distinct heights of one page
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("reach"), F.lit(-1).alias("line"), F.array().cast("array<struct<y:double,line:int>>").alias("out"))

    def step(s, h):
        new = s["top"].isNull() | (s["top"] - h["y"] > s["reach"])
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(
            F.when(new, h["y"]).otherwise(s["top"]).alias("top"), F.when(new, SAME_LINE * h["size"]).otherwise(F.greatest(s["reach"], SAME_LINE * h["size"])).alias("reach"), line.alias("line"),
            F.array_append(s["out"], F.struct(h["y"].alias("y"), line.alias("line"))).alias("out"),
        )

    bands = listed.select(*keys, F.inline(F.aggregate("h", start, step, lambda s: s["out"])))
    return glyphs.join(bands, [*keys, "y"])


def columns(placed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``block`` and ``column``: where a gap wider than GUTTER runs through consecutive lines, what is left of it is read first.

    placed: with ``line``. A block is a stretch of lines that the same empty strips run through: it begins with a line that has gaps, and goes on
    as long as some strip, at least the size wide, is left that no character of the next line stands in; so a line may end short of a strip, or begin after it. A strip
    parts columns if two lines at least have characters on both its sides. A line without gaps that isn't part of a block is a block by itself.
    """
    keys = keys or PAGE
    along = Window.partitionBy(*keys, "line").orderBy("x", "seq", "k")
    edge = F.max(F.col("x") + F.col("width")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("x") - edge > GUTTER * F.col("size"), F.struct(edge.alias("left"), F.col("x").alias("right")))
    marked = placed.withColumn("gap", gap)
    far = F.lit(1e18)
    outer = F.array(F.struct((-far).alias("left"), F.min("x").alias("right")), F.struct(F.max(F.col("x") + F.col("width")).alias("left"), far.alias("right")))
    lines = marked.groupBy(*keys, "line").agg(F.array_sort(F.collect_list("gap")).alias("gaps"), outer.alias("outer"), F.max("size").alias("size"))
    listed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "gaps", "outer", "size"))).alias("lines"))
    gaps = "array<struct<left:double,right:double>>"
    start = F.struct(F.lit(-1).alias("block"), F.array().cast(gaps).alias("common"), F.array().cast(f"array<struct<line:int,block:int,common:{gaps},gaps:{gaps}>>").alias("out"))

    def step(s, ln):
        # The strips that are left, each narrowed to what is empty in this line too.
        shared = F.filter(
            F.flatten(F.transform(s["common"], lambda a: F.transform(F.concat(ln["gaps"], ln["outer"]), lambda b: F.struct(F.greatest(a["left"], b["left"]).alias("left"), F.least(a["right"], b["right"]).alias("right"))))),
            lambda g: g["right"] - g["left"] >= ln["size"],
        )
        goes_on = F.size(shared) > 0
        block, common = F.when(goes_on, s["block"]).otherwise(s["block"] + 1), F.when(goes_on, shared).otherwise(ln["gaps"])
        return F.struct(block.alias("block"), common.alias("common"), F.array_append(s["out"], F.struct(ln["line"].alias("line"), block.alias("block"), common.alias("common"), ln["gaps"].alias("gaps"))).alias("out"))

    found = listed.select(*keys, F.inline(F.aggregate("lines", start, step, lambda s: s["out"])))
    # The gaps that hold for the whole block are those left after its last line.
    last = found.groupBy(*keys, "block").agg(F.max_by("common", "line").alias("strips"), F.flatten(F.collect_list("gaps")).alias("own"))
    crossed = lambda g: F.size(F.filter("own", lambda o: (o["left"] < g["right"]) & (g["left"] < o["right"])))
    last = last.select(*keys, "block", F.filter("strips", lambda g: crossed(g) >= 2).alias("strips"))
    blocks = found.select(*keys, "line", "block").join(last, [*keys, "block"])
    joined = marked.drop("gap").join(blocks, [*keys, "line"])
    column = F.size(F.filter("strips", lambda g: g["right"] <= F.col("x") + 1e-9))
    return joined.withColumn("column", column).drop("strips")


def reading_order(glyphs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """glyphs: keys, x, y, width, size, seq, k, ch. Adds line, block, column, and ``n``, the place in reading order: blocks from the top, their columns from the left, lines, characters.

    Characters are read once for their heights and once for their lines, so they are written to the shared folder first, and again with their lines.
    """
    keys = keys or PAGE
    spark = glyphs.sparkSession
    placed = columns(written(line_bands(written(glyphs, scratch(spark)), keys), scratch(spark)), keys)
    return placed.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("block", "column", "line", "x", "seq", "k")) - 1)


def text_index(ordered: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ordered: of ``reading_order``. Adds ``before`` ('', a space or a line end that the text has before the character), and ``at`` and ``after``, the character's place in the text.

    What the text adds has no character; a hyphen at the end of a line, and that line end, are in the text as they stand. ``at`` is a running sum, so nothing of the
    text need be built to look a character up.
    """
    keys = keys or PAGE
    w = Window.partitionBy(*keys).orderBy("n")
    same = (F.lag("line").over(w) == F.col("line")) & (F.lag("column").over(w) == F.col("column")) & (F.lag("block").over(w) == F.col("block"))
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    before = F.when(F.col("n") == 0, "").when(~same, "\n").when(gap > SPACE * F.col("size"), " ").otherwise("")
    marked = ordered.withColumn("before", before)
    size = F.length("before") + F.length("ch")
    after = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return marked.withColumn("after", after).withColumn("at", F.col("after") - F.length("ch"))


def page_text(indexed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, text) of ``text_index``."""
    keys = keys or PAGE
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat("before", "ch").alias("t"))))
    return indexed.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def range_boxes(ranges: DataFrame, indexed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ranges: keys, id, start, stop (half-open places in the page's text). A box for each line that a range has characters on: (keys, id, block, column, line, box, chars).

    A range over a space or a line end that has no character gives the boxes of what it does hold; over nothing else, none. The join is on the page and on
    stretches of 64 places, so only pages with ranges are read, and no character meets a range that ends before its stretch.
    """
    keys = keys or PAGE
    step = 64
    asked = ranges.where("start < stop").withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("stop") - 1) / step))))
    placed = indexed.where("at < after").withColumn("stretch", F.floor(F.col("at") / step))
    hit = asked.join(placed, [*keys, "stretch"]).where("at >= start AND at < stop")
    box = F.struct(F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("size")).alias("bottom"))
    chars = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ch"))), lambda c: c["ch"]), "")
    return hit.groupBy(*keys, "id", "block", "column", "line").agg(box.alias("box"), chars.alias("chars"))


def char_at(points: DataFrame, indexed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """points: keys, px, py -> with ``at``, the text place of the character whose box holds the point, the first in reading order; null where none does. Boxes reach from y to y + size."""
    keys = keys or PAGE
    id_ = F.monotonically_increasing_id()
    asked = points.withColumn("_id", id_)
    inside = (F.col("px") >= F.col("x")) & (F.col("px") <= F.col("x") + F.col("width")) & (F.col("py") >= F.col("y")) & (F.col("py") <= F.col("y") + F.col("size"))
    found = asked.join(indexed.select(*keys, "x", "y", "width", "size", "at"), keys, "left")
    best = found.groupBy("_id", *[F.col(c) for c in points.columns]).agg(F.min(F.when(inside, F.col("at"))).alias("at"))
    return best.drop("_id")
