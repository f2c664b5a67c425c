"""Text set in its fonts: strings cut into codes by each font's own coding, widths by code, places by running sums.

Advances along a line of text depend on widths, and widths on fonts, which are other objects; where the line begins doesn't. So the fold over a page's
operations says for each string which line it is on and the line's matrix, codes and widths are joined, and the place of each character
on its line is a running sum within (document, page, run, line), mapped by the line's matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charcodes as CC
from ..functions import text as T
from ..sources.walk import scratch, written
from . import lookup, objects

#: Thousandths of the size for a simple font without widths, and for a composite one.
SIMPLE_WIDTH, COMPOSITE_WIDTH = 500.0, 1000.0


def font_codings(table: DataFrame, streams: DataFrame) -> DataFrame:
    """doc_id, font_obj, simple, scheme, leads, spaces, coding, vertical, to_unicode, cmap (object numbers), fallback: how each font's strings are cut.

    Simple fonts have codes of one byte. Composite ones (Type0) are cut by a predefined code map, or by the code spaces of an embedded one;
    fallback: the width of a code without an entry, in thousandths.
    """
    wanted = {
        "type": ("name", "Type"), "subtype": ("name", "Subtype"), "encoding": ("name", "Encoding"), "cmap": ("ref", "Encoding"), "to_unicode": ("ref", "ToUnicode"), "below": ("refs", "DescendantFonts"),
        "descriptor": ("ref", "FontDescriptor"), "widths": ("nums", "Widths"),
    }
    found = objects.attributes(table, wanted).where("type = 'Font'")
    more = objects.attributes(table, {"missing": ("num", "MissingWidth"), "dw": ("num", "DW")})
    of = lambda ref, column, name: more.where(F.col(column).isNotNull()).select("doc_id", F.col("obj_num").alias(ref), F.col(column).alias(name))
    fonts = found.withColumn("below", F.get("below", F.lit(0)))
    fonts = fonts.join(of("descriptor", "missing", "missing"), ["doc_id", "descriptor"], "left").join(of("below", "dw", "dw"), ["doc_id", "below"], "left")
    maps = streams.join(found.select("doc_id", F.col("cmap").alias("obj_num")).distinct(), ["doc_id", "obj_num"], "left_semi")
    spaces = maps.select("doc_id", F.col("obj_num").alias("cmap"), CC.code_spaces(F.decode("data", "ISO-8859-1")).alias("spaces"))
    joined = fonts.join(spaces, ["doc_id", "cmap"], "left").withColumn("known", CC.predefined(F.col("encoding")))
    simple = F.coalesce(F.col("subtype") != "Type0", F.lit(True))
    none = F.array().cast("array<struct<low:string,high:string>>")
    scheme = F.when(simple, "one").when(F.col("spaces").isNotNull(), CC.scheme_of(F.col("spaces"))).otherwise(F.coalesce(F.col("known.scheme"), F.lit("two")))
    width = F.when(simple, F.coalesce("missing", F.when(F.col("widths").isNull(), SIMPLE_WIDTH).otherwise(0.0))).otherwise(F.coalesce("dw", F.lit(COMPOSITE_WIDTH)))
    return joined.select(
        "doc_id", F.col("obj_num").alias("font_obj"), simple.alias("simple"), scheme.alias("scheme"), F.coalesce("known.leads", F.array().cast(CC.RANGES)).alias("leads"),
        F.coalesce("spaces", none).alias("spaces"), F.col("known.coding").alias("coding"), F.coalesce("known.vertical", F.lit(False)).alias("vertical"), "to_unicode",
        F.when(~simple, F.col("cmap")).alias("cmap"), width.alias("fallback"), "below",
    )


def simple_widths(table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: doc_id, font_obj, code -> with the width that the font's Widths array has for the code; codes outside it have no row. A font is one row, whatever the length of its array."""
    found = objects.fonts(table).where("widths IS NOT NULL").select("doc_id", F.col("obj_num").alias("font_obj"), F.coalesce("first_char", F.lit(0)).alias("first"), "widths")
    at = F.col("code") - F.col("first")
    width = F.when((at >= 0) & (at < F.size("widths")), F.get("widths", at.cast("int")))
    return asked.join(found, ["doc_id", "font_obj"]).select("doc_id", "font_obj", "code", width.alias("width")).where("width IS NOT NULL")


def cid_widths(table: DataFrame) -> DataFrame:
    """(doc_id, below, low, high, width) of the W arrays of descendant fonts.

    Such an array has groups of two kinds, ``c [w w ...]`` and ``first last w``. Which number is which follows from its place in a run of
    numbers: triples from the run's start, and what is left before an array is that array's first code.
    """
    part = lambda k: F.get("path", F.lit(k))
    digits = "^[0-9]{1,9}$"
    of_w = table.where((part(0) == "W") & part(1).rlike(digits) & F.size("path").between(2, 3))
    top = of_w.where(F.size("path") == 2).select("doc_id", "obj_num", part(1).cast("int").alias("at"), "d", (F.col("kind") == "array").alias("is_array"))
    inner = of_w.where((F.size("path") == 3) & part(2).rlike(digits) & F.col("d").isNotNull()).select("doc_id", "obj_num", part(1).cast("int").alias("at"), part(2).cast("int").alias("k"), F.col("d").alias("width"))
    font = Window.partitionBy("doc_id", "obj_num").orderBy("at")
    stretch = Window.partitionBy("doc_id", "obj_num", "stretch").orderBy("at")
    runs = top.withColumn("stretch", F.coalesce(F.sum(F.col("is_array").cast("int")).over(font.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("before", F.lag("d").over(stretch))
    starts = runs.where("is_array AND before IS NOT NULL").select("doc_id", "obj_num", "at", F.col("before").cast("long").alias("first"))
    listed = inner.join(starts, ["doc_id", "obj_num", "at"]).select("doc_id", "obj_num", (F.col("first") + F.col("k")).alias("low"), (F.col("first") + F.col("k")).alias("high"), "width")
    numbered = runs.where("NOT is_array AND d IS NOT NULL").withColumn("n", F.row_number().over(stretch) - 1).withColumn("triple", F.floor(F.col("n") / 3)).withColumn("role", F.col("n") % 3)
    pick = lambda k: F.max(F.when(F.col("role") == k, F.col("d")))
    triples = numbered.groupBy("doc_id", "obj_num", "stretch", "triple").agg(pick(0).alias("low"), pick(1).alias("high"), pick(2).alias("width")).where("width IS NOT NULL")
    spans = triples.select("doc_id", "obj_num", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), "width")
    return listed.unionByName(spans).withColumnRenamed("obj_num", "below")


def unicode_ranges(maps: DataFrame) -> DataFrame:
    """maps: font_id, body -> font_id, low, high, text (UTF-16 of the first code, as a string): bfchar and bfrange entries, arrays of a range included."""
    hexed = "<([0-9A-Fa-f ]+)>"

    def entries(block: str, pattern: str) -> DataFrame:
        blocks = maps.select("font_id", F.explode(F.regexp_extract_all("body", F.lit(rf"(?s)begin{block}(.*?)end{block}"), F.lit(1))).alias("b"))
        return blocks.select("font_id", F.explode(F.regexp_extract_all("b", F.lit(pattern), F.lit(0))).alias("e"))

    def text(c: Column) -> Column:
        return F.decode(F.unhex(F.replace(c, F.lit(" "), F.lit(""))), "UTF-16BE")

    def code(c: Column) -> Column:
        return F.conv(F.replace(c, F.lit(" "), F.lit("")), 16, 10).cast("long")

    one, span, listed = rf"{hexed}\s*{hexed}", rf"{hexed}\s*{hexed}\s*{hexed}", rf"(?s){hexed}\s*{hexed}\s*\[(.*?)\]"
    get = lambda p, k: F.regexp_extract("e", p, k)
    chars = entries("bfchar", one).select("font_id", code(get(one, 1)).alias("low"), code(get(one, 1)).alias("high"), text(get(one, 2)).alias("text"))
    spans = entries("bfrange", span).select("font_id", code(get(span, 1)).alias("low"), code(get(span, 2)).alias("high"), text(get(span, 3)).alias("text"))
    each = entries("bfrange", listed).select("font_id", code(get(listed, 1)).alias("low"), F.posexplode(F.regexp_extract_all(get(listed, 3), F.lit(hexed), F.lit(1))).alias("k", "t"))
    lists = each.select("font_id", (F.col("low") + F.col("k")).alias("low"), (F.col("low") + F.col("k")).alias("high"), text(F.col("t")).alias("text"))
    return chars.unionByName(spans).unionByName(lists)


def shifted(text: Column, by: Column) -> Column:
    """The text whose last character is ``by`` code points further."""
    last = F.ascii(F.right(text, F.lit(1))) + by
    # The code point as UTF-32, which Java decodes and Spark's chr() doesn't go to.
    return F.when(by == 0, text).otherwise(F.concat(F.left(text, F.length(text) - 1), F.decode(F.unhex(F.lpad(F.hex(last.cast("long")), 8, "0")), "UTF-32")))


def codes(drawn: DataFrame, table: DataFrame, streams: DataFrame) -> DataFrame:
    """A row for each code that is shown: the keys and state of ``drawing.drawn``, k (its place in the string), n (of codes there), code, space (a single byte 32), and the font's coding."""
    named = objects.named_resources(table, "Font").select("doc_id", F.col("owner").alias("font_owner"), F.col("name").alias("font"), F.col("ref_obj").alias("font_obj"))
    codings = written(font_codings(table, streams), scratch(table.sparkSession))
    shown = drawn.where("type = 'text'").join(named, ["doc_id", "font_owner", "font"], "left").join(codings, ["doc_id", "font_obj"], "left")
    scheme = F.coalesce("scheme", F.lit("one"))
    cut = shown.withColumn("cut", CC.codes(F.col("text"), scheme, F.coalesce("leads", F.array().cast(CC.RANGES)), F.coalesce("spaces", F.array().cast("array<struct<low:string,high:string>>"))))
    keep = ["doc_id", "page_index", "run", "place", "place_text", "seq", "line", "base", "lead", "size", "char_space", "word_space", "scale", "font_obj", "simple", "coding", "vertical", "to_unicode", "cmap", "fallback", "below"]
    rows = cut.select(*keep, scheme.alias("scheme"), F.size("cut").alias("n"), F.posexplode("cut").alias("k", "code"))
    single = (F.col("scheme") == "one") | ((F.col("scheme") != "two") & (F.col("code") < 256))
    return rows.withColumn("space", (F.col("code") == 32) & single)


def glyphs(drawn: DataFrame, table: DataFrame, streams: DataFrame) -> DataFrame:
    """doc_id, page_index, place, seq, k, font_obj, code, cid, ch, width (thousandths), advance, x, y, size: every character that is shown, at its place.

    ch is what the font's ToUnicode map says; without one the byte of a simple font in PDFDocEncoding, or the code of a code map in Unicode; else null.
    Empty strings move what follows by their lead alone. Codes and widths are looked up once for each font and code, not for each character.
    """
    def kept(df: DataFrame) -> DataFrame:
        return written(df, scratch(table.sparkSession))  # used several times below: else plans grow with the number of ways to them

    rows = kept(codes(drawn, table, streams))
    used = kept(rows.where("font_obj IS NOT NULL").select("doc_id", "font_obj", "code", "simple", "cmap", "to_unicode", "below").distinct())
    one_key = F.concat_ws("/", "doc_id", "cmap"), F.concat_ws("/", "doc_id", "to_unicode")
    wanted_maps = used.select("doc_id", F.explode(F.array("cmap", "to_unicode")).alias("obj_num")).where("obj_num IS NOT NULL").distinct()
    bodies = kept(streams.join(wanted_maps, ["doc_id", "obj_num"], "left_semi").select(F.concat_ws("/", "doc_id", "obj_num").alias("font_id"), F.decode("data", "ISO-8859-1").alias("body")))
    from . import text as text_operators

    known = used.withColumn("cmap_id", one_key[0]).withColumn("unicode_id", one_key[1])
    by_cmap = known.where("cmap IS NOT NULL").select(F.col("cmap_id").alias("font_id"), "code").distinct()
    cid = lookup.grouped_ranges(by_cmap, ["font_id"], "code", text_operators.cmap_ranges(bodies), F.max(F.expr("cid + code - low")).alias("cid")).select(F.col("font_id").alias("cmap_id"), "code", "cid")
    by_unicode = known.where("to_unicode IS NOT NULL").select(F.col("unicode_id").alias("font_id"), "code").distinct()
    first = F.min_by(F.struct("text", (F.col("code") - F.col("low")).alias("by")), F.struct(F.expr("high - low"), "text")).alias("u")
    said = lookup.grouped_ranges(by_unicode, ["font_id"], "code", unicode_ranges(bodies), first).select(F.col("font_id").alias("unicode_id"), "code", shifted(F.col("u.text"), F.col("u.by")).alias("said"))
    named = known.join(cid, ["cmap_id", "code"], "left").join(said, ["unicode_id", "code"], "left")
    named = kept(named.withColumn("cid", F.when(F.col("simple") | F.col("cmap").isNull(), F.col("code")).otherwise(F.coalesce("cid", F.lit(0)))))
    simple = simple_widths(table, named.where("simple").select("doc_id", "font_obj", "code").distinct())
    asked = named.where("NOT simple AND below IS NOT NULL").select("doc_id", "below", "cid").distinct()
    composite = lookup.grouped_ranges(asked, ["doc_id", "below"], "cid", cid_widths(table), F.max("width").alias("cid_width"))
    named = named.join(simple, ["doc_id", "font_obj", "code"], "left").join(composite, ["doc_id", "below", "cid"], "left")
    facts = named.select("doc_id", "font_obj", "code", "cid", "said", F.coalesce("width", "cid_width").alias("own_width"))
    joined = rows.join(facts, ["doc_id", "font_obj", "code"], "left")
    width = F.coalesce("own_width", "fallback", F.lit(SIMPLE_WIDTH))
    byte = F.unhex(F.lpad(F.hex(F.col("code").cast("long")), 2, "0"))
    by_coding = F.when(F.col("coding").isin("ucs2", "utf16"), F.decode(F.unhex(F.lpad(F.hex(F.col("code").cast("long")), F.when(F.col("code") > 0xFFFF, 8).otherwise(4), F.lit("0"))), "UTF-16BE"))
    ch = F.coalesce("said", F.when(F.coalesce("simple", F.lit(True)), T.decode_text(byte)), by_coding)
    size, scale = F.col("size"), F.when(F.coalesce("vertical", F.lit(False)), 1.0).otherwise(F.col("scale"))
    em = F.when(F.coalesce("vertical", F.lit(False)), -1.0).otherwise(width / 1000)
    advance = (em * size + F.col("char_space") + F.when(F.col("space"), F.col("word_space")).otherwise(0.0)) * scale
    leading = F.when(F.col("k") == 0, F.col("lead") * size * scale).otherwise(0.0)
    along = Window.partitionBy("doc_id", "page_index", "run", "line").orderBy("seq", "k")
    before = F.sum(F.col("advance") + F.col("leading")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    at = joined.withColumns({"width": width, "ch": ch, "advance": advance, "leading": leading}).withColumn("at", F.coalesce(before, F.lit(0.0)) + F.col("leading"))
    b, upright = F.col("base"), ~F.coalesce("vertical", F.lit(False))
    x = F.when(upright, b["a"] * F.col("at")).otherwise(b["c"] * F.col("at")) + b["e"]
    y = F.when(upright, b["b"] * F.col("at")).otherwise(b["d"] * F.col("at")) + b["f"]
    return at.select("doc_id", "page_index", "place", "run", "line", "seq", "k", "font_obj", "code", "cid", "ch", "width", "advance", x.alias("x"), y.alias("y"), "size")


def text(found: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): a page's characters in drawing order; what no map names is U+FFFD."""
    parts = F.array_sort(F.collect_list(F.struct("place", "k", F.coalesce("ch", F.lit("�")).alias("ch"))))
    return found.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(parts, lambda p: p["ch"]), "").alias("text"))
