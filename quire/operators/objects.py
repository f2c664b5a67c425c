"""Typed attributes of objects, all keys of a kind of object in one aggregation over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.pdf import TRAILER, inherited

SCALARS = {
    "int": lambda: F.col("i"),
    "num": lambda: F.col("d"),
    "bool": lambda: F.when(F.col("kind") == "bool", F.col("i") == 1),
    "name": lambda: F.when(F.col("kind") == "name", F.decode("s", "ISO-8859-1")),
    "text": lambda: F.when(F.col("kind") == "string", T.decode_text(F.col("s"))),
    "ref": lambda: F.col("ref_obj"),
    "word": lambda: F.coalesce(SCALARS["text"](), SCALARS["name"](), F.col("i").cast("string")),
}
LISTS = {
    "nums": lambda: F.col("d"),
    "flags": lambda: F.when(F.col("kind") == "bool", F.col("i") == 1),
    "names": lambda: SCALARS["name"](),
    "texts": lambda: F.coalesce(SCALARS["text"](), F.when(F.col("kind") == "string", F.lower(F.hex("s")))),
    "refs": lambda: F.when(F.col("kind") == "ref", F.col("ref_obj")),
}
#: Filters that compress images, by their long names.
COMPRESSIONS = {
    "FlateDecode": "flate", "LZWDecode": "lzw", "RunLengthDecode": "run_length", "ASCIIHexDecode": "ascii_hex", "ASCII85Decode": "ascii85", "CCITTFaxDecode": "ccitt",
    "JBIG2Decode": "jbig2", "DCTDecode": "jpeg", "JPXDecode": "jpeg2000",
}
#: Kinds of shadings (PDF 32000-1, table 78), from 1.
SHADINGS = ("function", "axial", "radial", "free_form", "lattice", "coons", "tensor")


def attributes(table: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, obj_num, a column for each wanted name) of the objects that have any of the keys.

    wanted: name -> (type, key, other keys that serve if the first is missing). A key of dots leads into dictionaries
    (``MK.CA``). Types: those of SCALARS, and of LISTS for arrays; a list of names is also read from a single name. One
    partial aggregation, whatever the number of names.
    """
    keys = sorted({k for _, *some in wanted.values() for k in some})
    full, parent = F.array_join("path", "."), F.array_join(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), ".")
    rows = table.where(F.size("path").between(1, max(k.count(".") for k in keys) + 2)).withColumn("full", full).withColumn("parent", parent)
    rows = rows.where(F.col("full").isin(keys) | F.col("parent").isin(keys))
    place = F.when(F.element_at("path", -1).rlike("^[0-9]{1,9}$"), F.element_at("path", -1).cast("int"))
    aggregates = []
    for name, (kind, *some) in wanted.items():
        parts = []
        for k in some:
            if kind in SCALARS:
                parts.append(F.max(F.when(F.col("full") == k, SCALARS[kind]())))
            else:
                found = LISTS[kind]()
                listed = F.array_sort(F.collect_list(F.when((F.col("parent") == k) & place.isNotNull() & found.isNotNull(), F.struct(place.alias("k"), found.alias("v")))))
                values = F.transform(listed, lambda x: x["v"])
                single = F.max(F.when(F.col("full") == k, found)) if kind == "names" else F.lit(None)
                parts.append(F.when(F.size(listed) > 0, values).when(single.isNotNull(), F.array(single)))
        aggregates.append(F.coalesce(*parts).alias(name))
    return rows.groupBy("doc_id", "obj_num").agg(*aggregates)


def rect_of(nums: Column) -> Column:
    """struct<left, top, right, bottom> with sorted corners of four numbers, else null."""
    made = F.struct(
        F.least(nums[0], nums[2]).alias("left"), F.least(nums[1], nums[3]).alias("top"), F.greatest(nums[0], nums[2]).alias("right"), F.greatest(nums[1], nums[3]).alias("bottom")
    )
    return F.when(F.size(nums) >= 4, made)


def nearest(tree: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """tree: doc_id, obj_num, ancestors (nearest first). Each attribute of the object itself or of its nearest ancestor that has it: one join for all names."""
    up = tree.select("doc_id", "obj_num", F.posexplode("ancestors").alias("depth", "owner"))
    owned = found.select("doc_id", F.col("obj_num").alias("owner"), *names)
    joined = up.join(owned, ["doc_id", "owner"])
    return joined.groupBy("doc_id", "obj_num").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("depth"))).alias(n) for n in names])


BOXES = {"media_box": ("nums", "MediaBox"), "crop_box": ("nums", "CropBox"), "bleed_box": ("nums", "BleedBox"), "trim_box": ("nums", "TrimBox"), "art_box": ("nums", "ArtBox")}


def page_boxes(table: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_id, page_index, obj_num and the five boxes. Each is inherited; without one, crop is media, the others are crop; media is US letter."""
    found = nearest(tree, attributes(table, BOXES), list(BOXES))
    media = F.coalesce(rect_of(F.col("media_box")), rect_of(F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0)))))
    out = tree.join(found, ["doc_id", "obj_num"], "left").withColumn("media_box", media).withColumn("crop_box", F.coalesce(rect_of(F.col("crop_box")), F.col("media_box")))
    for name in ("bleed_box", "trim_box", "art_box"):
        out = out.withColumn(name, F.coalesce(rect_of(F.col(name)), F.col("crop_box")))
    return out.select("doc_id", "page_index", "obj_num", *BOXES)


def named_resources(table: DataFrame, category: str) -> DataFrame:
    """(doc_id, owner, name, ref_obj): what the resources of a page, page tree node or form call by a name. category: Font, XObject, Pattern, Shading ..."""
    part = lambda k: F.get("path", F.lit(k))
    refs = table.where(F.col("kind") == "ref")
    direct = refs.where((F.size("path") == 3) & (part(0) == "Resources") & (part(1) == category)).select("doc_id", F.col("obj_num").alias("owner"), part(2).alias("name"), "ref_obj")
    listed = refs.where((F.size("path") == 2) & (part(0) == category)).select("doc_id", F.col("obj_num").alias("held"), part(1).alias("name"), "ref_obj")
    elsewhere = refs.where(F.array_join("path", ".") == "Resources").select("doc_id", F.col("obj_num").alias("owner"), F.col("ref_obj").alias("held"))
    apart = refs.where(F.array_join("path", ".") == f"Resources.{category}").select("doc_id", F.col("obj_num").alias("owner"), F.col("ref_obj").alias("held"))
    top = refs.where(F.size("path") == 1).select("doc_id", F.col("obj_num").alias("held"), part(0).alias("name"), "ref_obj")
    return direct.unionByName(elsewhere.join(listed, ["doc_id", "held"]).drop("held")).unionByName(apart.join(top, ["doc_id", "held"]).drop("held"))


def resources(table: DataFrame, tree: DataFrame, category: str) -> DataFrame:
    """(doc_id, obj_num, name, ref_obj): what a page's own or inherited resources call by a name."""
    owners = inherited(tree, table, "Resources")
    return owners.join(named_resources(table, category), ["doc_id", "owner"]).select("doc_id", "obj_num", "name", "ref_obj")


def fonts(table: DataFrame) -> DataFrame:
    """doc_id, obj_num, subtype, base_font, encoding, first_char, widths of font objects."""
    found = attributes(
        table,
        {"type": ("name", "Type"), "subtype": ("name", "Subtype"), "base_font": ("name", "BaseFont"), "encoding": ("name", "Encoding"), "first_char": ("int", "FirstChar"), "widths": ("nums", "Widths")},
    )
    return found.where("type = 'Font'").drop("type")


def text_fonts(objects: DataFrame, pages: DataFrame, named: DataFrame, found: DataFrame) -> DataFrame:
    """Text rows with the base font that their page's resources give their font's name. An equi-join on document, page and name."""
    shown = objects.where("type = 'text'").join(pages.select("doc_id", "page_index", "obj_num"), ["doc_id", "page_index"])
    by_name = named.withColumnRenamed("name", "font").join(found.select("doc_id", F.col("obj_num").alias("ref_obj"), "base_font"), ["doc_id", "ref_obj"], "left")
    return shown.join(by_name, ["doc_id", "obj_num", "font"], "left").select("doc_id", "page_index", "seq", "font", "base_font", "size")


def char_widths(chars: DataFrame, found: DataFrame) -> DataFrame:
    """chars: doc_id, font_obj, code, ... Adds ``width`` in thousandths: the font's entry for the code, 500 without one."""
    w = found.select("doc_id", F.col("obj_num").alias("font_obj"), "first_char", "widths")
    at = F.col("code") - F.coalesce("first_char", F.lit(0))
    joined = chars.join(w, ["doc_id", "font_obj"], "left")
    return joined.withColumn("width", F.coalesce(F.when(at >= 0, F.get("widths", at.cast("int"))), F.lit(500.0))).drop("first_char", "widths")


def compression(filters: Column) -> Column:
    """Of an image, by its last filter: one of COMPRESSIONS, ``none`` without filters, else ``unknown``."""
    last = F.try_element_at(filters, F.lit(-1))
    known = F.create_map(*[F.lit(x) for pair in COMPRESSIONS.items() for x in pair])
    return F.when(last.isNull(), "none").otherwise(F.coalesce(known[last], F.lit("unknown")))


def has_filter(filters: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(filters, name), F.lit(False))


def images(table: DataFrame) -> DataFrame:
    """Image XObjects: size, bits, mask, interpolation, colour space, decode array, soft mask, filters and compression. Short keys of inline images serve too."""
    found = attributes(
        table,
        {
            "subtype": ("name", "Subtype"), "width": ("int", "Width", "W"), "height": ("int", "Height", "H"), "bits": ("int", "BitsPerComponent", "BPC"), "is_mask": ("bool", "ImageMask", "IM"),
            "interpolate": ("bool", "Interpolate", "I"), "space": ("name", "ColorSpace", "CS"), "spaces": ("names", "ColorSpace", "CS"), "decode": ("nums", "Decode", "D"), "soft_mask": ("ref", "SMask"),
            "matte": ("nums", "Matte"), "filters": ("names", "Filter", "F"),
        },
    )
    made = found.where("subtype = 'Image'").drop("subtype").withColumn("space", F.coalesce("space", F.get("spaces", F.lit(0)))).drop("spaces")
    bits = F.when(F.coalesce("is_mask", F.lit(False)), 1).otherwise(F.coalesce("bits", F.lit(8)))
    return made.withColumn("bits", bits.cast("long")).withColumn("is_mask", F.coalesce("is_mask", F.lit(False))).withColumn("interpolate", F.coalesce("interpolate", F.lit(False))).withColumn("compression", compression(F.col("filters")))


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _matrix(c: Column) -> Column:
    return F.when(F.size(c) == 6, c).otherwise(F.array(*map(F.lit, UNIT)))


def form_xobjects(table: DataFrame) -> DataFrame:
    """doc_id, obj_num, box (the declared one), matrix, group (its subtype), transparent of form XObjects."""
    found = attributes(table, {"subtype": ("name", "Subtype"), "box": ("nums", "BBox"), "matrix": ("nums", "Matrix"), "group": ("name", "Group.S")})
    made = found.where("subtype = 'Form'")
    return made.select("doc_id", "obj_num", rect_of(F.col("box")).alias("box"), _matrix(F.col("matrix")).alias("matrix"), "group", F.coalesce(F.col("group") == "Transparency", F.lit(False)).alias("transparent"))


def form_contents(table: DataFrame, streams: DataFrame) -> DataFrame:
    """(doc_id, page_index, data) of form XObjects, ``page_index`` being their object number: what ``content`` makes of pages it makes of these."""
    return form_xobjects(table).join(streams, ["doc_id", "obj_num"]).select("doc_id", F.col("obj_num").alias("page_index"), "data")


def tiling_patterns(table: DataFrame) -> DataFrame:
    """doc_id, obj_num, paint (colored or uncolored), tiling (1 to 3), box, x_step, y_step, matrix."""
    wanted = {
        "kind_of": ("int", "PatternType"), "paint": ("int", "PaintType"), "tiling": ("int", "TilingType"), "box": ("nums", "BBox"), "x_step": ("num", "XStep"), "y_step": ("num", "YStep"),
        "matrix": ("nums", "Matrix"),
    }
    made = attributes(table, wanted).where("kind_of = 1")
    paint = F.when(F.col("paint") == 2, "uncolored").otherwise("colored")
    return made.select("doc_id", "obj_num", paint.alias("paint"), F.coalesce("tiling", F.lit(1)).alias("tiling"), rect_of(F.col("box")).alias("box"), "x_step", "y_step", _matrix(F.col("matrix")).alias("matrix"))


def shadings(table: DataFrame) -> DataFrame:
    """doc_id, obj_num, type (one of SHADINGS), space, background, coords, extend_start, extend_end, domain of shading dictionaries."""
    wanted = {
        "n": ("int", "ShadingType"), "space": ("name", "ColorSpace"), "background": ("nums", "Background"), "coords": ("nums", "Coords"), "extend": ("flags", "Extend"), "domain": ("nums", "Domain"),
    }
    made = attributes(table, wanted).where(F.col("n").between(1, len(SHADINGS)))
    kind = F.get(F.array(*map(F.lit, SHADINGS)), (F.col("n") - 1).cast("int"))
    ends = [F.coalesce(F.get("extend", F.lit(k)), F.lit(False)) for k in (0, 1)]
    domain = F.coalesce("domain", F.array(F.lit(0.0), F.lit(1.0)))
    return made.select("doc_id", "obj_num", kind.alias("type"), "space", "background", "coords", ends[0].alias("extend_start"), ends[1].alias("extend_end"), domain.alias("domain"))


def trailers(table: DataFrame) -> DataFrame:
    """doc_id, root, info, encrypt (object numbers, null unless references), size, ids (hex where they are no text) of the newest trailer."""
    found = attributes(table.where(F.col("obj_num") == TRAILER), {"root": ("ref", "Root"), "info": ("ref", "Info"), "encrypt": ("ref", "Encrypt"), "size": ("int", "Size"), "ids": ("texts", "ID")})
    return found.drop("obj_num")


def form_settings(table: DataFrame) -> DataFrame:
    """(doc_id, need_appearances, signatures_exist, append_only, default_appearance, quadding) of interactive forms, direct or referred to by the catalog."""
    names = {"need_appearances": ("bool", "NeedAppearances"), "signatures": ("int", "SigFlags"), "default_appearance": ("text", "DA"), "quadding": ("int", "Q")}
    refs = table.where((F.array_join("path", ".") == "AcroForm") & F.col("ref_obj").isNotNull()).select("doc_id", F.col("ref_obj").alias("obj_num"))
    far = attributes(table, names).join(refs, ["doc_id", "obj_num"])
    near = attributes(table, {n: (t, f"AcroForm.{k}") for n, (t, k) in names.items()})
    signatures = F.coalesce("signatures", F.lit(0))
    return far.unionByName(near).select(
        "doc_id", F.coalesce("need_appearances", F.lit(False)).alias("need_appearances"), (signatures.bitwiseAND(1) != 0).alias("signatures_exist"),
        (signatures.bitwiseAND(2) != 0).alias("append_only"), "default_appearance", F.coalesce("quadding", F.lit(0)).alias("quadding"),
    )


def choice_options(table: DataFrame) -> DataFrame:
    """(doc_id, obj_num, place, export, display): an option is a string, or a pair of export value and text shown."""
    rows = table.where((F.get("path", F.lit(0)) == "Opt") & F.size("path").between(2, 3) & F.col("s").isNotNull())
    value, inner = T.decode_text(F.col("s")), F.get("path", F.lit(2))
    one = rows.groupBy("doc_id", "obj_num", F.get("path", F.lit(1)).cast("int").alias("place")).agg(
        F.max(F.when(inner.isNull() | (inner == "0"), value)).alias("export"), F.max(F.when(inner.isNull() | (inner == "1"), value)).alias("display")
    )
    return one.select("doc_id", "obj_num", "place", "export", F.coalesce("display", "export").alias("display"))


def controls(table: DataFrame) -> DataFrame:
    """Widgets: state, rect, border and background colours, captions, rotation, and the value that a set button exports."""
    wanted = {
        "subtype": ("name", "Subtype"), "state": ("name", "AS"), "rect": ("nums", "Rect"), "background": ("nums", "MK.BG"), "border": ("nums", "MK.BC"), "caption": ("text", "MK.CA"),
        "rollover": ("text", "MK.RC"), "pressed": ("text", "MK.AC"), "rotation": ("int", "MK.R"),
    }
    made = attributes(table, wanted).where("subtype = 'Widget'").drop("subtype").withColumn("rect", rect_of(F.col("rect"))).withColumn("rotation", F.coalesce("rotation", F.lit(0)))
    states = table.where((F.size("path") == 3) & (F.get("path", F.lit(0)) == "AP") & (F.get("path", F.lit(1)) == "N") & (F.get("path", F.lit(2)) != "Off"))
    on = states.groupBy("doc_id", "obj_num").agg(F.min(F.get("path", F.lit(2))).alias("export"))
    return made.join(on, ["doc_id", "obj_num"], "left").withColumn("export", F.coalesce("export", F.lit("Yes")))


def actions(table: DataFrame) -> DataFrame:
    """(doc_id, obj_num, kind, uri, script, named, dest_page, fit, next_kind) of the action that an annotation or object has under A, or is itself.

    dest_page: the page object of a destination array, or its number; fit: its kind, such as XYZ or FitH.
    """

    def of(prefix: str) -> DataFrame:
        p = f"{prefix}." if prefix else ""
        wanted = {
            "kind": ("name", f"{p}S"), "uri": ("text", f"{p}URI"), "script": ("text", f"{p}JS"), "named": ("name", f"{p}N"), "next_kind": ("name", f"{p}Next.S"), "pages": ("refs", f"{p}D"),
            "places": ("nums", f"{p}D"), "fits": ("names", f"{p}D"), "is_action": ("name", f"{p}Type"),
        }
        found = attributes(table, wanted)
        return found.where("kind IS NOT NULL") if prefix else found.where("kind IS NOT NULL AND is_action = 'Action'")

    made = of("A").unionByName(of(""))
    page = F.coalesce(F.get("pages", F.lit(0)).cast("long"), F.get("places", F.lit(0)).cast("long"))
    return made.select("doc_id", "obj_num", "kind", "uri", "script", "named", F.when(F.col("kind") == "GoTo", page).alias("dest_page"), F.when(F.col("kind") == "GoTo", F.get("fits", F.lit(0))).alias("fit"), "next_kind")
