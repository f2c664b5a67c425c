"""Queries over documents with forms, annotations, images and patterns, made of the rows of ``part``; the SQL says what must be read back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import content, forms, images, objects
from .plans.extract import Documents
from .queries import _dealt, _t, query
from .sources import pdf


def _body(template: str, **columns: Column) -> Column:
    """Text with @name@ where a column's text goes."""
    parts = re.split(r"@(\w+)@", template)
    return F.concat(*[columns[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x or k % 2])


def _made(spark, sf_dir: str) -> DataFrame:
    name, brand, kind = (T.string_object(F.col(c)) for c in ("p_name", "p_brand", "p_type"))
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")

    def text(template: str) -> Column:
        return _body(template, name=name, brand=brand, kind=kind, size=size, key=key, sig=(F.col("p_size") % 4).cast("string"), q=(F.col("p_size") % 3).cast("string"), f=F.when(F.col("p_partkey") % 2 == 0, "4").otherwise("6"))

    def stream(entries: str, data: str) -> pdf.Bytes:
        return pdf.stream_body(F.encode(text(data), "ISO-8859-1"), text(entries))

    pixels = F.concat(F.hex(F.encode("p_name", "ISO-8859-1")), F.lit(">"))
    bodies = [
        text("<< /Type /Catalog /Pages 2 0 R /AcroForm 6 0 R >>"),
        text("<< /Type /Pages /Kids 12 0 R /Count 1 /MediaBox 22 0 R /Resources << /Font << /F1 5 0 R >> /XObject 23 0 R >> >>"),
        text("<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots 7 0 R /CropBox [1 2 150 300] /TrimBox [90 80 5 @size@] >>"),
        stream("", "BT /F1 12 Tf 100 700 Td @name@ Tj ET q 2 0 0 3 5 7 cm 1 2 m @size@ 40 l S Q BT /F1 10 Tf 1 0 0 1 100 600 Tm (a) Tj 1 0 0 1 130 600 Tm (b) Tj 1 0 0 1 100 550 Tm (c) Tj ET"),
        text("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 65 /Widths [600 @size@ 700] >>"),
        text("<< /Fields [8 0 R 9 0 R 10 0 R] /NeedAppearances true /SigFlags @sig@ /DA (/F1 0 Tf) /Q @q@ >>"),
        text("[11 0 R 15 0 R]"),
        text("<< /FT /Tx /T (name) /V @name@ /MaxLen @size@ /TU (tip) /Q 2 >>"),
        text("<< /FT /Ch /T (brand) /Ff 131072 /V @brand@ /Opt [[(b) (Big)] (small) [@brand@ @kind@]] >>"),
        text("<< /T (group) /FT /Btn /Kids [16 0 R] /DA (own) /TM (map) >>"),
        text("<< /Type /Annot /Subtype /Link /Rect [30 40 10 @size@] /F @f@ /A << /S /URI /URI (http://x/@key@) >> >>"),
        text("[3 0 R]"),
        pdf.stream_body(F.encode(pixels, "ISO-8859-1"), text(" /Type /XObject /Subtype /Image /Width @size@ /Height 2 /BitsPerComponent 4 /ColorSpace /DeviceGray /Filter [/ASCIIHexDecode] /Decode [1 0] /SMask 13 0 R")),
        stream(" /Type /XObject /Subtype /Form /BBox [5 6 1 2] /Matrix [1 0 0 1 @size@ 0] /Group << /S /Transparency >>", "BT /F1 8 Tf @brand@ Tj ET"),
        text("<< /Subtype /Widget /Rect [1 1 9 9] /AS /Go /AP << /N << /Off 4 0 R /Go 4 0 R >> >> /MK << /CA @brand@ /BG [1 0 0] /R 90 >> /F 2 >>"),
        text("<< /T (sub) /Parent 10 0 R /V /Go >>"),
        stream(" /PatternType 1 /PaintType 2 /TilingType 3 /BBox [0 0 10 @size@] /XStep 10 /YStep @size@", "0 0 1 1 re f"),
        text("<< /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 1 @size@] /Extend [true false] /Background [1 1 1] >>"),
        text("<< /Type /Action /S /GoTo /D [3 0 R /FitH @size@] /Next << /S /Named /N /NextPage >> >>"),
        text("<< /Type /Action /S /JavaScript /JS @kind@ >>"),
        text("<< /Title @name@ /Author @brand@ /Same 24 0 R >>"),
        text("[0 0 200 400]"),
        text("<< /Im1 13 0 R /Fm1 14 0 R >>"),
        text("@kind@"),
    ]
    docs = _dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pdf.assembled(bodies, " /Info 21 0 R /ID [<FF01> <FF02>]").alias("content"))
    return docs


def _documents(spark, sf_dir: str) -> Documents:
    return Documents(_made(spark, sf_dir))


@query("SELECT p_partkey AS doc_id, 1 AS root, 21 AS info, NULL::INT AS encrypt, 25::BIGINT AS size, 'ÿ' || chr(1) AS first_id FROM part")
def trailer_info(spark, sf_dir):
    found = objects.trailers(_documents(spark, sf_dir).nodes)
    return found.select("doc_id", "root", "info", "encrypt", "size", F.get("ids", F.lit(0)).alias("first_id"))


@query("SELECT p_partkey AS doc_id, k AS key, CASE k WHEN 'Title' THEN p_name ELSE p_brand END AS value FROM part, (VALUES ('Title'), ('Author')) AS v(k)")
def metadata(spark, sf_dir):
    return pdf.metadata(_documents(spark, sf_dir).nodes)


@query("SELECT p_partkey AS doc_id, k AS key, CASE k WHEN 'Title' THEN p_name WHEN 'Author' THEN p_brand ELSE p_type END AS value FROM part, (VALUES ('Title'), ('Author'), ('Same')) AS v(k)")
def ref_resolution(spark, sf_dir):
    nodes = _documents(spark, sf_dir).nodes
    entries = pdf.entries_of(nodes, "Title", "Author", "Same")
    return pdf.resolved(nodes, entries).where("obj_num = 21").select("doc_id", "key", T.decode_text(F.col("s")).alias("value"))


@query(
    """SELECT p_partkey AS doc_id, 0 AS page_index, 200.0::DOUBLE AS media_right, 400.0::DOUBLE AS media_bottom, 150.0::DOUBLE AS crop_right, 150.0::DOUBLE AS bleed_right,
       5.0::DOUBLE AS trim_left, least(80, p_size)::DOUBLE AS trim_top, greatest(80, p_size)::DOUBLE AS trim_bottom, 1.0::DOUBLE AS art_left FROM part"""
)
def page_boxes(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return objects.page_boxes(d.nodes, d.tree).select(
        "doc_id", "page_index", F.col("media_box.right").alias("media_right"), F.col("media_box.bottom").alias("media_bottom"), F.col("crop_box.right").alias("crop_right"),
        F.col("bleed_box.right").alias("bleed_right"), F.col("trim_box.left").alias("trim_left"), F.col("trim_box.top").alias("trim_top"), F.col("trim_box.bottom").alias("trim_bottom"),
        F.col("art_box.left").alias("art_left"),
    )


@query("SELECT p_partkey AS doc_id, c AS category, n AS name, o::INT AS ref_obj FROM part, (VALUES ('Font', 'F1', 5), ('XObject', 'Im1', 13), ('XObject', 'Fm1', 14)) AS v(c, n, o)")
def page_resources(spark, sf_dir):
    d = _documents(spark, sf_dir)
    both = [objects.resources(d.nodes, d.tree, c).select("doc_id", F.lit(c).alias("category"), "name", "ref_obj") for c in ("Font", "XObject")]
    return both[0].unionByName(both[1])


@query("SELECT p_partkey AS doc_id, 'Helvetica' AS base_font, 'WinAnsiEncoding' AS encoding, count(*) AS n FROM part, range(4) GROUP BY ALL")
def text_fonts(spark, sf_dir):
    d = _documents(spark, sf_dir)
    found = objects.fonts(d.nodes)
    shown = objects.text_fonts(d.objects, d.pages, objects.resources(d.nodes, d.tree, "Font"), found)
    return shown.join(found.select("doc_id", "base_font", "encoding"), ["doc_id", "base_font"]).groupBy("doc_id", "base_font", "encoding").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS doc_id, c::INT AS code, CASE c WHEN 65 THEN 600.0 WHEN 66 THEN p_size WHEN 67 THEN 700 ELSE 500 END::DOUBLE AS width FROM part, range(64, 69) AS r(c)")
def char_widths(spark, sf_dir):
    codes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(5).alias("font_obj"), F.explode(F.sequence(F.lit(64), F.lit(68))).alias("code"))
    return objects.char_widths(codes, objects.fonts(_documents(spark, sf_dir).nodes)).select("doc_id", "code", "width")


@query(
    """SELECT p_partkey AS doc_id, f AS full_name, CASE f WHEN 'name' THEN 'text' WHEN 'brand' THEN 'combo_box' ELSE 'check_box' END AS type, CASE f WHEN 'brand' THEN 131072 ELSE 0 END::BIGINT AS flags,
       CASE f WHEN 'name' THEN p_name WHEN 'brand' THEN p_brand ELSE 'Go' END AS value, CASE f WHEN 'name' THEN 'tip' END AS alternate_name, CASE f WHEN 'group.sub' THEN 'map' END AS mapping_name,
       CASE f WHEN 'group.sub' THEN 'own' END AS default_appearance, CASE f WHEN 'name' THEN 2 END::BIGINT AS quadding, CASE f WHEN 'name' THEN p_size END::BIGINT AS max_length
       FROM part, (VALUES ('name'), ('brand'), ('group.sub')) AS v(f)"""
)
def form_fields(spark, sf_dir):
    names = "full_name type flags value alternate_name mapping_name default_appearance quadding max_length".split()
    return forms.fields(_documents(spark, sf_dir).nodes).select("doc_id", *names)


@query("SELECT p_partkey AS doc_id, p_brand AS value FROM part WHERE p_partkey % 2 = 0")
def field_by_name(spark, sf_dir):
    wanted = _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.lit("brand").alias("full_name"))
    return forms.by_name(forms.fields(_documents(spark, sf_dir).nodes), wanted).select("doc_id", "value")


@query("SELECT p_partkey AS doc_id, k::INT AS place, CASE k WHEN 0 THEN 'b' WHEN 1 THEN 'small' ELSE p_brand END AS export, CASE k WHEN 0 THEN 'Big' WHEN 1 THEN 'small' ELSE p_type END AS display FROM part, range(3) AS r(k)")
def choice_options(spark, sf_dir):
    return objects.choice_options(_documents(spark, sf_dir).nodes).select("doc_id", "place", "export", "display")


@query(
    """SELECT p_partkey AS doc_id, true AS need_appearances, p_size % 4 IN (1, 3) AS signatures_exist, p_size % 4 IN (2, 3) AS append_only, '/F1 0 Tf' AS default_appearance,
       (p_size % 3)::BIGINT AS quadding FROM part"""
)
def form_settings(spark, sf_dir):
    return objects.form_settings(_documents(spark, sf_dir).nodes)


@query("SELECT p_partkey AS doc_id, 'Go' AS state, 'Go' AS export, p_brand AS caption, 90::BIGINT AS rotation, 1.0::DOUBLE AS red, 8.0::DOUBLE AS width FROM part")
def widget_controls(spark, sf_dir):
    found = objects.controls(_documents(spark, sf_dir).nodes)
    return found.select("doc_id", "state", "export", "caption", "rotation", F.col("background")[0].alias("red"), F.expr("rect.right - rect.left").alias("width"))


@query(
    """SELECT p_partkey AS doc_id, k::INT AS annot_seq, CASE k WHEN 0 THEN 'Link' ELSE 'Widget' END AS subtype, CASE k WHEN 0 THEN 'http://x/' || p_partkey END AS uri,
       CASE k WHEN 0 THEN least(40, p_size) ELSE 1 END::DOUBLE AS top, k = 0 AND p_partkey % 2 = 0 AS seen, k = 0 AND p_partkey % 2 = 0 AS printed, k = 1 AS hit
       FROM part, range(2) AS r(k)"""
)
def annotation_rows(spark, sf_dir):
    d = _documents(spark, sf_dir)
    found = forms.annotations(d.nodes, d.pages)
    keys = ["doc_id", "annot_seq"]
    marks = [f(found).select(*keys, F.lit(True).alias(n)) for n, f in (("seen", forms.visible), ("printed", forms.printable), ("hit", lambda a: forms.at_point(a, 5, 5)))]
    out = found.select(*keys, "subtype", "uri", F.col("rect.top").alias("top"))
    for m in marks:
        out = out.join(m, keys, "left")
    return out.select(*keys, "subtype", "uri", "top", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("seen", "printed", "hit")])


@query(
    """SELECT p_partkey AS doc_id, o::INT AS obj_num, k AS kind, CASE k WHEN 'URI' THEN 'http://x/' || p_partkey END AS uri, CASE k WHEN 'JavaScript' THEN p_type END AS script,
       CASE k WHEN 'GoTo' THEN 3 END::BIGINT AS dest_page, CASE k WHEN 'GoTo' THEN 'FitH' END AS fit, CASE k WHEN 'GoTo' THEN 'Named' END AS next_kind
       FROM part, (VALUES (11, 'URI'), (19, 'GoTo'), (20, 'JavaScript')) AS v(o, k)"""
)
def annotation_actions(spark, sf_dir):
    return objects.actions(_documents(spark, sf_dir).nodes).select("doc_id", "obj_num", "kind", "uri", "script", "dest_page", "fit", "next_kind")


@query(
    """SELECT p_partkey AS doc_id, p_size::BIGINT AS width, 2::BIGINT AS height, 4::BIGINT AS bits, false AS is_mask, 'DeviceGray' AS space, 1.0::DOUBLE AS low, 13 AS soft_mask, 'ascii_hex' AS compression,
       false AS flate FROM part"""
)
def image_attributes(spark, sf_dir):
    found = objects.images(_documents(spark, sf_dir).nodes)
    return found.select("doc_id", "width", "height", "bits", "is_mask", "space", F.col("decode")[0].alias("low"), "soft_mask", "compression", objects.has_filter(F.col("filters"), "FlateDecode").alias("flate"))


@query(
    """WITH s AS (SELECT p_partkey AS doc_id, p_name, p_size, y, unnest(range(p_size)) AS x FROM part, range(2) AS r(y)), b AS (SELECT *, y * ((p_size + 1) // 2) + x // 2 AS pos FROM s)
       SELECT doc_id, x::INT AS x, y::INT AS y, CASE WHEN pos < length(p_name) THEN (ascii(substr(p_name, pos::INT + 1, 1)) >> (4 - 4 * (x % 2))::INT) & 15 END::INT AS v FROM b"""
)
def image_rows(spark, sf_dir):
    """Every sample of the images at their own size; those that the data is too short for are null."""
    d = _documents(spark, sf_dir)
    found = objects.images(d.nodes).join(pdf.streams(d.nodes).select("doc_id", "obj_num", "data"), ["doc_id", "obj_num"])
    made = found.select(F.col("doc_id").alias("img_id"), "data", *[F.col(c).cast("int").alias(c) for c in ("width", "height", "bits")], F.lit(1).alias("components"))
    return images.samples(made).select(F.col("img_id").alias("doc_id"), "x", "y", "v")


@query("SELECT p_partkey AS doc_id, 1.0::DOUBLE AS x1, 6.0::DOUBLE AS y2, p_size::DOUBLE AS dx, 'Transparency' AS group_kind, true AS transparent FROM part")
def form_xobjects(spark, sf_dir):
    found = objects.form_xobjects(_documents(spark, sf_dir).nodes)
    return found.select("doc_id", F.col("box.left").alias("x1"), F.col("box.bottom").alias("y2"), F.col("matrix")[4].alias("dx"), F.col("group").alias("group_kind"), "transparent")


@query("SELECT p_partkey AS doc_id, 14 AS obj_num, p_brand AS text FROM part")
def form_xobject_text(spark, sf_dir):
    d = _documents(spark, sf_dir)
    shown = content.page_text(content.page_objects(objects.form_contents(d.nodes, pdf.streams(d.nodes))))
    return shown.select("doc_id", F.col("page_index").alias("obj_num"), "text")


@query("SELECT p_partkey AS doc_id, 'uncolored' AS paint, 3::BIGINT AS tiling, p_size::DOUBLE AS bottom, 10.0::DOUBLE AS x_step, p_size::DOUBLE AS y_step FROM part")
def tiling_patterns(spark, sf_dir):
    return objects.tiling_patterns(_documents(spark, sf_dir).nodes).select("doc_id", "paint", "tiling", F.col("box.bottom").alias("bottom"), "x_step", "y_step")


@query("SELECT p_partkey AS doc_id, 'axial' AS type, 'DeviceRGB' AS space, p_size::DOUBLE AS y2, true AS extend_start, false AS extend_end, 1.0::DOUBLE AS t2 FROM part")
def shadings(spark, sf_dir):
    found = objects.shadings(_documents(spark, sf_dir).nodes)
    return found.select("doc_id", "type", "space", F.col("coords")[3].alias("y2"), "extend_start", "extend_end", F.col("domain")[1].alias("t2"))


@query("SELECT p_partkey AS doc_id, least(1, p_size)::DOUBLE AS x1, greatest(1, p_size)::DOUBLE AS x2, 2.0::DOUBLE AS y1, 40.0::DOUBLE AS y2, 5.0::DOUBLE AS dx FROM part")
def path_bounds(spark, sf_dir):
    shown = _documents(spark, sf_dir).objects
    box = content.path_bounds(shown).join(shown.where("type = 'path'").select("doc_id", "page_index", "seq", F.col("matrix.e").alias("dx")), ["doc_id", "page_index", "seq"])
    return box.select("doc_id", F.col("box.left").alias("x1"), F.col("box.right").alias("x2"), F.col("box.top").alias("y1"), F.col("box.bottom").alias("y2"), "dx")


@query("SELECT p_partkey AS doc_id, k::BIGINT AS place, CASE k WHEN 1 THEN p_name WHEN 2 THEN 'a b' ELSE 'c' END AS text FROM part, range(1, 4) AS r(k)")
def reading_order(spark, sf_dir):
    lines = content.line_text(content.characters(_documents(spark, sf_dir).objects))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("place"), F.trim("text").alias("text"))
