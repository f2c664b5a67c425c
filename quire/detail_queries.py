"""Queries over links between fields, states of drawing, turned pages, rows of samples, single pixels and fixed-point numbers, and the SQL that says what they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import color as C
from .functions import geometry as G
from .functions import sniff
from .functions import text as T
from .operators import content, crypto, forms, images, raster
from .page_queries import _parts
from .plans.extract import Documents
from .queries import _dealt, _t, query
from .sources import filters, pdf


def _form(spark, sf_dir: str, fields: list) -> Documents:
    """A document a row of ``part`` whose form, object 4, comes before its fields, which are objects from 5 on; the first entry lists the form's own fields."""
    listed, *bodies = fields
    head = ["<< /Type /Catalog /Pages 2 0 R /AcroForm 4 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R >>", f"<< /Fields [{listed}] >>"]
    every = [F.lit(b) if isinstance(b, str) else b for b in [*head, *bodies]]
    return Documents(_dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pdf.assembled(every).alias("content")))


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, p_name, p_size % 2 = 0 AS even FROM part)
       SELECT doc_id, 5 AS obj_num, p_name AS full_name, NULL::INT AS parent_obj, '' AS children, '5' AS controls, 0 AS place FROM p
       UNION ALL SELECT doc_id, 6, 'group', NULL, CASE WHEN even THEN '7,8,9' ELSE '7,9' END, CASE WHEN even THEN '' ELSE '8' END, CASE WHEN even THEN 4 ELSE 3 END FROM p
       UNION ALL SELECT doc_id, 7, 'group.sub', 6, '', '11,10', 1 FROM p
       UNION ALL SELECT doc_id, 8, 'group.w', 6, '', '8', 2 FROM p WHERE even
       UNION ALL SELECT doc_id, 9, 'group.x', 6, '', '9', CASE WHEN even THEN 3 ELSE 2 END FROM p"""
)
def field_links(spark, sf_dir):
    """Parents, children and controls of fields, and their places in the form's list. The kid 8 is a field in half of the documents and a control in the others."""
    kid = F.when(F.col("p_size") % 2 == 0, "<< /T (w) /Parent 6 0 R >>").otherwise("<< /Subtype /Widget /Parent 6 0 R >>")
    widget = "<< /Subtype /Widget /Parent 7 0 R /Rect [0 0 1 1] >>"
    d = _form(spark, sf_dir, [
        "5 0 R 6 0 R", F.concat(F.lit("<< /FT /Tx /T "), T.string_object(F.col("p_name")), F.lit(" >>")), "<< /T (group) /FT /Btn /Kids [7 0 R 8 0 R 9 0 R] >>",
        "<< /T (sub) /Parent 6 0 R /Kids [11 0 R 10 0 R] >>", kid, "<< /FT /Btn /T (x) /Subtype /Widget /Parent 6 0 R >>", widget, widget,
    ])
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return forms.field_links(d.nodes).select("doc_id", "obj_num", "full_name", "parent_obj", joined("children"), joined("controls"), "place")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS full_name FROM part WHERE p_size % 3 < 2")
def form_list_entry(spark, sf_dir):
    """The field at a place of each form's list; no row past its end."""
    d = _form(spark, sf_dir, ["5 0 R 6 0 R", *[F.concat(F.lit("<< /FT /Tx /T "), T.string_object(F.col(c)), F.lit(" >>")) for c in ("p_type", "p_name")]])
    wanted = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 3).cast("int").alias("place"))
    return forms.field_at(forms.field_links(d.nodes), wanted).select("doc_id", "full_name")


@query(
    """WITH f AS (SELECT p_partkey AS doc_id, 'a' AS full_name, CASE p_size % 3 WHEN 0 THEN 'push_button' WHEN 1 THEN 'radio_button' ELSE 'check_box' END AS type FROM part
       UNION ALL SELECT p_partkey, 'b', CASE p_size % 2 WHEN 1 THEN 'combo_box' ELSE 'list_box' END FROM part UNION ALL SELECT p_partkey, 'c', CASE p_partkey % 2 WHEN 1 THEN 'signature' ELSE 'text' END FROM part)
       SELECT doc_id, 'buttons' AS asked, full_name, type FROM f WHERE type IN ('push_button', 'radio_button', 'check_box') UNION ALL SELECT doc_id, 'lists', full_name, type FROM f WHERE type = 'list_box'
       UNION ALL SELECT doc_id, 'others', full_name, type FROM f WHERE type IN ('combo_box', 'signature', 'text')"""
)
def fields_of_types(spark, sf_dir):
    n = F.col("p_size")
    button = F.concat(F.lit("<< /FT /Btn /T (a) /Ff "), F.when(n % 3 == 0, "65536").when(n % 3 == 1, "32768").otherwise("0"), F.lit(" >>"))
    choice = F.concat(F.lit("<< /FT /Ch /T (b) /Ff "), (n % 2 * 131072).cast("string"), F.lit(" >>"))
    other = F.when(F.col("p_partkey") % 2 == 1, "<< /FT /Sig /T (c) >>").otherwise("<< /FT /Tx /T (c) >>")
    found = forms.fields(_form(spark, sf_dir, ["5 0 R 6 0 R 7 0 R", button, choice, other]).nodes)
    asked = {"buttons": ("push_button", "radio_button", "check_box"), "lists": ("list_box",), "others": ("combo_box", "signature", "text")}
    made = [forms.of_type(found, *types).select("doc_id", F.lit(name).alias("asked"), "full_name", "type") for name, types in asked.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, p_size::DOUBLE AS n FROM part),
       v(seq, type, paint, fill, stroke, n_segments, mode, k) AS (VALUES (0, 'path', 'f', '1.0,0.0,0.0', '0.25,0.5,1.0', 5, 0, 0), (1, 'path', 's', '0.5', '0.25,0.5,1.0', 3, 0, 0), (2, 'text', NULL, '0.5', '0.25,0.5,1.0', NULL, 1, 1),
       (3, 'text', NULL, '0.5', '0.25,0.5,1.0', NULL, 1, 2), (4, 'text', NULL, '0.5', '0.25,0.5,1.0', NULL, 1, 3), (5, 'text', NULL, '0.5', '0.25,0.5,1.0', NULL, 1, 4), (6, 'path', 'B*', '0.1,0.2,0.3,0.4', '0.4,0.3,0.2,0.1', 5, 1, 5))
       SELECT doc_id, seq, type, paint, fill, stroke, n_segments, mode AS render_mode, (CASE WHEN k = 0 THEN 0 WHEN k < 4 THEN n ELSE 4 END)::DOUBLE AS char_space, (CASE WHEN k = 0 THEN 0 WHEN k < 4 THEN 1 ELSE 3 END)::DOUBLE AS word_space,
       (CASE WHEN k = 0 THEN 1 ELSE 0.5 END)::DOUBLE AS scale, (CASE WHEN k IN (0, 5) THEN 0 ELSE 10 END)::DOUBLE AS x, (CASE k WHEN 1 THEN 700 WHEN 2 THEN 700 - n WHEN 3 THEN 660 - n WHEN 4 THEN 640 - n ELSE 0 END)::DOUBLE AS y FROM p, v"""
)
def drawing_states(spark, sf_dir):
    """Colours, text parameters and places of what a page draws, saved and restored; a path that ends with n isn't drawn."""
    size = F.col("p_size").cast("string")
    shown = F.concat(
        F.lit("0.5 g 0.25 0.5 1 RG q 1 0 0 rg 0 0 1 1 re f Q 2 3 m 4 5 l s 7 7 m 8 8 l n BT /F1 9 Tf "), size, F.lit(" Tc 1 Tw 50 Tz 3 Ts 1 Tr "), size,
        F.lit(" TL 10 700 Td (a) Tj T* (b) Tj 0 -20 TD (c) ' 3 4 (d) \" ET 0.4 0.3 0.2 0.1 K 0.1 0.2 0.3 0.4 k 1 1 2 2 re B*"),
    )
    m = F.col("matrix")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _parts(spark, sf_dir, shown, ["<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]).objects.select(
        "doc_id", "seq", "type", "paint", listed("fill"), listed("stroke"), F.when(F.col("segments").isNotNull(), F.size("segments")).alias("n_segments"), "render_mode", "char_space", "word_space", "scale",
        m["e"].alias("x"), m["f"].alias("y"),
    )


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, 100.0::DOUBLE AS w, (100 + p_size)::DOUBLE AS h, least(200.0::DOUBLE / (100 + p_size), 3) AS s FROM part)
       SELECT doc_id, 0 AS page_index, 2::BIGINT AS page_count, 270 AS rotation, h AS width, w AS height, round(s * (h - 50), 6) AS x, round(s * (w - 50), 6) AS y FROM p
       UNION ALL SELECT doc_id, 1, 2, 90, h, w, round(s * 50, 6), round(s * 50, 6) FROM p"""
)
def turned_pages(spark, sf_dir):
    """Pages with a rotation of their own and an inherited one: their sizes, and where a point is shown on a device of 200 x 300 pixels."""
    tree = F.concat(F.lit("<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Rotate 90 /MediaBox [10 20 110 "), (120 + F.col("p_size")).cast("string"), F.lit("] >>"))
    bodies = [F.lit("<< /Type /Catalog /Pages 2 0 R >>"), tree, F.lit("<< /Type /Page /Parent 2 0 R /Rotate -90 >>"), F.lit("<< /Type /Page /Parent 2 0 R >>")]
    d = Documents(_dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pdf.assembled(bodies).alias("content")))
    shown = G.transform_point(G.display_matrix(F.col("media_box"), 200.0, 300.0, F.col("rotation") / 90), 60.0, 70.0)
    pages = d.pages.withColumn("at", shown)
    counts = d.pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    return pages.join(counts, "doc_id").select("doc_id", "page_index", "page_count", "rotation", "width", "height", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"))


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, p_name, p_brand FROM part)
       SELECT doc_id, 0 AS line, p_name AS text, 50.0::DOUBLE AS x1, 700.0::DOUBLE AS y1, (50 + 5.0 * length(p_name))::DOUBLE AS x2, 710.0::DOUBLE AS y2 FROM p
       UNION ALL SELECT doc_id, 1, p_brand, 50, 680, 50 + 5.0 * length(p_brand), 690 FROM p"""
)
def line_boxes(spark, sf_dir):
    shown = F.concat(F.lit("BT /F1 10 Tf 50 700 Td "), T.string_object(F.col("p_name")), F.lit(" Tj 0 -20 Td "), T.string_object(F.col("p_brand")), F.lit(" Tj ET"))
    found = content.line_text(content.characters(_parts(spark, sf_dir, shown, ["<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]).objects))
    b = F.col("box")
    return found.select("doc_id", F.col("line").cast("int").alias("line"), "text", b["left"].alias("x1"), b["top"].alias("y1"), b["right"].alias("x2"), b["bottom"].alias("y2"))


@query("SELECT p_partkey AS doc_id, 0 AS type, 2::BIGINT AS n, p_name AS text, p_brand AS title FROM part UNION ALL SELECT p_partkey, 1, 3, p_name, p_brand FROM part UNION ALL SELECT p_partkey, 2, 4, p_name, p_brand FROM part")
def packed_documents(spark, sf_dir):
    """Documents whose cross-reference section is a stream, with objects in an object stream: entries by type, text and title."""
    shown = F.encode(F.concat(F.lit("BT /F1 12 Tf "), T.string_object(F.col("p_name")), F.lit(" Tj ET")), "ISO-8859-1")
    inside = {
        1: F.lit("<< /Type /Catalog /Pages 2 0 R >>"), 2: F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] >>"), 3: F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"),
        6: F.concat(F.lit("<< /Title "), T.string_object(F.col("p_brand")), F.lit(" >>")),
    }
    made = pdf.assembled_compactly({4: pdf.stream_body(shown), 7: pdf.object_stream(inside)}, {7: list(inside)}, "/Info 6 0 R")
    d = Documents(_dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), made.alias("content")))
    counts = d.xref.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(d.text.select("doc_id", "text"), "doc_id").join(pdf.metadata(d.nodes).select("doc_id", F.col("value").alias("title")), "doc_id")


@query("SELECT p_partkey AS doc_id, p_name AS text FROM part")
def owner_opened(spark, sf_dir):
    """Encrypted documents that only the owner's password opens here."""
    ident, permissions = b"\x03" * 16, -44
    owner = crypto.owner_value(b"boss", b"guest", 3, 16)
    key = crypto.file_key(b"guest", owner, permissions, ident, 3, 16)
    user = crypto.user_value(key, ident, 3)
    shown = F.encode(F.concat(F.lit("BT /F1 12 Tf "), T.string_object(F.col("p_name")), F.lit(" Tj ET")), "ISO-8859-1")
    bodies = [
        F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] >>"), F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"),
        pdf.stream_body(crypto.rc4(T.object_key(F.lit(key), F.lit(4), F.lit(0)), shown)), F.lit(f"<< /Filter /Standard /V 2 /R 3 /Length 128 /P {permissions} /O <{owner.hex()}> /U <{user.hex()}> >>"),
    ]
    docs = _dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pdf.assembled(bodies, f" /Encrypt 5 0 R /ID [<{ident.hex()}> <{ident.hex()}>]").alias("content"))
    return Documents(docs, b"boss").text.select("doc_id", "text")


@query(
    """WITH p AS (SELECT p_partkey AS img_id, p_name, p_size % 8 AS h FROM part)
       SELECT img_id, y::INT AS y, substr(p_name, (7 * y + 1)::INT, 7) AS line, 8 AS pitch FROM p, range(8) AS r(y) WHERE y < h AND 7 * h <= length(p_name)"""
)
def run_length_rows(spark, sf_dir):
    """Rows of samples from runs; images for which the runs are too short have none."""
    packed = filters.encoded(F.encode("p_name", "ISO-8859-1"), F.array(F.lit("RunLengthDecode")))
    made = _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("img_id"), packed.alias("data"), F.lit(7).alias("width"), (F.col("p_size") % 8).cast("int").alias("height"), F.lit(1).alias("components"), F.lit(8).alias("bits")
    )
    line = F.col("line")
    return images.run_length_lines(made).select("img_id", "y", F.decode(F.substring(line, 1, 7), "ISO-8859-1").alias("line"), F.length(line).alias("pitch"))


@query(
    """WITH p AS (SELECT p_partkey AS img_id, p_name, 2 + p_size % 3 AS w FROM part), x AS (SELECT *, unnest(range(w)) AS x FROM p), a AS (SELECT *, y, (y * w + x) * 3 AS pos FROM x, range(3) AS r(y)),
       v AS (SELECT img_id, x, y, ascii(substr(p_name, pos::INT + 1, 1))::BIGINT AS r, ascii(substr(p_name, pos::INT + 2, 1))::BIGINT AS g, ascii(substr(p_name, pos::INT + 3, 1))::BIGINT AS b FROM a WHERE pos + 3 <= length(p_name))
       SELECT img_id, x::INT AS x, y::INT AS y, s AS swapped, CASE WHEN s THEN 4278190080 + b * 65536 + g * 256 + r ELSE 4278190080 + r * 65536 + g * 256 + b END AS argb FROM v, (VALUES (false), (true)) AS o(s)"""
)
def packed_pixels(spark, sf_dir):
    """Pixels of three bytes in both orders."""
    made = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"), F.encode("p_name", "ISO-8859-1").alias("data"), (2 + F.col("p_size") % 3).cast("int").alias("width"), F.lit(3).alias("height"))
    both = [images.rgb_pixels(made, swapped=s).withColumn("swapped", F.lit(s)) for s in (False, True)]
    return both[0].unionByName(both[1])


@query(
    """WITH a AS (SELECT p_partkey AS img_id, x, y FROM part, range(4) AS r(x), range(3) AS s(y)),
       c AS (SELECT l_partkey AS img_id, l_linenumber - 2 AS x, l_suppkey % 5 AS y, arg_max(l_quantity::BIGINT, (l_orderkey, l_linenumber, l_quantity)) AS level FROM lineitem GROUP BY ALL)
       SELECT a.img_id, a.x::INT AS x, a.y::INT AS y, coalesce(level, 7)::INT AS level FROM a LEFT JOIN c ON a.img_id = c.img_id AND a.x = c.x AND a.y = c.y"""
)
def pixel_changes(spark, sf_dir):
    """Gray pixels set one after the other in cleared images; some are outside."""
    sizes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"), F.lit(4).alias("w"), F.lit(3).alias("h"))
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("img_id"), (F.col("l_linenumber") - 2).cast("int").alias("x"), (F.col("l_suppkey") % 5).cast("int").alias("y"),
        raster.gray_argb(F.col("l_quantity").cast("long")).alias("argb"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("turn"),
    )
    made = raster.with_pixels(raster.blank(sizes, "w", "h", 0xFF070707), rows, "turn")
    return made.select("img_id", "x", "y", C.channel(F.col("argb"), "g").alias("level"))


@query(
    """WITH s(k, head, image, font) AS (VALUES (0, '89504E470D0A1A0A', 'png', 'truetype'), (1, 'FFD8FFE0', 'jpeg', 'truetype'), (2, '0000000C6A5020200D0A870A', 'jp2', 'truetype'), (3, 'FF4FFF51', 'j2k', 'truetype'), (4, 'FF0A', 'jxl', 'truetype'),
       (5, '0000000C4A584C200D0A870A', 'jxl', 'truetype'), (6, '47494638', 'gif', 'truetype'), (7, '00010000', NULL, 'truetype'), (8, '4F54544F', NULL, 'cff'), (9, '74746366', NULL, 'ttc'), (10, '25215053', NULL, 'type1'))
       SELECT p_partkey AS id, image, font, substr(p_type || '    ', 1, 4) AS tag FROM part JOIN s ON p_partkey % 11 = k"""
)
def signatures(spark, sf_dir):
    heads = "89504E470D0A1A0A FFD8FFE0 0000000C6A5020200D0A870A FF4FFF51 FF0A 0000000C4A584C200D0A870A 47494638 00010000 4F54544F 74746366 25215053".split()
    head = F.get(F.array(*map(F.lit, heads)), (F.col("p_partkey") % len(heads)).cast("int"))
    data = F.concat(F.unhex(head), F.encode("p_name", "ISO-8859-1"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sniff.image_kind(data).alias("image"), sniff.font_kind(data).alias("font"), T.tag_text(T.tag_number(F.col("p_type"))).alias("tag"))


def _chunk(kind: str, data, wrong=None):
    body = F.concat(F.lit(kind.encode()), data)
    crc = F.crc32(body) if wrong is None else F.crc32(body).bitwiseXOR(F.when(wrong, 1).otherwise(0).cast("long"))
    four = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    return F.concat(four(F.length(data)), body, four(crc))


@query(
    """WITH p AS (SELECT p_partkey AS img_id, length(p_name) AS n FROM part)
       SELECT img_id, 0 AS k, 'IHDR' AS type, 13::BIGINT AS length, 8::BIGINT AS "offset", true AS crc_ok FROM p UNION ALL SELECT img_id, 1, 'tEXt', n, 33, img_id % 3 <> 0 FROM p UNION ALL SELECT img_id, 2, 'IEND', 0, 45 + n, true FROM p"""
)
def png_chunk_rows(spark, sf_dir):
    """Chunks of images in a row of bytes each; a third of the texts have a wrong checksum."""
    text = _chunk("tEXt", F.encode("p_name", "ISO-8859-1"), F.col("p_partkey") % 3 == 0)
    data = F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), _chunk("IHDR", F.lit(bytes(13))), text, _chunk("IEND", F.lit(b"")))
    return images.png_chunks(_dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"), data.alias("data")))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size AS n, p_size / 50.0 AS t, (2.0 * p_size + 16) / 116 AS m FROM part), y AS (SELECT *, CASE WHEN m >= 6 / 29.0 THEN m * m * m ELSE 108 / 841.0 * (m - 4 / 29.0) END * (-0.9689 * 0.9505 + 1.8758 + 0.0415 * 1.089) AS v FROM p)
       SELECT id, floor(least(1.0, greatest(0.0, CASE WHEN v <= 0.0031308 THEN 12.92 * v ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END)) * 255 + 0.5)::INT AS lab, floor((1 - t) * 255 + 0.5)::INT AS registration, floor(t * 255 + 0.5)::INT AS spot,
       n % 7 = 0 AS nothing, n BETWEEN 10 AND 30 AND n + 1 BETWEEN 0 AND 25 AS keyed FROM y"""
)
def mixed_colors(spark, sf_dir):
    """CIE lightness, separations (All, a spot colour, None) and a colour-key mask."""
    n = F.col("p_size")
    named = F.when(n % 7 == 0, "None").otherwise("Spot")
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), C.lab_to_rgb(2.0 * n, 0.0, 0.0)["g"].alias("lab"), C.separation_to_rgb(F.lit("All"), n / 50.0, 3)["r"].alias("registration"), C.separation_to_rgb(F.lit("Spot"), n / 50.0, 3)["b"].alias("spot"),
        C.separation_to_rgb(named, n / 50.0, 3).isNull().alias("nothing"), C.in_color_key(F.array(n, n + 1), F.array(F.lit(10), F.lit(0)), F.array(F.lit(30), F.lit(25))).alias("keyed"),
    )


@query(
    """SELECT p_partkey AS id, p_size >= 5 AND p_size < 20 AS half_open, p_size BETWEEN 5 AND 20 AS closed, p_size < 20 AS overlaps, p_size <= 20 AS touching, CASE WHEN p_size <= 20 THEN 20 - greatest(5, p_size) END::DOUBLE AS clipped_width,
       (20 - greatest(5, p_size))::DOUBLE AS met_width, p_size BETWEEN 1 AND 9 AS crossing, p_size BETWEEN 4 AND 30 AS path_hit FROM part"""
)
def rect_predicates(spark, sf_dir):
    """Open, half-open and closed tests of rectangles; crossing segments; points within the bounds of a drawn path."""
    n = F.col("p_size")
    r, s = G.rect(5, 5, 20, 20), G.rect(n, 0, n + 40, 30)
    d = _parts(spark, sf_dir, F.lit("4 4 26 26 re f"), ["<< /Type /Font >>"])
    hit = content.path_bounds(d.objects).select("doc_id", "box")
    rows = _t(spark, sf_dir, "part").join(hit.withColumnRenamed("doc_id", "p_partkey"), "p_partkey")
    return rows.select(
        F.col("p_partkey").alias("id"), G.contains_half_open(r, n, 5).alias("half_open"), G.contains(r, n, 20).alias("closed"), G.intersects(r, s).alias("overlaps"), G.touches(r, s).alias("touching"),
        G.width(G.clipped(r, G.rect(n, 5, n + 40, 20))).alias("clipped_width"), G.width(G.meet(r, s)).alias("met_width"),
        G.segments_cross(0.5, 0, 9.5, 0, n, -1, n, 1).alias("crossing"), G.contains(F.col("box"), n, 5).alias("path_hit"),
    )


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size::BIGINT AS n FROM part)
       SELECT id, greatest(-20, least(20, n - 25))::BIGINT AS saturated, (n * 200 + 128 + ((n * 200 + 128) >> 8)) >> 8 AS product, ((n * 11 + 32) // 64) * 64 AS nearest, (n * 11 // 64) * 64 AS below, ((n * 11 + 63) // 64) * 64 AS above,
       n * 65536 * 2 + n * 100 AS x, 65536::BIGINT AS y, 32768::BIGINT AS xx, -(n * 50)::BIGINT AS xy, n < 11 AS near FROM p"""
)
def fixed_numbers(spark, sf_dir):
    """Numbers kept within bounds, products of bytes, places brought to the pixel grid, vectors and matrices of 16.16 numbers."""
    n, one = F.col("p_size").cast("long"), 65536
    moved = G.fixed_transform(F.lit(2 * one), n * 100, F.lit(0), F.lit(one), n * one, F.lit(one))
    inverse = G.fixed_inverse(F.lit(2 * one), n * 100, F.lit(0), F.lit(one))
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), G.saturated((n - 25).cast("double"), 20).alias("saturated"), G.multiply_one(n, 200, 8).alias("product"), G.snapped(n * 11).alias("nearest"), G.snapped(n * 11, how="floor").alias("below"),
        G.snapped(n * 11, how="ceil").alias("above"), moved["x"].alias("x"), moved["y"].alias("y"), inverse["xx"].alias("xx"), inverse["xy"].alias("xy"), G.nearly(n / 1000, 0.0, 0.0105).alias("near"),
    )
