"""Queries over what pages draw: text in its fonts, forms within forms, paths; documents made of rows, and the SQL that says what must be read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import content as content_operators
from .operators import crypto, layout, paths, typeset
from .plans.extract import Documents
from .queries import _dealt, _t, query
from .sources import pdf

#: Widths of the codes 32 to 126 in the documents below; in SQL ``200 + 7 * (code - 32)``.
WIDTHS = " ".join(str(200 + 7 * k) for k in range(95))


def _parts(spark, sf_dir: str, contents, fonts: list, more: str = "") -> Documents:
    """A page a row of ``part``: objects 1 to 4 are catalog, pages, page and content; then ``fonts`` (texts or streams)."""
    bodies = [
        F.lit("<< /Type /Catalog /Pages 2 0 R >>"),
        F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"),
        F.lit(f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> {more} >> >>"),
        pdf.stream_body(F.encode(contents, "ISO-8859-1")),
        *[f if not isinstance(f, str) else F.lit(f) for f in fonts],
    ]
    return Documents(_dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pdf.assembled(bodies).alias("content")))


@query(
    """WITH s AS (SELECT p_partkey AS doc_id, p_size AS size, p_name AS a, p_brand AS b FROM part),
       c AS (SELECT doc_id, size, 1 AS part, unnest(range(1, length(a) + 1)) AS k, a AS t FROM s UNION ALL SELECT doc_id, size, 2, unnest(range(1, length(b) + 1)), b FROM s),
       w AS (SELECT doc_id, part, k, ascii(substr(t, k::INT, 1)) AS code, size, CASE WHEN part = 2 AND k = 1 THEN 0.25 * size ELSE 0 END AS lead FROM c),
       g AS (SELECT *, (200 + 7 * (code - 32)) / 1000.0 * size + 0.5 + CASE WHEN code = 32 THEN 2 ELSE 0 END AS advance FROM w),
       x AS (SELECT *, lead + coalesce(sum(advance + lead) OVER (PARTITION BY doc_id ORDER BY part, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along FROM g)
       SELECT doc_id, (part - 1)::INT AS seq, (k - 1)::INT AS k, chr(code) AS ch, round(100 + 2 * along, 6)::DOUBLE AS x, 700::DOUBLE AS y FROM x"""
)
def glyph_places(spark, sf_dir):
    """Two strings of one array, with a number between them, in a simple font whose widths all differ."""
    shown = F.concat(F.lit("BT /F1 "), F.col("p_size").cast("string"), F.lit(" Tf 0.5 Tc 2 Tw 2 0 0 1 100 700 Tm ["), T.string_object(F.col("p_name")), F.lit(" -250 "), T.string_object(F.col("p_brand")), F.lit("] TJ ET"))
    d = _parts(spark, sf_dir, shown, [f"<< /Type /Font /Subtype /Type1 /BaseFont /Own /FirstChar 32 /Widths [{WIDTHS}] >>"])
    return d.glyphs.select("doc_id", "seq", "k", "ch", F.round("x", 6).alias("x"), "y")


@query(
    """WITH c AS (SELECT p_partkey AS doc_id, unnest(range(1, length(p_name) + 1)) AS k, p_name AS t FROM part),
       g AS (SELECT doc_id, k, ascii(substr(t, k::INT, 1)) AS code FROM c),
       w AS (SELECT *, CASE WHEN code BETWEEN 97 AND 101 THEN 300 + 10 * (code - 97) WHEN code BETWEEN 102 AND 122 THEN 450 ELSE 800 END AS width FROM g)
       SELECT doc_id, (k - 1)::INT AS k, code::BIGINT AS code, CASE WHEN code BETWEEN 97 AND 122 THEN chr(code - 32) WHEN code = 32 THEN '_' END AS ch, width::DOUBLE AS width,
              (coalesce(sum(width) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100)::DOUBLE AS x FROM w"""
)
def composite_glyphs(spark, sf_dir):
    """A composite font with codes of two bytes: both kinds of groups in W, DW for the rest, and a ToUnicode map that makes small letters capitals."""
    shown = F.concat(F.lit("BT /F1 10 Tf <"), F.hex(F.encode("p_name", "UTF-16BE")), F.lit("> Tj ET"))
    to_unicode = pdf.stream_body(F.encode(F.lit("1 beginbfrange <0061> <007A> <0041> endbfrange 1 beginbfchar <0020> <005F> endbfchar"), "ISO-8859-1"))
    fonts = ["<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", "<< /Type /Font /Subtype /CIDFontType2 /DW 800 /W [97 [300 310 320 330 340] 102 122 450] >>", to_unicode]
    return _parts(spark, sf_dir, shown, fonts).glyphs.select("doc_id", "k", "code", "ch", "width", F.round("x", 6).alias("x"))


@query(
    """WITH s AS (SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'hi' ELSE p_brand END AS t, p_size FROM part),
       b AS (SELECT doc_id, unnest(range(1, length(t) + 1)) AS k, t, p_size FROM s),
       u AS (SELECT doc_id, k, CASE WHEN p_size % 3 = 0 THEN ascii(substr(t, k::INT, 1)) ELSE 32768 + ascii(substr(t, k::INT, 1)) END AS code FROM b)
       SELECT doc_id, count(*)::BIGINT AS n, sum(code)::BIGINT AS codes, sum(CASE WHEN code < 32768 THEN code - 32 + 500 ELSE code - 32768 + 1 END)::BIGINT AS cids FROM u GROUP BY doc_id"""
)
def mixed_codes(spark, sf_dir):
    """Strings of one-byte or two-byte codes, told apart by the code spaces of each font's embedded code map, and mapped by its ranges."""
    t = F.when(F.col("p_size") % 2 == 0, F.lit("hi")).otherwise(F.col("p_brand"))
    wide = F.regexp_replace(F.hex(F.encode(t, "ISO-8859-1")), "(..)", "80$1")
    shown = F.concat(F.lit("BT /F1 10 Tf <"), F.when(F.col("p_size") % 3 == 0, F.hex(F.encode(t, "ISO-8859-1"))).otherwise(wide), F.lit("> Tj ET"))
    cmap = "2 begincodespacerange <20> <7F> <8000> <80FF> endcodespacerange 2 begincidrange <20> <7F> 500 <8000> <80FF> 1 endcidrange"
    fonts = ["<< /Type /Font /Subtype /Type0 /Encoding 7 0 R /DescendantFonts [6 0 R] >>", "<< /Type /Font /Subtype /CIDFontType0 >>", pdf.stream_body(F.encode(F.lit(cmap), "ISO-8859-1"))]
    found = _parts(spark, sf_dir, shown, fonts).glyphs
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("codes"), F.sum("cid").alias("cids"))


def _nested(spark, sf_dir: str) -> Documents:
    """The page runs form A twice; A runs B, B runs C, and C asks for A again, which is cut. B takes A's resources."""
    size = F.col("p_size").cast("string")

    def form(data, matrix: str, entries: str = "") -> pdf.Bytes:
        head = F.concat(F.lit(f" /Type /XObject /Subtype /Form /BBox [0 0 100 100] {entries} /Matrix ["), F.replace(F.lit(matrix), F.lit("S"), size), F.lit("]"))
        return pdf.stream_body(F.encode(F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in data]), "ISO-8859-1"), head)

    def text(c: str):
        return F.concat(F.lit("BT /F1 10 Tf "), T.string_object(F.col(c)), F.lit(" Tj ET "))

    own = "/Resources << /Font << /F1 5 0 R >> /XObject << /B 7 0 R /C 8 0 R /A 6 0 R >> >>"
    forms = [
        form([text("p_name"), "q 2 0 0 2 0 0 cm /B Do Q"], "1 0 0 1 S 0", own),
        form(["q 1 0 0 1 3 4 cm /C Do Q ", text("p_brand")], "1 0 0 1 0 10"),
        form([text("p_type"), "/A Do 1 2 3 4 re f"], "0 1 -1 0 0 0"),
    ]
    return _parts(spark, sf_dir, F.concat(F.lit("q /A Do Q "), text("p_type"), F.lit("1 0 0 1 0 500 cm /A Do")), ["<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", *forms], "/XObject << /A 6 0 R >>")


@query(
    """WITH r AS (SELECT p_partkey AS doc_id, p_name, p_brand, p_type, p_size::DOUBLE AS s, unnest([0.0, 500.0]) AS up, unnest(['0', '2']) AS st FROM part)
       SELECT doc_id, st || '.0' AS place_text, p_name AS text, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, s AS e, up::DOUBLE AS f FROM r
       UNION ALL SELECT doc_id, st || '.1.0.0', p_type, 0.0, 2.0, s + 6, up + 28 FROM r
       UNION ALL SELECT doc_id, st || '.1.1', p_brand, 2.0, 0.0, s, up + 20 FROM r
       UNION ALL SELECT doc_id, '1', p_type, 1.0, 0.0, 0.0, 0.0 FROM r WHERE st = '0'"""
)
def nested_forms(spark, sf_dir):
    m = F.col("matrix")
    return _nested(spark, sf_dir).drawn.where("type = 'text'").select("doc_id", "place_text", T.decode_text(F.col("text")).alias("text"), m["a"].alias("a"), m["b"].alias("b"), m["e"].alias("e"), m["f"].alias("f"))


@query("SELECT p_partkey AS doc_id, p_name || p_type || p_brand || p_type || p_name || p_type || p_brand AS text FROM part")
def nested_form_text(spark, sf_dir):
    return typeset.text(_nested(spark, sf_dir).glyphs).select("doc_id", "text")


def _shapes(spark, sf_dir: str) -> Documents:
    """A rectangle, a triangle and a circle of four curves, whose sizes follow p_size."""
    size = F.col("p_size")
    k = 0.5522847498307936  # how far the control points of a quarter circle lie
    d = 0.7071067811865476
    corners = [(d, d), (-d, d), (-d, -d), (d, -d)]  # arcs from corner to corner, so that the extremes lie inside them
    arcs = []
    for n, (x, y) in enumerate(corners):
        u, v = corners[(n + 1) % 4]
        arcs.append([x - k * y, y + k * x, u + k * v, v - k * u, u, v])
    numbers = lambda p: F.concat_ws(" ", *[F.format_string("%.9f", size * F.lit(c) + 60) for c in p])
    circle = F.concat_ws(" ", numbers(corners[0]), F.lit("m"), *[x for a in arcs for x in (numbers(a), F.lit("c"))], F.lit("f"))
    s, twice = size.cast("string"), (2 * size).cast("string")
    content = F.concat(F.lit("1.5 2.25 "), s, F.lit(" 1.5 re f 10 20 m "), (10 + 2 * size).cast("string"), F.lit(" 20 l 10 "), (20 + size).cast("string"), F.lit(" l f "), circle, F.lit(" 0 0 "), twice, F.lit(" 1 re S"))
    return _parts(spark, sf_dir, content, ["<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"])


@query("SELECT p_partkey AS doc_id, k::INT AS seq, CASE k WHEN 0 THEN 1.5 * p_size ELSE p_size * p_size END::DOUBLE AS area FROM part, range(2) AS r(k)")
def filled_areas(spark, sf_dir):
    """A rectangle and a triangle: their edges are cut into cells, whose covers and areas add up to the exact area."""
    drawn = _shapes(spark, sf_dir).objects.where("paint = 'f' AND seq < 2")
    return paths.filled_area(paths.cells(paths.edges(drawn))).select("doc_id", "seq", F.abs("area").alias("area"))


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, p_size AS s, unnest(range(1, p_size + 2)) AS x FROM part),
       w AS (SELECT doc_id, x, least(x + 1, 1.5 + s) - greatest(x, 1.5) AS wide FROM p),
       r AS (SELECT doc_id, x, wide, y, CASE y WHEN 2 THEN 0.75 ELSE 0.75 END AS high FROM w, (VALUES (2), (3)) AS v(y))
       SELECT doc_id, y::INT AS y, count(*)::BIGINT AS pixels, sum(least(255, floor(wide * high * 256)))::BIGINT AS alpha FROM r WHERE wide > 0 GROUP BY doc_id, y"""
)
def drawn_coverage(spark, sf_dir):
    """Coverage of a rectangle with corners within pixels, spans between its edges included."""
    found = paths.spans(paths.cells(paths.edges(_shapes(spark, sf_dir).objects.where("seq = 0"))))
    alpha = F.least(F.lit(255), F.shiftright(F.abs("units"), 9))
    return found.groupBy("doc_id", "y").agg(F.sum("n").cast("long").alias("pixels"), F.sum(F.col("n") * alpha).cast("long").alias("alpha"))


@query("SELECT p_partkey AS doc_id, (60 - p_size)::DOUBLE AS x1, (60 - p_size)::DOUBLE AS y1, (60 + p_size)::DOUBLE AS x2, (60 + p_size)::DOUBLE AS y2 FROM part")
def curve_bounds(spark, sf_dir):
    """Bounds of a circle whose curves begin and end between the axes: of the curves, not of their control points."""
    box = F.col("box")
    found = paths.exact_bounds(_shapes(spark, sf_dir).objects.where("seq = 2"))
    return found.select("doc_id", *[F.round(box[k], 6).alias(n) for k, n in (("left", "x1"), ("top", "y1"), ("right", "x2"), ("bottom", "y2"))])


def _scattered(spark, sf_dir: str) -> DataFrame:
    """Characters of pages of a title and two columns, drawn from the bottom up and from right to left; with their places in the text."""
    strings = [(300, 500, "p_type", "right two"), (50, 500, "p_brand", "left two"), (300, 520, "p_brand", "right one"), (50, 520, "p_name", "left one"), (50, 700, "p_type", "title")]
    content = F.concat(*[F.concat(F.lit(f"BT /F1 8 Tf {x} {y} Td "), T.string_object(F.col(c)), F.lit(" Tj ET ")) for x, y, c, _ in strings])
    d = _parts(spark, sf_dir, content, ["<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"])
    chars = content_operators.characters(d.objects)
    return layout.text_index(layout.reading_order(chars))


@query("SELECT p_partkey AS doc_id, 0 AS page_index, p_type || chr(10) || p_name || chr(10) || p_brand || chr(10) || p_brand || chr(10) || p_type AS text FROM part")
def column_text(spark, sf_dir):
    return layout.page_text(_scattered(spark, sf_dir))


@query(
    """WITH t AS (SELECT p_partkey AS doc_id, length(p_type) AS a, length(p_name) AS b, p_name, p_brand FROM part)
       SELECT doc_id, 1 AS line, right(p_name, 3) AS chars, round(50 + 4.0 * (b - 3), 4)::DOUBLE AS x1, round(50 + 4.0 * b, 4)::DOUBLE AS x2, 520::DOUBLE AS y FROM t
       UNION ALL SELECT doc_id, 2, left(p_brand, 2), 50, 58, 500 FROM t"""
)
def boxes_across_lines(spark, sf_dir):
    """The boxes of a range of the text from the last three characters of one line to the first two of the next: what lies between them, a line end, has none."""
    indexed = _scattered(spark, sf_dir)
    start = (F.length("p_type") + 1 + F.length("p_name") - 3).cast("int")
    ranges = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(1).alias("id"), start.alias("start"), (start + 6).alias("stop"))
    box = F.col("box")
    return layout.range_boxes(ranges, indexed).select("doc_id", "line", "chars", F.round(box["left"], 4).alias("x1"), F.round(box["right"], 4).alias("x2"), box["top"].alias("y"))


@query("SELECT p_partkey AS doc_id, p_name AS text, p_brand AS title, p_size::DOUBLE AS width FROM part")
def packed_encrypted(spark, sf_dir):
    """Documents under AES whose catalog, page tree and information lie in an object stream, and whose cross-reference section is a stream."""
    owner, ident, permissions = bytes(range(32)), b"\x02" * 16, -44
    key = crypto.file_key(b"", owner, permissions, ident, 4, 16)
    user = crypto.user_value(key, ident, 4)

    def lock(n: int):
        return lambda data: F.aes_encrypt(data, T.object_key(F.lit(key), F.lit(n), F.lit(0), aes=True), F.lit("CBC"), F.lit("PKCS"))

    shown = F.encode(F.concat(F.lit("BT /F1 12 Tf "), T.string_object(F.col("p_name")), F.lit(" Tj ET")), "ISO-8859-1")
    inside = {
        1: F.lit("<< /Type /Catalog /Pages 2 0 R >>"), 2: F.concat(F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 "), F.col("p_size").cast("string"), F.lit(" 9] >>")),
        3: F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"), 6: F.concat(F.lit("<< /Title "), T.string_object(F.col("p_brand")), F.lit(" >>")),
    }
    crypt = f"<< /Filter /Standard /V 4 /R 4 /Length 128 /P {permissions} /O <{owner.hex()}> /U <{user.hex()}> /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF >>"
    bodies = {4: pdf.stream_body(lock(4)(shown)), 5: F.lit(crypt), 7: pdf.object_stream(inside, lock(7))}
    made = pdf.assembled_compactly(bodies, {7: list(inside)}, f"/Info 6 0 R /Encrypt 5 0 R /ID [<{ident.hex()}> <{ident.hex()}>]")
    d = Documents(_dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), made.alias("content")))
    sizes = d.pages.select("doc_id", "width")
    return d.text.select("doc_id", "text").join(pdf.metadata(d.nodes).where("key = 'Title'").select("doc_id", F.col("value").alias("title")), "doc_id").join(sizes, "doc_id")


@query("SELECT p_partkey AS doc_id, k AS key, CASE k WHEN 'A' THEN p_name END AS text FROM part, (VALUES ('A'), ('B'), ('C')) AS v(k)")
def object_fetch(spark, sf_dir):
    """References to an object of the right generation, of a wrong one, and to none."""
    d = _parts(spark, sf_dir, F.lit(""), ["<< /Type /Font >>", T.string_object(F.col("p_name")), "<< /A 6 0 R /B 6 3 R /C 99 0 R >>"])
    refs = pdf.entries_of(d.nodes, "A", "B", "C").where("kind = 'ref' AND obj_num = 7").select("doc_id", "key", "ref_obj", "ref_gen")
    return pdf.fetched(d.nodes, refs).select("doc_id", "key", T.decode_text(F.col("to_s")).alias("text"))
