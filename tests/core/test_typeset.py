"""Text through fonts, forms that run, and the lookups under them."""

import random

import pytest
from pyspark.sql import functions as F

from made import BASE, build, documents, stream
from quire.operators import lookup, typeset

FONTS = {
    40: b"<< /Type /Font /Subtype /Type1 /BaseFont /A /FirstChar 65 /Widths [600 300 900] /FontDescriptor 41 0 R >>",
    41: b"<< /Type /FontDescriptor /MissingWidth 100 >>",
    42: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [43 0 R] /ToUnicode 44 0 R >>",
    43: b"<< /Type /Font /Subtype /CIDFontType2 /DW 700 /W [1 [250 300] 10 20 400 30 [111]] >>",
    44: stream(b"1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0003> <0062> <000A> <000B> [<D83DDE00> <00660069>] endbfrange"),
    45: b"<< /Type /Font /Subtype /Type0 /Encoding 46 0 R /DescendantFonts [43 0 R] >>",
    46: stream(b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 begincidrange <41> <43> 9 endcidrange 1 begincidchar <8001> 30 endcidchar"),
    47: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
}
RESOURCES = b"/Resources << /Font << /A 40 0 R /I 42 0 R /M 45 0 R /H 47 0 R >> /XObject << /X 50 0 R >> >>"


def page(data: bytes, more: dict | None = None) -> bytes:
    return build({1: BASE[1], 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R %s >>" % RESOURCES, 4: stream(data), **FONTS, **(more or {})})


def shown(d):
    return [(r.ch, r.cid, r.width, round(r.x, 6), round(r.y, 6)) for r in d.glyphs.orderBy("place", "k").collect()]


def test_widths_move_what_follows(spark):
    d = documents(spark, page(b"BT /A 10 Tf 2 Tc 5 Tw 50 Tz 100 700 Td (AB) Tj [(C A) -500 () 100 (Z)] TJ 0 -20 Td (A) Tj ET"))
    # Each advance is (width / 100 + 2, and 5 for a space) / 2.
    assert shown(d) == [("A", 65, 600.0, 100.0, 700.0), ("B", 66, 300.0, 104.0, 700.0), ("C", 67, 900.0, 106.5, 700.0), (" ", 32, 100.0, 112.0, 700.0), ("A", 65, 600.0, 116.0, 700.0),
                        ("Z", 90, 100.0, 122.0, 700.0), ("A", 65, 600.0, 100.0, 680.0)]


def test_composite_fonts(spark):
    d = documents(spark, page(b"BT /I 10 Tf 1 0 0 2 0 0 Tm <00010002000A000B00030020> Tj /M 10 Tf 0 9 Td <418001FF> Tj ET"))
    assert shown(d) == [("A", 1, 250.0, 0.0, 0.0), ("b", 2, 300.0, 2.5, 0.0), ("😀", 10, 400.0, 5.5, 0.0), ("fi", 11, 400.0, 9.5, 0.0), ("c", 3, 700.0, 13.5, 0.0), (None, 32, 700.0, 20.5, 0.0),
                        (None, 9, 700.0, 0.0, 18.0), (None, 30, 111.0, 7.0, 18.0), (None, 0, 700.0, 8.11, 18.0)]


def test_fonts_without_widths_or_entry(spark):
    d = documents(spark, page(b"BT /H 10 Tf (ab) Tj /None 20 Tf (cd) Tj ET"))
    assert shown(d) == [("a", 97, 500.0, 0.0, 0.0), ("b", 98, 500.0, 5.0, 0.0), ("c", None, 500.0, 10.0, 0.0), ("d", None, 500.0, 20.0, 0.0)]


def test_forms_run_where_they_stand(spark):
    form = b"/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [%s]"
    more = {
        50: stream(b"BT /H 10 Tf (1) Tj ET q 2 0 0 2 0 0 cm /Y Do Q BT (3) Tj ET", form % b"1 0 0 1 10 0" + b" /Resources << /XObject << /Y 51 0 R /Self 50 0 R >> /Font << /H 40 0 R >> >>"),
        51: stream(b"1 g BT (2) Tj ET /Self Do 0 0 1 1 re f", form % b"1 0 0 1 0 100"),  # takes the resources and the font of 50; runs 50 again, which is cut
    }
    d = documents(spark, page(b"0.5 g /X Do BT /A 5 Tf (4) Tj ET q 1 0 0 1 7 7 cm /X Do Q", more))
    rows = d.drawn.orderBy("place").collect()
    assert [(r.place_text, r.type, r.text and bytes(r.text).decode(), r.font, r.font_owner, r.fill, (r.matrix.a, r.matrix.e, r.matrix.f)) for r in rows] == [
        ("0", "xobject", None, "X", 3, [0.5], (1, 0, 0)),
        ("0.0", "text", "1", "H", 50, [0.5], (1, 10, 0)),
        ("0.1", "xobject", None, "Y", 50, [0.5], (2, 10, 0)),
        ("0.1.0", "text", "2", "H", 50, [1.0], (2, 10, 200)),
        ("0.1.1", "xobject", None, "Self", 50, [1.0], (2, 10, 200)),
        ("0.1.2", "path", None, "H", 50, [1.0], (2, 10, 200)),
        ("0.2", "text", "3", "H", 50, [0.5], (1, 10, 0)),
        ("1", "text", "4", "A", 3, [0.5], (1, 0, 0)),
        ("2", "xobject", None, "X", 3, [0.5], (1, 7, 7)),
        ("2.0", "text", "1", "H", 50, [0.5], (1, 17, 7)),
        ("2.1", "xobject", None, "Y", 50, [0.5], (2, 17, 7)),
        ("2.1.0", "text", "2", "H", 50, [1.0], (2, 17, 207)),
        ("2.1.1", "xobject", None, "Self", 50, [1.0], (2, 17, 207)),
        ("2.1.2", "path", None, "H", 50, [1.0], (2, 17, 207)),
        ("2.2", "text", "3", "H", 50, [0.5], (1, 17, 7)),
    ]
    assert [r.text for r in typeset.text(d.glyphs).collect()] == ["1234123"]


def test_pages_without_resources_and_empty_tables(spark):
    plain = build({1: BASE[1], 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: stream(b"/X Do BT /A 8 Tf (x) Tj ET")})
    assert shown(documents(spark, plain)) == [("x", None, 500.0, 0.0, 0.0)]
    assert shown(documents(spark, None, b"no")) == []


def test_w_arrays_that_end_oddly(spark):
    rows = []
    for n, w in enumerate((b"[1 [5] 2]", b"[1 2]", b"[[7]]", b"[1 2 3 4 5 6 9 [8 8]]", b"[]", b"[3 [1 2] 3 [4]]")):
        rows.append((n, bytearray(build({**BASE, 60: b"<< /W " + w + b" >>"}))))
    from quire.plans.extract import Documents

    d = Documents(spark.createDataFrame(rows, "doc_id long, content binary"))
    got = sorted((r.doc_id, r.low, r.high, r.width) for r in typeset.cid_widths(d.nodes).collect())
    assert got == [(0, 1, 1, 5.0), (3, 1, 2, 3.0), (3, 4, 5, 6.0), (3, 9, 9, 8.0), (3, 10, 10, 8.0), (5, 3, 3, 1.0), (5, 3, 3, 4.0), (5, 4, 4, 2.0)]


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_range_join_of_any_width(spark, hot):
    r = random.Random(hot)
    points = [(k, r.choice([5.0, r.uniform(-1000, 1000), float(r.randrange(-9, 9))])) for k in range(300)] + [(1000, None)]
    ranges = [(k, a, a + w) for k in range(60) for a, w in [(r.uniform(-1000, 1000), r.choice([0.0, 1.0, 17.0, 256.0, 5000.0]))]] + [(90, -1e12, 1e12), (91, 3.0, 2.0), (92, None, 1.0), (93, 5.0, 5.0)]
    p, q = spark.createDataFrame(points, "id long, v double"), spark.createDataFrame(ranges, "r long, lo double, hi double")
    got = sorted((x.id, x.r) for x in lookup.range_join(p, "v", q, "lo", "hi", 2.0, hot=hot).collect())
    assert got == sorted((i, k) for i, v in points for k, a, b in ranges if None not in (v, a, b) and a <= v <= b)


def test_pieces_are_few(spark):
    df = spark.createDataFrame([(0, 1 << 40), (-5, 1_000_003), (7, 7), (15, 16), (3, 2)], "a long, b long").withColumn("p", lookup.pieces(F.col("a"), F.col("b")))
    for r in df.collect():
        assert sum(16**x.level for x in r.p) == max(0, r.b - r.a + 1) and len(r.p) <= 200


def test_overlap_join_of_any_size(spark):
    r = random.Random(4)

    def some(n):
        out = []
        for k in range(n):
            x, y, w, h = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.0, 0.3, 5.0, 80.0]), r.choice([0.1, 4.0, 300.0])
            out.append((k, (x, y, x + w, y + h)))
        return out

    a, b = some(60), some(50)
    box = "struct<left:double,top:double,right:double,bottom:double>"
    got = sorted((x.i, x.j) for x in lookup.overlap_join(spark.createDataFrame(a, f"i long, l {box}"), spark.createDataFrame(b, f"j long, r {box}"), 2.0).collect())
    assert got == sorted((i, j) for i, p in a for j, q in b if p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3])
