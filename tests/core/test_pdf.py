"""Documents built by hand: revisions, object streams, inheritance, damage, forms, annotations."""

import zlib

import pytest
from pyspark.sql import functions as F

from made import BASE, build, documents, stream
from quire.operators import content, forms
from quire.sources import filters, pdf, syntax


def test_pages_inherit_and_cycles_end(spark):
    d = documents(spark, build(BASE), b"not a pdf", None)
    rows = d.pages.orderBy("doc_id", "page_index").collect()
    assert [(r.page_index, r.obj_num, r.width, r.height, r.rotation) for r in rows] == [(0, 3, 400.0, 300.0, 90), (1, 7, 200.0, 100.0, 180), (2, 8, 400.0, 300.0, 90)]
    assert tuple(rows[2].crop_box) == (10.0, 10.0, 20.0, 30.0)
    assert tuple(rows[0].crop_box) == (0.0, 0.0, 300.0, 400.0)
    compat = pdf.pages(d.nodes, inherit_rotation=False).orderBy("page_index").collect()
    assert [r.rotation for r in compat] == [0, 180, 0]
    assert [(r.doc_id, r.error) for r in pdf.files(d.docs).orderBy("doc_id").collect()] == [(0, None), (1, "format"), (2, "file")]


def test_text_and_paths(spark):
    d = documents(spark, build(BASE))
    assert [r.text for r in d.text.collect()] == ["Hello)World"]
    shape = d.objects.where("type = 'path'").first()
    assert tuple(shape.matrix) == (2, 0, 0, 2, 5, 5) and [s.op for s in shape.segments] == ["m", "l", "l", "l", "h"]
    assert tuple(content.path_bounds(d.objects).first().box) == (10.0, 20.0, 40.0, 60.0)
    lines = content.line_text(content.characters(d.objects)).orderBy("line").collect()
    assert [r.text for r in lines] == ["Hello)", "World"]


def test_newest_revision_wins(spark):
    first = build(BASE)
    at = len(first)
    more = b"7 0 obj\n<< /Type /Page /Parent 6 0 R /MediaBox [0 0 50 60] >>\nendobj\n"
    prev = int(first.split(b"startxref\n")[1].split()[0])
    second = first + more + b"xref\n7 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, prev, at + len(more))
    d = documents(spark, second)
    assert [r.width for r in d.pages.where("page_index = 1").collect()] == [60.0]
    oldest = pdf.latest(pdf.xref(d.docs), oldest=True).where("obj_num = 7").first()
    assert oldest.revision == 1 and d.xref.where("obj_num = 7").first().field == at


def test_object_and_xref_streams(spark):
    packed = b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] >>"
    body = b"%PDF-1.5\n"
    a = len(body)
    body += b"3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n"
    b = len(body)
    first = packed.index(b"<<")
    body += b"5 0 obj\n" + stream(zlib.compress(packed), b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % first) + b"\nendobj\n"
    c = len(body)
    rows = [(2, 5, 0), (2, 5, 1), (1, a, 0), (0, 0, 0), (1, b, 0)]
    table = filters.png_filtered(b"".join(bytes([t]) + f.to_bytes(2, "big") + bytes([g]) for t, f, g in rows), 4)
    entries = b"/Type /XRef /W [1 2 1] /Index [1 5] /Size 6 /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >>"
    body += b"6 0 obj\n" + stream(zlib.compress(table), entries) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % c
    assert [(r.page_index, r.obj_num, r.width) for r in documents(spark, body).pages.collect()] == [(0, 3, 612.0)]


def test_forms(spark):
    objects = BASE | {
        1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm 20 0 R >>",
        20: b"<< /Fields [21 0 R 24 0 R] >>",
        21: b"<< /T (person) /FT /Tx /Ff 4096 /V (all) /Kids [22 0 R 23 0 R] >>",
        22: b"<< /T (name) /V <FEFF00C9> /Parent 21 0 R >>",
        23: b"<< /T (town) /Parent 21 0 R >>",
        24: b"<< /T (ok) /FT /Btn /Ff 32768 /V /Yes /Kids [25 0 R] >>",
        25: b"<< /Subtype /Widget /Parent 24 0 R /Rect [0 0 1 1] >>",
    }
    found = forms.fields(documents(spark, build(objects)).nodes)
    rows = {r.full_name: (r.type, r.flags, r.value) for r in found.collect()}
    assert rows == {"person.name": ("text", 4096, "É"), "person.town": ("text", 4096, "all"), "ok": ("radio_button", 32768, "Yes")}
    assert forms.form_data(found).first().data == {"person.name": "É", "person.town": "all", "ok": "Yes"}


def test_annotations(spark):
    objects = BASE | {
        3: b"<< /Type /Page /Parent 2 0 R /Annots [30 0 R 31 0 R] >>",
        30: b"<< /Subtype /Link /Rect [10 10 50 50] /F 4 /A << /S /URI /URI (http://x.example/) >> >>",
        31: b"<< /Subtype /Text /Rect [60 60 70 70] /F 6 /Contents (note) >>",
    }
    d = documents(spark, build(objects))
    found = forms.annotations(d.nodes, d.pages)
    assert [(r.annot_seq, r.subtype, r.uri, r.contents) for r in found.orderBy("annot_seq").collect()] == [(0, "Link", "http://x.example/", None), (1, "Text", None, "note")]
    assert [r.annot_seq for r in forms.printable(found).collect()] == [0]
    assert [r.annot_seq for r in forms.at_point(found, 25, 25).collect()] == [0]


def test_resolved_references(spark):
    objects = BASE | {40: b"<< /A 41 0 R /B 99 0 R /C 43 0 R >>", 41: b"42 0 R", 42: b"(end)", 43: b"43 0 R"}
    nodes = documents(spark, build(objects)).nodes
    got = {r.key: (r.kind, r.s) for r in pdf.resolved(nodes, pdf.entries_of(nodes, "A", "B", "C").where("obj_num = 40")).collect()}
    assert got["A"] == ("string", bytearray(b"end")) and got["B"][0] == "ref" and got["C"][0] == "ref"


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"42", 42), (b"-3.5", -3.5), (b"/A#42#zz", "AB#zz"), (b"(a(b)\\101\\n\\\nc)", b"a(b)A\nc"), (b"<48 656>", b"He`"), (b"[1 /N (s) null]", [1, "N", b"s", None]),
        (b"10 0 R", syntax.Ref(10, 0)), (b"<< /W 1 /K << /Z true >> >>", {"W": 1, "K": {"Z": True}}), (b"% c\n7", 7),
    ],
)
def test_objects(data, expected):
    assert syntax.read(data, 0)[0] == expected


def test_nesting_ends():
    with pytest.raises(syntax.End):
        syntax.read(b"[" * 600, 0)


@pytest.mark.parametrize("name", list(filters.ENCODERS))
@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 300 + b"bcd" * 50, bytes(range(256)) * 40])
def test_filters_turn_back(name, data):
    assert filters.decode(filters.ENCODERS[name](data), [name], []) == data


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_png_predictors(kind):
    data = bytes((k * k) % 251 for k in range(600))
    assert filters.predicted(filters.png_filtered(data, 20, kind), 12, columns=20) == data


def test_paeth_and_average():
    line = bytes([4, 10, 20, 30]) + bytes([3, 4, 4, 4])
    assert filters.predicted(line, 15, columns=3) == bytes([10, 30, 60, 9, 23, 45])


def test_unknown_and_broken_filters():
    assert filters.decode(b"x", ["JPXDecode"], []) == b"x"
    assert filters.decode(b"zz!~>", ["ASCII85Decode"], []) in (b"", filters.decode(b"zz!~>", ["ASCII85Decode"], []))


def test_decoded_column(spark):
    df = spark.createDataFrame([(bytearray(zlib.compress(b"x" * 9)), ["FlateDecode"]), (None, None)], "raw binary, f array<string>")
    out = [r.d for r in df.select(filters.decoded(F.col("raw"), F.col("f"), F.lit(None).cast("array<map<string,bigint>>")).alias("d")).collect()]
    assert out == [bytearray(b"x" * 9), None]


def test_images_fonts_and_search(spark):
    from quire.functions import sniff
    from quire.operators import images
    from quire.operators import text as search

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"IDAT", b"data") + chunk(b"IEND", b"")[:-1] + b"\0"
    df = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(b"no"))], "img_id long, data binary")
    rows = images.png_chunks(df).orderBy("k").collect()
    assert [(r.type, r.length, r.crc_ok) for r in rows] == [("IHDR", 13, True), ("IDAT", 4, True), ("IEND", 0, False)]
    bits = df.where("img_id = 2").select("img_id", F.lit(bytes([0b10110000, 0b01000000])).alias("data"), F.lit(4).alias("width"), F.lit(2).alias("height"), F.lit(1).alias("components"), F.lit(1).alias("bits"))
    assert [r.v for r in images.samples(bits).orderBy("y", "x").collect()] == [1, 0, 1, 1, 0, 1, 0, 0]
    table = b"\0\1\0\0" + (2).to_bytes(2, "big") + b"\0" * 6 + b"head\0\0\0\0" + (44).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"glyf\0\0\0\0" + (44).to_bytes(4, "big") + (999).to_bytes(4, "big") + b"abc"
    fonts = spark.createDataFrame([(1, bytearray(table))], "font_id long, data binary")
    assert [(r.tag, bytes(r.table)) for r in images.sfnt_tables(fonts).collect()] == [("head", b"abc")]
    assert fonts.select(sniff.font_kind(F.col("data")).alias("k")).first().k == "truetype"
    d = documents(spark, build(BASE))
    chars = search.indexed(content.characters(d.objects), ["doc_id", "page_index"], ["seq", "k"])
    texts = d.text.withColumn("what", F.lit("lo"))
    boxes = search.hit_boxes(search.hits(texts, "text", "what"), chars, ["doc_id", "page_index"], "what").collect()
    assert [(r.at, tuple(r.box)) for r in boxes] == [(3, (65.0, 60.0, 75.0, 70.0))]


def test_files_of_a_folder_and_release(spark, tmp_path):
    from quire.plans.extract import Documents

    (tmp_path / "deep").mkdir()
    (tmp_path / "a.pdf").write_bytes(build(BASE))
    (tmp_path / "deep" / "b.pdf").write_bytes(b"no document")
    read = pdf.read_files(spark, f"file://{tmp_path}")
    assert sorted((r.path.rsplit("/", 1)[1], r.length == len(r.content)) for r in read.collect()) == [("a.pdf", True), ("b.pdf", True)]
    with Documents(read.select("doc_id", "content")) as d:
        assert [r.text for r in d.text.collect()] == ["Hello)World"]
        assert d.nodes.is_cached
        nodes = d.nodes
    assert not nodes.is_cached
