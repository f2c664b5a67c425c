"""Damaged and odd input: a document's error is its own, linear time, repeated rows, arrays elsewhere."""

import random
import time

import pytest
from pyspark.sql import functions as F
from made import BASE, build, documents, stream

from quire.functions import text as T
from quire.operators import forms, raster
from quire.operators import text as shaping
from quire.sources import filters, pdf, syntax
from quire.streaming import windows


def test_odd_numbers_and_tables_spoil_no_other_document(spark):
    odd = [
        b"<< /Type /Catalog /Pages 2 0 R /N 99999999999999999999 >>",
        b"<< /Type /Catalog /Pages 2 0 R /N 99999999999999 0 R >>",
        b"<< /Type /Catalog /Pages 2 0 R /N " + b"9" * 5000 + b" >>",
        b"<< /Type /Catalog /Pages 2 0 R /N " + b"[" * 3000 + b" >>",
    ]
    broken = stream(b"\0" * 40, b"/Type /XRef /W [1 /a 1] /Size 3")
    whole = build(BASE)
    table = b"%PDF-1.7\n1 0 obj\n" + broken + b"\nendobj\nstartxref\n9\n%%EOF\n"
    d = documents(spark, whole, *[build(BASE | {1: x}) for x in odd], table, whole)
    assert {r.doc_id for r in d.text.collect()} >= {0, 1, 2, 3, 6}
    assert d.nodes.where("kind = 'error' and doc_id in (0, 6)").count() == 0
    large = d.nodes.where("doc_id = 1 and kind = 'int' and path[0] = 'N'").first()
    assert large.i is None and large.d == 1e20


def test_fuzzed_bytes(spark):
    rng, whole = random.Random(2), build(BASE)
    rows = []
    for _ in range(150):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(9, len(data))
            data[at : at + rng.randrange(3)] = bytes(rng.choice(b"0159[]<>()/R \n\xff") for _ in range(rng.randrange(4)))
        rows.append(bytes(data))
    d = documents(spark, whole, *rows)
    assert d.nodes.where("doc_id = 0").count() == documents(spark, whole).nodes.count()
    assert d.xref.count() > 0 and d.pages.where("doc_id = 0").count() == 3
    assert [r.text for r in d.text.where("doc_id = 0").collect()] == ["Hello)World"]


def test_predictors_that_make_no_sense():
    assert filters.decode(b"abc", ["LZWDecode"], [{"Predictor": 2, "Columns": 0}]) == filters.lzw(b"abc")
    assert filters.predicted(b"abc", 12, columns=0) == b"abc"
    assert syntax.inflated(b"no deflate") == b"no deflate"


def test_arrays_that_stand_elsewhere(spark):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids 10 0 R /Count 1 /MediaBox 11 0 R >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 12 0 R /Annots 13 0 R >>",
        4: stream(b"BT /F1 10 Tf (a) Tj"),
        5: stream(b"(b) Tj ET"),
        6: b"<< /Type /Annot /Subtype /Link /Rect 14 0 R /F 4 >>",
        10: b"[3 0 R]",
        11: b"[0 0 200 100]",
        12: b"[4 0 R 5 0 R]",
        13: b"[6 0 R]",
        14: b"[1 2 3 4]",
    }
    d = documents(spark, build(objects))
    page = d.pages.first()
    assert (page.width, page.height) == (200.0, 100.0) and [r.text for r in d.text.collect()] == ["ab"]
    assert tuple(forms.annotations(d.nodes, d.pages).first().rect) == (1.0, 2.0, 3.0, 4.0)
    assert d.nodes.where("obj_num = 2 and path = array('Kids')").first().ref_obj == 10


def test_an_array_that_holds_itself(spark):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids 3 0 R >>", 3: b"[<< /Kids 3 0 R >>]"}
    assert documents(spark, build(objects)).nodes.where("kind = 'error'").count() == 0


def test_repeated_codes_stay(spark):
    codes = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, 9, "y"), (2, None, "z")], "font_id int, code long, note string")
    ranges = spark.createDataFrame([(1, 4, 6, 40)], "font_id int, low long, high long, cid long")
    assert sorted((r.note, r.cid) for r in shaping.cids(codes, ranges).collect()) == [("x", 41), ("x", 41), ("y", 0), ("z", 0)]


def test_linear_time(spark):
    data = bytes(random.Random(1).choices(range(256), k=400_000))
    began = time.perf_counter()
    packed = filters.lzw_encode(data)
    assert time.perf_counter() - began < 5 and filters.lzw(packed) == data
    for n in range(6):
        assert filters.lzw(filters.lzw_encode(b"ab" * n)) == b"ab" * n
    began = time.perf_counter()
    df = spark.createDataFrame([("ab" * 80_000, "b"), ("aaa", "aa"), ("x", ""), (None, "a"), ("é.é.", ".")], "t string, w string")
    found = [r.x for r in df.select(T.all_hits(F.col("t"), F.col("w")).alias("x")).collect()]
    assert time.perf_counter() - began < 20 and len(found[0]) == 80_000 and found[1:] == [[0], [], None, [1, 3]]
    pixels = spark.range(90_000).selectExpr("1 as img_id", "cast(id % 300 as int) as x", "cast(id div 300 as int) as y", "4278190080 + id as argb")
    began = time.perf_counter()
    image = bytes(raster.rgb_bytes(pixels).first().data)
    assert time.perf_counter() - began < 20 and image[:6] == bytes([0, 0, 0, 0, 0, 1]) and len(image) == 270_000


def test_streams_in_complete_and_append_mode(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 3} 00:00:00", k % 2, float(k)) for k in range(30)] + [(99, "2024-02-01 00:00:00", 0, 0.0), (99, "2024-02-01 00:00:01", 0, 0.0)]
    spark.createDataFrame(rows, "id long, t string, user long, value double").withColumn("ts", F.col("t").cast("timestamp")).write.parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    arriving = windows.arriving(spark, f"file://{tmp_path}/in", schema)
    whole = windows.drain(windows.windowed(arriving, "ts", "1 day", ["user"]), f"file://{tmp_path}/a", "complete")
    assert whole.agg(F.sum("n")).first()[0] == 32
    firsts = windows.drain(windows.first_of_each(arriving, "id", "ts", "400 days"), f"file://{tmp_path}/b")
    assert firsts.count() == 31
    made = windows.drain(windows.sessions(arriving, "ts", "25 hours", ["user"], "1 second"), f"file://{tmp_path}/c")
    assert {(r.user, r.n) for r in made.collect()} >= {(0, 15), (1, 15)}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quire.sources import walk

    class Elsewhere:
        class sparkContext:
            master = "spark://h:7077"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        walk.scratch(Elsewhere)
    assert pdf.TRAILER == 0
