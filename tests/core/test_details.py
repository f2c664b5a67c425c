"""Field links on odd forms, rows from runs, pixels and fixed-point numbers against plain versions."""

import math
import random

from pyspark.sql import functions as F

from made import build, documents
from quire.functions import codecs
from quire.functions import geometry as G
from quire.operators import forms, images, raster
from quire.sources import filters

HEAD = {1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm 4 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R >>"}


def links(spark, *forms_of):
    d = documents(spark, *[build(HEAD | f) for f in forms_of])
    return {(r.doc_id, r.obj_num): r for r in forms.field_links(d.nodes).collect()}


def test_odd_forms(spark):
    cyclic = {4: b"<< /Fields [5 0 R] >>", 5: b"<< /T (a) /Kids [6 0 R] >>", 6: b"<< /T (b) /Kids [5 0 R 7 0 R] >>", 7: b"<< /Subtype /Widget >>"}
    twice = {4: b"<< /Fields [5 0 R 6 0 R 5 0 R] >>", 5: b"<< /T (a) /FT /Tx >>", 6: b"<< /T (b) /Kids [5 0 R 5 0 R] >>"}
    bare = {4: b"<< /Fields [] >>"}
    gone = {4: b"<< /Fields [9 0 R 5 0 R] >>", 5: b"<< /FT /Tx /Kids [] >>"}
    rows = links(spark, cyclic, twice, bare, gone)
    assert {k: (r.full_name, r.parent_obj, r.children, r.controls, r.place) for k, r in rows.items()} == {
        (0, 5): ("a", None, [6], [], 0), (0, 6): ("a.b", 5, [5], [7], None),
        (1, 5): ("a", None, [], [5], 0), (1, 6): ("b", None, [5, 5], [], 1),
        (3, 5): ("", None, [], [], 1), (3, 9): ("", None, [], [9], 0),
    }


def test_rows_from_runs(spark):
    rng, made = random.Random(3), []
    for k in range(200):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randrange(40)))
        packed = filters.run_length_encode(raw)
        packed = packed[: rng.randrange(len(packed) + 1)] if k % 3 == 0 else packed
        made.append((k, bytearray(packed), rng.randrange(1, 9), rng.randrange(6), rng.choice([1, 3]), rng.choice([1, 4, 8])))
    df = spark.createDataFrame([*made, (200, None, 1, 1, 1, 8)], "img_id long, data binary, width int, height int, components int, bits int")
    got = {}
    for r in images.run_length_lines(df).collect():
        got.setdefault(r.img_id, {})[r.y] = bytes(r.line)
    rejected = 0
    for k, data, width, height, components, bits in made:
        size, out, at = 0, b"", 0
        while at < len(data) and data[at] != 128:  # announced sizes and what is there, one run at a time
            n = data[at] + 1 if data[at] < 128 else 257 - data[at]
            size, out, at = size + n, out + (bytes(data[at + 1 : at + 1 + n]) if data[at] < 128 else bytes(data[at + 1 : at + 2]) * n), at + (n + 1 if data[at] < 128 else 2)
        used, pitch = -(-width * components * bits // 8), -(-width * components * bits // 32) * 4
        enough = size >= -(-width * components * bits * height // 8)
        rejected += not enough
        assert got.get(k, {}) == ({y: out[y * used : (y + 1) * used].ljust(pitch, b"\0") for y in range(height)} if enough else {})
    assert 20 < rejected < 180 and 200 not in got


def test_pixels(spark):
    one = spark.createDataFrame([(1, bytearray(b"\1\2\3\4\5\6\7\x08"), 2, 2), (2, None, 1, 1), (3, bytearray(), 0, 4)], "img_id long, data binary, width int, height int")
    assert {(r.x, r.y): r.argb for r in images.rgb_pixels(one).collect()} == {(0, 0): 0xFF010203, (1, 0): 0xFF040506}
    assert {(r.x, r.y): r.argb for r in images.rgb_pixels(one, swapped=True).collect()} == {(0, 0): 0xFF030201, (1, 0): 0xFF060504}
    blank = raster.blank(spark.createDataFrame([(1, 2, 2)], "img_id long, w int, h int"), "w", "h")
    changes = spark.createDataFrame([(1, 0, 0, 5, 1), (1, 0, 0, 6, 3), (1, 0, 0, 7, 2), (1, 9, 0, 8, 4), (1, -1, 0, 8, 4), (2, 0, 0, 8, 4)], "img_id long, x int, y int, argb long, t int")
    assert {(r.x, r.y): r.argb for r in raster.with_pixels(blank, changes, "t").collect()} == {(0, 0): 6, (1, 0): 0xFFFFFFFF, (0, 1): 0xFFFFFFFF, (1, 1): 0xFFFFFFFF}


def test_numbers(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(256), rng.randrange(256), rng.uniform(-40, 40), rng.randrange(-5000, 5000)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, v double, p long")
    out = df.select("*", G.multiply_one(F.col("a"), F.col("b"), 8).alias("m"), G.saturated(F.col("v"), 20).alias("s"), *[G.snapped(F.col("p"), how=h).alias(h) for h in ("round", "floor", "ceil")]).collect()
    for r in out:
        assert abs(r.m - r.a * r.b / 255) <= 0.5 + 1e-9
        assert r.s == max(-20, min(20, int(abs(r.v) + 0.5) * (1 if r.v > 0 else -1)))
        assert (r.floor, r.ceil) == (r.p // 64 * 64, -(-r.p // 64) * 64) and abs(r["round"] - r.p) <= 32
    one = 65536
    m = spark.range(1).select(G.fixed_inverse(F.lit(one), F.lit(2 * one), F.lit(one), F.lit(2 * one)).alias("none"), G.fixed_inverse(F.lit(2 * one), F.lit(one), F.lit(0), F.lit(one)).alias("m")).first()
    assert m.none is None and tuple(m.m) == (one // 2, -one // 2, 0, one)


def test_bessel_says_where_it_ends(spark):
    """Against the integral of the definition, and null where the series would be wrong."""
    rows = spark.createDataFrame([(k / 2,) for k in range(0, 45)], "x double").select("x", codecs.bessel(1, F.col("x")).alias("j")).collect()
    for r in rows:
        if r.x > 20:
            assert r.j is None
        else:
            n = 2000
            mean = sum(math.cos(t - r.x * math.sin(t)) for t in (math.pi * (k + 0.5) / n for k in range(n))) / n
            assert abs(r.j - mean) < 1e-6
