"""Known answers of the expression library."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import color as C
from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import crypto, forms, lookup, raster
from quire.streaming import windows


@pytest.fixture(scope="module")
def one(spark):
    df = spark.range(1)
    return lambda c: df.select(c.alias("v")).first().v


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "made, expected",
    [
        (lambda: G.transform_point(G.translation(10, 20), 5, 5), (15, 25)),
        (lambda: G.transform_point(G.scaling(2, 3), 10, 10), (20, 30)),
        (lambda: G.transform_point(G.multiply(G.translation(1, 0), G.scaling(2, 2)), 1, 1), (4, 2)),
        (lambda: G.union(G.rect(0, 0, 50, 50), G.rect(25, 25, 100, 100)), (0, 0, 100, 100)),
        (lambda: G.intersection(G.rect(0, 0, 50, 50), G.rect(25, 25, 100, 100)), (25, 25, 50, 50)),
        (lambda: G.transform_rect(G.rotation(90), G.rect(0, 0, 2, 1)), (-1, 0, 0, 2)),
        (lambda: G.transform_point(G.display_matrix(G.rect(0, 0, 612, 792), 612, 792, 0), 0, 792), (0, 0)),
        (lambda: G.transform_point(G.display_matrix(G.rect(0, 0, 100, 200), 200, 100, 1), 0, 0), (0, 0)),
        (lambda: C.gray_to_rgb(0.5), (128, 128, 128)),
        (lambda: C.device_rgb(0.5, 0.25, 1.5), (128, 64, 255)),
        (lambda: C.cmyk_to_rgb(1.0, 0.0, 0.0, 0.0), (0, 255, 255)),
        (lambda: C.lab_to_rgb(100.0, 0.0, 0.0), (255, 255, 255)),
        (lambda: C.xyz_to_rgb(0.0, 0.0, 0.0), (0, 0, 0)),
        (lambda: C.separation_to_rgb(F.lit("All"), 1.0, 3), (0, 0, 0)),
    ],
)
def test_structs(one, made, expected):
    assert [round(v, 6) for v in one(made())] == list(expected)


@pytest.mark.parametrize(
    "made, expected",
    [
        (lambda: G.contains(G.rect(0, 0, 1, 1), 1, 1), True),
        (lambda: G.contains_half_open(G.rect(0, 0, 1, 1), 1, 1), False),
        (lambda: G.intersects(G.rect(0, 0, 1, 1), G.rect(1, 0, 2, 1)), False),
        (lambda: G.inverse(G.matrix(1, 2, 2, 4, 0, 0)), None),
        (lambda: G.segments_cross(0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0), True),
        (lambda: G.fixed_multiply(3 << 16, 1 << 15), 3 << 15),
        (lambda: G.fixed_divide(3 << 16, 2 << 16), 3 << 15),
        (lambda: T.number_text(lit(1.5)), "1.5"),
        (lambda: T.number_text(lit(-0.000001)), "0"),
        (lambda: T.number_text(lit(20.0)), "20"),
        (lambda: T.parse_number(lit("-.5")), -0.5),
        (lambda: T.parse_number(lit("1e5")), 0.0),
        (lambda: T.hex_decode(lit("48 656")), bytearray(b"He`")),
        (lambda: T.hex_decode(lit("4G")), None),
        (lambda: T.decode_text(lit(b"\xfe\xff\x00\xc9")), "É"),
        (lambda: T.decode_text(lit(b"\xef\xbb\xbf\xc3\xa9")), "é"),
        (lambda: T.decode_text(lit(b"\xe9")), "é"),
        (lambda: T.format_date(T.parse_date(lit("D:20240131120000+02'30'"))), "D:20240131093000Z"),
        (lambda: T.format_date(T.parse_date(lit("D:2024"))), "D:20240101000000Z"),
        (lambda: T.parse_date(lit("D:20241399")), None),
        (lambda: T.parse_date(lit("tomorrow")), None),
        (lambda: T.all_hits(lit("a.b.c"), lit(".")), [1, 3]),
        (lambda: T.all_hits(lit("abc"), lit("")), []),
        (lambda: T.find_first(lit("hello"), lit("l"), 3), 3),
        (lambda: T.tag_text(T.tag_number(lit("kern"))), "kern"),
        (lambda: C.luminance(255, 255, 255), 255),
        (lambda: C.argb(128, 255, 0, 0), 0x80FF0000),
        (lambda: C.source_over(lit(0xFF000000), lit(0x80FFFFFF)), 0xFF808080),
        (lambda: C.in_color_key(F.array(lit(1), lit(2)), F.array(lit(0), lit(2)), F.array(lit(1), lit(3))), True),
        (lambda: C.in_color_key(F.array(lit(1)), F.array(lit(0), lit(2)), F.array(lit(1), lit(3))), False),
        (lambda: forms.field_type(lit("Btn"), lit(1 << 15)), "radio_button"),
        (lambda: forms.field_type(lit("Btn"), lit(3 << 15)), "push_button"),
        (lambda: forms.field_type(lit("Ch"), lit(1 << 17)), "combo_box"),
    ],
)
def test_values(one, made, expected):
    assert one(made()) == expected


def test_rc4_known_answer():
    assert crypto.rc4_bytes(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("revision, length", [(2, 5), (3, 16)])
def test_passwords(revision, length):
    file_id, p = b"0123456789abcdef", -44
    owner = crypto.owner_value(b"owner", b"user", revision, length)
    user = crypto.user_value(crypto.file_key(b"user", owner, p, file_id, revision, length), file_id, revision)
    key = crypto.authenticate_user(b"user", owner, user, p, file_id, revision, length)
    assert key and crypto.authenticate_owner(b"owner", owner, user, p, file_id, revision, length) == key
    assert crypto.authenticate_user(b"wrong", owner, user, p, file_id, revision, length) is None
    assert hashlib.md5(b"").hexdigest() == "d41d8cd98f00b204e9800998ecf8427e"


def test_pixels(spark):
    size = spark.createDataFrame([(1, 2, 2, 4, 4)], "img_id long, width int, height int, new_width int, new_height int")
    base = raster.blank(size, "width", "height")
    red = raster.fill_rect(base, 0, 0, 1, 1, 0xFFFF0000)
    assert raster.scaled(red, size).where(F.col("argb") == 0xFFFF0000).count() == 4
    over = raster.blit(base, red.where("x = 0 and y = 0"), 1, 1)
    assert [(r.x, r.y) for r in over.where(F.col("argb") == 0xFFFF0000).collect()] == [(1, 1)]
    assert raster.rgb_bytes(red).first().data == bytearray(bytes([255, 0, 0]) + b"\xff" * 9)


def test_range_join_finds_all_and_only_holders(spark):
    points = spark.range(100).select(F.col("id").cast("double").alias("v"))
    ranges = spark.createDataFrame([("a", 0.0, 35.0), ("b", 35.0, 35.0), ("c", 99.5, 200.0)], "name string, lo double, hi double")
    got = {r.name: r["count"] for r in lookup.range_join(points, "v", ranges, "lo", "hi", 10.0).groupBy("name").count().collect()}
    assert got == {"a": 36, "b": 1}


def test_upsert_keeps_the_latest(spark, tmp_path):
    apply = windows.upsert_latest(spark, str(tmp_path / "t"), ["k"], "rev")
    schema = "k int, rev int, v string"
    apply(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema), 0)
    late = spark.createDataFrame([(1, 3, "c"), (2, 0, "old"), (3, 1, "d")], schema)
    apply(late, 1)
    apply(late, 1)  # a batch that runs again
    apply(spark.createDataFrame([(2, 0, "older")], schema), 7)  # numbers needn't follow each other
    table = spark.createDataFrame([], schema).schema
    rows = windows.newest(spark, str(tmp_path / "t"), table, ["k"], "rev").orderBy("k").collect()
    assert windows.newest(spark, str(tmp_path / "none"), table, ["k"], "rev").count() == 0
    assert [(r.k, r.rev, r.v) for r in rows] == [(1, 3, "c"), (2, 1, "b"), (3, 1, "d")]


def test_entry_points_work_without_the_optional_part(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(entry.core.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
