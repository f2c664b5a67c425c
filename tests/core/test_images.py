"""PNG images of many chunks."""

import zlib

from quire.operators import images


def test_png_of_several_hundred_chunks(spark):
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"IDAT", b"data") * 400 + chunk(b"IEND", b"")
    rows = images.png_chunks(spark.createDataFrame([(1, bytearray(png)), (2, bytearray(b"no"))], "img_id long, data binary")).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(402)) and all(r.crc_ok for r in rows)
    assert rows[-1].type == "IEND" and rows[-1].offset == len(png) - 12


def test_odd_boxes_end_the_walk_of_their_image_only(spark):
    start = b"\x00\x00\x00\x0cjP  \r\n\x87\n"
    data = {1: start, 2: start + b"\x00\x00\x00\x04free" + b"x" * 50, 3: start + b"\x00\x00\x01\x00uuid", 4: b"", 5: start + b"\x00\x00\x00\x00jp2h" + b"\x00\x00\x00\x08pclr", 6: start + b"\x00\x00\x00\x01uuid" + b"\xff" * 8}
    rows = images.jp2_boxes(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "img_id long, data binary")).collect()
    found = sorted((r.img_id, r.k, r.type, r.length, r.whole) for r in rows if r.k)
    assert found == [(3, 1, "uuid", 256, False), (5, 1, "jp2h", 16, True), (5, 2, "pclr", 8, True), (6, 1, "uuid", (1 << 63) - 1, False)]


def test_smooth_wavelet_of_short_rows(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (2, 1, 3.0)], "k int, i int, v double")
    bands = images.lifted_smooth(rows, ["k"], "i", "v")
    assert [r.v for r in bands.where("k = 1").collect()] == [5.0]
    assert [round(r.v, 9) for r in images.lowered_smooth(bands, ["k"], "i", "v").orderBy("k", "i").collect()] == [5.0, 1.0, 3.0]


def test_tiff_predictor_of_single_bits_by_channel():
    from quire.sources.filters import predicted

    bits = [1, 0, 1, 1, 0, 1, 0, 0]  # four columns of two channels
    got = predicted(bytes([int("".join(map(str, bits)), 2)]), 2, colors=2, bits=1, columns=4)
    for c in range(2):
        level, expected = 0, []
        for b in bits[c::2]:
            level ^= b
            expected.append(level)
        assert [got[0] >> (7 - k) & 1 for k in range(c, 8, 2)] == expected
    assert predicted(b"\x01", 2, bits=16, columns=3) == b"\x01"
