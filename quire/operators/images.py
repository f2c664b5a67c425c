"""Image samples and font tables as rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sniff import big_endian
from ..sources.filters import run_length_checked


#: Fixed values (JPEG 2000, annex F): the lifting factors of the irreversible 9-7 wavelet, and the scale of its low band.
LIFTING = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971)
LOW_SCALE = 1.230174104914001
#: Rows of many images that are given back at once.
ROWS = 50_000


def samples(images: DataFrame) -> DataFrame:
    """images: img_id, data, width, height, components, bits (1, 2, 4, 8) -> img_id, x, y, c, v: every sample, rows padded to bytes, high bits first.

    Past the end of the data v is null.
    """
    row_bytes = F.floor((F.col("width") * F.col("components") * F.col("bits") + 7) / 8)
    rows = images.withColumn("row_bytes", row_bytes.cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = rows.select("img_id", "y", "width", "components", "bits", F.substring("data", F.col("y") * F.col("row_bytes") + 1, F.col("row_bytes")).alias("line"))
    every = line.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("components") - 1)))
    byte = big_endian(F.col("line"), F.floor(F.col("k") * F.col("bits") / 8).cast("int"), 1)
    shift = 8 - F.col("bits") - F.pmod(F.col("k") * F.col("bits"), F.lit(8))
    v = F.call_function("shiftright", byte, shift.cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("bits")) - 1)
    x, c = F.floor(F.col("k") / F.col("components")).cast("int"), F.pmod(F.col("k"), F.col("components"))
    return every.select("img_id", x.alias("x"), "y", c.alias("c"), v.cast("int").alias("v"))


def run_length_lines(images: DataFrame) -> DataFrame:
    """images: img_id, data (runs), width, height, components, bits -> img_id, y, line: all rows of samples, padded with zeros to a multiple of four bytes.

    Images whose runs announce less than the whole image have no rows. Where a run is announced but its bytes are missing, a row is filled up with zeros.
    """
    sample_bits = F.col("width") * F.col("components") * F.col("bits")
    least = F.ceil(sample_bits * F.col("height") / 8).cast("long")
    made = images.select("img_id", run_length_checked("data", least).alias("data"), F.ceil(sample_bits / 8).cast("int").alias("used"), (F.ceil(sample_bits / 32) * 4).cast("int").alias("pitch"), "height")
    rows = made.where("data IS NOT NULL AND height > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = F.substring("data", F.col("y") * F.col("used") + 1, F.col("used"))
    return rows.select("img_id", "y", F.rpad(line, F.col("pitch"), F.lit(b"\0")).alias("line"))


def rgb_pixels(images: DataFrame, swapped: bool = False) -> DataFrame:
    """images: img_id, data, width, height of three bytes a pixel -> pixels (img_id, x, y, argb), without a shuffle. swapped: the first byte is blue. Pixels that the data is too short for are left out."""
    rows = images.where("width > 0 AND height > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = rows.select("img_id", "y", "width", F.substring("data", F.col("y") * F.col("width") * 3 + 1, F.col("width") * 3).alias("line"))
    every = line.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    v = big_endian(F.col("line"), F.col("x") * 3, 3)
    color = F.shiftleft(v.bitwiseAND(255), 16) + v.bitwiseAND(0xFF00) + F.shiftright(v, 16) if swapped else v
    return every.select("img_id", "x", "y", (color + 0xFF000000).alias("argb")).where("argb IS NOT NULL")


def scaled_to_bytes(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("v", F.floor(F.col("v") * 255 / ((1 << bits) - 1)).cast("int"))


def sfnt_tables(fonts: DataFrame) -> DataFrame:
    """fonts: font_id, data -> font_id, tag, offset, length, table: the directory of a TrueType or CFF font; tables that lie outside are left out."""
    data = F.col("data")
    n = big_endian(data, 4, 2)
    each = fonts.where(n > 0).select("font_id", "data", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("k"))
    at = F.col("k") * 16 + 12
    found = each.select(
        "font_id", "data", F.decode(F.substring("data", at + 1, F.lit(4)), "ISO-8859-1").alias("tag"), big_endian(data, at + 8, 4).alias("offset"), big_endian(data, at + 12, 4).alias("length")
    )
    inside = found.where(F.col("offset") + F.col("length") <= F.length("data"))
    return inside.select("font_id", "tag", "offset", "length", F.substring("data", (F.col("offset") + 1).cast("int"), F.col("length").cast("int")).alias("table"))


def png_chunks(images: DataFrame) -> DataFrame:
    """images: img_id, data -> img_id, k, type, length, offset, crc_ok: all chunks of each image, one after the other; one that the data cuts short has no true crc_ok."""
    kind = images.schema["img_id"].dataType.simpleString()
    columns = ["img_id", "k", "type", "length", "offset", "crc_ok"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for img, data in zip(part["img_id"], part["data"], strict=True):
                k, at = 0, 8
                while at + 8 <= len(data):
                    length = int.from_bytes(data[at : at + 4], "big")
                    crc = data[at + 8 + length : at + 12 + length]
                    rows.append((img, k, data[at + 4 : at + 8].decode("latin-1"), length, at, len(crc) == 4 and zlib.crc32(data[at + 4 : at + 8 + length]) == int.from_bytes(crc, "big")))
                    k, at = k + 1, at + length + 12
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    signed = images.where(F.startswith(F.col("data"), F.lit(b"\x89PNG\r\n\x1a\n"))).select("img_id", "data")
    return signed.mapInPandas(run, f"img_id {kind}, k int, type string, length long, offset long, crc_ok boolean")


def lifted(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """One level of the reversible 5-3 wavelet along a row: odd places become differences, even ones averages. Both ends are mirrored."""
    w = Window.partitionBy(*keys).orderBy(at)
    odd = F.col(at) % 2 == 1
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    high = rows.withColumn("_h", F.when(odd, F.col(value) - F.floor((F.coalesce(before, after) + F.coalesce(after, before)) / 2)))
    left, right = F.lag("_h").over(w), F.lead("_h").over(w)
    around = F.coalesce(left, right, F.lit(0)) + F.coalesce(right, left, F.lit(0))
    return high.withColumn(value, F.when(odd, F.col("_h")).otherwise(F.col(value) + F.floor((around + 2) / 4)).cast("long")).drop("_h")


def lowered(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Undoes ``lifted``."""
    w = Window.partitionBy(*keys).orderBy(at)
    odd = F.col(at) % 2 == 1
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    around = F.coalesce(left, right, F.lit(0)) + F.coalesce(right, left, F.lit(0))
    even = rows.withColumn("_e", F.when(~odd, F.col(value) - F.floor((around + 2) / 4)))
    before, after = F.lag("_e").over(w), F.lead("_e").over(w)
    return even.withColumn(value, F.when(odd, F.col(value) + F.floor((F.coalesce(before, after) + F.coalesce(after, before)) / 2)).otherwise(F.col("_e")).cast("long")).drop("_e")


def _moved(rows: DataFrame, keys: list[str], at: str, value: str, odd: int, factor: float) -> DataFrame:
    """Places of one parity moved by a factor of the sum of both neighbours; both ends are mirrored."""
    w = Window.partitionBy(*keys).orderBy(at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    around = F.coalesce(before, after, F.lit(0.0)) + F.coalesce(after, before, F.lit(0.0))
    return rows.withColumn(value, F.when(F.col(at) % 2 == odd, F.col(value) + factor * around).otherwise(F.col(value)))


def lifted_smooth(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """One level of the irreversible 9-7 wavelet along a row: four liftings by windows over one shuffle, then both bands are scaled. A row of one sample stays."""
    out = rows.withColumn(value, F.col(value).cast("double"))
    for k, factor in enumerate(LIFTING):
        out = _moved(out, keys, at, value, 1 - k % 2, factor)
    single = F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    return out.withColumn(value, F.when(single, F.col(value)).when(F.col(at) % 2 == 1, F.col(value) * LOW_SCALE).otherwise(F.col(value) / LOW_SCALE))


def lowered_smooth(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Undoes ``lifted_smooth``."""
    single = F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    out = rows.withColumn(value, F.when(single, F.col(value)).when(F.col(at) % 2 == 1, F.col(value) / LOW_SCALE).otherwise(F.col(value) * LOW_SCALE))
    for k, factor in reversed(list(enumerate(LIFTING))):
        out = _moved(out, keys, at, value, 1 - k % 2, -factor)
    return out


def jp2_boxes(images: DataFrame) -> DataFrame:
    """images: img_id, data -> img_id, k, parent, type, offset, header, length, whole: the boxes of a JP2 file and those within its header box.

    A length of 1 stands for one of 64 bits after the type, 0 for all that is left. A box shorter than its own header ends the walk; one that the data cuts short isn't whole.
    """
    kind = images.schema["img_id"].dataType.simpleString()

    def boxes(data: bytes) -> list[tuple]:
        rows, ahead = [], [(0, len(data), None)]
        while ahead:
            at, end, parent = ahead.pop()
            if at + 8 > end:
                continue
            length, name, header = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1"), 8
            if length == 1:
                length, header = min(int.from_bytes(data[at + 8 : at + 16], "big"), (1 << 63) - 1), 16
            elif length == 0:
                length = end - at
            if length < header:
                continue
            rows.append((len(rows), parent, name, at, header, length, at + length <= end))
            ahead.append((at + length, end, parent))
            if name == "jp2h":
                ahead.append((at + header, min(at + length, end), name))
        return rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for img, data in zip(part["img_id"], part["data"], strict=True):
                if rows := boxes(data):
                    yield pd.DataFrame([(img, *r) for r in rows], columns=["img_id", "k", "parent", "type", "offset", "header", "length", "whole"])

    signed = images.where(F.startswith(F.col("data"), F.lit(b"\x00\x00\x00\x0cjP  \r\n\x87\n"))).select("img_id", "data")
    return signed.mapInPandas(run, f"img_id {kind}, k int, parent string, type string, offset long, header int, length long, whole boolean")


def palette_mapped(samples: DataFrame, palettes: DataFrame) -> DataFrame:
    """samples: img_id, x, y, v; palettes: img_id, entry, c, level -> img_id, x, y, c, v: each index becomes one sample a channel, an equi-join.

    An index past the last entry takes the last one; images without a palette are left out.
    """
    last = palettes.groupBy("img_id").agg(F.max("entry").alias("last"))
    placed = samples.join(last, "img_id").withColumn("entry", F.greatest(F.least(F.col("v"), F.col("last")), F.lit(0)))
    return placed.join(palettes, ["img_id", "entry"]).select("img_id", "x", "y", "c", F.col("level").alias("v"))


def palette_indexed(samples: DataFrame, palettes: DataFrame, channels: int) -> DataFrame:
    """samples: img_id, x, y, v; palettes: img_id, lookup (binary, ``channels`` bytes an entry, as documents hold it) -> img_id, x, y, c, v: what ``palette_mapped`` gives of the entries as rows.

    An image's palette is one row, so what is shuffled doesn't grow with its entries.
    """
    entry = F.greatest(F.least(F.col("v"), (F.length("lookup") / channels).cast("int") - 1), F.lit(0))
    placed = samples.join(palettes.where(F.length("lookup") >= channels), "img_id").select("img_id", "x", "y", F.substring("lookup", entry * channels + 1, F.lit(channels)).alias("color"))
    levels = F.array(*[F.struct(F.lit(c).alias("c"), big_endian(F.col("color"), c, 1).cast("int").alias("v")) for c in range(channels)])
    return placed.select("img_id", "x", "y", F.inline(levels))
