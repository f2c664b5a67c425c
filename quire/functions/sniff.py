"""Kinds of binary data by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures in hexadecimal, the first that fits wins.
FONTS = (("ttc", "74746366"), ("truetype", "00010000"), ("truetype", "74727565"), ("cff", "4F54544F"), ("type1", "8001"), ("type1", "25215053"), ("type1", "252146"))
IMAGES = (
    ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("jp2", "0000000C6A5020200D0A870A"), ("j2k", "FF4FFF51"), ("jxl", "FF0A"), ("jxl", "0000000C4A584C200D0A870A"), ("gif", "47494638"),
)


def kind(data: Column, signatures: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    head, out = F.hex(F.substring(data, 1, 12)), F.lit(default)
    for name, signature in reversed(signatures):
        out = F.when(F.startswith(head, F.lit(signature)), F.lit(name)).otherwise(out)
    return out


def font_kind(data: Column) -> Column:
    return kind(data, FONTS, "truetype")


def image_kind(data: Column) -> Column:
    return kind(data, IMAGES)


def big_endian(data: Column, at, size: int) -> Column:
    """An unsigned number at a 0-based place of a binary column; null past the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.substring(data, at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))
