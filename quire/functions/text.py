"""PDF strings, names, numbers, dates and hashes as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def decode_text(b: Column) -> Column:
    """Text of a PDF string: UTF-16 or UTF-8 by its byte order mark, else Latin-1."""
    head = F.hex(F.substring(b, 1, 3))
    return (
        F.when(head.startswith("FEFF"), F.decode(F.substring(b, 3, 1 << 30), "UTF-16BE"))
        .when(head.startswith("FFFE"), F.decode(F.substring(b, 3, 1 << 30), "UTF-16LE"))
        .when(head == "EFBBBF", F.decode(F.substring(b, 4, 1 << 30), "UTF-8"))
        .otherwise(F.decode(b, "ISO-8859-1"))
    )


def encode_utf16(s: Column) -> Column:
    return F.concat(F.unhex(F.lit("FEFF")), F.encode(s, "UTF-16BE"))


def is_latin1(s: Column) -> Column:
    return ~s.rlike("[^\\x00-\\xFF]")


def hex_encode(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_decode(s: Column) -> Column:
    """White space is skipped, an odd last digit is followed by 0; null if there is another character."""
    plain = F.regexp_replace(s, r"[\x00\t\n\f\r ]", "")
    return F.when(plain.rlike("^[0-9A-Fa-f]*$"), F.unhex(F.when(F.length(plain) % 2 == 1, F.concat(plain, F.lit("0"))).otherwise(plain)))


def literal(s: Column) -> Column:
    """A literal string in parentheses, Latin-1 text escaped."""
    out = s
    for char, escaped in (("\\\\", "\\\\\\\\"), ("\\(", "\\\\("), ("\\)", "\\\\)"), ("\r", "\\\\r"), ("\n", "\\\\n")):
        out = F.regexp_replace(out, char, escaped)
    return F.concat(F.lit("("), out, F.lit(")"))


def string_object(s: Column) -> Column:
    """As a PDF writes it: a literal if Latin-1 holds it and it doesn't look like a byte order mark, else UTF-16 in hex."""
    plain = is_latin1(s) & ~s.rlike("^(\u00fe\u00ff|\u00ff\u00fe|\u00ef\u00bb\u00bf)")
    return F.when(plain, literal(s)).otherwise(F.concat(F.lit("<"), F.hex(encode_utf16(s)), F.lit(">")))


def number_text(d: Column) -> Column:
    """Up to five decimals without trailing zeros; whole numbers without a point."""
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", d.cast("double")), "0+$", ""), "\\.$", "")
    return F.when(fixed == "-0", F.lit("0")).otherwise(fixed)


def parse_number(s: Column) -> Column:
    """Sign first, digits, one point, no exponent; 0.0 if it is none."""
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), s.cast("double")).otherwise(F.lit(0.0))


def number_or_reference(s: Column) -> Column:
    """struct<obj, gen> of ``n g R``, else null."""
    pattern = r"^\s*(\d+)\s+(\d+)\s+R\s*$"
    made = F.struct(F.regexp_extract(s, pattern, 1).cast("int").alias("obj"), F.regexp_extract(s, pattern, 2).cast("int").alias("gen"))
    return F.when(s.rlike(pattern), made)


def parse_date(s: Column) -> Column:
    """``D:YYYYMMDDHHmmSSOHH'mm'`` to a timestamp; missing parts are their least value; null if it is no date."""
    pattern = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(Z|[+-])?(\d{2})?'?(\d{2})?'?$"

    def part(k: int, default: str) -> Column:
        x = F.regexp_extract(s, pattern, k)
        return F.when(x == "", F.lit(default)).otherwise(x)

    stamp = F.concat(part(1, "2000"), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    sign = F.when(part(7, "Z") == "+", 1).when(part(7, "Z") == "-", -1).otherwise(0)
    seconds = sign * (part(8, "0").cast("int") * 3600 + part(9, "0").cast("int") * 60)
    return F.when(s.rlike(pattern), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def format_date(t: Column) -> Column:
    """In the session's zone, which is to be UTC."""
    return F.concat(F.lit("D:"), F.date_format(t, "yyyyMMddHHmmss"), F.lit("Z"))


def find_first(text: Column, what, start: Column | int = 0) -> Column:
    """0-based place of the first occurrence from ``start`` on, -1 if there is none."""
    start = start if isinstance(start, Column) else F.lit(start)
    what = what if isinstance(what, Column) else F.lit(what)
    return F.locate(what, text, start + 1) - 1 if isinstance(what, str) else F.call_function("locate", what, text, start + 1) - 1


def part(text: Column, start: int, count: int = -1) -> Column:
    """``count`` characters from a 0-based place on, all that are left if it is negative; empty before the beginning or past the end."""
    if start < 0 or count == 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.substring(text, start + 1, count if count > 0 else (1 << 31) - 1)


def count_hits(text: Column, what: Column) -> Column:
    """How often a non-empty string occurs, not overlapping."""
    return F.when(F.length(what) > 0, ((F.length(text) - F.length(F.replace(text, what, F.lit("")))) / F.length(what)).cast("long")).otherwise(F.lit(0).cast("long"))


@F.pandas_udf(ArrayType(IntegerType()))
def _places(texts: pd.Series, whats: pd.Series) -> pd.Series:
    def one(text, what) -> list[int]:
        out, at = [], text.find(what) if what else -1
        while at >= 0:
            out.append(at)
            at = text.find(what, at + len(what))
        return out

    return pd.Series([None if t is None or w is None else one(t, w) for t, w in zip(texts, whats, strict=True)], dtype=object)


def all_hits(text: Column, what: Column) -> Column:
    """0-based places of all occurrences, not overlapping; linear in the text, which a fold over an array isn't."""
    return _places(text, what)


def tag_text(tag: Column) -> Column:
    """A four-character tag from its number."""
    return F.decode(F.unhex(F.lpad(F.hex(tag), 8, "0")), "ISO-8859-1")


def tag_number(s: Column) -> Column:
    return F.conv(F.hex(F.encode(F.rpad(F.substring(s, 1, 4), 4, " "), "ISO-8859-1")), 16, 10).cast("long")


def has_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) == mask


def object_key(file_key: Column, obj: Column, gen: Column, aes: bool = False) -> Column:
    """Key of one object: MD5 of file key, number and generation in little-endian bytes, and ``sAlT`` for AES."""

    def little(n: Column, size: int) -> Column:
        digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
        return F.concat(*[F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)])

    salt = F.lit("73416C54" if aes else "")
    made = F.md5(F.unhex(F.concat(F.hex(file_key), little(obj, 3), little(gen, 2), salt)))
    return F.unhex(F.substring(made, F.lit(1), 2 * F.least(F.length(file_key) + 5, F.lit(16))))
