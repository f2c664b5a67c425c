"""Character codes in strings: coding schemes, predefined code maps, code spaces.

A scheme says how many bytes a code has: ``one``, ``two``, ``mixed_two`` (two after a leading byte of some ranges) or ``mixed_four``
(one to four, by code spaces). Each becomes a pattern, so that a string is cut into codes in one pass and in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

#: Predefined code maps without their direction: name, character set, coding, ranges of leading bytes (none: two bytes a code).
PREDEFINED = (
    ("GB-EUC", "GB1", "gb", ((0xA1, 0xFE),)),
    ("GBpc-EUC", "GB1", "gb", ((0xA1, 0xFC),)),
    ("GBK-EUC", "GB1", "gb", ((0x81, 0xFE),)),
    ("GBKp-EUC", "GB1", "gb", ((0x81, 0xFE),)),
    ("GBK2K-EUC", "GB1", "gb", ((0x81, 0xFE),)),
    ("GBK2K", "GB1", "gb", ((0x81, 0xFE),)),
    ("UniGB-UCS2", "GB1", "ucs2", ()),
    ("UniGB-UTF16", "GB1", "utf16", ()),
    ("B5pc", "CNS1", "big5", ((0xA1, 0xFC),)),
    ("HKscs-B5", "CNS1", "big5", ((0x88, 0xFE),)),
    ("ETen-B5", "CNS1", "big5", ((0xA1, 0xFE),)),
    ("ETenms-B5", "CNS1", "big5", ((0xA1, 0xFE),)),
    ("UniCNS-UCS2", "CNS1", "ucs2", ()),
    ("UniCNS-UTF16", "CNS1", "utf16", ()),
    ("83pv-RKSJ", "Japan1", "jis", ((0x81, 0x9F), (0xE0, 0xFC))),
    ("90ms-RKSJ", "Japan1", "jis", ((0x81, 0x9F), (0xE0, 0xFC))),
    ("90msp-RKSJ", "Japan1", "jis", ((0x81, 0x9F), (0xE0, 0xFC))),
    ("90pv-RKSJ", "Japan1", "jis", ((0x81, 0x9F), (0xE0, 0xFC))),
    ("Add-RKSJ", "Japan1", "jis", ((0x81, 0x9F), (0xE0, 0xFC))),
    ("EUC", "Japan1", "jis", ((0x8E, 0x8E), (0xA1, 0xFE))),
    ("H", "Japan1", "jis", ()),
    ("V", "Japan1", "jis", ()),
    ("Ext-RKSJ", "Japan1", "jis", ((0x81, 0x9F), (0xE0, 0xFC))),
    ("UniJIS-UCS2", "Japan1", "ucs2", ()),
    ("UniJIS-UCS2-HW", "Japan1", "ucs2", ()),
    ("UniJIS-UTF16", "Japan1", "utf16", ()),
    ("KSC-EUC", "Korea1", "korea", ((0xA1, 0xFE),)),
    ("KSCms-UHC", "Korea1", "korea", ((0x81, 0xFE),)),
    ("KSCms-UHC-HW", "Korea1", "korea", ((0x81, 0xFE),)),
    ("KSCpc-EUC", "Korea1", "korea", ((0xA1, 0xFD),)),
    ("UniKS-UCS2", "Korea1", "ucs2", ()),
    ("UniKS-UTF16", "Korea1", "utf16", ()),
)
RANGES = "array<struct<low:int,high:int>>"


def predefined(name: Column) -> Column:
    """struct<charset, coding, scheme, leads, vertical> of a code map's name with its direction (``-H``, ``-V``); ``Identity`` has no character set; null if it is unknown."""

    def row(charset: str | None, coding: str, leads) -> Column:
        ranges = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in leads]).cast(RANGES)
        return F.struct(F.lit(charset).cast("string").alias("charset"), F.lit(coding).alias("coding"), F.lit("mixed_two" if leads else "two").alias("scheme"), ranges.alias("leads"))

    known = F.map_from_arrays(F.array(F.lit("Identity"), *[F.lit(p[0]) for p in PREDEFINED]), F.array(row(None, "cid", ()), *[row(*p[1:]) for p in PREDEFINED]))
    found = known[F.when(F.length(name) > 2, F.substring(name, F.lit(1), F.length(name) - 2)).otherwise(name)]
    return F.when(found.isNotNull(), F.struct(*[found[k].alias(k) for k in ("charset", "coding", "scheme", "leads")], F.endswith(name, F.lit("V")).alias("vertical")))


def code_value(word: Column) -> Column:
    """The number in ``<hexadecimal>`` or decimal digits; 0 if it is none or has more than 32 bits."""
    digits = F.when(F.startswith(word, F.lit("<")), F.conv(F.regexp_extract(word, "^<([0-9A-Fa-f]{1,15})", 1), 16, 10)).otherwise(F.regexp_extract(word, r"^(\d{1,15})", 1))
    n = F.coalesce(F.when(digits != "", digits).try_cast("long"), F.lit(0))
    whole = ~word.rlike("^<?[0-9A-Fa-f]{16,}")
    return F.when(whole & (n <= 0xFFFFFFFF), n).otherwise(0)


def code_spaces(body: Column) -> Column:
    """array<struct<low, high>> (hexadecimal, of equal length) of a code map's text, in its order."""
    inside = F.array_join(F.regexp_extract_all(body, F.lit(r"(?s)begincodespacerange(.*?)endcodespacerange"), F.lit(1)), " ")
    pair = F.lit(r"<\s*((?:[0-9A-Fa-f]{2}){1,4})\s*>\s*<\s*((?:[0-9A-Fa-f]{2}){1,4})\s*>")
    both = F.zip_with(F.regexp_extract_all(inside, pair, F.lit(1)), F.regexp_extract_all(inside, pair, F.lit(2)), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    return F.filter(both, lambda s: F.length(s["low"]) == F.length(s["high"]))


def scheme_of(spaces: Column) -> Column:
    """By code spaces: several are ``mixed_four``, a single one has codes of one or two bytes; without any it is ``two``."""
    single = F.when(F.length(F.get(spaces, F.lit(0))["low"]) == 4, "two").otherwise("one")
    return F.when(F.size(spaces) > 1, "mixed_four").when(F.size(spaces) == 1, single).otherwise("two")


def _lead(leads: Column) -> Column:
    parts = F.transform(leads, lambda r: F.concat(F.lit("\\x{"), F.hex(r["low"]), F.lit("}-\\x{"), F.hex(r["high"]), F.lit("}")))
    return F.when(F.size(leads) > 0, F.concat(F.lit("["), F.array_join(parts, ""), F.lit("]"))).otherwise("(?!)")


def _bytes(space: Column, n: Column) -> Column:
    """The pattern of the first n bytes of a code space."""
    one = lambda k: F.concat(F.lit("[\\x{"), F.substring(space["low"], 2 * k - 1, F.lit(2)), F.lit("}-\\x{"), F.substring(space["high"], 2 * k - 1, F.lit(2)), F.lit("}]"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")


def _whole(spaces: Column) -> Column:
    """Codes of one to four bytes, the shortest first."""
    size = lambda s: F.floor(F.length(s["low"]) / 2).cast("int")
    sized = F.array_sort(F.transform(spaces, lambda s: F.struct(size(s).alias("n"), _bytes(s, size(s)).alias("p"))))
    return F.array_join(F.transform(sized, lambda s: s["p"]), "|")


def _broken(spaces: Column) -> Column:
    """What begins like a code and isn't one: the longest beginning and the byte that doesn't fit."""
    size = lambda s: F.floor(F.length(s["low"]) / 2).cast("int")
    starts = F.flatten(F.transform(F.filter(spaces, lambda s: size(s) > 1), lambda s: F.transform(F.sequence(F.lit(1), size(s) - 1), lambda n: F.struct((-n).alias("n"), F.concat(_bytes(s, n), F.lit(".?")).alias("p")))))
    return F.array_join(F.transform(F.array_sort(starts), lambda s: s["p"]), "|")


def codes(data: Column, scheme: Column, leads: Column | None = None, spaces: Column | None = None) -> Column:
    """array<bigint>: the codes of a binary string, in order. A missing second byte is 0; bytes in no code space are the code 0. Null without a scheme."""
    leads = F.array().cast(RANGES) if leads is None else leads
    spaces = F.array().cast("array<struct<low:string,high:string>>") if spaces is None else spaces
    texts = {"scheme": scheme, "lead": _lead(leads), "whole": F.when(F.size(spaces) > 0, _whole(spaces)).otherwise("(?!)"), "broken": F.when(_broken(spaces) != "", F.concat(F.lit("|"), _broken(spaces))).otherwise("")}

    def patterns(x: Column) -> Column:
        """Made once a string, not once a code."""
        mixed_two = F.concat(F.lit("(?s)"), x["lead"], F.lit(".?|."))
        cut = F.when(x["scheme"] == "one", "(?s).").when(x["scheme"] == "two", "(?s)..?").when(x["scheme"] == "mixed_two", mixed_two).otherwise(F.concat(F.lit("(?s)"), x["whole"], x["broken"], F.lit("|.")))
        return F.struct(x["scheme"].alias("scheme"), x["lead"].alias("lead"), cut.alias("cut"), F.concat(F.lit("^(?s:"), x["whole"], F.lit(")$")).alias("whole"))

    def numbers(x: Column) -> Column:
        found = lambda t, pattern: F.call_function("regexp_extract", t, pattern, F.lit(0)) != ""  # noqa: E731 (rlike compiles a pattern from a column anew for every value; this one when it changes)

        def number(t: Column) -> Column:
            n = F.conv(F.hex(F.encode(t, "ISO-8859-1")), 16, 10).cast("long")
            short = (F.length(t) == 1) & ((x["scheme"] == "two") | ((x["scheme"] == "mixed_two") & found(t, x["lead"])))
            return F.when(short, n * 256).when((x["scheme"] == "mixed_four") & ~found(t, x["whole"]), 0).otherwise(n)

        return F.transform(F.regexp_extract_all(F.decode(data, "ISO-8859-1"), x["cut"], F.lit(0)), number)

    given = F.struct(*[c.alias(k) for k, c in texts.items()])
    return F.when(scheme.isNotNull(), let(let(given, patterns), numbers))


def code_size(code: Column, scheme: Column) -> Column:
    """Bytes of a code."""
    four = F.when(code < 0x100, 1).when(code < 0x10000, 2).when(code < 0x1000000, 3).otherwise(4)
    return F.when(scheme == "one", 1).when(scheme == "two", 2).when(scheme == "mixed_two", F.when(code < 0x100, 1).otherwise(2)).otherwise(four)


def code_bytes(code: Column, scheme: Column) -> Column:
    """A code as it stands in a string."""
    n = code_size(code, scheme) * 2
    return F.unhex(F.right(F.lpad(F.hex(code.cast("long")), 8, "0"), n))
