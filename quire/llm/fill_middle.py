"""Fill-in-the-middle rewriting of texts, cut at boundaries of units.

A unit grammar names character classes: a maximal run of characters of one class is a unit, any other character is one by itself.
It is translated to a zero-width regular expression that looks at the characters on both sides: a boundary is everywhere but
between two neighbours of one class. Spark's ``split`` keeps every character, so the pieces are the text. The empty text, of
which ``split`` makes one empty piece, has no units.

DataFrame functions only; nothing is shuffled, and each row is cut by itself.

Defined results: a null text is an empty one, which stays plain; a null key is drawn for as the key ``null``; repeated rows are
cut alike; a text of any length is one row's arrays, never a prefix. New columns whose names are taken get leading underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

#: Classes of characters, as they stand within the brackets of a regular expression, whose runs are units.
GRAMMARS: dict[str, tuple[str, ...]] = {
    "characters": (),
    "letters": ("A-Za-z",),
    "words": (r"\p{L}\p{M}", r"\p{Nd}", r"\s"),
    "lines": (r"^\n",),
}
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(classes: tuple[str, ...]) -> str:
    """The zero-width expression of a grammar: inside the text, not within a surrogate pair, not between two characters of one class."""
    return r"(?<=[\s\S])(?=[\s\S])(?![\uDC00-\uDFFF])" + "".join(f"(?!(?<=[{c}])[{c}])" for c in classes)


def units(text: Column, classes: tuple[str, ...]) -> Column:
    """The text's units in order; joined they are the text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(classes), -1))


def draws(key: Column, seed: str) -> list[Column]:
    """Four integers below 2^32, from the first 32 hexadecimal digits of the SHA-256 of seed, colon and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, key: str, text: str, grammar: str = "letters", seed: str = "1", plain: int = 10, spm: int = 20) -> tuple[DataFrame, str]:
    """(df with a struct column, its name): n units, form, parts, output.

    The two cuts are drawn from all n + 1 boundaries. ``plain`` of 100 texts, the empty ones and those that hold a mark stay as they
    are (form plain); of the others ``spm`` of 100 begin with the suffix (spm), the rest with the prefix (psm).
    """
    whole, pieces, drawn, ends, made = fresh(df, "whole", "pieces", "drawn", "ends", "fim")
    cut = df.withColumn(whole, F.coalesce(col(text), F.lit("")))
    cut = cut.withColumn(pieces, units(col(whole), GRAMMARS[grammar])).withColumn(drawn, F.array(*draws(col(key), seed)))
    n = F.size(col(pieces)).cast("long")
    at = [col(drawn)[k] % (n + 1) for k in range(2)]
    cut = cut.withColumn(ends, F.struct(n.alias("n"), F.least(*at).alias("first"), F.greatest(*at).alias("last")))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(col(whole), F.lit(mark))
    form = F.when((col(whole) == "") | held | (col(drawn)[2] % 100 >= 100 - plain), "plain").when(col(drawn)[3] % 100 < spm, "spm").otherwise("psm")

    def part(start: Column, end: Column) -> Column:
        return F.array_join(F.slice(col(pieces), (start + 1).cast("int"), (end - start).cast("int")), "")

    e = col(ends)
    parts = F.struct(
        e["n"].alias("n"), form.alias("form"),
        part(F.lit(0).cast("long"), e["first"]).alias("prefix"), part(e["first"], e["last"]).alias("middle"), part(e["last"], e["n"]).alias("suffix"),
    )
    cut = cut.withColumn(made, parts)
    m = col(made)
    psm = F.concat(F.lit(PREFIX), m["prefix"], F.lit(SUFFIX), m["suffix"], F.lit(MIDDLE), m["middle"])
    output = F.when(m["form"] == "plain", col(whole)).when(m["form"] == "spm", F.concat(F.lit(SUFFIX), m["suffix"], F.lit(PREFIX), m["prefix"], F.lit(MIDDLE), m["middle"]))
    return cut.withColumn(made, m.withField("output", output.otherwise(psm))).select(*[col(c) for c in df.columns], m), made


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no mark can begin within a part and end beyond it, so each stands once."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
