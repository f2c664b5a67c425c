"""Objects as a document writes them: text of names, arrays, dictionaries, references and streams, and changes of them, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def name_text(s: Column) -> Column:
    """``/Name``; bytes that aren't plain become ``#`` and two digits."""
    plain = "^[!\"$&'*+,.0-9:;=?@A-Z^_`a-z|~\\\\-]$"
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(chars, lambda c: F.when(c.rlike(plain), c).otherwise(F.concat(F.lit("#"), F.hex(F.encode(c, "ISO-8859-1"))))), ""))


def boolean_text(b: Column) -> Column:
    return F.when(b, "true").otherwise("false")


def reference_text(obj: Column, gen: Column | int = 0) -> Column:
    return F.concat(obj.cast("string"), F.lit(" "), (gen if isinstance(gen, Column) else F.lit(gen)).cast("string"), F.lit(" R"))


def array_text(items: Column) -> Column:
    """items: array<string>, each an object's text; null items are the null object."""
    return F.concat(F.lit("["), F.array_join(items, " ", "null"), F.lit("]"))


def numbers_text(items: Column) -> Column:
    """An array of numbers: rectangles, matrices."""
    return array_text(F.transform(items, T.number_text))


def dictionary_text(entries: Column) -> Column:
    """entries: map from a name to an object's text, in the map's order; null is the null object."""
    each = F.transform(F.map_entries(entries), lambda e: F.concat(name_text(e["key"]), F.lit(" "), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("<<"), F.array_join(each, " "), F.lit(">>"))


def with_entry(entries: Column, key: str, value: Column) -> Column:
    """The map with one entry set: replaced where it is there, else last."""
    return F.map_concat(without_entry(entries, key), F.create_map(F.lit(key), value))


def without_entry(entries: Column, key: str) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


SETTERS = {
    "int": lambda v: v.cast("long").cast("string"),
    "number": T.number_text,
    "bool": boolean_text,
    "string": T.string_object,
    "name": name_text,
    "reference": reference_text,
    "numbers": numbers_text,
}


def set_typed(entries: Column, key: str, kind: str, value: Column) -> Column:
    """kind: one of SETTERS; rectangles and matrices are numbers."""
    return with_entry(entries, key, SETTERS[kind](value))


def removed_at(items: Column, place: int) -> Column:
    return F.filter(items, lambda _, k: k != place)


def inserted(items: Column, place: int, value: Column) -> Column:
    return F.concat(F.slice(items, F.lit(1), F.lit(place)), F.array(value), F.slice(items, F.lit(place + 1), F.size(items) + 1))
