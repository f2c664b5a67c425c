"""Content streams: operations, page objects, characters, lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import syntax

OPERATIONS = "doc_id long, page_index int, op_seq int, op string, args array<struct<num:double,str:binary,name:string>>"
OBJECTS = (
    "doc_id long, page_index int, seq int, type string, matrix struct<a:double,b:double,c:double,d:double,e:double,f:double>, text binary, font string, size double, "
    "char_space double, word_space double, scale double, render_mode int, fill array<double>, stroke array<double>, paint string, "
    "segments array<struct<op:string,pts:array<double>>>, line int, base struct<a:double,b:double,c:double,d:double,e:double,f:double>, lead double, state_font string"
)
_MATRIX, _NUMBERS = pa.struct([(c, pa.float64()) for c in "abcdef"]), pa.list_(pa.float64())
#: ``OBJECTS`` as Arrow has it.
_OBJECTS = pa.schema([
    ("doc_id", pa.int64()), ("page_index", pa.int32()), ("seq", pa.int32()), ("type", pa.string()), ("matrix", _MATRIX), ("text", pa.binary()), ("font", pa.string()), ("size", pa.float64()),
    ("char_space", pa.float64()), ("word_space", pa.float64()), ("scale", pa.float64()), ("render_mode", pa.int32()), ("fill", _NUMBERS), ("stroke", _NUMBERS), ("paint", pa.string()),
    ("segments", pa.list_(pa.struct([("op", pa.string()), ("pts", _NUMBERS)]))), ("line", pa.int32()), ("base", _MATRIX), ("lead", pa.float64()), ("state_font", pa.string()),
])
PAINTS = frozenset("S s f F f* B B* b b*".split())
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def arguments(operands: list) -> list[dict]:
    args = []
    for x in operands:
        for y in x if isinstance(x, list) else [x]:
            number = isinstance(y, (int, float)) and not isinstance(y, bool)
            args.append({"num": float(y) if number else None, "str": y if isinstance(y, bytes) else None, "name": str(y) if isinstance(y, syntax.Name) else None})
    return args


def operations(contents: DataFrame) -> DataFrame:
    """A row for each operation of (doc_id, page_index, data). An array operand gives its elements."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (doc, page, k, op, arguments(operands))
                for doc, page, data in zip(part["doc_id"], part["page_index"], part["data"], strict=True)
                for k, (op, operands) in enumerate(syntax.operations(data or b""))
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "page_index", "op_seq", "op", "args"])

    return contents.select("doc_id", "page_index", "data").mapInPandas(run, OPERATIONS)


def _times(m: tuple, n: tuple) -> tuple:
    """m first, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


def fold(doc, page, ops: list[tuple[str, list[dict]]], compat: bool, inherit: bool = False) -> list[dict]:
    """The page objects that one page's operations draw. compat: the order of ``cm`` is reversed, BT forgets the font, and modes are one too high.

    ``matrix`` of a text moves on by half the size for each byte before it. What doesn't depend on the font is given besides, for
    ``typeset``: the ``line`` within which advances add up, its matrix ``base``, and the ``lead`` that numbers in TJ add before the string,
    as a share of the size. inherit: what the operations don't set is null, as the programme is run by another.
    """
    zero, whole, black = (None, None, None) if inherit else (0.0, 100.0, [0.0])
    state = {"ctm": UNIT, "fill": black, "stroke": black, "font": None, "size": zero, "Tc": zero, "Tw": zero, "Tz": whole, "TL": 0.0, "Ts": 0.0, "Tr": None if inherit else 0}
    saved, out, path, tm, tlm, lines, lead = [], [], [], UNIT, UNIT, 0, 0.0

    def emit(kind: str, matrix: tuple, **more) -> None:
        row = dict(
            doc_id=doc, page_index=page, seq=len(out), type=kind, matrix=dict(zip("abcdef", matrix, strict=True)), text=None, font=state["font"], size=state["size"], char_space=state["Tc"],
            word_space=state["Tw"], scale=None if state["Tz"] is None else state["Tz"] / 100, render_mode=None if state["Tr"] is None else (state["Tr"] + compat) % 8, fill=state["fill"],
            stroke=state["stroke"], paint=None, segments=None, line=None, base=None, lead=None, state_font=None,
        )
        out.append(row | more)

    def show(data: bytes) -> None:
        nonlocal tm, lead
        base = _times(_times((1.0, 0.0, 0.0, 1.0, 0.0, state["Ts"]), tlm), state["ctm"])
        emit("text", _times(tm, state["ctm"]), text=data, line=lines, base=dict(zip("abcdef", base, strict=True)), lead=lead)
        lead = 0.0 if data else lead
        size, between, spaces, scale = (state[x] or 0.0 for x in ("size", "Tc", "Tw", "Tz"))
        tm = _times((1.0, 0.0, 0.0, 1.0, ((0.5 * size + between) * len(data) + spaces * data.count(b" ")) * scale / 100, 0.0), tm)

    def begin(matrix: tuple) -> None:
        nonlocal tm, tlm, lines, lead
        tm = tlm = matrix
        lines, lead = lines + 1, 0.0

    def line(x: float, y: float) -> None:
        begin(_times((1.0, 0.0, 0.0, 1.0, x, y), tlm))

    for op, args in ops:
        nums = [a["num"] for a in args if a["num"] is not None]
        strs = [a["str"] for a in args if a["str"] is not None]
        if op == "q":
            saved.append(dict(state))
        elif op == "Q":
            state = saved.pop() if saved else state
        elif op == "cm" and len(nums) == 6:
            state["ctm"] = _times(state["ctm"], tuple(nums)) if compat else _times(tuple(nums), state["ctm"])
        elif op in ("g", "rg", "k"):
            state["fill"] = [min(1.0, max(0.0, x)) for x in nums]
        elif op in ("G", "RG", "K"):
            state["stroke"] = [min(1.0, max(0.0, x)) for x in nums]
        elif op in ("m", "l", "c", "v", "y") and nums:
            path.append({"op": op, "pts": nums})
        elif op == "re" and len(nums) == 4:
            x, y, w, h = nums
            path += [{"op": o, "pts": p} for o, p in (("m", [x, y]), ("l", [x + w, y]), ("l", [x + w, y + h]), ("l", [x, y + h]), ("h", []))]
        elif op == "h":
            path.append({"op": "h", "pts": []})
        elif op in PAINTS:
            if path:
                if op in ("s", "b", "b*") and not compat:
                    path.append({"op": "h", "pts": []})
                emit("path", state["ctm"], paint=op, segments=path)
            path = []
        elif op == "n":
            path = []
        elif op == "BT":
            begin(UNIT)
            if compat:
                state |= {"font": None, "size": 0.0}
        elif op == "Tf" and nums:
            lead *= (state["size"] or nums[0]) / nums[0] if nums[0] else 0.0
            state |= {"font": next((a["name"] for a in args if a["name"]), None), "size": nums[0]}
        elif op in ("Tc", "Tw", "Tz", "TL", "Ts") and nums:
            state[op] = nums[0]
        elif op == "Tr" and nums:
            state["Tr"] = int(nums[0])
        elif op in ("Td", "TD") and len(nums) == 2:
            if op == "TD":
                state["TL"] = -nums[1]
            line(*nums)
        elif op == "Tm" and len(nums) == 6:
            begin(tuple(nums))
        elif op == "T*":
            line(0.0, -state["TL"])
        elif op in ("Tj", "'", '"'):
            if op == '"' and len(nums) >= 2:
                state |= {"Tw": nums[0], "Tc": nums[1]}
            if op != "Tj":
                line(0.0, -state["TL"])
            for s in strs:
                show(s)
        elif op == "TJ":
            for a in args:
                if a["str"] is not None:
                    show(a["str"])
                elif a["num"] is not None:
                    lead -= a["num"] / 1000
                    tm = _times((1.0, 0.0, 0.0, 1.0, -a["num"] / 1000 * (state["size"] or 0.0) * (state["Tz"] or 0.0) / 100, 0.0), tm)
        elif op == "Do":
            emit("xobject", state["ctm"], font=next((a["name"] for a in args if a["name"]), None), state_font=state["font"])
    return out


def page_objects(contents: DataFrame, compat: bool = False, inherit: bool = False) -> DataFrame:
    """Text, path and XObject rows in drawing order of (doc_id, page_index, data): an ordered fold over each page, without a shuffle. inherit: see ``fold``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc, page, data in zip(*part.columns, strict=True):
                ops = [(op, arguments(x)) for op, x in syntax.operations(data.as_py() or b"")]
                rows += fold(doc.as_py(), page.as_py(), ops, compat, inherit)
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_OBJECTS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_OBJECTS)

    return contents.select("doc_id", "page_index", "data").mapInArrow(run, OBJECTS)


def page_text(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): the strings of a page in drawing order, without added white space."""
    shown = objects.where("type = 'text'").select("doc_id", "page_index", "seq", T.decode_text(F.col("text")).alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "t")))
    return shown.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def characters(objects: DataFrame) -> DataFrame:
    """A row for each character with its place: a running sum of advances along its string."""
    shown = objects.where("type = 'text'").withColumn("t", T.decode_text(F.col("text")))
    every = shown.select("doc_id", "page_index", "seq", "matrix", "size", "char_space", "word_space", "scale", F.posexplode(F.split("t", "")).alias("k", "ch")).where("ch <> ''")
    advance = (F.lit(0.5) * F.col("size") + F.col("char_space") + F.when(F.col("ch") == " ", F.col("word_space")).otherwise(0.0)) * F.col("scale")
    before = Window.partitionBy("doc_id", "page_index", "seq").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    x = F.coalesce(F.sum(advance).over(before), F.lit(0.0))
    m = F.col("matrix")
    return every.select(
        "doc_id", "page_index", "seq", "k", "ch", F.ascii("ch").alias("unicode"), (m["a"] * x + m["e"]).alias("x"), (m["b"] * x + m["f"]).alias("y"), advance.alias("width"), "size",
    )


def lines(glyphs: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str = "y", size: str = "size") -> DataFrame:
    """Adds ``line``: a new one where y moves more than half the size from the glyph before; gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.abs(F.col(y) - F.lag(y).over(w)) > 0.5 * F.col(size)).cast("int"), F.lit(0))
    return glyphs.withColumn("new", new).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def line_text(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, line, text, box): lines with a space where a gap is wider than 0.3 of the size."""
    placed = lines(glyphs, ["doc_id", "page_index"], ["seq", "k"])
    w = Window.partitionBy("doc_id", "page_index", "line").orderBy("x", "seq", "k")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    piece = F.when(gap > 0.3 * F.col("size"), F.concat(F.lit(" "), "ch")).otherwise(F.col("ch"))
    marked = placed.withColumn("piece", piece)
    parts = F.array_sort(F.collect_list(F.struct("x", "seq", "k", "piece")))
    box = F.struct(F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("size")).alias("bottom"))
    return marked.groupBy("doc_id", "page_index", "line").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"), box.alias("box"))


def path_bounds(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, box): bounds of each path's points, null without any."""
    pts = F.flatten(F.transform("segments", lambda s: s["pts"]))
    xs = F.filter(pts, lambda _, k: k % 2 == 0)
    ys = F.filter(pts, lambda _, k: k % 2 == 1)
    box = F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))
    return objects.where("type = 'path'").select("doc_id", "page_index", "seq", F.when(F.size(pts) > 0, box).alias("box"))
