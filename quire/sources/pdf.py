"""PDF documents as tables, one level after the other; each is a DataFrame keyed by doc_id.

``xref`` and ``nodes`` come from one pass of Arrow batches over the bytes; all that follows (reference resolution, the page
tree, inherited attributes, streams, fields, annotations) is joins and recursion over them. Documents that
can't be read give a row with an error in ``files`` and none elsewhere; one that goes wrong while it is parsed gives a node of
kind ``error`` with the reason, and what other documents have is not touched by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crypto
from . import syntax
from .filters import decode, decoded
from .walk import levels, scratch, written

XREF = "doc_id long, revision int, obj_num int, type int, field long, gen int"
NODES = "doc_id long, obj_num int, gen int, path array<string>, kind string, i long, d double, s binary, ref_obj int, ref_gen int, raw binary"
COLUMNS = [x.split()[0] for x in NODES.split(", ")]
TRAILER = 0  # the trailer's nodes have this object number


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files under a path; the doc_id is a hash of the path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def from_text(text: Column, width: int = 612, height: int = 792) -> Column:
    """A one-page PDF (binary) that shows a text with one operator; an expression."""

    def latin(c) -> Column:
        return F.encode(c if isinstance(c, Column) else F.lit(c), "ISO-8859-1")

    stream = latin(F.concat(F.lit("BT /F1 12 Tf 100 700 Td "), T.string_object(text), F.lit(" Tj ET")))
    return assembled(
        [
            F.lit("<< /Type /Catalog /Pages 2 0 R >>"),
            F.lit(f"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 {width} {height}] >>"),
            F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>"),
            stream_body(stream),
            F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"),
        ]
    )


class Bytes(NamedTuple):
    """A column of binary data, told from one of text."""

    column: Column


def stream_body(data: Column, entries: Column | str = "") -> Bytes:
    """The body of a stream object. data: binary, encoded already; entries: text of more dictionary entries."""
    more = entries if isinstance(entries, Column) else F.lit(entries)
    head = F.concat(F.lit("<< /Length "), F.length(data).cast("string"), more, F.lit(" >>\nstream\n"))
    return Bytes(F.concat(F.encode(head, "ISO-8859-1"), data, F.lit(b"\nendstream")))


def assembled(bodies: list[Column | Bytes], trailer: Column | str = "") -> Column:
    """A document (binary) of objects 1, 2, ... with these bodies (Latin-1 text, or Bytes); object 1 is the catalog. trailer: text of more entries. An expression."""

    def binary(c: Column) -> Column:
        return F.encode(c, "ISO-8859-1")

    out, places, at = binary(F.lit("%PDF-1.4\n")), [], F.lit(9)
    for k, body in enumerate(bodies, 1):
        made = F.concat(binary(F.lit(f"{k} 0 obj\n")), body.column if isinstance(body, Bytes) else binary(body), binary(F.lit("\nendobj\n")))
        places.append(at)
        out, at = F.concat(out, made), at + F.length(made)
    n = len(bodies) + 1
    entries = [F.concat(F.lpad(p.cast("string"), 10, "0"), F.lit(" 00000 n \n")) for p in places]
    more = trailer if isinstance(trailer, Column) else F.lit(trailer)
    head = F.concat(F.lit(f"xref\n0 {n}\n0000000000 65535 f \n"), *entries, F.lit(f"trailer\n<< /Size {n} /Root 1 0 R"), more, F.lit(" >>\nstartxref\n"))
    return F.concat(out, binary(F.concat(head, at.cast("string"), F.lit("\n%%EOF\n"))))


def object_stream(objects: dict[int, Column], lock=lambda data: data) -> Bytes:
    """The body of an object stream of some objects' texts (Latin-1). lock: what encrypts its data, if anything does."""
    heads, at = [], F.lit(0)
    for n, text in objects.items():
        heads.append(F.concat(F.lit(f"{n} "), at.cast("string"), F.lit(" ")))
        at = at + F.length(text) + 1
    head = F.concat(*heads)
    data = F.encode(F.concat(head, *[F.concat(t, F.lit("\n")) for t in objects.values()]), "ISO-8859-1")
    return stream_body(lock(data), F.concat(F.lit(f" /Type /ObjStm /N {len(objects)} /First "), F.length(head).cast("string")))


def assembled_compactly(bodies: dict[int, Column | Bytes], packed: dict[int, list[int]], trailer: str = "") -> Column:
    """A document (binary) whose cross-reference section is a stream, with objects in object streams. packed: number of an object stream -> the objects in it, in order. An expression."""

    def binary(c: Column) -> Column:
        return F.encode(c, "ISO-8859-1")

    def row(kind: int, field: Column, more: int) -> Column:
        return F.concat(F.lit(bytes([kind])), F.unhex(F.lpad(F.hex(field.cast("long")), 8, "0")), F.lit(more.to_bytes(2, "big")))

    out, rows = binary(F.lit("%PDF-1.5\n")), {0: row(0, F.lit(0), 65535)}
    for n, body in sorted(bodies.items()):
        rows[n] = row(1, F.length(out), 0)
        out = F.concat(out, binary(F.lit(f"{n} 0 obj\n")), body.column if isinstance(body, Bytes) else binary(body), binary(F.lit("\nendobj\n")))
    for stream, inside in packed.items():
        rows |= {n: row(2, F.lit(stream), k) for k, n in enumerate(inside)}
    last = max(rows) + 1
    start = F.length(out)
    rows[last] = row(1, start, 0)
    table = F.concat(*[rows.get(n, row(0, F.lit(0), 0)) for n in range(last + 1)])
    section = stream_body(table, f" /Type /XRef /W [1 4 2] /Size {last + 1} /Root 1 0 R {trailer}")
    return F.concat(out, binary(F.lit(f"{last} 0 obj\n")), section.column, binary(F.concat(F.lit("\nendobj\nstartxref\n"), start.cast("string"), F.lit("\n%%EOF\n"))))


def files(docs: DataFrame) -> DataFrame:
    """doc_id, length, version and error (null, or what is wrong with the header) of (doc_id, content)."""
    head = F.decode(F.substring("content", 1, 20), "ISO-8859-1")
    version = F.regexp_extract(head, r"^%PDF-(\d+\.\d+)", 1)
    error = F.when(F.col("content").isNull(), "file").when(~F.startswith(head, F.lit("%PDF-")), "format")
    return docs.select("doc_id", F.length("content").alias("length"), F.when(version == "", "1.4").otherwise(version).alias("version"), error.alias("error"))


def readable(part: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
    """Of a batch, the documents that have the header. Told here and not by a filter, which would make Spark evaluate an expression for the content twice."""
    for doc, content in zip(part["doc_id"], part["content"], strict=True):
        if content is not None and content[:5] == b"%PDF-":
            yield doc, content


def xref(docs: DataFrame) -> DataFrame:
    """Every entry of every revision; revision 0 is the newest."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, content in readable(part):
                try:
                    found = [(doc, revision, obj, kind, field, gen) for revision, entries, _ in syntax.sections(content) for obj, (kind, field, gen) in entries.items()]
                except (ValueError, TypeError, IndexError, OverflowError, RecursionError):
                    continue  # ``nodes`` has the reason
                rows += [r for r in found if 0 <= r[2] < 1 << 31 and 0 <= r[4] < 1 << 62 and 0 <= r[5] < 1 << 31]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "revision", "obj_num", "type", "field", "gen"])

    return docs.select("doc_id", "content").mapInPandas(run, XREF)


def latest(entries: DataFrame, oldest: bool = False) -> DataFrame:
    """One entry of each object: of the newest revision, or of the oldest for compatibility."""
    pick = F.max_by if oldest else F.min_by
    one = pick(F.struct("revision", "type", "field", "gen"), F.col("revision")).alias("e")
    return entries.groupBy("doc_id", "obj_num").agg(one).select("doc_id", "obj_num", "e.*")


def _objects(content: bytes, password: bytes = b"", bodies: syntax.Bodies | None = None):
    """(number, generation, object, raw stream, key) of each object that is in use, of the newest revision. bodies: see ``syntax.indirect``.

    What is encrypted with RC4 is decrypted here; of what is encrypted with AES the object's key is given along.
    """
    entries, trailer = {}, None
    for _, some, t in syntax.sections(content):
        entries = some | entries
        trailer = trailer or t

    def length_of(ref: syntax.Ref):
        kind, at, _ = entries.get(ref.obj, (0, 0, 0))
        got = syntax.indirect(content, at) if kind == 1 else None
        return got[2] if got else None

    trailer = trailer or {}
    yield TRAILER, 0, trailer, None, None
    locked = trailer.get("Encrypt")
    at_lock = locked.obj if isinstance(locked, syntax.Ref) else -1
    if isinstance(locked, syntax.Ref):
        kind, at, _ = entries.get(locked.obj, (0, 0, 0))
        locked = got[2] if kind == 1 and (got := syntax.indirect(content, at)) else None
    method, key = "none", b""
    if isinstance(locked, dict):
        ident = trailer.get("ID") or [b""]
        method, key = crypto.security(locked, ident[0], password)

    def opened(number: int, gen: int, value, raw):
        if method == "none" or number == at_lock or isinstance(value, dict) and value.get("Type") == "XRef":
            return value, raw, None
        own = crypto.object_key(key, number, gen, method == "aes")
        if method == "aes":
            return value, raw, own
        return syntax.mapped(value, lambda s: crypto.rc4_bytes(own, s)), None if raw is None else crypto.rc4_bytes(own, raw), None

    def body_of(number: int, raw: bytes) -> bytes:
        """Of an object stream: it must be read here, and what is within it isn't encrypted once more."""
        if method == "aes":
            return crypto.aes_cbc_bytes(crypto.object_key(key, number, 0, True), raw)
        return opened(number, 0, None, raw)[1]

    packs: dict[int, dict[int, tuple]] = {}
    for number, (kind, at, gen) in sorted(entries.items()):
        if kind == 1 and (got := syntax.indirect(content, at, length_of, bodies)):
            value, raw, own = opened(number, got[1], got[2], got[3])
            yield number, got[1], value, raw, own
        elif kind == 2:
            if at not in packs:
                packs[at] = _pack(content, entries, at, length_of, body_of)
            if number in packs[at]:
                yield number, 0, packs[at][number], None, None


def _pack(content: bytes, entries: dict, stream: int, length_of, opened) -> dict:
    """Objects of one object stream, by number."""
    kind, at, _ = entries.get(stream, (0, 0, 0))
    got = syntax.indirect(content, at, length_of) if kind == 1 else None
    if not got or got[3] is None:
        return {}
    body, d, out = decode(opened(stream, got[3]), *syntax.filter_list(got[2])), got[2], {}
    numbers = [int(x) for x in re.findall(rb"\d+", body[: d.get("First", 0)])]
    for number, offset in zip(numbers[::2], numbers[1::2]):
        try:
            out[number] = syntax.read(body, d.get("First", 0) + offset)[0]
        except syntax.End:
            continue
    return out


def nodes(docs: DataFrame, password: bytes = b"") -> DataFrame:
    """All objects in use, flattened: a row for each node of their trees; streams keep their raw bytes at the root.

    password: of the user or owner, for documents with the standard security handler of versions 1, 2 and 4.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = syntax.Bodies()
        for part in parts:
            made = _Rows(part.column(0))
            for n, content in enumerate(part.column(1)):
                content = content.as_py()
                if content is None or content[:5] != b"%PDF-":
                    continue
                try:
                    made.add(n, _objects(content, password, bodies))
                except (ValueError, TypeError, IndexError, KeyError, OverflowError, RecursionError, AttributeError) as e:
                    made.add_error(n, f"{type(e).__name__}: {e}".encode("utf-8", "replace")[:1000])
                if made.size >= 100_000:  # many documents a batch, but not all: their nodes are larger than they are
                    yield made.batch()
                    made = _Rows(part.column(0))
            if made.size:
                yield made.batch()

    made = docs.select("doc_id", "content").mapInArrow(run, f"{NODES}, key binary")
    opened = {"s": F.when(F.col("kind") == "string", crypto.aes_decrypt(F.col("key"), F.col("s"))).otherwise(F.col("s")), "raw": crypto.aes_decrypt(F.col("key"), F.col("raw"))}
    return made.select(*[F.when(F.col("key").isNotNull(), opened[c]).otherwise(F.col(c)).alias(c) if c in opened else c for c in COLUMNS])


class _Rows:
    """Rows of nodes as Arrow columns. Those of an object that several documents share are made once a batch and copied by ``take``."""

    SCHEMA = pa.schema([("path", pa.list_(pa.string())), ("kind", pa.string()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.binary()), ("ref_obj", pa.int32()), ("ref_gen", pa.int32())])

    def __init__(self, doc_ids: pa.Array):
        self.doc_ids, self.size = doc_ids, 0
        self.columns: list[list] = [[] for _ in self.SCHEMA]
        self.known: dict[int, tuple] = {}  # id of an object -> the object, which keeps the id its own, its first row, how many, and what arrays it may look up
        self.blocks: list[tuple] = []  # document, number, generation, first row, rows, raw stream, key

    def _put(self, rows: list[tuple]) -> tuple[int, int]:
        first = len(self.columns[0])
        for column, values in zip(self.columns, zip(*rows, strict=True), strict=True):
            column += values
        return first, len(rows)

    def _block(self, value, arrays: dict[int, list]) -> tuple[int, int]:
        found = self.known.get(id(value))
        if found and found[3].isdisjoint(arrays):
            return found[1:3]
        rows = [(path, kind, i, d, s, r.obj if r else None, r.gen if r else None) for path, kind, i, d, s, r in syntax.flattened(value, arrays=arrays)]
        first, n = self._put(rows)
        if not found and (refs := syntax.listed(value) if isinstance(value, (dict, list)) else set()).isdisjoint(arrays):
            self.known[id(value)] = value, first, n, refs
        return first, n

    def add(self, doc: int, objects: Iterator[tuple]) -> None:
        """The objects of one document, or an exception and nothing of it."""
        found = [x for x in objects if x[0] < 1 << 31 and x[1] < 1 << 31]
        arrays = {number: value for number, _, value, _, _ in found if isinstance(value, list)}
        made = [(doc, number, gen, *self._block(value, arrays), raw, key) for number, gen, value, raw, key in found]
        self.blocks += made
        self.size += sum(b[4] for b in made)

    def add_error(self, doc: int, reason: bytes) -> None:
        self.blocks.append((doc, TRAILER, 0, *self._put([(["error"], "error", None, None, reason, None, None)]), None, None))
        self.size += 1

    def batch(self) -> pa.RecordBatch:
        docs, numbers, gens, firsts, counts = (np.array(c, np.int64) for c in list(zip(*self.blocks, strict=True))[:5])
        starts = np.cumsum(counts) - counts
        where = np.repeat(firsts - starts, counts) + np.arange(self.size)
        rows = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(self.columns, self.SCHEMA, strict=True)], schema=self.SCHEMA).take(pa.array(where))

        def sparse(k: int, at: np.ndarray) -> pa.Array:
            """Values of the blocks at their rows, null elsewhere."""
            return pa.array([b[k] for b in self.blocks], pa.binary()).take(pa.array(at, mask=at < 0))

        roots = np.full(self.size, -1)
        roots[starts[counts > 0]] = np.arange(len(self.blocks))[counts > 0]
        every = np.repeat(np.arange(len(self.blocks)), counts)
        of = dict(zip(rows.schema.names, rows.columns, strict=True)) | {
            "doc_id": self.doc_ids.take(pa.array(docs[every])), "obj_num": pa.array(numbers[every].astype(np.int32)), "gen": pa.array(gens[every].astype(np.int32)), "raw": sparse(5, roots), "key": sparse(6, every),
        }
        return pa.RecordBatch.from_arrays([of[c] for c in [*COLUMNS, "key"]], names=[*COLUMNS, "key"])


def entries_of(table: DataFrame, *keys: str) -> DataFrame:
    """Direct entries of the objects' dictionaries, as doc_id, obj_num, key and the node's columns."""
    top = table.where(F.size("path") == 1).withColumn("key", F.get("path", F.lit(0))).drop("path", "raw", "gen")
    return top.where(F.col("key").isin(*keys)) if keys else top


def resolved(table: DataFrame, entries: DataFrame, links: int = 2) -> DataFrame:
    """Entries whose references are followed to the object they mean, through at most ``links`` references in a row.

    What a missing object or a cycle leaves is a reference still. Arrays and dictionaries stay references:
    their nodes are found by ``ref_obj``.
    """
    values = ("kind", "i", "d", "s", "ref_obj", "ref_gen")
    roots = table.where((F.size("path") == 0) & ~F.col("kind").isin("dict", "array")).select("doc_id", F.col("obj_num").alias("ref_obj"), F.struct(*values).alias("to"))
    out = entries.select("doc_id", "obj_num", "key", *values)
    for _ in range(links):
        joined = out.join(roots, ["doc_id", "ref_obj"], "left")
        out = joined.select("doc_id", "obj_num", "key", *[F.when(F.col("to").isNotNull(), F.col("to")[c]).otherwise(F.col(c)).alias(c) for c in values])
    return out


def fetched(table: DataFrame, refs: DataFrame) -> DataFrame:
    """refs: doc_id, ref_obj, ref_gen, more -> with the root of the object they mean (kind, i, d, s), null unless one of this number and this very generation is in use."""
    roots = table.where((F.size("path") == 0) & (F.col("obj_num") != TRAILER)).select("doc_id", F.col("obj_num").alias("ref_obj"), F.col("gen").alias("ref_gen"), *[F.col(c).alias(f"to_{c}") for c in ("kind", "i", "d", "s")])
    rest = [c for c in refs.columns if c not in ("doc_id", "ref_obj", "ref_gen")]
    return refs.join(roots, ["doc_id", "ref_obj", "ref_gen"], "left").select("doc_id", "ref_obj", "ref_gen", *rest, *[F.col(f"to_{c}").alias(f"to_{c}") for c in ("kind", "i", "d", "s")])


def page_tree(table: DataFrame) -> DataFrame:
    """(doc_id, obj_num, page_index, ancestors) of the pages in order: a walk over /Kids from the catalog, level by level, cycles cut.

    ancestors: object numbers from the page up to the root.
    """
    first, second = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    listed = ((F.size("path") == 1) & first.isin("Root", "Pages")) | ((F.size("path") == 2) & (first == "Kids"))
    refs = written(table.where((F.col("kind") == "ref") & listed).select("doc_id", "obj_num", first.alias("key"), second.cast("int").alias("n"), "ref_obj"), scratch(table.sparkSession))
    top = refs.where((F.col("obj_num") == TRAILER) & (F.col("key") == "Root")).select("doc_id", F.col("ref_obj").alias("catalog"))
    pages = refs.where("key = 'Pages'").select("doc_id", F.col("obj_num").alias("catalog"), F.col("ref_obj").alias("root"))
    kids = refs.where("key = 'Kids'").select("doc_id", F.col("obj_num").alias("parent"), "n", F.col("ref_obj").alias("kid"))
    types = table.where((F.col("path") == F.array(F.lit("Type"))) & (F.col("kind") == "name")).select("doc_id", "obj_num", F.decode("s", "ISO-8859-1").alias("type"))

    def below(level: DataFrame) -> DataFrame:
        down = level.withColumnRenamed("obj_num", "parent").join(kids, ["doc_id", "parent"]).where("NOT array_contains(ancestors, kid)")
        return down.select("doc_id", F.col("kid").alias("obj_num"), F.array_append("place", F.col("n")).alias("place"), F.array_prepend("ancestors", F.col("kid")).alias("ancestors"))

    roots = top.join(pages, ["doc_id", "catalog"]).select("doc_id", F.col("root").alias("obj_num"), F.array().cast("array<int>").alias("place"), F.array("root").alias("ancestors"))
    walked = levels(roots, below).join(types.where("type = 'Page'"), ["doc_id", "obj_num"])
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    return walked.select("doc_id", "obj_num", index.cast("int").alias("page_index"), "ancestors")


def inherited(tree: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(doc_id, obj_num, owner): the page itself or its nearest ancestor whose dictionary has the key."""
    owners = table.where(F.col("path") == F.array(F.lit(key))).select("doc_id", F.col("obj_num").alias("owner")).distinct()
    up = tree.select("doc_id", "obj_num", F.posexplode("ancestors").alias("depth", "owner"))
    return up.join(owners, ["doc_id", "owner"]).groupBy("doc_id", "obj_num").agg(F.min_by("owner", "depth").alias("owner"))


def pages(table: DataFrame, inherit_rotation: bool = True, tree: DataFrame | None = None) -> DataFrame:
    """doc_id, page_index, obj_num, media_box, crop_box, rotation (0, 90, 180, 270), width, height.

    tree: the page tree, if it is kept. One join finds all inherited attributes.
    """
    from ..operators.objects import attributes, nearest, rect_of

    tree = page_tree(table) if tree is None else tree
    wanted = {"media_box": ("nums", "MediaBox"), "crop_box": ("nums", "CropBox"), "turn": ("int", "Rotate")}
    found = attributes(table, wanted)
    names = list(wanted) if inherit_rotation else list(wanted)[:2]
    out = tree.join(nearest(tree, found, names), ["doc_id", "obj_num"], "left")
    if not inherit_rotation:
        out = out.join(found.select("doc_id", "obj_num", "turn"), ["doc_id", "obj_num"], "left")
    whole = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(612.0).alias("right"), F.lit(792.0).alias("bottom"))
    turn = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(360))
    out = out.withColumn("media_box", F.coalesce(rect_of(F.col("media_box")), whole)).withColumn("crop_box", F.coalesce(rect_of(F.col("crop_box")), F.col("media_box")))
    out = out.withColumn("rotation", F.when(turn % 90 == 0, turn).otherwise(0).cast("int"))
    w, h = F.expr("media_box.right - media_box.left"), F.expr("media_box.bottom - media_box.top")
    turned = F.col("rotation").isin(90, 270)
    return out.select("doc_id", "page_index", "obj_num", "media_box", "crop_box", "rotation", F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def streams(table: DataFrame) -> DataFrame:
    """doc_id, obj_num, filters, parms, data: all streams, decoded once."""
    raw = table.where((F.size("path") == 0) & F.col("raw").isNotNull()).select("doc_id", "obj_num", "raw")
    named = table.where((F.get("path", F.lit(0)) == "Filter") & (F.col("kind") == "name") & (F.size("path") <= 2))
    filters = named.groupBy("doc_id", "obj_num").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.try_element_at("path", F.lit(2)).cast("int"), F.lit(0)).alias("n"), F.decode("s", "ISO-8859-1").alias("f")))), lambda x: x["f"]).alias("filters")
    )
    given = table.where((F.get("path", F.lit(0)) == "DecodeParms") & F.col("i").isNotNull() & F.size("path").between(2, 3))
    n = F.when(F.size("path") == 3, F.get("path", F.lit(1)).cast("int")).otherwise(0)
    by_filter = given.groupBy("doc_id", "obj_num", n.alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(F.element_at("path", -1), F.col("i")))).alias("p"))
    parms = by_filter.groupBy("doc_id", "obj_num").agg(F.map_from_entries(F.collect_list(F.struct("n", "p"))).alias("by"))
    joined = raw.join(filters, ["doc_id", "obj_num"], "left").join(parms, ["doc_id", "obj_num"], "left")
    none = F.create_map().cast("map<string,bigint>")
    listed = F.transform(F.coalesce("filters", F.array().cast("array<string>")), lambda _, k: F.coalesce(F.col("by")[k], none))
    return joined.select("doc_id", "obj_num", F.coalesce("filters", F.array().cast("array<string>")).alias("filters"), listed.alias("parms"), decoded(F.col("raw"), F.col("filters"), listed).alias("data"))


def contents(table: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_id, page_index, data: the content streams of each page, joined by line feeds."""
    refs = table.where((F.col("kind") == "ref") & (F.get("path", F.lit(0)) == "Contents") & (F.size("path") <= 2))
    refs = refs.select("doc_id", "obj_num", F.coalesce(F.try_element_at("path", F.lit(2)).cast("int"), F.lit(0)).alias("n"), "ref_obj")
    found = tree.join(refs, ["doc_id", "obj_num"]).join(streams(table).select("doc_id", F.col("obj_num").alias("ref_obj"), "data"), ["doc_id", "ref_obj"])
    parts = found.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("n", "data"))).alias("parts"))
    first = F.col("parts")[0]["data"]
    joined = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), first, lambda s, p: F.concat(s, F.lit(b"\n"), p["data"]))
    return parts.select("doc_id", "page_index", joined.alias("data"))


def metadata(table: DataFrame) -> DataFrame:
    """doc_id, key, value of the information dictionary's strings."""
    info = table.where((F.col("obj_num") == TRAILER) & (F.col("path") == F.array(F.lit("Info")))).select("doc_id", F.col("ref_obj").alias("obj_num"))
    strings = entries_of(table).where("kind = 'string'").select("doc_id", "obj_num", "key", T.decode_text(F.col("s")).alias("value"))
    return info.join(strings, ["doc_id", "obj_num"]).select("doc_id", "key", "value")


def append_revision(content: Column, last_xref, obj_num, body: Column) -> Column:
    """The document with one object replaced or added by an incremental update; an expression.

    last_xref: place of the newest cross-reference section; body: the object's text, Latin-1.
    """
    last, number = (x if isinstance(x, Column) else F.lit(x) for x in (last_xref, obj_num))

    def latin(c: Column) -> Column:
        return F.encode(c, "ISO-8859-1")

    made = latin(F.concat(number.cast("string"), F.lit(" 0 obj\n"), body, F.lit("\nendobj\n")))
    start = F.length(content)
    table = F.concat(
        F.lit("xref\n"), number.cast("string"), F.lit(" 1\n"), F.lpad(start.cast("string"), 10, "0"), F.lit(" 00000 n \ntrailer\n<< /Size "), (number + 1).cast("string"),
        F.lit(" /Root 1 0 R /Prev "), last.cast("string"), F.lit(" >>\nstartxref\n"), (start + F.length(made)).cast("string"), F.lit("\n%%EOF\n"),
    )
    return F.concat(content, made, latin(table))


def updated(content: Column, last_xref: Column, changes: dict[int, Column | None]) -> Column:
    """The document with several objects replaced or added, and those whose body is None deleted, by one incremental update; an expression."""

    def latin(c: Column) -> Column:
        return F.encode(c, "ISO-8859-1")

    out, lines = content, []
    for number, body in sorted(changes.items()):
        place = F.lpad(F.length(out).cast("string"), 10, "0")
        if body is None:
            lines.append(F.lit(f"{number} 1\n0000000000 00001 f \n"))
            continue
        lines.append(F.concat(F.lit(f"{number} 1\n"), place, F.lit(" 00000 n \n")))
        out = F.concat(out, latin(F.concat(F.lit(f"{number} 0 obj\n"), body, F.lit("\nendobj\n"))))
    size = max(changes, default=0) + 1
    table = F.concat(F.lit("xref\n"), *lines, F.lit(f"trailer\n<< /Size {size} /Root 1 0 R /Prev "), last_xref.cast("string"), F.lit(" >>\nstartxref\n"), F.length(out).cast("string"), F.lit("\n%%EOF\n"))
    return F.concat(out, latin(table))


def start_of_xref(content: Column) -> Column:
    """Place of the newest cross-reference section: the last ``startxref`` within the final 1,024 bytes."""
    tail = F.decode(F.substring(content, F.greatest(F.length(content) - 1023, F.lit(1)), F.lit(1024)), "ISO-8859-1")
    return F.element_at(F.regexp_extract_all(tail, F.lit(r"startxref\s+(\d+)"), F.lit(1)), -1).cast("long")
