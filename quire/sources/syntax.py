"""Small helpers for the bytes of one PDF: tokens, objects, cross-reference sections. Tables are made in ``pdf``."""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

_TOKEN = re.compile(rb"[\x00\t\n\f\r ]*(?:%[^\r\n]*[\x00\t\n\f\r ]*)*(<<|>>|[\[\]{}]|\(|<[^<>]*>|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[^\x00\t\n\f\r ()<>\[\]{}/%]+|\)|>)")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_REFERENCE = re.compile(rb"[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|[\s\S])")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
DEEPEST = 512
MOST_INFLATED = 1 << 30  # bytes that one stream may inflate to
LARGEST = 1 << 63
#: Entries whose value may be a reference to an array elsewhere; the array is then read as if it stood there.
LISTS = frozenset("Kids Contents MediaBox CropBox BleedBox TrimBox ArtBox Annots Fields Opt Rect BBox Matrix Filter DecodeParms Widths W Decode ColorSpace Coords Extend Background".split())


class Name(str):
    """A name object, without its slash."""


class Ref(NamedTuple):
    obj: int
    gen: int


class Keyword(bytes):
    """A bare word, such as an operator."""


class End(Exception):
    """No more tokens."""


def name_of(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), raw).decode("latin-1"))


def _unescaped(m: re.Match) -> bytes:
    c = m[1]
    if c[:1].isdigit() and c[:1] < b"8":
        return bytes([int(c, 8) & 255])
    return b"" if c in (b"\n", b"\r", b"\r\n") else _PLAIN.get(c, c)


def literal_end(data: bytes, at: int) -> int:
    """Place after the closing parenthesis; ``at`` is after the opening one."""
    depth = 1
    for m in re.compile(rb"\\[\s\S]|[()]").finditer(data, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    raise End


def read(data: bytes, at: int, depth: int = 0, references: bool = True):
    """(object, place after it). Closing brackets come back as keywords."""
    m = _TOKEN.match(data, at)
    if m is None or depth > DEEPEST:
        raise End
    t, at = m[1], m.end()
    if t == b"(":
        end = literal_end(data, at)
        return _ESCAPE.sub(_unescaped, data[at : end - 1].replace(b"\r\n", b"\n").replace(b"\r", b"\n")), end
    if t == b"<<" or t == b"[":
        items, close = [], Keyword(b">>" if t == b"<<" else b"]")
        while True:
            item, at = read(data, at, depth + 1, references)
            if isinstance(item, Keyword) and item == close:
                break
            if not isinstance(item, Keyword) or item in (b"true", b"false", b"null"):
                items.append(item)
        if t == b"[":
            return items, at
        return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}, at
    if t[:1] == b"<" and t != b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", t)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if t[:1] == b"/":
        return name_of(t[1:]), at
    if _NUMBER.match(t):
        if references and t.isdigit() and len(t) < 10 and (r := _REFERENCE.match(data, at)) and len(r[1]) < 10:
            return Ref(int(t), int(r[1])), r.end()
        return (float(t) if b"." in t or len(t) > 300 else int(t)), at
    if t in (b"true", b"false"):
        return t == b"true", at
    return (None if t == b"null" else Keyword(t)), at


def operations(data: bytes) -> list[tuple[str, list]]:
    """A content stream as (operator, operands); inline images are skipped."""
    out, operands, at = [], [], 0
    try:
        while True:
            item, at = read(data, at, references=False)
            if not isinstance(item, Keyword):
                operands.append(item)
                continue
            if item == b"ID":
                found = re.compile(rb"[\x00\t\n\f\r ]EI(?=[\x00\t\n\f\r ]|\Z)").search(data, at)
                at = found.end() if found else len(data)
                item = Keyword(b"EI")
            out.append((item.decode("latin-1"), operands))
            operands = []
    except End:
        return out


class Bodies(dict):
    """What was read from the texts of objects: those of one producer's documents are often the same. Bounded by the texts' bytes; a full one is emptied, so results never depend on it."""

    LONGEST, MOST = 1024, 1 << 20

    def __init__(self):
        super().__init__()
        self.held = 0

    def read(self, data: bytes, at: int):
        """What ``read`` gives. An object that ends before the next ``endobj`` is read alike whatever follows that."""
        stop = data.find(b"endobj", at, at + self.LONGEST)
        if stop < 0:
            return read(data, at)
        text = data[at : stop + 6]
        if (found := self.get(text)) is None:
            try:
                found = read(text, 0)
            except End:
                found = None, len(text)
            if self.held + len(text) > self.MOST:
                self.clear()
                self.held = 0
            self[text] = found
            self.held += len(text)
        value, end = found
        return (value, at + end) if end <= len(text) - 6 else read(data, at)


_HEAD = re.compile(rb"[\x00\t\n\f\r ]*(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj")
_STREAM = re.compile(rb"[\x00\t\n\f\r ]*stream(?:\r\n|\n|\r)")
_ENDSTREAM = re.compile(rb"[\x00\t\n\f\r ]*endstream")


def indirect(data: bytes, at: int, length_of=None, bodies: Bodies | None = None):
    """(number, generation, object, raw stream or None) of ``n g obj`` at a place, else None. length_of: resolves a length that is a reference.

    bodies: what equal texts gave before; such objects are shared, so they must not be changed.
    """
    head = _HEAD.match(data, at)
    if not head:
        return None
    try:
        value, end = read(data, head.end()) if bodies is None else bodies.read(data, head.end())
    except End:
        return None
    raw = None
    if isinstance(value, dict) and (s := _STREAM.match(data, end)):
        n = value.get("Length")
        n = length_of(n) if isinstance(n, Ref) and length_of else n
        if not isinstance(n, int) or not _ENDSTREAM.match(data, s.end() + n):
            stop = data.find(b"endstream", s.end())
            stop = len(data) if stop < 0 else stop
            raw = data[s.end() : stop].rstrip(b"\r\n ")
        else:
            raw = data[s.end() : s.end() + n]
    return int(head[1]), int(head[2]), value, raw


def inflated(raw: bytes) -> bytes:
    """zlib data, else raw deflate; as much as can be read."""
    for bits in (15, -15):
        z = zlib.decompressobj(bits)
        try:
            return z.decompress(raw, MOST_INFLATED)
        except zlib.error:
            continue
    return raw


def sections(data: bytes):
    """Cross-reference sections from newest to oldest: (revision, entries {obj: (type, field, gen)}, trailer). Cycles end the chain."""
    tail = data.rfind(b"startxref", max(0, len(data) - 1024))
    m = re.compile(rb"startxref[\x00\t\n\f\r ]*(\d+)").match(data, tail) if tail >= 0 else None
    at, seen, revision = (int(m[1]) if m else None), set(), 0
    while at is not None and at not in seen and at < len(data):
        seen.add(at)
        found = _table(data, at) if data[at : at + 32].lstrip().startswith(b"xref") else _stream(data, at)
        if found is None:
            return
        yield revision, *found
        prev = found[1].get("Prev")
        at, revision = (int(prev) if isinstance(prev, (int, float)) else None), revision + 1


def _table(data: bytes, at: int):
    entries, place = {}, data.index(b"xref", at) + 4
    line = re.compile(rb"[\x00\t\n\f\r ]*(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]*([nf]?)")
    start = re.compile(rb"[\x00\t\n\f\r ]*(\d+)[\x00\t\n\f\r ]+(\d+)(?![\x00\t\n\f\r ]*[nf]\b)")
    while h := start.match(data, place):
        place = h.end()
        for k in range(int(h[2])):
            if not (e := line.match(data, place)):
                return None
            entries[int(h[1]) + k] = (1 if e[3] == b"n" else 0, int(e[1]), int(e[2]))
            place = e.end()
    t = re.compile(rb"[\x00\t\n\f\r ]*trailer").match(data, place)
    try:
        trailer = read(data, t.end())[0] if t else {}
    except End:
        trailer = {}
    return entries, trailer if isinstance(trailer, dict) else {}


def _stream(data: bytes, at: int):
    got = indirect(data, at)
    if got is None or got[3] is None or not isinstance(w := got[2].get("W"), list) or len(w) < 3 or not all(isinstance(x, int) and 0 <= x <= 8 for x in w) or not any(w):
        return None
    from .filters import decode

    body, entries, place = decode(got[3], *filter_list(got[2])), {}, 0
    index = got[2].get("Index") or [0, got[2].get("Size", 0)]
    if not isinstance(index, list) or not all(isinstance(x, int) and x >= 0 for x in index):
        return None
    for first, count in zip(index[::2], index[1::2]):
        for k in range(min(count, (len(body) - place) // sum(w[:3]) + 1)):
            fields = []
            for size in w[:3]:
                fields.append(int.from_bytes(body[place : place + size], "big"))
                place += size
            entries[first + k] = (fields[0] if w[0] else 1, fields[1], fields[2])
    return entries, got[2]


def mapped(value, change):
    """The object with all its strings changed."""
    if isinstance(value, bytes) and not isinstance(value, Keyword):
        return change(value)
    if isinstance(value, list):
        return [mapped(x, change) for x in value]
    return {k: mapped(x, change) for k, x in value.items()} if isinstance(value, dict) else value


def filter_list(d: dict) -> tuple[list[str], list[dict]]:
    """Names and parameters of a stream's filters. One dictionary for several filters belongs to the first."""
    f, p = d.get("Filter", d.get("F")), d.get("DecodeParms", d.get("DP"))
    names = [str(x) for x in f if isinstance(x, Name)] if isinstance(f, list) else [str(f)] if isinstance(f, Name) else []
    parms = [x if isinstance(x, dict) else {} for x in p] if isinstance(p, list) else [p] if isinstance(p, dict) else []
    return names, [{str(k): int(v) for k, v in x.items() if isinstance(v, (int, float, bool))} for x in (parms + [{}] * len(names))[: len(names)]]


def listed(value) -> set[int]:
    """Numbers of the objects that entries of LISTS refer to, at any depth: what ``flattened`` may look up."""
    if isinstance(value, dict):
        return {x.obj for k, x in value.items() if k in LISTS and isinstance(x, Ref)}.union(*map(listed, value.values()))
    return set().union(*map(listed, value)) if isinstance(value, list) else set()


def flattened(value, path: tuple[str, ...] = (), arrays: dict[int, list] | None = None, ref: Ref | None = None):
    """(path, kind, int, double, bytes, reference) of every node of an object, parents first.

    arrays: by object number; where an entry of LISTS refers to one, it is read as the entry's value, and the entry keeps the
    reference. Whole numbers beyond 64 bits have a double only.
    """
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kind = (
        "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "real" if number
        else "ref" if isinstance(value, Ref) else "name" if isinstance(value, Name) else "string" if isinstance(value, bytes) else "array" if isinstance(value, list) else "dict"
    )
    data = value.encode("latin-1", "replace") if kind == "name" else value if kind == "string" else None
    whole = int(value) if kind == "bool" or number and -LARGEST < value < LARGEST else None
    yield list(path), kind, whole, float(value) if number else None, data, value if kind == "ref" else ref
    if kind == "array":
        for k, x in enumerate(value):
            yield from flattened(x, (*path, str(k)), arrays)
    elif kind == "dict":
        for k, x in value.items():
            if arrays and k in LISTS and isinstance(x, Ref) and x.obj in arrays:
                yield from flattened(arrays[x.obj], (*path, str(k)), {n: a for n, a in arrays.items() if n != x.obj}, x)
            else:
                yield from flattened(x, (*path, str(k)), arrays)
