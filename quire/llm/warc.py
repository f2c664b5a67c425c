"""A deterministic sharded WARC writer and its reader, as a Spark data source.

Records are range-sorted; each task rolls its gzip files by compressed size and writes them under temporary
names. The driver renames those of the attempts that succeeded and writes a manifest, last; a reader sees what the manifest
lists and nothing else. Headers and digests are made anew from the payload. The same rows give the same files, byte for
byte: the ranges' bounds come from a sample by hash and from sums over all rows, so neither the session nor how the rows
happen to be partitioned has a part in them. A folder that holds an archive already is refused.

Of equal payloads of at least ``least`` bytes the one with the greatest key is written as a response, the others
as revisits of it. Defined results: a null payload is empty; a null key sorts first; of rows alike in key and payload the
first is the response and the others revisit it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import col

FORMAT = "quire_warc"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
LEAST_RANGE, MOST_RANGE, MOST_RANGES = 16 << 20, 1 << 30, 1 << 16  # payload bytes of a range of records, and how many ranges
PER_RANGE = 20  # sampled rows for each bound
SCHEMA = "key long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, block_ok boolean"


def record_id(key: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key}/{digest.hex()}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record. Keys and the full payload's length are in extension fields."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(key, digest),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "WARC-Block-Digest": _sha1(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Key": "" if key is None else str(key),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Key": "" if refers_to is None else str(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def packed(data: bytes, level: int) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Committed(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.roll = int(options.get("roll_bytes", 64 << 20))
        self.level = int(options.get("level", 6))
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        attempt, files, sink, part = uuid.uuid4().hex, [], None, None
        marker, answered = None, None

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                sink = None

        for batch in iterator:
            for row in batch.to_pylist():
                identity = (row["key"], row["digest"])
                if row["part"] != part:
                    close()
                    part, number = row["part"], 0
                if row["marker"]:
                    marker = (identity, row["refers_to"])
                    continue
                revisit, refers_to = False, None
                if marker and marker[0] == identity:
                    refers_to = marker[1]
                    revisit = refers_to != row["key"] or answered == identity
                    answered = identity
                data = packed(record(row["key"], row["url"], row["payload"], refers_to, revisit, self.date), self.level)
                if sink is None:
                    files.append({"name": f"part-{part:05d}-{number:04d}.warc.gz", "temporary": f"_temporary/{attempt}-{len(files):06d}", "records": 0, "bytes": 0})
                    number += 1
                    sink = store.open_output_stream(f"{root}/{files[-1]['temporary']}", compression=None)
                sink.write(data)
                files[-1]["records"] += 1
                files[-1]["bytes"] += len(data)
                if files[-1]["bytes"] >= self.roll:
                    close()
        close()
        return _Committed(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        for f in files:
            store.move(f"{root}/{f['temporary']}", f"{root}/{f['name']}")
        listed = [{k: f[k] for k in ("name", "records", "bytes")} for f in files]
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest.tmp") as out:
            out.write(json.dumps({"files": listed}).encode())
        store.move(f"{root}/_manifest.tmp", f"{root}/_manifest.json")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.path))

    @staticmethod
    def _clear(store: pafs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


class _File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    z, out = zlib.decompressobj(31), []
    while data := source.read(chunk):
        while data:
            out.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
            elif not data:
                break
    if any(out):
        raise ValueError("the last record is cut off")


def parsed(data: bytes) -> dict:
    """Fields of one record as SCHEMA has them; its digests are checked."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    whole = fields["WARC-Type"] == "response"
    payload = block.partition(b"\r\n\r\n")[2] if whole else None
    number = lambda name: int(fields[name]) if fields.get(name) else None
    digest = fields["WARC-Payload-Digest"]
    return {
        "key": number("X-Key"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload": payload,
        "payload_bytes": len(payload) if whole else number("X-Payload-Length"),
        "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
        "refers_to": number("X-Refers-To-Key"),
        "block_ok": _sha1(block) == fields["WARC-Block-Digest"] and (not whole or _sha1(payload) == digest),
    }


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.with_payload = options.get("payload", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        with store.open_input_stream(f"{root}/_manifest.json") as f:
            return [_File(x["name"]) for x in json.loads(f.read())["files"]] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block_ok", pa.bool_()),
        ])
        if not partition.name:
            return
        store, root = _store(self.path)
        rows, size = [], 0
        with store.open_input_stream(f"{root}/{partition.name}", compression=None) as f:
            for data in members(f):
                row = parsed(data)
                if not self.with_payload:
                    row["payload"] = None
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """Options: path; for writing roll_bytes, level, date; for reading payload (true or false)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _sortable(key, digest):
    """Bytes that sort as (key, digest) does, null keys first."""
    flipped = F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(key.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), F.unhex(flipped))), digest)


def ranges(total: int) -> int:
    """How many ranges so many bytes are cut into: 64, unless they would be below or above the limits of a range."""
    size = max(LEAST_RANGE, min(MOST_RANGE, total // 64), -(-total // MOST_RANGES))
    return max(1, -(-total // size))


def _bounds(rows: DataFrame) -> list[bytes]:
    """Where ranges of about equal payloads begin, but for the first. At most ``PER_RANGE`` sampled rows a range reach the driver, give or take chance."""
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("payload") + 200), F.lit(0))).first()
    n = ranges(total)
    if n == 1:
        return []
    every = max(1, count // (PER_RANGE * n))
    chosen = rows.where(F.pmod(F.xxhash64("key", "url", F.length("payload")), F.lit(every)) == 0)
    sample = sorted((bytes(r.at), r.size) for r in chosen.select(_sortable(F.col("key"), F.col("digest")).alias("at"), (F.length("payload") + 200).alias("size")).collect())
    whole, seen, out = sum(size for _, size in sample), 0, []
    for at, size in sample:
        if seen * n >= (len(out) + 1) * whole and (not out or at > out[-1]):
            out.append(at)
        seen += size
    return out


def write(pages: DataFrame, key: str, url: str, payload: str, path: str, least: int = 1000, **options) -> None:
    """Writes all rows to ``path``, a folder that all executors and the driver share and that holds no archive yet.

    The payload is shuffled once, by the range sort. Which rows revisit another is found on keys and digests alone; those
    markers are sorted along and meet their rows in the writer.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    store, root = _store(path.rstrip("/"))
    if store.get_file_info(f"{root}/_manifest.json").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive already")
    body = F.coalesce(F.encode(col(payload).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(col(key).cast("long").alias("key"), F.unhex(F.sha1(body)).alias("digest"), col(url).cast("string").alias("url"), body.alias("payload"))
    slim = rows.where(F.length("payload") >= least).select("key", "digest")
    heads = slim.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    markers = slim.distinct().join(heads, "digest").select("key", "digest", "refers_to")
    one = rows.select("key", "digest", F.lit(False).alias("marker"), "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    other = markers.select("key", "digest", F.lit(True).alias("marker"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    bounds = _bounds(rows)
    shared = spark.sparkContext.broadcast(bounds)  # MOST_RANGES at most, of 29 bytes

    @F.pandas_udf("int")
    def placed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for at in parts:
            yield pd.Series([bisect.bisect_right(shared.value, x) for x in at], dtype="int32")

    part = placed(_sortable(F.col("key"), F.col("digest"))) if bounds else F.lit(0)
    ordered = one.unionByName(other).withColumn("part", part).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "digest", F.desc("marker"), "url")
    writer = ordered.write.format(FORMAT).mode("append").option("path", path)
    for name, value in options.items():
        writer = writer.option(name, str(value))
    writer.save()


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).option("path", path).option("payload", str(with_payload).lower()).load()
