"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.walk import scratch

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names; without one only a session within one process goes on (tests)."""
    folder = scratch(spark)
    _MADE.append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to scratch paths made within: for work whose result is written elsewhere by then."""
    first = len(_MADE)
    yield
    for folder in _MADE[first:]:
        remove(spark, folder)
    del _MADE[first:]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and every executor sees it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet (case ignored), one for each wish."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def long_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: from now on this session sends at most so many rows to Python at once, which bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


class Memo(dict):
    """A bounded cache around a pure function: a full cache is emptied, so results never depend on it."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_KEPT: dict = {}


def kept(key, make: Callable):
    """What a worker keeps from task to task, of one operator at a time: workers serve one stage after the other, and what each left would add up."""
    if key not in _KEPT:
        released()
        _KEPT[key] = make()
    return _KEPT[key]


def released() -> None:
    """Called where a task begins that needs nothing kept: drops what another operator's tasks left in the worker, and gives freed memory back to the system."""
    _KEPT.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def word_hashes(most: int = 400_000) -> Memo:
    """word, in UTF-8 -> 64-bit hash."""
    return Memo(xxhash.xxh64_intdigest, most)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """64-bit hashes to doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; fewer than n, but not none, count as one run."""
    if len(words) == 0:
        return words
    if len(words) < n:
        out = words[:1] * np.uint64(1)
        for k, w in enumerate(words[1:], 1):
            out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ w
        return mix(out + np.uint64(len(words)))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def batches(texts: Iterable[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters each, so that what is built for a range is bounded."""
    start, size, k, any_text = 0, 0, 0, False
    for k, t in enumerate(texts):
        any_text = True
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if any_text:
        yield start, k + 1


SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """Words of letters, digits and any non-ASCII characters, A-Z lower-cased, in UTF-8: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.encode("utf-8", "surrogatepass").translate(SEPARATE).split() if text else []
