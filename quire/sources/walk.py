"""Walks over trees of all documents at once, level by level, without a limit of rows or depth."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names; in a local one of our own only where it names none and runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quire-walk-")
        found = _OWN[app]
    return f"{found.rstrip('/')}/quire-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table read back. It is never broadcast: packed files of a few MB hold millions of short rows, which the driver would have to gather."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("shuffle_merge")


def levels(top: DataFrame, below: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``top``, those ``below`` gives for them, those it gives for these, and so on until it gives none.

    Each level is written to the shared folder, so a plan holds one join however deep the trees are.
    """
    path, found, level = scratch(top.sparkSession), [], top
    while not found or not found[-1].isEmpty():
        found.append(written(level, f"{path}/{len(found)}"))
        level = below(found[-1])
    return reduce(DataFrame.unionByName, found).hint("shuffle_merge")
