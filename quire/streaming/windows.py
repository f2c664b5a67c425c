"""Streams: documents that arrive in revisions, and windowed counts of events with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    reader = spark.readStream.schema(schema)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(path)


def first_of_each(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key hasn't come within the watermark; state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, width: str, keys: list[str], delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per window and keys; windows close once the watermark has passed them."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    made = stream.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    made = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return made.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def arriving_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files as they arrive under a path."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def newer_only(stream: DataFrame, key: str, order: str, time: str | None = None, keep: str | None = None) -> DataFrame:
    """The rows that are newer than any of their key before, as a log of changes: ``lookup.latest`` of it is the newest of each key.

    key: a column of strings or whole numbers; order: of whole numbers. The state is the greatest order of each key, no row; what comes late, or twice, gives nothing. Of
    a batch's rows of a key the newest is given. time, keep: a timestamp column, and how long (``30 days``) after
    the last time of a key the watermark forgets it, so that the state is bounded; a row of that key then counts as new, whatever its order, and rows
    that the watermark has passed are dropped. Without these keys are remembered for ever.
    """
    life = int(pd.Timedelta(keep).total_seconds() * 1000) if time and keep else None
    names = stream.columns

    def newest_of(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, last = state.get if state.exists else (None, 0)
        best = None
        for part in parts:  # a batch may give a key's rows in several parts
            if life and part[time].notna().any():
                last = max(last, int(part[time].max().timestamp() * 1000))
            part = part[part[order].notna()]
            if len(part) and (best is None or part[order].max() > best[order].iloc[0]):
                best = part.loc[[part[order].idxmax()]]
        if best is not None and (known is None or int(best[order].iloc[0]) > known):
            known = int(best[order].iloc[0])
            yield best[names]
        if known is not None:
            state.update((known, last))
            if life:
                state.setTimeoutTimestamp(max(last + life, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.EventTimeTimeout if life else GroupStateTimeout.NoTimeout
    marked = stream.withWatermark(time, keep) if life else stream
    return marked.groupBy(key).applyInPandasWithState(newest_of, stream.schema, "newest long, last long", "append", timeout)


def upsert_latest(spark: SparkSession, path: str, keys: list[str], order: str):
    """For foreachBatch: writes the latest row of each key that a batch has, under ``path``; a batch that is run again writes the same folder.

    The cost of a batch is its own size, and what is there is a log of changes, which ``newest`` reads.
    """
    from ..operators.lookup import latest

    def apply(batch: DataFrame, batch_id: int) -> None:
        latest(batch, keys, [order]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def newest(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of what ``upsert_latest`` has written; of equal orders that of the later batch."""
    from ..operators.lookup import latest

    if not _batches(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", path).schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{path}/batch=*")
    return latest(rows, keys, [order, "batch"]).select(*schema.names)


def _files(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``batch=n`` that were written whole."""
    found = _files(spark, path).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)


def drain(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, and not yet done, into Parquet folders beside its checkpoint; gives all that it has written so far.

    In the other modes than append each micro-batch's result is a folder of its own, written by the executors; the last one
    is read, whichever run wrote it. A batch that is run again writes the same folder.
    """
    spark, out = stream.sparkSession, f"{checkpoint}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{checkpoint}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    done = _batches(spark, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={done[-1]}") if done else spark.createDataFrame([], stream.schema)
