"""Tables from files, ready for work that costs more than reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files for each core up to which rows are dealt out: less than a task of a large table reads.
SPREAD_BYTES = 32 << 20


#: Bytes of a table of short rows, each of which becomes a document, that one task gets: some ten thousand rows.
ROW_BYTES = 128 << 10


def spread(spark: SparkSession, path: str, task_bytes: int | None = None) -> DataFrame:
    """A Parquet table whose rows will be parsed or encoded.

    A file of few row groups is read by as few tasks, however many cores are idle; where the files are small (their sizes are looked up, their contents aren't read)
    the rows are dealt out to all cores. Larger tables have row groups enough and stay where they are read: nothing is shuffled.
    task_bytes: where rows grow as they are worked on, the files' bytes that a task gets, however large the table is.
    """
    cores = spark.sparkContext.defaultParallelism
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    rows = spark.read.parquet(path)
    if task_bytes:
        return rows.repartition(cores * -(-max(size, 1) // (task_bytes * cores)))
    return rows.repartition(cores) if size <= SPREAD_BYTES * cores else rows
