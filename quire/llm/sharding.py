"""Rendezvous hashing of record keys over weighted shards.

Every record goes to the shard with the greatest score ``weight / -ln(u)``, where u in (0, 1) is a hash
of key and shard. Adding a shard moves only the records that the new shard wins; removing one moves only its own.
DataFrame functions only.

Defined results: a null key counts as a key of its own, a null text as an empty one; repeated rows go to
the same shard and get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh


def _unit(key: Column, shard: int) -> Column:
    """A double in (0, 1) from the first 52 bits of an MD5: the same in every engine."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard (int) of a string key. Of equal scores the greater shard number wins."""
    scores = [F.struct((F.lit(-float(w)) / F.log(_unit(key, s))).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(next(iter(weights)))


def stable_key(c: Column) -> Column:
    """A string for a key of any plain type; null is told from every string."""
    return F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit("null"))


def assign(df: DataFrame, key: str, weights: dict[int, float], grown: dict[int, float] | None = None) -> DataFrame:
    """Adds ``shard`` and, if ``grown`` weights are given, ``grown_shard`` (clashing names get a leading underscore). No shuffle."""
    shard, more = fresh(df, "shard", "grown_shard")
    out = df.withColumn(shard, rendezvous(stable_key(col(key)), weights))
    if not grown:
        return out
    # The old winner is known: only shards that are new or weigh otherwise can take a record from it.
    if all(grown.get(s) == w for s, w in weights.items()):
        k, best = stable_key(col(key)), F.lit(None)
        old = F.element_at(F.array(*[F.lit(float(w)) for _, w in sorted(weights.items())]), F.array_position(F.array(*[F.lit(s) for s in sorted(weights)]), col(shard)).cast("int"))
        bits = F.conv(F.substring(F.md5(F.concat(k, F.lit("/"), col(shard).cast("string"))), 1, 13), 16, 10).cast("double")
        best = F.struct((-old / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52)))).alias("score"), col(shard).alias("shard"))
        new = [F.struct((F.lit(-float(w)) / F.log(_unit(k, s))).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(grown.items()) if s not in weights]
        return out.withColumn(more, F.greatest(best, *new)["shard"])
    return out.withColumn(more, rendezvous(stable_key(col(key)), grown))


def with_slots(df: DataFrame, shard: str, order: list[str], key: str, cells: int | None = None) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... within each shard, ordered by a hash of key and ``order``.

    A shard may hold any share of all rows, so no window spans one: each is cut by the key's hash into ``cells``
    cells, rows are numbered within a cell, and the counts of earlier cells (shards x cells rows) are added.
    The slots don't depend on the number of cells. Only rows alike in key and ``order`` must share one.
    """
    cells = cells or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slot, h, cell, n, before = fresh(df, "slot", "h", "cell", "n", "before")
    hashed = df.withColumn(h, F.xxhash64(stable_key(col(key)), *[col(c) for c in order]))
    placed = hashed.withColumn(cell, F.least(F.floor((col(h) / F.lit(2.0**64) + F.lit(0.5)) * cells), F.lit(cells - 1)).cast("int"))
    within = Window.partitionBy(col(shard), col(cell)).orderBy(col(h), *[col(c) for c in order])
    counts = placed.groupBy(col(shard), col(cell)).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(col(shard)).orderBy(col(cell)).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(col(shard), col(cell), F.coalesce(F.sum(col(n)).over(earlier), F.lit(0)).alias(before))
    numbered = placed.withColumn(slot, F.row_number().over(within) - 1)
    joined = numbered.join(F.broadcast(starts), [shard, cell])  # shards x cells rows, however many records there are
    return joined.withColumn(slot, (col(slot) + col(before)).cast("long")).select(*[col(c) for c in df.columns], col(slot))
