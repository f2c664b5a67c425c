"""Stupid-backoff scores of documents under the n-gram counts of all the others.

S(w | c) = c(c w) / c(c) for the longest context c, of ``order`` - 1 words at most, after which another document has w;
each word that the context is shortened by costs ``BACKOFF``, and without a context S(w) = c(w) / N. Counts leave the document's own
words out, so a text isn't explained by itself; a word that no other document has counts as one. A document's score is the sum
of log S over its words, and per word. One start mark precedes the first word; contexts don't reach beyond it, and what a
document's beginning lacks of a context costs nothing.

Distinct texts are dealt to stretches of about ``STRETCH`` characters and written down; copies of a text count as often as there are copies, and
are scored once. For one order after the other, and a part of its n-grams at a time, the texts give rows (n-gram, stretch, count), one a
stretch and n-gram, which are shuffled by the beginning of the n-gram's hash, as arrays for each beginning and stretch, and exploded behind the shuffle; their counts are
a table, summed by hash, and joined to the same rows without another shuffle.
What a stretch's n-grams count in all is written down too, as arrays again, without those that occur once. A share of the stretches at a time, texts and counts are put
together by stretch; the counts, less a text's own, go through the backoff of its words. So only a part of the exploded rows is on disk at once, and
an n-gram has no more rows than there are stretches, however common it is. Nothing is gathered in the driver.

Defined results: a null text, or one without words, has n_words 0 and null scores. Repeated rows are scored alike. A text of any length is one
row of its n-grams. Result columns whose names the key column has get leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK, SEPARATE, batches, col, fresh, long_texts, materialize, mix, released

BACKOFF = 0.4
#: The hash of the start mark, whose count is the number of documents with words; that under which the number of all words is counted.
START, ALL = np.uint64(0x5354415254), np.uint64(0x414C4C574F524453)
#: Characters of a stretch; parts of an order's n-grams that are counted one after the other, but for the highest order's; shares of the stretches that are scored one after the other.
STRETCH, PARTS, SHARES = 16_000_000, 2, 2
#: Buckets to a partition, so that partitions come out about even; characters of texts that a worker takes apart at once, whose arrays fit the processor's cache.
EVEN, BATCH = 4, 200_000
SHARE = 0.01
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C17
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) <= n:
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, x, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, each with the start mark before it, number of words of each); texts without words have no mark.

    A word's hash is the sum of its bytes' random numbers times powers of a base: the difference of two running sums.
    """
    coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
    text = np.frombuffer(b" ".join(coded).translate(SEPARATE), np.uint8)
    inside = np.concatenate(([False], text != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    up, down = _powers(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * up[: len(text)], out=sums[1:])
    words = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    sizes = np.diff(np.searchsorted(first, begins)).astype(np.int64)
    held = sizes + (sizes > 0)
    seq, is_word = np.full(int(held.sum()), START), np.ones(int(held.sum()), bool)
    is_word[(np.cumsum(held) - held)[sizes > 0]] = False
    seq[is_word] = words
    return seq, sizes


def _ngrams(seq: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2, ... order elements that end at each place; the first n - 1 places of those of n mean nothing."""
    out = [seq]
    for _ in range(1, order):
        longer = np.zeros_like(seq)
        longer[1:] = mix(mix(out[-1][:-1]) + seq[1:])
        out.append(longer)
    return out


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in it) of each element, the start mark being at place 0."""
    held = sizes + (sizes > 0)
    return np.repeat(np.arange(len(sizes)), held), np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their n."""
    if (n == 1).all():
        h = np.sort(h)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.diff(np.append(first, len(h)))
    by = np.argsort(h)
    h, n = h[by], n[by]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first)


def _exploded(orders: tuple[int, ...], part: int, parts: int, buckets: int):
    """Rows (bucket, stretch, h, n), h and n being arrays: how often a stretch's texts, with their copies, have the n-grams of so many words that fall to
    ``part``. A bucket has the n-grams whose hashes begin alike."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        held, at = [], None

        def flush() -> Iterator[pd.DataFrame]:
            h, n = _summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held.clear()
            bucket = ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            end = np.append(first[1:], len(h))
            h = h.view(np.int64)
            for start in range(0, len(first), 500):
                some = range(start, min(start + 500, len(first)))
                yield pd.DataFrame({"bucket": bucket[first[some]], "stretch": np.int32(at), "h": [h[first[i] : end[i]] for i in some], "n": [n[first[i] : end[i]] for i in some]})

        for some in rows:
            for stretch, group in some.groupby("stretch"):
                if held and stretch != at:
                    yield from flush()
                at, texts, copies = stretch, group["text"].tolist(), group["m"].to_numpy(np.int64)
                for start, end in batches(texts, BATCH):
                    seq, sizes = _tokens(texts[start:end])
                    if not len(seq):
                        continue
                    doc, place = _places(sizes)
                    m, grams = copies[start:end], _ngrams(seq, max(orders))
                    for k in orders:
                        mine = np.flatnonzero((place >= k - 1) & ((grams[k - 1] >> np.uint64(33)) % np.uint64(parts) == part))
                        held.append((grams[k - 1][mine], m[doc[mine]]))
                    if 1 in orders and part == 0:
                        held.append((np.array([ALL]), np.array([int((sizes * m).sum())])))
        if held and any(len(x) for x, _ in held):
            yield from flush()

    return run


def _left(h: np.ndarray, doc: np.ndarray, table: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How often the other documents have the n-gram at each place."""
    by = np.argsort(h, kind="stable")  # documents stay in order
    hs, ds = h[by], doc[by]
    other = np.concatenate(([True], hs[1:] != hs[:-1]))
    first = np.flatnonzero(other | np.concatenate(([True], ds[1:] != ds[:-1])))
    own = np.diff(np.append(first, len(hs)))
    each = hs[first]
    at = np.minimum(np.searchsorted(table, each), len(table) - 1)
    left = np.where(table[at] == each, totals[at] - own, 0)
    out = np.empty(len(h), np.int64)
    out[by] = np.repeat(np.maximum(left, 0), own)
    return out


def _backoff(texts: list, table: np.ndarray, totals: np.ndarray, words: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, sum of log S) of each text. table: sorted n-grams that occur more than once, and their counts in all documents; words: of all documents."""
    seq, sizes = _tokens(texts)
    value = np.zeros(len(texts))
    if not len(seq):
        return sizes, value
    doc, place = _places(sizes)
    grams = _ngrams(seq, order)
    longest = np.minimum(place + 1, order)
    below = _left(seq, doc, table, totals)  # of the start mark: the other documents with words
    rest = np.maximum(words - sizes, 1)
    scores = np.log(BACKOFF) * (longest - 1) + np.log(np.maximum(below, 1)) - np.log(rest)[doc]
    for k in range(2, order + 1):
        may = np.flatnonzero((place[1:] >= k - 1) & (below[1:] > 0) & (below[:-1] > 0)) + 1  # else no other document has the longer run
        found = np.zeros(len(seq), np.int64)
        if len(may):
            found[may] = _left(grams[k - 1][may], doc[may], table, totals)
        seen = np.flatnonzero(found)
        scores[seen] = np.log(BACKOFF) * (longest[seen] - k) + np.log(found[seen]) - np.log(below[seen - 1])
        below = found
    return sizes, np.bincount(doc, np.where(place > 0, scores, 0.0), minlength=len(texts))


def _scored(order: int):
    """Rows (key, n_words, value) of a stretch's texts."""

    def run(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        released()
        h, n = (np.concatenate([np.zeros(0, np.int64), *counts[x]]) for x in ("h", "total"))
        h = h.view(np.uint64)
        by = np.argsort(h)
        table, totals = np.append(h[by], np.uint64(MASK)), np.append(n[by], 0)
        at = int(np.searchsorted(table, ALL))
        words = int(totals[at]) if table[at] == ALL else 1
        some, made = texts["text"].tolist(), [(np.zeros(0, np.int64), np.zeros(0))]
        for start, end in batches(some, BATCH):
            made.append(_backoff(some[start:end], table, totals, words, order))
        return pd.DataFrame({"key": texts["key"], "n_words": np.concatenate([x for x, _ in made]), "value": np.concatenate([x for _, x in made])})

    return run


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, h, total) of the n-grams that occur more than once. rows: bucket, stretch, h, n, partitioned by bucket, which h decides."""
    # stretch is counted so that this reads the columns of the join's other side, and both read one shuffle
    return rows.groupBy("bucket", "h").agg(F.sum("n").alias("total"), F.count("stretch").alias("stretches")).where("total > 1 AND stretches > 0").select("bucket", "h", "total")


def _gathered(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of a stretch to one, with arrays."""
    for some in rows:
        stretch, h, total = (some[x].to_numpy() for x in ("stretch", "h", "total"))
        first = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1]))[: len(stretch)])
        yield pd.DataFrame({"stretch": stretch[first], "h": np.split(h, first[1:]) if len(h) else [], "total": np.split(total, first[1:]) if len(h) else []})


def _known(rows: DataFrame) -> DataFrame:
    """(stretch, h, total), h and total being arrays: the n-grams of each stretch that occur more than once in all. rows: as in ``ngram_counts``."""
    both = rows.join(ngram_counts(rows).hint("shuffle_hash"), ["bucket", "h"])
    both = both.where("total >= n")  # it always is; said so that this side reads n too: else the shuffle, and all before it, is made twice
    return both.select("stretch", "h", "total").mapInPandas(_gathered, "stretch int, h array<bigint>, total array<bigint>")


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver happens to collect its garbage; rows that are dealt by one of a join's keys
    stay where they are; and what is sent to Python at once is bounded by bytes."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    wanted |= {"spark.sql.execution.arrow.maxRecordsPerBatch": "100000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def score(docs: DataFrame, doc_id: str, text: str, bucket_bytes: int = 24 << 20, order: int = 2, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row.

    bucket_bytes: of exploded rows, about as many in a task. share: has no effect any more, common n-grams need no way of their own.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    long_texts(spark)
    keyed = docs.select(col(doc_id).alias("id"), F.coalesce(col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    stretches = max(1, -(-chars // STRETCH))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = int(max(tasks, -(-chars * 6 // bucket_bytes)))  # a row of 36 bytes for each word of six characters

    with _settings(spark):
        texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("m")).withColumn("stretch", F.pmod("key", F.lit(stretches)).cast("int"))
        texts = materialize(texts.repartition(max(tasks, stretches), "stretch").sortWithinPartitions("stretch"), "texts")
        counts = []
        for orders in [(k,) for k in range(order, 2, -1)] + [tuple(range(1, min(order, 2) + 1))]:  # the most rows first, while little is written
            parts = PARTS if orders[-1] < order and stretches > 1 else 1
            for part in range(parts):
                cells = texts.select("stretch", "m", "text").mapInPandas(_exploded(orders, part, parts, EVEN * dealt), "bucket int, stretch int, h array<bigint>, n array<bigint>")
                cells = cells.where("bucket is not null").repartition(dealt, "bucket")  # none is; said here so that both readers filter alike
                rows = cells.select("bucket", "stretch", "n", F.posexplode("h").alias("at", "h")).select("bucket", "stretch", "h", F.col("n")[F.col("at")].alias("n"))
                counts.append(materialize(_known(rows), "counts"))
        counted, made = reduce(DataFrame.unionByName, counts), []
        for k in range(min(SHARES, stretches)):
            some, known = (x.where(F.pmod("stretch", F.lit(min(SHARES, stretches))) == k) for x in (texts, counted))
            rows = some.select("stretch", "key", "text").groupBy("stretch").cogroup(known.groupBy("stretch"))
            made.append(materialize(rows.applyInPandas(_scored(order), "key long, n_words long, value double"), "scored"))
    made = reduce(DataFrame.unionByName, made)

    names = fresh(docs.select(col(doc_id)), "n_words", "log_score", "mean_log_score")
    n = F.col("n_words")
    value = F.col("value")
    scored = keyed.select("id", "key").join(made, "key")
    columns = [n, F.when(n > 0, value), F.when(n > 0, value / n)]
    return scored.select(F.col("id").alias(doc_id), *[c.alias(x) for c, x in zip(columns, names, strict=True)])
