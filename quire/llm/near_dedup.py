"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Each distinct shingle of five words, weighted by how often its text has it, sends out a Poisson process of arrivals at a
rate of its weight. An arrival goes to a random register, which keeps the earliest; an element stops
once its next arrival comes after all registers have an earlier one. Two texts agree in a register with
the probability of their probability Jaccard similarity. Registers are banded; texts that share a band are candidates, and
candidates become links if their exact probability Jaccard similarity is at least 0.8. Classes are the components of links.

Large groups: equal texts are one node. In each bucket all nodes are first compared with one hub (a pair a row, at most);
a hub with many partners is joined to them in cells, of which each has its own copy of the hub's row.
Only nodes of one bucket that are then still in different components are compared with each
other, block by block inside tasks, and only links that connect classes leave a task. Two texts that share several open buckets are
compared in one of them. No bucket or partner is capped, and no pair that could join two classes is left out.

Defined results: a null text is a class of its own; texts without words are alike only if equal; texts of one to four words
have one shingle, all their words. class_id is the least doc_id of a class; rows with equal doc_id keep their own rows. Result columns whose names
the key column has get leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .common import MASK, batches, col, fresh, long_texts, materialize, mix, ngram_hashes, released, uniform, word_bytes, word_hashes
from .components import connected_components

SPLIT = 4096  # partners of a hub in one cell
WORDS = 150_000  # words whose hashes a task remembers
REGISTERS, ROWS = 192, 6  # 32 bands: a pair at 0.8 shares one with probability 0.99994


def shingles(text: str | None, words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of distinct shingles, sorted, and how often each occurs. words: from word to hash."""
    found = list(map(words.__getitem__, word_bytes(text)))
    return np.unique(ngram_hashes(np.array(found, np.uint64), n), return_counts=True)


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures, docs x registers, of the elements that win; documents without elements get zeros.

    doc: ascending numbers of the documents that the elements belong to. All elements advance together, one arrival a
    round; those past their document's latest register have ended.
    """
    arrival = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    x, latest, k = np.zeros(len(doc)), np.full(docs, np.inf), 0
    while len(doc):
        k += 1
        state = mix(element + np.uint64(k * 0x9E3779B97F4A7C15 & int(MASK)))
        x = x - np.log(uniform(state)) / weight
        going = x < latest[doc]
        doc, element, weight, x, state = doc[going], element[going], weight[going], x[going], state[going]
        at = doc * registers + (mix(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, at, x)
        won = arrival[at] == x
        winner[at[won]] = element[won]
        touched = np.unique(doc) if k > 8 else np.arange(docs)
        latest[touched] = arrival.reshape(docs, registers)[touched].max(axis=1)
    return winner.reshape(docs, registers)


def prob_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Exact: the sum over common d of 1 / sum over all e of max(w1[e] / w1[d], w2[e] / w2[d])."""
    both, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = w1[i].astype(np.float64), w2[j].astype(np.float64)
    only1, only2 = w1.sum() - a.sum(), w2.sum() - b.sum()
    if (a == b).all():
        return float((a / (a.sum() + only1 + only2)).sum())
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    below_b = np.concatenate(([0.0], np.cumsum(b)))  # where a[e] / b[e] is less, b[e] / b[d] is the greater term
    above_a = np.concatenate((np.cumsum(a[::-1])[::-1], [0.0]))
    k = np.searchsorted(a / b, a / b, side="left")
    return float((1 / ((only1 + above_a[k]) / a + (only2 + below_b[k]) / b)).sum())


def _signed(bands: int, most_chars: int = 1_000_000):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        words = word_hashes(WORDS)
        for part in parts:
            texts = part["text"].tolist()
            for start, end in batches(texts, most_chars):
                made = [shingles(t, words) for t in texts[start:end]]
                sizes = np.array([len(h) for h, _ in made], np.int64)
                doc = np.repeat(np.arange(len(made)), sizes)
                element = mix(np.concatenate([h for h, _ in made]))
                weight = np.concatenate([c for _, c in made]).astype(np.float64)
                signature = prob_min_hash(doc, element, weight, len(made))
                key = np.full((len(made), bands), 0, np.uint64)
                for r in range(ROWS):
                    key = mix(key + np.uint64(0x9E3779B97F4A7C15)) ^ signature[:, r::ROWS]
                key = mix(key + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                marks = (mix(signature) >> np.uint64(48)).astype("<u2")
                yield pd.DataFrame({
                    "digest": part["digest"].iloc[start:end].to_numpy(),
                    "marks": [m.tobytes() for m in marks],
                    "keys": [k if n else [] for k, n in zip(key, sizes, strict=True)],
                })

    return run


def _vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    released()
    words = word_hashes(WORDS)
    for part in parts:
        texts = part["text"].tolist()
        for start, end in batches(texts, 1_000_000):
            made = [shingles(t, words) for t in texts[start:end]]
            yield pd.DataFrame({"digest": part["digest"].iloc[start:end].to_numpy(), "h": [h.tobytes() for h, _ in made], "w": [c.astype("<u4").tobytes() for _, c in made]})


@F.pandas_udf(DoubleType())
def _similarity(h1: pd.Series, w1: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
    def one(a, b, c, d):
        return prob_jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(c, np.uint64), np.frombuffer(d, "<u4").astype(np.int64))

    return pd.Series([one(*x) for x in zip(h1, w1, h2, w2, strict=True)], dtype="float64")


@F.pandas_udf(IntegerType())
def _agreeing(m1: pd.Series, m2: pd.Series) -> pd.Series:
    a = np.frombuffer(b"".join(m1), "<u2").reshape(len(m1), -1)
    b = np.frombuffer(b"".join(m2), "<u2").reshape(len(m2), -1)
    return pd.Series((a == b).sum(axis=1, dtype=np.int32))


def _across(least: int, similarity: float):
    """Links between the nodes of two blocks that are still in different classes; no more than connect them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        for part in parts:
            for row in part.itertuples(index=False):
                if found := _links(row, least, similarity):
                    yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _links(row, least: int, similarity: float) -> list[tuple[bytes, bytes]]:
    m1, m2 = (np.frombuffer(b"".join(m), "<u2").reshape(len(m), -1) for m in (row.marks1, row.marks2))
    names = {x: k for k, x in enumerate({*row.labels1, *row.labels2})}
    l1, l2 = (np.array([names[x] for x in labels]) for labels in (row.labels1, row.labels2))
    k1, k2 = ([frozenset(x.tolist()) for x in keys] for keys in (row.keys1, row.keys2))
    head, out, vectors = list(range(len(names))), [], {}

    def root(k: int) -> int:
        while head[k] != k:
            head[k] = k = head[head[k]]
        return k

    def vector(side: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if (side, k) not in vectors:
            h, w = (row.h1[k], row.w1[k]) if side == 1 else (row.h2[k], row.w2[k])
            vectors[side, k] = np.frombuffer(h, np.uint64), np.frombuffer(w, "<u4").astype(np.int64)
        return vectors[side, k]

    alike = (m1[:, None, :] == m2[None, :, :]).sum(axis=2, dtype=np.int16)
    i, j = np.nonzero((alike >= least) & (l1[:, None] != l2[None, :]))
    order = np.argsort(-alike[i, j], kind="stable")  # likely links first: what they join needn't be compared again
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        p, q = root(int(l1[x])), root(int(l2[y]))
        if p != q and min(k1[x] & k2[y]) == row.key and prob_jaccard(*vector(1, x), *vector(2, y)) >= similarity:
            head[p] = q
            out.append((row.nodes1[x], row.nodes2[y]))
    return out


def classes(docs: DataFrame, doc_id: str, text: str, similarity: float = 0.8, block: int = 128) -> DataFrame:
    """(doc_id, class_id, class_size long, representative boolean) of every row; one representative a class.

    The registers' agreement is binomial; pairs of which fewer agree than five standard deviations below
    ``similarity`` aren't compared exactly.
    """
    long_texts(docs.sparkSession)
    bands = REGISTERS // ROWS
    least = int(REGISTERS * (similarity - 5 * (similarity * (1 - similarity) / REGISTERS) ** 0.5))
    rows = docs.select(col(doc_id).alias("id"), F.unhex(F.md5(col(text))).alias("digest"), col(text).alias("text"))
    texts = rows.select("digest", "text").where("text is not null")

    signed = texts.mapInPandas(_signed(bands), "digest binary, marks binary, keys array<long>").dropDuplicates(["digest"])
    signed = materialize(signed, "signed")
    banded = signed.select("digest", F.explode("keys").alias("key"))
    company = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(banded.join(company, "key"), "company")  # rows of buckets with more than one text
    # The hub of a bucket is the text that has most company in all its buckets: in a group of copies, one near the original.
    popular = shared.groupBy("digest").agg(F.sum("n").alias("popularity"))
    hubs = shared.join(popular, "digest").groupBy("key").agg(F.max_by("digest", F.struct("popularity", "digest")).alias("hub"))
    shared = materialize(shared.join(hubs, "key"), "shared")

    # Copies of a text are put together in the tasks that read them, before any shuffle.
    vectors = texts.groupBy("digest").agg(F.first("text").alias("text")).join(shared.select("digest").distinct(), "digest", "left_semi")
    vectors = materialize(vectors.mapInPandas(_vectors, "digest binary, h binary, w binary"), "vectors")
    marks = signed.select("digest", "marks")
    cells = F.ceil(F.col("n") / SPLIT).cast("int")
    cell = F.pmod(F.xxhash64("digest"), cells).cast("int").alias("cell")
    to_hub = shared.where("digest <> hub").select(F.col("digest").alias("a"), F.col("hub").alias("b"), cell).groupBy("a", "b").agg(F.max("cell").alias("cell"))
    hub_cells = shared.where("digest = hub").groupBy(F.col("hub").alias("b")).agg(F.max(cells).alias("cells"))

    def of_hubs(table: DataFrame, *columns: str) -> DataFrame:
        found = hub_cells.join(table.withColumnRenamed("digest", "b"), "b")
        return found.select("b", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), *columns)

    near = to_hub.join(marks.select(F.col("digest").alias("a"), F.col("marks").alias("m1")), "a").join(of_hubs(marks, F.col("marks").alias("m2")), ["b", "cell"])
    tested = materialize(near.where(_agreeing("m1", "m2") >= least).select("a", "b", "cell"), "tested")
    pairs = tested.join(vectors.select(F.col("digest").alias("a"), F.col("h").alias("h1"), F.col("w").alias("w1")), "a")
    pairs = pairs.join(of_hubs(vectors, F.col("h").alias("h2"), F.col("w").alias("w2")), ["b", "cell"])
    links = materialize(pairs.where(_similarity("h1", "w1", "h2", "w2") >= similarity).select("a", "b"), "links")
    labels = connected_components(links)

    # What the hubs couldn't settle: buckets whose members are in several components, cut into blocks of bounded size.
    named = shared.select("key", "digest", "n").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.max("n").alias("n")).where("l1 <> l2 and n > 2").select("key")
    members = materialize(named.join(open_keys, "key"), "unsettled")
    keys = members.groupBy("digest").agg(F.collect_list("key").alias("keys"))  # one for each band at most
    cut = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / block)).cast("int").alias("cut")
    payload = keys.join(marks, "digest").join(vectors, "digest")
    blocks = members.select("key", "digest", "label", cut).join(payload, "digest")
    parts = ("nodes", "labels", "keys", "marks", "h", "w")
    listed = [F.col("m")[c].alias(p) for c, p in zip(("digest", "label", "keys", "marks", "h", "w"), parts, strict=True)]
    grouped = blocks.groupBy("key", "cut").agg(F.collect_list(F.struct("digest", "label", "keys", "marks", "h", "w")).alias("m"))
    grouped = materialize(grouped.select("key", "cut", *listed), "blocks")
    left = grouped.select("key", *[F.col(c).alias(f"{c}1") for c in ("cut", *parts)])
    right = grouped.select("key", *[F.col(c).alias(f"{c}2") for c in ("cut", *parts)])
    rest = left.join(right, "key").where("cut1 <= cut2").drop("cut1", "cut2").mapInPandas(_across(least, similarity), "a binary, b binary")
    labels = connected_components(materialize(rest, "rest"), labels)

    named = rows.select("id", "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    return _with_classes(named, doc_id)


def _with_classes(named: DataFrame, doc_id: str) -> DataFrame:
    """named: id, digest, label (null for null texts). Of equal rows the one with the least hash of its place is the representative."""
    alone = named.where("label is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("representative"))
    placed = named.where("label is not null").withColumn("place", F.monotonically_increasing_id())
    # The place only tells equal ids apart; it is written down, so that it can't change when a task runs again.
    placed = materialize(placed, "placed")
    heads = placed.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "place")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    known = placed.join(heads, "label").select("id", F.col("head.id").alias("class_id"), "class_size", (F.col("place") == F.col("head.place")).alias("representative"))
    made = known.unionByName(alone)
    columns = ("class_id", "class_size", "representative")
    return made.select(F.col("id").alias(doc_id), *[F.col(c).alias(n) for c, n in zip(columns, fresh(made.select(F.col("id").alias(doc_id)), *columns), strict=True)])


def dedupe(docs: DataFrame, doc_id: str, text: str, similarity: float = 0.8) -> DataFrame:
    """The documents with one row of each class, the one with the least doc_id; same columns."""
    (key,) = fresh(docs, "row_key")
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    order = keyed.select(F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), col(doc_id).alias("id"), col(key).alias("key")).alias("id"), col(text).alias("text"))
    kept = classes(order, "id", "text", similarity).where("representative").select(F.col("id.key").alias(key))
    return keyed.join(kept, key, "left_semi").select(*[col(c) for c in docs.columns])
