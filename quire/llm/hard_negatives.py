"""Hard negatives by exact inner-product search over one-dimensional distance keys.

Vectors are augmented by one component, so that all have the greatest norm of the table, and queries by 0: the nearest row in
Euclidean distance is then the one with the greatest inner product. Each row belongs to its nearest pivot, and the index stores
rows sorted by (pivot, distance to the pivot), in blocks of ``BLOCK`` rows with the interval of their keys. What lies within
distance r of a query has a key within r of the query's own distance to that pivot, so a search scans the annuli of that
width in the blocks they touch. A first narrow scan finds some candidates; the distance of the worst that is needed bounds
what could still replace it, and the next scan, over the rest of the annuli of that width, certifies the answer. A search that found too
few doubles its width instead. Scans are joins of chunks of queries, blocks of rows and the narrow table of pairs that touch; answers are merged by query.

The results are exact whatever the pivots are; those only decide how much is scanned. They are fitted to the
``SAMPLE`` rows of the smallest hashes. Where the distances of a table hardly differ (random directions in many dimensions), annuli
of the needed width hold nearly all of it, and the scans come to comparing the queries with all rows in blocks.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows with the same id count as one,
the least by (label, vector). Shorter vectors are padded with zeros. Components are integers here; those beyond +-2^26 count as +-2^26, and
more than 2,000 components are refused, so inner products fit into 64 bits. Ties go to the smaller id. A query without positives or negatives has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize

BLOCK, CHUNK, SAMPLE, PIVOTS = 4096, 512, 4096, 16
#: The first scan is as wide as a sampled query's distance to the nearest of this share of the sample.
FIRST = 0.02
MOST_COMPONENT, MOST_LENGTH = 1 << 26, 2000


def vectors(df: DataFrame, key: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """(id, label, v: array of integers) of the rows that take part, one a key."""
    x = F.transform(col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    fit = df.where(col(key).isNotNull() & col(label).isNotNull() & col(vector).isNotNull()).where(finite)
    bound = F.lit(float(MOST_COMPONENT))
    whole = F.transform(x, lambda c: F.greatest(-bound, F.least(bound, F.floor(c * scale).cast("double"))).cast("int"))
    rows = fit.select(col(key).cast("long").alias("id"), col(label).cast("long").alias("label"), whole.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


class Space:
    """The augmented space: greatest squared norm, pivots with their extra component, and the error allowed for floating sums."""

    def __init__(self, most: float, length: int, sample: np.ndarray):
        self.most, self.length = most, length
        self.slack = 1e-6 * (np.sqrt(most) + 1)
        points = self.augmented(sample) if len(sample) else np.zeros((1, length + 1))
        order = np.lexsort(points.T[::-1])
        pivots = points[order][np.linspace(0, len(points) - 1, min(PIVOTS, len(points))).astype(int)]
        for _ in range(8):  # Lloyd's rounds
            near = self.distances(points, pivots).argmin(axis=1)
            pivots = np.stack([points[near == k].mean(axis=0) if (near == k).any() else p for k, p in enumerate(pivots)])
        self.pivots = pivots
        some = points[:: max(1, len(points) // 64)].copy()
        some[:, -1] = 0
        self.width = float(np.median(np.quantile(self.distances(some, points), FIRST, axis=1))) if len(sample) else 1.0

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None]])

    @staticmethod
    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0))

    def to_pivots(self, x: np.ndarray, query: bool) -> np.ndarray:
        return self.distances(np.hstack([x, np.zeros((len(x), 1))]) if query else self.augmented(x), self.pivots)

    def reach(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance at which rows have these scores."""
        return np.sqrt(np.maximum(self.most + norms - 2 * scores, 0)) + self.slack


def space(rows: DataFrame) -> Space:
    """Fitted to the rows of the smallest hashes; the greatest norm is of all rows."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    most, length = rows.agg(F.max(norm), F.max(F.size("v"))).first()
    if length and length > MOST_LENGTH:
        raise ValueError(f"vectors of {length} components; at most {MOST_LENGTH} are taken")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    return Space(float(most or 0), length or 0, _matrix([r.v for r in some], length or 0))


def _matrix(rows: list, length: int) -> np.ndarray:
    out = np.zeros((len(rows), length))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def keyed(rows: DataFrame, sp: Space) -> DataFrame:
    """Adds ``pivot`` and ``key``, the distance to it."""

    @F.pandas_udf("pivot int, key double")
    def placed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in parts:
            d = sp.to_pivots(_matrix(list(v), sp.length), False)
            near = d.argmin(axis=1)
            yield pd.DataFrame({"pivot": near.astype(np.int32), "key": d[np.arange(len(d)), near]})

    return rows.withColumn("p", placed("v")).select("id", "label", "v", "p.pivot", "p.key")


_PACKED = "block string, pivot int, low double, high double, ids binary, labels binary, keys binary, matrix binary, extra binary"


def packed(rows: DataFrame, sp: Space, most: int, extra: list[str]) -> DataFrame:
    """Rows sorted by (pivot, key) as blocks of at most ``most`` rows of one pivot; ``extra`` columns of doubles ride along."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: list[pd.DataFrame] = []
        made = 0

        def block(own: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            made += 1
            x = _matrix(list(own["v"]), sp.length).astype(np.int32)
            more = own[extra].to_numpy(np.float64) if extra else np.zeros((len(own), 0))
            name = f"{TaskContext.get().partitionId()}/{made}"
            cells = [own["id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), own["key"].to_numpy(np.float64), x, more]
            return pd.DataFrame([(name, int(own["pivot"].iloc[0]), own["key"].min(), own["key"].max(), *[c.tobytes() for c in cells])], columns=[c.split()[0] for c in _PACKED.split(", ")])

        for part in parts:
            for _, own in part.groupby("pivot", sort=True):
                if held and (held[0]["pivot"].iloc[0] != own["pivot"].iloc[0]):
                    yield block(pd.concat(held))
                    held = []
                held.append(own)
                while (n := sum(map(len, held))) >= most:
                    whole = pd.concat(held)
                    yield block(whole.iloc[:most])
                    held = [whole.iloc[most:]] if n > most else []
        if held:
            yield block(pd.concat(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "pivot", "key", "id").sortWithinPartitions("pivot", "key", "id").mapInPandas(pack, _PACKED)


def _best(scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of the first k rows that fit each query, by score and then the smaller id."""
    shown = np.where(fit, scores, -np.inf)
    if shown.shape[1] > k:
        least = np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k]
        q, r = np.nonzero(fit & (shown >= least[:, None]))
    else:
        q, r = np.nonzero(fit)
    order = np.lexsort((ids[r], -scores[q, r], q))
    q, r = q[order], r[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], r[keep]


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where they hold them, else as integers."""
    if a.size and b.size and float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1] >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(np.float64) @ b.astype(np.float64).T


def scan(index: DataFrame, queries: DataFrame, sp: Space, k: int, same: bool) -> DataFrame:
    """(query, goal, id, score) of the first ``k`` rows in the annuli of each query, by block.

    queries: id, label, v, pivot, key, old, wide (the annuli have half-widths from ``old``, excluded, to ``wide``), and ``goals``: rows of another
    label (``same`` false) with a score from the lower to the upper bound of each of ``lows`` and ``highs``, arrays of one length;
    with ``same`` the rows of the same label but the query itself, as goal 0.
    """
    goals = queries.select(F.max(F.size("lows"))).first()[0] or 0
    flat = queries.withColumns({f"{x}{g}": F.coalesce(F.get(x, F.lit(g)), F.lit(float("nan"))) for g in range(goals) for x in ("lows", "highs")})
    extra = ["old", "wide", *[f"{x}{g}" for x in ("lows", "highs") for g in range(goals)]]
    chunks = materialize(packed(flat.select("id", "label", "v", "pivot", "key", *extra), sp, CHUNK, extra), "chunks")

    @F.pandas_udf("array<struct<pivot:int,low:double,high:double>>")
    def spans(matrices: pd.Series, extras: pd.Series) -> pd.Series:
        out = []
        for m, e in zip(matrices, extras, strict=True):
            x = np.frombuffer(m, np.int32).reshape(-1, sp.length).astype(np.float64) if sp.length else np.zeros((len(e) // 8 // len(extra), 0))
            wide = np.frombuffer(e).reshape(len(x), -1)[:, 1:2]
            d = sp.to_pivots(x, True)
            out.append([{"pivot": p, "low": a, "high": b} for p, (a, b) in enumerate(zip((d - wide).min(axis=0), (d + wide).max(axis=0), strict=True))])
        return pd.Series(out)

    touched = chunks.select("block", F.inline(spans("matrix", "extra"))).select(F.col("block").alias("chunk"), "pivot", F.col("low").alias("from"), F.col("high").alias("to"))
    pairs = touched.join(index.select("block", "pivot", "low", "high"), "pivot").where("low <= to and high >= from").select("chunk", "block")
    sent = pairs.join(chunks.select(F.col("block").alias("chunk"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "matrix", "extra")]), "chunk").drop("chunk")
    met = sent.join(index.drop("low", "high"), "block")

    def compare(ids, labels, keys, matrix, pivot, q_ids, q_labels, q_matrix, q_extra) -> list[dict]:
        ids, labels, keys = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(keys)
        q_ids, q_labels = np.frombuffer(q_ids, np.int64), np.frombuffer(q_labels, np.int64)
        x = np.frombuffer(matrix, np.int32).reshape(len(ids), sp.length)
        q, more = np.frombuffer(q_matrix, np.int32).reshape(len(q_ids), sp.length), np.frombuffer(q_extra).reshape(len(q_ids), -1)
        away = np.abs(sp.to_pivots(q.astype(np.float64), True)[:, pivot][:, None] - keys[None])
        reached = (away > more[:, :1]) & (away <= more[:, 1:2])
        some = reached.any(axis=1)
        if not some.any():
            return []
        q, more, reached, q_ids, q_labels = q[some], more[some], reached[some], q_ids[some], q_labels[some]
        scores = _inner(q, x)
        alike = q_labels[:, None] == labels[None]
        found = []
        for g in range(1 if same else goals):
            fit = reached & (alike & (q_ids[:, None] != ids[None]) if same else ~alike & (scores >= more[:, 2 + g, None]) & (scores <= more[:, 2 + goals + g, None]))
            a, b = _best(scores, fit, ids, k)
            found += [{"query": int(q_ids[i]), "goal": g, "id": int(ids[j]), "score": int(scores[i, j])} for i, j in zip(a, b, strict=True)]
        return found

    @F.pandas_udf("array<struct<query:long,goal:int,id:long,score:long>>")
    def found(*columns: pd.Series) -> pd.Series:
        return pd.Series([compare(*row) for row in zip(*columns, strict=True)])

    hits = met.select(F.inline(found("ids", "labels", "keys", "matrix", "pivot", "q_ids", "q_labels", "q_matrix", "q_extra")))
    return _first(hits, k)


def _first(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query", "goal").orderBy(F.desc("score"), "id"))
    return hits.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search(index: DataFrame, queries: DataFrame, sp: Space, k: int, same: bool) -> DataFrame:
    """``scan`` with widths that grow until each query's answer is certain. queries: as for ``scan``, without ``old``; ``last`` is a width that suffices."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    open_ = materialize(queries.withColumn("old", F.lit(-1.0)).withColumn("norm", norm).withColumn("wide", F.least("wide", "last")), "open")
    hits: DataFrame | None = None
    while True:
        new = scan(index, open_, sp, k, same)
        hits = materialize(new if hits is None else _first(hits.unionByName(new), k), "hits")
        wanted = F.lit(1) if same else F.size("lows")
        full = hits.groupBy("query", "goal").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).groupBy("query")
        least = full.agg(F.sum((F.col("n") >= k).cast("int")).alias("full"), F.min(F.when(F.col("n") >= k, F.col("worst"))).alias("worst"))
        reach = F.sqrt(F.greatest(F.lit(sp.most) + F.col("norm") - 2 * F.col("worst"), F.lit(0.0))) + sp.slack
        needed = F.when(F.col("full") >= wanted, F.least("last", reach)).otherwise(F.least("last", 2 * F.col("wide")))
        done = F.col("wide") >= F.when(F.col("full") >= wanted, F.least("last", reach)).otherwise(F.col("last"))
        state = open_.join(least.withColumnRenamed("query", "id"), "id", "left").withColumn("done", F.coalesce(done, F.lit(False)))
        rest = state.where(~F.col("done")).withColumn("old", F.col("wide")).withColumn("wide", F.greatest(needed, F.col("wide") + sp.slack))
        open_ = materialize(rest.select(*open_.columns), "open")
        if open_.isEmpty():
            return hits


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: of ``vectors``; anchors: a column ``id`` of the anchors among them, once each. An anchor's positives are the best rows of its
    label but itself; a positive's negatives the best of other labels with low * positive <= 100 * negative <= high * positive.
    """
    rows = materialize(rows, "vectors")
    sp = space(rows)
    placed = materialize(keyed(rows, sp), "placed")
    index = materialize(packed(placed, sp, BLOCK, []), "index").drop("extra")
    asked = placed.join(anchors.select("id"), "id", "left_semi")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    everything = F.lit(2 * float(np.sqrt(sp.most)) + 3 * sp.slack)  # from a query to any row, and so to any pivot's annulus
    none = F.array().cast("array<double>")
    near = search(index, asked.withColumns({"lows": none, "highs": none, "wide": F.lit(sp.width), "last": everything}), sp, positives, True)
    near = near.select(F.col("query").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Integers: 30 p <= 100 n <= 90 p is ceil(30 p / 100) <= n <= floor(90 p / 100), and nothing where p is below 0.
    bounds = near.where("positive_score >= 0").withColumns({
        "lo": F.expr(f"({low} * positive_score + 99) div 100").cast("double"), "hi": F.expr(f"({high} * positive_score) div 100").cast("double"),
    })
    goals = F.sort_array(F.collect_list(F.struct("positive_id", "positive_score", "lo", "hi")))  # at most ``positives``
    wanted = bounds.groupBy(F.col("anchor_id").alias("id")).agg(goals.alias("goals"))
    wanted = materialize(asked.join(wanted, "id").withColumns({"lows": F.col("goals.lo"), "highs": F.col("goals.hi")}), "goals")
    within = lambda score: F.sqrt(F.greatest(F.lit(sp.most) + norm - 2 * score, F.lit(0.0))) + sp.slack
    ready = wanted.withColumns({
        "wide": within(F.array_min("highs") - (F.array_min("highs") - F.array_min("lows")) * 0.1), "last": within(F.array_min("lows")),
    })
    hits = search(index, ready.drop("goals"), sp, negatives, False)
    g = F.get(F.col("goals"), F.col("goal"))
    named = hits.join(wanted.select(F.col("id").alias("query"), "goals"), "query").select(
        F.col("query").alias("anchor_id"), g["positive_id"].alias("positive_id"), F.col("id").alias("negative_id"), g["positive_score"].alias("positive_score"), F.col("score").alias("negative_score")
    )
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return named.withColumn("rank", rank).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
