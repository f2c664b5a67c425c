"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Tables of moved nodes up to this many rows (about 50 bytes each) are broadcast in a round; larger ones are shuffled.
SMALL = 300_000


def connected_components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """edges (a, b) -> (node, label): the least node of each component.

    In each round every node moves to its least neighbour, if that is less, and on to where that one moves, by pointer jumping;
    then edges within a node vanish and parallel ones become one. Of a component only nodes without a lesser neighbour are left;
    one of them that nothing moved to has a lesser neighbour in the next round. So every two rounds halve a component's nodes at least,
    each round is over fewer edges than the one before, and it ends for every graph. Rounds are written to the shared folder; nothing but counts reaches the driver. ``start``: labels (node,
    label) known from a part of the edges, which need not be in ``edges`` any more.
    """
    own = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    if start is None:
        labels, left = own.withColumn("label", F.col("node")), _plain(edges.select("a", "b"))
    else:
        labels = start.unionByName(own.join(start, "node", "left_anti").withColumn("label", F.col("node")))
        left = _moved(edges.select("a", "b"), start.withColumnRenamed("label", "parent"))
    left, labels = materialize(left, "edges"), materialize(labels, "labels")
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node"), "moves")
        n = moves.count()
        if not n:
            return labels
        moves = _jumped(moves, n)
        moves = F.broadcast(moves) if n <= SMALL else moves
        to = labels.join(moves.withColumnRenamed("node", "label"), "label", "left")
        labels = materialize(to.select("node", F.coalesce("parent", "label").alias("label")), "labels")
        left = materialize(_moved(left, moves), "edges")


def _jumped(moves: DataFrame, n: int) -> DataFrame:
    """Moves to where the parents end up; each turn halves the way."""
    while True:
        further = moves.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        longer = moves.join(F.broadcast(further) if n <= SMALL else further, "parent", "left")
        # a turn that changes nothing is the last; counted before it is written
        if not longer.where("next is not null").limit(1).count():
            return moves
        moves = materialize(longer.select("node", F.coalesce("next", "parent").alias("parent")), "moves")


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _moved(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges between the nodes that their ends have moved to."""
    for end in ("a", "b"):
        at = moves.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_to"))
        edges = edges.join(at, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
    return _plain(edges)
