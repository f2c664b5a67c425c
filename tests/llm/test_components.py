"""Components against a union-find, on chains, stars and random graphs."""

import random

import pytest

from quire.llm import components
from quire.llm.components import connected_components


def brute(edges):
    head = {x: x for e in edges for x in e}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        head[max(x, y)] = min(x, y)
    return {x: root(x) for x in head}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_against_union_find(spark, kind):
    rng = random.Random(8)
    names = list(range(200))
    rng.shuffle(names)
    edges = {
        "chain": list(zip(names, names[1:])),
        "star": [(names[0], x) for x in names[1:]] + [(7, 7)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(110)],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in connected_components(df).collect()} == brute(edges)
    half = spark.createDataFrame(edges[: len(edges) // 2], "a long, b long")
    rest = spark.createDataFrame(edges[len(edges) // 2 :], "a long, b long")
    assert {r.node: r.label for r in connected_components(rest, connected_components(half)).collect()} == brute(edges)


def test_a_long_ascending_chain(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "_jumped", lambda moves, n, jump=components._jumped: rounds.append(n) or jump(moves, n))
    chain = spark.range(9_999).selectExpr("id as a", "id + 1 as b")
    found = connected_components(chain)
    assert found.count() == 10_000 and found.where("label <> 0").count() == 0 and len(rounds) <= 2


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
