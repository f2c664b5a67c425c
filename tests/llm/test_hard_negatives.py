"""Hard negatives against a comparison of all rows, SQL, and odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest

from quire.llm import hard_negatives, queries


def plainly(rows, anchors, positives=5, negatives=10):
    out = set()
    for a in anchors:
        label, v = rows[a]
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), b) for b, (_, w) in rows.items() if b != a))
        for p, b in [(-s, b) for s, b in scored if rows[b][0] == label][:positives]:
            found = [(-s, c) for s, c in scored if rows[c][0] != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out |= {(a, b, k, c, p, s) for k, (s, c) in enumerate(found, 1)}
    return out


def mined(spark, data, anchors, monkeypatch=None, block=None):
    if block:
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    df = spark.createDataFrame([(k, v, label, "x") for k, v, label in data], "vec_id long, embedding array<float>, label int, id string")
    rows = hard_negatives.vectors(df, "vec_id", "embedding", "label")
    out = hard_negatives.mine(rows, rows.where(rows.id.isin(anchors)).select("id"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def whole(v):
    return [max(-(1 << 26), min(1 << 26, math.floor(256 * float(np.float32(x))))) for x in v]


@pytest.mark.parametrize("kind", ["directions", "clusters", "ties", "lengths"])
def test_against_all_rows(spark, monkeypatch, kind):
    r = random.Random(kind)
    data = []
    for k in range(300):
        centre = [8.0 * (j == k % 5) for j in range(6)]
        v = {
            "directions": [r.gauss(0, 1) for _ in range(6)],
            "clusters": [c + r.gauss(0, 0.2) for c in centre],
            "ties": [float(r.randrange(-1, 2)) for _ in range(3)] if k % 3 else [1.0, 1.0, 0.0],
            "lengths": [r.gauss(0, 10 ** r.randrange(3)) for _ in range(r.choice([0, 2, 6]))],
        }[kind]
        data.append((k, v, r.randrange(3)))
    rows = {k: (label, whole(v)) for k, v, label in data}
    anchors = list(range(0, 300, 20))
    assert mined(spark, data, anchors, monkeypatch, 16) == plainly(rows, anchors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.0], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [], 2), (9, [1e30, 1e30], 2), (10, [0.6, 9.0], 2)]
    rows = {0: (1, [256, 0]), 1: (1, [256, 128]), 2: (2, [128, 0]), 8: (2, [0, 0]), 9: (2, [1 << 26, 1 << 26]), 10: (2, [whole([0.6])[0], 2304])}
    assert mined(spark, data, [0, 1, 2, 3]) == plainly(rows, [0, 1, 2])


@pytest.mark.parametrize("data", [[], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [], 1), (1, [], 1), (2, [], 2)]])
def test_hardly_any_rows(spark, data):
    rows = {k: (label, whole(v)) for k, v, label in data if k is not None}
    assert {x[:4] for x in mined(spark, data, [0])} == {x[:4] for x in plainly({k: (c, v + [0] * (1 - len(v))) for k, (c, v) in rows.items()}, [0] if 0 in rows else [])}


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    result = con.execute(queries.oracle_sql()["op12_hard_negatives"])
    names = [d[0] for d in result.description]
    out = queries.op12_hard_negatives(spark, sf_dir).select(*names)
    assert dict(out.dtypes) == {n: "int" if n == "rank" else "bigint" for n in names}
    got, expected = sorted(map(tuple, out.collect())), sorted(result.fetchall())
    assert got == expected and expected
