"""Near-duplicate classes against exact similarities of all pairs."""

import itertools
import random

import numpy as np
import pytest

from quire.llm import near_dedup
from quire.llm.common import word_hashes

WORDS = word_hashes()


def brute(rows, least=0.8):
    vectors = {i: near_dedup.shingles(t, WORDS) for i, t in rows if t is not None}
    texts = dict(rows)
    head = {i: i for i, _ in rows}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in itertools.combinations(sorted(vectors), 2):
        if texts[a] == texts[b] or near_dedup.prob_jaccard(*vectors[a], *vectors[b]) >= least:
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def slow_jaccard(h1, w1, h2, w2):
    a, b = dict(zip(h1.tolist(), w1.tolist())), dict(zip(h2.tolist(), w2.tolist()))
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in set(a) & set(b))


def test_probability_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h1, h2 = (np.unique(rng.integers(0, 40, 25)).astype(np.uint64) for _ in "ab")
        w1, w2 = rng.integers(1, 5, len(h1)), rng.integers(1, 5, len(h2))
        assert near_dedup.prob_jaccard(h1, w1, h2, w2) == pytest.approx(slow_jaccard(h1, w1, h2, w2))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, own = rng.integers(1, 1 << 60, 300).astype(np.uint64), rng.integers(1, 1 << 60, (2, 60)).astype(np.uint64)
    h = [np.unique(np.concatenate((shared, o))) for o in own]
    w = [np.where(np.isin(x, shared[:50]), 3, 1) for x in h]
    s = near_dedup.prob_min_hash(np.repeat([0, 1], [len(h[0]), len(h[1])]), np.concatenate(h), np.concatenate(w).astype(float), 2, 20_000)
    assert (s[0] == s[1]).mean() == pytest.approx(near_dedup.prob_jaccard(h[0], w[0], h[1], w[1]), abs=0.02)


def make_rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for _ in range(120):  # a group of near copies whose pairs lie on both sides of the limit
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    rows += [rows[5]] * 30 + ["", "", "  ", None, None, "one two", "One two!", "a b c d e", "long " * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT", 8)  # hubs have several cells
    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.classes(docs, "doc_id", "text", block=16).collect()
    expected = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == expected
    sizes = {}
    for c in expected.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r.class_size == sizes[r.class_id] and r.representative == (r.doc_id == r.class_id) for r in got)


def test_dedupe_keeps_one_row_of_each_class_and_all_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (None, "q r s t u v", None), (3, None, "n"), (4, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    kept = near_dedup.dedupe(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "q r s t u v"), (3, None), (4, None)], key=str)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "class_id long, text string")
    got = near_dedup.classes(docs, "class_id", "text")
    assert got.columns == ["class_id", "_class_id", "class_size", "representative"]
    assert sorted(map(tuple, got.select("class_id", "_class_id").collect())) == [(1, 1), (2, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, label int")
    assert near_dedup.classes(docs, "doc_id", "text").count() == 0
