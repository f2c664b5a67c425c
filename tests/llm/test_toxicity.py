"""Toxicity: segments and tails against brute force, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import queries, toxicity


def brute(values, offset=0):
    """The best segment, then those to its left and right."""
    best = max(((sum(values[a:b]), -(b - a), a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = best[2:]
    return brute(values[:a], offset) + [(offset + a, offset + b - 1, best[0])] + brute(values[b:], offset + b)


def test_segments_against_brute_force():
    r = random.Random(3)
    for _ in range(400):
        neutral = -r.choice([1, 2, 3])
        values = [r.choice([neutral, neutral, 1, 2, 5]) + r.random() * 1e-3 if r.random() < 0.5 else neutral for _ in range(r.randrange(25))]
        values = [v if v > 0 else neutral for v in values]
        places = [k for k, v in enumerate(values) if v > 0]
        got = toxicity.segments(places, [values[k] for k in places], neutral)
        expected = brute(values)
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert np.allclose([g[2] for g in got], [e[2] for e in expected])


def test_segments_take_linear_time():
    for scores in ([float(k) for k in range(1, 200_001)], [float(k) for k in range(200_000, 0, -1)], [1.0] * 200_000):
        places = [2 * k for k in range(len(scores))]
        assert toxicity.segments(places, scores, -1.5)


def test_tail_against_simulation():
    r = np.random.default_rng(1)
    counts = r.poisson(1, 400_000)
    sums = r.gamma(np.maximum(counts, 1e-9))
    for t in (0.01, 0.5, 1.0, 3.0, 6.0):
        assert math.isclose(toxicity.log_tail(t), -math.log((sums >= t).mean()), abs_tol=0.05)
    assert toxicity.log_tail(0) == 0 and toxicity.log_tail(50_000) > 40_000
    assert all(toxicity.log_tail(t) < toxicity.log_tail(t + 0.5) for t in np.arange(0.5, 300, 0.5))


def test_lexicon_has_no_beginning_of_another():
    words = ["badword", "badly", "bad", "good", "goodness"]
    totals = np.array([[1000.0, 50_000.0], [200.0, 10_000.0]])
    counts = {}
    for w, (d0, d1) in zip(words, [(0, 80), (0, 60), (400, 80), (500, 100), (300, 10)], strict=True):
        for n in toxicity.nodes_of(w):
            counts[n] = counts.get(n, 0) + np.array([[d0, d0], [d1, d1]], float)
    lex = toxicity.lexicon(counts, totals)
    assert set(lex.scores) == {"bad"} and lex.neutral < 0  # longer words that begin so; the word itself is common
    assert lex.of(b"badwordish") > 0 and lex.of(b"bad") == 0 and lex.of(b"goodness") == 0 and lex.of(b"ba") == 0


def test_stems_that_clean_texts_have_too():
    """Of one language among several: texts of both classes have them, toxic ones often; and of few labelled texts."""
    totals = np.array([[3531.0, 1_400_000.0, 3531.0], [431.0, 170_000.0, 431.0]])
    counts = {"achl": np.array([[58.0, 63.0, 4.0], [63.0, 577.0, 61.0]]), "ach": np.array([[390.0, 700.0, 150.0], [64.0, 700.0, 62.0]]), "the ": np.array([[2000.0, 50_000.0, 1900.0], [260.0, 6000.0, 240.0]])}
    assert set(toxicity.lexicon(counts, totals).scores) == {"achl"}
    totals = np.array([[284.0, 110_000.0, 284.0], [45.0, 18_000.0, 45.0]])
    counts = {"veju": np.array([[0.0, 0.0, 0.0], [4.0, 30.0, 4.0]]), "once ": np.array([[0.0, 0.0, 0.0], [1.0, 1.0, 0.0]])}
    assert set(toxicity.lexicon(counts, totals).scores) == {"veju"}


@pytest.fixture(scope="module")
def judged(spark, sf_dir):
    out = queries.op11_toxicity(spark, sf_dir)
    rows = {r.doc_id: r for r in out.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    return out, rows, labels


def test_contract_and_accuracy(spark, sf_dir, judged):
    out, rows, labels = judged
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= dict(out.dtypes).items()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    known = [(rows[d].predicted, t) for d, t in labels.items() if d in rows]
    assert sum(p for p, t in known if t) >= 0.6 * sum(t for _, t in known)
    assert sum(p for p, t in known if not t) <= 0.02 * len(known)


def test_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(
        [(k, t, "x") for k, t in enumerate(["fine words here " * 30] * 40 + ["you zzidiot and zzidiots here " * 3] * 20 + [None, "", "  \n", "zzidiot " * 50_000, "A zzIDIOTS! b"])] + [(None, "zzidiots", "x")],
        "doc_id long, text string, Toxicity string",
    )
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(60)] + [(None, 1), (61, None), (62, 7)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_keys(labels, "doc_id", "toxic"), docs, "doc_id", "text")
    found, name = toxicity.find(docs, "text", model)
    assert name == "_toxicity" and found.columns == [*docs.columns, name]
    rows = found.select("doc_id", "text", F.col(name).alias("t")).collect()
    assert len(rows) == 66
    for r in rows:
        assert 0 <= r.t.probability <= 1
        for p in r.t.passages:
            part = r.text[p.first : p.after]
            assert part == part.strip() and p.expected < 1
    by = {r.doc_id: r.t for r in rows}
    assert by[60].n_words == by[61].n_words == by[62].n_words == 0 and by[60].evidence == 0 and by[60].passages == []
    assert by[40] == by[59] and by[40].probability >= 0.0


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(None, None)]])
def test_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    keys = toxicity.training_keys(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "toxic")
    model = toxicity.fit(keys, docs, "doc_id", "text")
    out, name = toxicity.find(docs, "text", model)
    assert [r[0] for r in out.select(F.col(name)["probability"]).collect()] == [1.0 if labels == [(1, 1)] else pytest.approx(0.0)] * 2
    assert toxicity.find(docs.limit(0), "text", model)[0].count() == 0


def test_copies_of_one_text_count_once(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rare = " ".join(r.sample(words, 80))
    rows = [(k, " ".join(r.choices(words, k=80)), 0) for k in range(200)]
    rows += [(1000 + k, rare, 1) for k in range(60)]
    rows += [(2000 + k, " ".join([*r.choices(words, k=30), "zznasty", *r.choices(words, k=30), "zznasty", *r.choices(words, k=20)]), 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.training_keys(docs, "doc_id", "toxic"), docs, "doc_id", "text")
    assert set(model.lexicon.scores) == {"zzn"} or set(model.lexicon.scores) == {"zznasty "}
