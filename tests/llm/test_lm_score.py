"""LM scores against a brute-force count over all documents."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import lm_score, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text)) if text else []


def brute(rows):
    tokens, singles, pairs, docs = 0, Counter(), Counter(), 0
    for _, t in rows:
        w = words(t)
        tokens += len(w)
        docs += bool(w)
        singles.update(w)
        pairs.update(zip([None, *w], w))
    out = []
    for i, t in rows:
        w, total = words(t), 0.0
        own, own_pairs = Counter(w), Counter(zip([None, *w], w))
        for a, b in zip([None, *w], w):
            both = pairs[a, b] - own_pairs[a, b]
            if both > 0:
                total += math.log(both / (docs - 1 if a is None else singles[a] - own[a]))
            else:
                total += math.log(0.4 * max(1, singles[b] - own[b]) / max(1, tokens - len(w)))
        out.append((i, len(w), total if w else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").limit(120)
    made = [tuple(r) for r in docs.collect()]
    return [*made, made[0], (9001, None), (9002, ""), (9003, "!!!"), (9004, "the The THE the"), (None, "the end")]


@pytest.mark.parametrize("options", [{}, {"share": 0.3}, {"share": 2.0, "bucket_bytes": 2000}])
def test_against_brute_force(spark, rows, options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_score.score(docs, "doc_id", "text", **options).collect()), key=str)
    expected = brute(rows)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    for g, e in zip(got, expected):
        assert (g[2] is None) == (e[2] is None)
        assert e[2] is None or g[2] == pytest.approx(e[2], rel=1e-5)


def test_many_equal_rows(spark):
    text = " ".join(f"w{k % 97}" for k in range(300))
    docs = spark.range(100_000).select(F.col("id").alias("n_words"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(-1, "w1 w2 and more")], "n_words long, text string"))
    out = lm_score.score(docs, "n_words", "text", order=3)
    assert out.columns == ["n_words", "_n_words", "log_score", "mean_log_score"]
    rows = out.groupBy("_n_words", "log_score").count().orderBy("_n_words").collect()
    assert [(r["_n_words"], r["count"]) for r in rows] == [(4, 1), (300, 100_000)]


def test_hashes_of_copies_and_commons_agree(spark, rows):
    docs = spark.createDataFrame([*rows, *rows[:50], *rows[:50]], "doc_id long, text string")
    for share in (2.0, 0.05):
        got = sorted(((r.doc_id, r.log_score) for r in lm_score.score(docs, "doc_id", "text", order=3, share=share).collect()), key=str)
        expected = sorted(((i, v) for i, _, v in brute_order([*rows, *rows[:50], *rows[:50]], 3)), key=str)
        for g, e in zip(got, expected, strict=True):
            assert g[0] == e[0] and (g[1] is None and e[1] is None or g[1] == pytest.approx(e[1], rel=1e-9))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, key string, id int")
    assert lm_score.score(docs, "doc_id", "text").count() == 0


def brute_order(rows, order):
    """By the definition, with tuples: the longest context that others have, a backoff for each word it is shortened by."""
    per = [Counter(tuple(s[i : i + k]) for k in range(1, order + 1) for i in range(len(s) - k + 1)) for s in ([None, *words(t)] if words(t) else [] for _, t in rows)]
    every, tokens, out = sum(per, Counter()), sum(len(words(t)) for _, t in rows), []
    for (i, t), own in zip(rows, per):
        s, total = [None, *words(t)], 0.0
        for p in range(1, len(s)):
            longest = min(order, p + 1)
            for k in range(longest, 0, -1):
                gram = tuple(s[p - k + 1 : p + 1])
                left = every[gram] - own[gram]
                if k == 1 or left > 0:
                    below = every[gram[:-1]] - own[gram[:-1]] if k > 1 else max(1, tokens - len(s) + 1)
                    total += math.log(0.4) * (longest - k) + math.log(max(1, left) / below)
                    break
        out.append((i, len(s) - 1, total if len(s) > 1 else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_longer_contexts_against_brute_force(spark, rows, order):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_score.score(docs, "doc_id", "text", order=order).collect()), key=str)
    expected = brute_order(rows, order)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    for g, e in zip(got, expected):
        assert e[2] is None and g[2] is None or g[2] == pytest.approx(e[2], rel=1e-9)


def test_texts_that_differ_in_trigrams_only_score_apart(spark):
    assert queries.LM_ORDER >= 3
    corpus = ["a b c", "x b d", "p a b", "q x b"]
    rows = [*enumerate(corpus), (10, "z a b c"), (11, "z a b d")]
    out = {r.doc_id: r.log_score for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", order=queries.LM_ORDER).collect()}
    assert out[10] > out[11]


def test_several_stretches_and_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_score, "STRETCH", 100_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.log_score) for r in lm_score.score(docs, "doc_id", "text", order=3).collect()), key=str)
    for g, (i, _, v) in zip(got, brute_order(rows, 3), strict=True):
        assert g[0] == i and (v is None and g[1] is None or g[1] == pytest.approx(v, rel=1e-9))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == spark.newSession().conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def shuffled(spark):
    """Rows that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_ngrams_are_not_shuffled_row_by_row(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(200)], "doc_id long, text string")
    before = shuffled(spark)
    assert lm_score.score(docs, "doc_id", "text", order=3).where("n_words = 100").count() == 200
    made = sum(rows for stage, rows in shuffled(spark).items() if stage not in before)
    assert made < 200 * 100  # of some 60,000 n-grams
