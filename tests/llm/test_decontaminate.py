"""Benchmark hits against a search for every window in every text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text)) if text else []


def brute(docs, items, window):
    out = {}
    wanted = []
    for i, t in items:
        w = words(t)
        wanted += [(i, tuple(w[k : k + window])) for k in range(len(w) - window + 1)] if len(w) >= window else [(i, tuple(w))] if w else []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for i, run in wanted:
            for k in range(len(w) - len(run) + 1):
                if tuple(w[k : k + len(run)]) == run:
                    found.add(str(i))
                    hit[k : k + len(run)] = [True] * len(run)
        out[d] = (len(w), sum(hit), sorted(found))
    return out


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "d", "é", "f1"]

    def run(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(run(rng.choice([0, 1, 2, 4, 5, 6, 9, 15])))) for k in range(8)]
    items += [(100, items[-1][1]), (101, None), (102, "?!")]
    docs = []
    for k in range(60):
        parts = run(rng.randrange(0, 40))
        if rng.random() < 0.7:
            parts += (rng.choice(items)[1] or "").upper().replace("É", "é").split() + run(5)
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts)))
    return [*docs, (900, None), (901, ""), (902, "a " * 4000)], items


@pytest.mark.parametrize("seed, most", [(1, 10**6), (2, 10**6), (3, 40)])
def test_against_brute_force(spark, seed, most):
    docs, items = make(seed)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = spark.createDataFrame(items, "item_id long, text string")
    found, name = decontaminate.find(table, "text", wanted, "item_id", "text", window=5, most_chars=most)
    got = {r.doc_id: (r[name].n_words, r[name].n_hit, r[name]["items"]) for r in found.collect()}
    assert got == brute(docs, items, 5)


def test_automaton_longest_matches():
    a = decontaminate.SuffixAutomaton(3)
    a.add("x", "one two three four")
    a.add("y", "two three five")
    a.finish()
    ids = [a.vocabulary.get(w, -1) for w in "zero one two three five two three four six".split()]
    hits, items = a.match(ids)
    assert hits == [(1, 3), (2, 4), (5, 7)] and items == {"x", "y"}


def test_remove_cuts_spans_and_drops_documents(spark):
    item = " ".join(f"w{k}" for k in range(13))
    filler = " ".join(f"x{k}" for k in range(400))
    rows = [(1, f"Before. {item}, after {filler}", "k"), (2, item, "k"), (3, "Nothing, here  to see.", "k"), (4, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.remove(docs, "text", items, "item_id", "text")
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"Before., after {filler}", 3: "Nothing, here  to see.", 4: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove(docs, "text", items, "item_id", "text").count() == 1
    assert decontaminate.remove(docs.where(F.lit(False)), "text", items, "item_id", "text").count() == 0


@pytest.mark.parametrize("least", [13, 30_000])
def test_repeated_word_takes_linear_time(least):
    automaton = decontaminate.SuffixAutomaton(least)
    automaton.add("a", "w " * 20_000)
    automaton.add("b", "w w")
    automaton.finish()
    began = time.perf_counter()
    hits, items = automaton.match([0] * 20_000)
    if least == 13:
        assert items == {"a", "b"} and decontaminate.merged(hits) == [(0, 19_999)] and time.perf_counter() - began < 3
    else:  # items shorter than a window are whole: one each for the two of them, at most, at each place
        assert items == {"a", "b"} and len(hits) == 1 + 19_999
