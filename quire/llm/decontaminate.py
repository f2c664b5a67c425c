"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item. A document's words are streamed through it, which
gives at each word the longest run ending there that some item has. Runs of ``window`` words or more (and whole
items that are shorter) are hits; ``remove`` cuts them out and drops documents of which they cover too much.

Defined results: a null text has no words and no hits; empty and null items match nothing; items alike in text each
count; equal ids count once. Items are taken in blocks of bounded size, so the broadcast automaton is bounded however
many items there are; several blocks mean several passes, whose results are written between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, col, fresh, long_texts, materialize, released

#: Words of normalised text; in raw text the upper-case letters belong to them too.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def normalise(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.translate(_LOWER)


class SuffixAutomaton:
    """Of several word sequences. State 0 is the start; ``follow`` maps words to states."""

    def __init__(self, window: int):
        self.window, self.follow, self.link, self.length = window, [{}], [-1], [0]
        self.vocabulary: dict[str, int] = {}
        self.items: list[str] = []
        self._ends: list[list[int]] = []
        self.whole: dict[int, list[tuple[int, int]]] = {}
        self.least = window

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        follow, link, length = self.follow, self.link, self.length
        if (q := follow[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new, p = self._state(length[last] + 1, {}, 0), last
        while p >= 0 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.follow[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.follow[p].get(word) == q:
            self.follow[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, item: str, text: str) -> None:
        words = WORD.findall(normalise(text))
        if not words:
            return
        ids, last = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], 0
        for w in ids:
            last = self._extend(last, w)
        self.items.append(item)
        self._ends.append(ids)
        self.least = min(self.least, len(ids))

    def finish(self) -> SuffixAutomaton:
        """Notes, at every state that holds runs of just ``window`` words, the items that have them; and where short items end.

        Of each state the ancestor that holds its runs of ``window`` words is noted (``cut``), and the nearest one, itself included, at which a
        short item ends (``short``): a walk along links, which is as long as an item is repetitive, is then a look-up.
        """
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)  # links lead to shorter runs
        self.cut, self.short = list(range(len(self.length))), [0] * len(self.length)
        for at in order:
            if self.length[self.link[at]] >= self.window:
                self.cut[at] = self.cut[self.link[at]]
        self.having: dict[int, list[int]] = {}
        for k, ids in enumerate(self._ends):
            state = 0
            for n, w in enumerate(ids, 1):
                state = self.follow[state][w]
                if n >= self.window and (got := self.having.setdefault(self.cut[state], []))[-1:] != [k]:
                    got.append(k)
            if len(ids) < self.window:
                self.whole.setdefault(state, []).append((len(ids), k))
        for at in order:
            self.short[at] = at if at in self.whole else self.short[self.link[at]]
        self._ends = []
        self.shorts = bool(self.whole)
        return self

    def scan(self, ids: list[int], offset: int, hits: list[tuple[int, int]], found: set[int]) -> None:
        """ids: words that all occur in items. Appends (first, last) of each window hit, in order of last."""
        follow, link, length, window, state, run = self.follow, self.link, self.length, self.window, 0, 0
        for k, w in enumerate(ids):
            while state and w not in follow[state]:
                state = link[state]
                run = length[state]
            if (to := follow[state].get(w)) is None:
                run = 0
                continue
            state, run = to, run + 1
            if run >= window:
                hits.append((offset + k - window + 1, offset + k))
                found.update(self.having[self.cut[state]])
            if self.shorts:
                at = self.short[state]
                while at > 0:  # short items that end here, one within the other: fewer than ``window``
                    for n, item in self.whole[at]:
                        if n <= run:
                            hits.append((offset + k - n + 1, offset + k))
                            found.add(item)
                    at = self.short[link[at]]

    def match(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """words: ids, -1 for words that no item has. Only stretches of known words that could hold a hit are walked."""
        known = np.fromiter(words, np.int64, len(words)) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - first >= self.least:
                self.scan(words[first:end], first, hits, found)
        return hits, {self.items[k] for k in found}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words, both ends included, as the fewest spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words; the white space before a cut goes too."""
    places = [m.span() for m in RAW_WORD.finditer(text)]
    out, at = [], 0
    for first, last in spans:
        kept = text[at : places[first][0]]
        out.append(kept.rstrip() if kept.strip() else "")
        at = places[last][1]
    out.append(text[at:])
    joined = "".join(out)
    return joined if text[:1].isspace() else joined.lstrip()


SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>, cleaned string"


def _matcher(spark, rows: list, window: int, coverage: int | None):
    automaton = SuffixAutomaton(window)
    for item, text in rows:
        automaton.add(item, text)
    shared = spark.sparkContext.broadcast(automaton.finish())

    @F.pandas_udf(SCHEMA)
    def matched(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        released()
        a = shared.value
        ids = Memo(lambda w: a.vocabulary.get(normalise(w), -1), 300_000)
        for texts, had, marked in parts:
            out = []
            for text, known, places in zip(texts, had, marked, strict=True):
                words = list(map(ids.__getitem__, RAW_WORD.findall(text))) if text else []
                hits, items = a.match(words)
                if known is not None:  # from an earlier block of items
                    items.update(known)
                    hits.extend((s["first"], s["last"]) for s in places)
                spans = merged(hits)
                n = sum(b - a + 1 for a, b in spans)
                cleaned = cut(text, spans) if spans and coverage and coverage * n < len(words) else None
                out.append((len(words), n, sorted(items), [{"first": x, "last": y} for x, y in spans], cleaned))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans", "cleaned"])

    return matched.asNondeterministic()  # so that a filter on the result doesn't make Spark match twice


def find(docs: DataFrame, text: str, items: DataFrame, item: str, item_text: str, window: int = 13, most_chars: int = 5_000_000, coverage: int | None = None) -> tuple[DataFrame, str]:
    """(docs with a struct column of SCHEMA, its name). ``cleaned`` is the text without its spans where they cover less than one word in ``coverage``, else null. ``most_chars`` bounds the items of one automaton, which takes about 70 bytes a character in each worker (measured). No shuffle of the documents."""
    long_texts(docs.sparkSession)
    (name,) = fresh(docs, "hits")
    listed = items.where(col(item_text).isNotNull()).select(F.coalesce(col(item).cast("string"), F.lit("")).alias("i"), col(item_text).alias("t"))
    chars = listed.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // most_chars))
    out = docs.withColumn(name, F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in re.split(', ', SCHEMA))}>"))
    for k in range(blocks):
        if k:
            out = materialize(out, f"hits{k}")
        rows = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        out = out.withColumn(name, _matcher(docs.sparkSession, sorted((r.i, r.t) for r in rows.collect()), window, coverage)(col(text), col(name)["items"], col(name)["spans"]))
    return out, name


def over(hits: Column, coverage: int = 20) -> Column:
    """Whether hits cover at least one word in ``coverage``."""
    return (hits["n_hit"] > 0) & (F.lit(coverage) * hits["n_hit"] >= hits["n_words"])


def remove(docs: DataFrame, text: str, items: DataFrame, item: str, item_text: str, window: int = 13, coverage: int = 20) -> DataFrame:
    """The documents without those over the coverage limit, and without the spans over the length limit; same columns.

    Documents without a hit are returned as they are.
    """
    found, name = find(docs, text, items, item, item_text, window, coverage=coverage)
    kept = found.where(~over(col(name), coverage))
    return kept.withColumn(text, F.coalesce(col(name)["cleaned"], col(text))).select(*[col(c) for c in docs.columns])
