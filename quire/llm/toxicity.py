"""Toxic passages: maximum-scoring segments of token log-odds.

**Tokens.** A word belongs to at most one class of the lexicon: of its beginnings (``SHORTEST`` to ``LONGEST``
characters, but not all) and the whole word the one that labelled toxic texts hold most significantly more often. Significance is the root of the likelihood ratio
statistic of document counts: of documents that have the class at all, or that have it ``OFTEN`` times, whichever says more. Of few labelled texts
it tells more than a z-score, and a stem that clean texts have too, by chance and seldom, is known by the documents that have it often. Besides, the log-odds
ratio of token counts must be great, under an informative Dirichlet prior, whose mass is ``PRIOR`` of the counts and whose centre is the pooled distribution. A class scores the log-odds of its tokens in a toxic passage, of which ``DENSITY`` is toxic
tokens, against clean text (smoothed by the same kind of prior); every other word scores the log-odds of the rest, below zero.

**Segments.** One scan in linear time finds all maximal segments: the best one, the best ones to its left and right, and so on.

**Calibration.** By construction the scores' Karlin-Altschul lambda is 1, so of n words of clean text the segments that score over
ln(K n) come as a Poisson process of mean 1 with exponential excesses. K is fitted to the best segments of clean training texts. A text's
evidence is minus the logarithm of the chance that clean text has as great a sum of excesses; a logistic curve over ln(1 + evidence) makes it a probability.
K and the curve are fitted to training texts scored by lexicons of the other ``FOLDS - 1`` folds.

A training text weighs 1 / n if about n of the training texts are copies or near copies of it (the median, over ``MARKS`` min-hashes of
five-word shingles, of how many have the same), so that words of one text that was copied often aren't taken for toxic ones.

The model is fitted on at most ``MAX_TRAIN`` labelled texts of each class (those of the smallest hashes) and holds at most
``MAX_NODES`` candidates; texts are scored where they are read, whole, and nothing is shuffled for that.

Defined results: a null text, an empty one and one without words have no passages, evidence 0 and the least probability. Without
texts of both classes the lexicon is empty and every text has the share of toxic ones among the labels (0 if there are none).
Repeated rows are scored alike. New columns whose names are taken get leading underscores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, col, fresh, long_texts, materialize, mix, ngram_hashes, word_bytes, word_hashes

SHORTEST, LONGEST = 3, 12
MAX_TRAIN, MAX_NODES, FOLDS, MARKS = 10_000, 100_000, 3, 15
#: Mass of the Dirichlet priors as a share of the counts; the least significance and log-odds ratio of a lexicon class; toxic tokens in a toxic passage.
PRIOR, LEAST_Z, LEAST_ODDS, DENSITY = 0.05, 3.7, 3.0, 0.2
#: Occurrences in a document from which it has a class often.
OFTEN = 2
COUNTED = ("docs", "tokens", "often")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # as word_bytes, before lower-casing


def nodes_of(word: str) -> list[str]:
    """The classes that a word may belong to, shortest first: its beginnings, as those of longer words, and the whole word, with a space at its end."""
    return [word[:k] for k in range(SHORTEST, min(LONGEST + 1, len(word)))] + [word + " "]


@dataclass(frozen=True)
class Lexicon:
    """Log-odds of classes of words, none a beginning of another, and of any other word."""

    scores: dict[str, float]
    neutral: float

    def of(self, word: bytes) -> float:
        """0 for a word of no class."""
        return next((self.scores[n] for n in nodes_of(word.decode("utf-8", "replace")) if n in self.scores), 0.0)


def _odds(n0: float, n1: float, all0: float, all1: float) -> float:
    """Log-odds ratio of n1 of all1 against n0 of all0."""
    mass = PRIOR * (all0 + all1)
    a = mass * (n0 + n1) / (all0 + all1)
    if not n1 or n1 + a >= all1 + mass:
        return 0.0
    return math.log((n1 + a) / (all1 + mass - n1 - a)) - math.log((n0 + a) / max(all0 + mass - n0 - a, 1e-9))


def _significance(n0: float, n1: float, all0: float, all1: float) -> float:
    """Root of the likelihood ratio statistic of two shares, 0 if the second isn't greater: as a z-score, but also where a count is 0."""
    if n1 * all0 <= n0 * all1:
        return 0.0
    pooled = (n0 + n1) / (all0 + all1)
    g = sum(x * math.log(x / (whole * p)) for n, whole in ((n0, all0), (n1, all1)) for x, p in ((n, pooled), (whole - n, 1 - pooled)) if x > 0 and p > 0)
    return math.sqrt(max(0.0, 2 * g))


def lexicon(counts: dict[str, np.ndarray], totals: np.ndarray) -> Lexicon:
    """counts: node -> (documents, tokens, documents that have it often, if these were counted) of clean and toxic texts, as an array [class, kind]; totals: the same of all texts."""
    (docs0, words0), (docs1, words1) = totals[:, :2]
    if not docs0 or not docs1:
        return Lexicon({}, -1.0)
    likely = []
    for node, found in counts.items():
        (_, t0, *_), (_, t1, *_) = found
        z = max(_significance(n0, n1, docs0, docs1) for n0, n1 in found[:, [0, *range(2, found.shape[1])]].T)
        if z >= LEAST_Z and _odds(t0, t1, words0, words1) >= LEAST_ODDS:
            likely.append((-z, len(node), node))
    kept: dict[str, np.ndarray] = {}
    above: set[str] = set()
    for _, _, node in sorted(likely):  # of a word's classes the most significant
        beginnings = [node[:k] for k in range(SHORTEST, len(node))]
        if node not in above and not any(b in kept for b in beginnings):
            kept[node] = counts[node][:, 1]
            above.update(beginnings)
    toxic = sum(t1 for _, t1 in kept.values())
    mass, scores, rest = PRIOR * (words0 + words1), {}, 1.0
    for node, (t0, t1) in kept.items():
        clean = (t0 + mass * (t0 + t1) / (words0 + words1)) / (words0 + mass)
        score = math.log(DENSITY * t1 / toxic / clean)
        if score > 0:
            scores[node] = score
            rest -= clean
    return Lexicon(scores, min(math.log((1 - DENSITY) / max(rest, 1e-9)), -1e-3))


def segments(places: list[int], scores: list[float], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first place, last place, score) of a text whose words at ``places`` have positive ``scores`` and others ``neutral``, below 0. Linear time."""
    lefts: list[float] = []
    rights: list[float] = []
    ends: list[tuple[int, int]] = []
    links: list[int] = []  # the nearest segment before that begins at a lower sum
    total, after = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += neutral * (place - after)
        left, first = total, place
        total += score
        after = place + 1
        while True:
            k = len(lefts) - 1
            while k >= 0 and lefts[k] >= left:
                k = links[k]
            if k < 0 or rights[k] >= total:
                break
            left, first = lefts[k], ends[k][0]
            del lefts[k:], rights[k:], ends[k:], links[k:]
        lefts.append(left)
        rights.append(total)
        ends.append((first, place))
        links.append(k)
    return [(a, b, r - x) for (a, b), x, r in zip(ends, lefts, rights, strict=True)]


def log_tail(total: float) -> float:
    """Minus the logarithm of the chance that a Poisson number (mean 1) of exponential excesses (mean 1) sums up to ``total`` or more; 0 for 0."""
    if total <= 0:
        return 0.0
    j = np.arange(int(4 * math.sqrt(total)) + 60, dtype=np.float64)
    factorials = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, len(j) + 1)))))  # ln k! for k to len(j)
    more, term = np.ones_like(j), np.ones_like(j)
    for k in range(2, 30):  # the chance of more than j excesses is e^-1 / (j+1)! times this series
        term = term / (j + k)
        more += term
    parts = j * math.log(total) - factorials[:-1] - factorials[1:] + np.log(more)
    peak = parts.max()
    return max(0.0, 1 + total - peak - math.log(np.exp(parts - peak).sum()))


def evidence(n_words: int, found: list[float], k: float) -> float:
    """Of segment scores."""
    threshold = max(0.0, math.log(k * n_words)) if n_words else 0.0
    return log_tail(sum(s - threshold for s in found if s > threshold))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    k: float
    intercept: float
    slope: float

    def probability(self, e: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * math.log1p(e)))))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """(intercept, slope, not below 0) by Newton's method; the slope is drawn to 0 by ``ridge``, so separable classes have a finite one."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        g, w = weights * (y - p), weights * p * (1 - p)
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, [g.sum(), (g * x).sum() - ridge * b])
        size = np.abs(step).max()
        step *= min(1.0, 2 / size) if size else 1
        a, b = a + step[0], b + step[1]
        if size < 1e-9:
            break
    return (a, b) if b >= 0 else (math.log(max((weights * y).sum(), 1e-9) / max((weights * (1 - y)).sum(), 1e-9)), 0.0)


def training_keys(labels: DataFrame, key: str, label: str, most: int = MAX_TRAIN) -> DataFrame:
    """At most ``most`` rows (key, label) of each label 0 and 1, those of the smallest hashes; at most 2 ``most`` narrow rows, so they may be broadcast."""
    rows = labels.where(col(key).isNotNull()).select(col(key).alias("key"), col(label).cast("int").alias("label"))
    parts = [rows.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(most) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def _weighted(sample: DataFrame) -> DataFrame:
    """Adds ``weight``: 1 over the number of like texts."""

    @F.pandas_udf("array<long>")
    def marks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, seeds = word_hashes(), mix(np.arange(1, MARKS + 1, dtype=np.uint64))
        for texts in parts:
            out = []
            for t in texts:
                h = ngram_hashes(np.array(list(map(hashes.__getitem__, word_bytes(t))), np.uint64), 5)
                out.append([int(mix(h ^ s).min().view(np.int64)) for s in seeds] if len(h) else [])
            yield pd.Series(out)

    marked = sample.select("key", F.posexplode(marks("text")).alias("place", "mark"))
    same = marked.join(marked.groupBy("place", "mark").agg(F.count(F.lit(1)).alias("n")), ["place", "mark"])
    return sample.join(same.groupBy("key").agg((1 / F.median("n")).alias("weight")), "key", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def _counted(sample: DataFrame) -> DataFrame:
    """(node, weighted documents, tokens and documents that have it often, by fold and class) of a table of text, label, fold and weight. Each batch is summed before it is shuffled."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sums: dict[int, dict[str, list[float]]] = {}
            for text, label, fold, weight in zip(part["text"], part["label"], part["fold"], part["weight"], strict=True):
                own: Counter = Counter()
                for word, n in Counter(word_bytes(text)).items():
                    own[""] += n
                    for node in nodes_of(word.decode("utf-8", "replace")):
                        own[node] += n
                own[""] += 0
                at = sums.setdefault(fold * 2 + label, {})
                for node, n in own.items():
                    x = at.setdefault(node, [0.0, 0.0, 0.0])
                    x[0] += weight
                    x[1] += weight * n
                    x[2] += weight * (n >= OFTEN)
            for place, found in sums.items():
                yield pd.DataFrame({"node": list(found), "place": place} | {name: [x[k] for x in found.values()] for k, name in enumerate(COUNTED)})

    rows = sample.mapInPandas(count, "node string, place int, docs double, tokens double, often double")
    sums = [F.sum(F.when(F.col("place") == 2 * f + c, F.col(x)).otherwise(0)).alias(f"{x}{f}{c}") for f in range(FOLDS) for c in range(2) for x in COUNTED]
    return rows.groupBy("node").agg(*sums)


def fit(keys: DataFrame, docs: DataFrame, key: str, text: str) -> Model:
    """keys: of ``training_keys``; docs: the texts. Only candidates of the lexicon and training texts' segment scores reach the driver, both bounded."""
    long_texts(docs.sparkSession)
    joined = docs.select(col(key).alias("key"), col(text).alias("text")).join(F.broadcast(keys), "key")
    drawn = materialize(joined.select("key", "text", "label", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")), "toxic")
    sample = materialize(_weighted(drawn), "weighted")
    counted = materialize(_counted(sample), "tokens")
    columns = counted.columns[1:]
    as_array = lambda r: np.array(r[1:], np.float64).reshape(FOLDS, 2, len(COUNTED))
    root = counted.where("node = ''").collect()
    if not root:
        return Model(Lexicon({}, -1.0), 1.0, -500.0, 0.0)
    totals = as_array(root[0])
    docs0, docs1 = totals.sum(axis=0)[:, 0]
    if not docs0 or not docs1:
        return Model(Lexicon({}, -1.0), 1.0, 500.0 if docs1 else -500.0, 0.0)
    clean, toxic, seldom, often = (sum(F.col(c) for c in columns if c.startswith(k) and c.endswith(str(x))) for k in ("docs", "often") for x in (0, 1))
    more = lambda some, others: (some >= 1.5) & (some * float(docs0) >= others * (2 * float(docs1)))
    likely = counted.where((F.col("node") != "") & (more(toxic, clean) | more(often, seldom)))
    counts = {r.node: as_array(r) for r in likely.orderBy(toxic.desc(), "node").limit(MAX_NODES).collect()}
    others = [lexicon({n: c.sum(axis=0) - c[f] for n, c in counts.items()}, totals.sum(axis=0) - totals[f]) for f in range(FOLDS)]

    @F.pandas_udf("n int, found array<double>")
    def scored(texts: pd.Series, folds: pd.Series) -> pd.DataFrame:
        scanners = [_scanner(x) for x in others]
        found = [scanners[f](t) for t, f in zip(texts, folds, strict=True)]
        return pd.DataFrame({"n": [n for n, _ in found], "found": [[s for _, _, s in x] for _, x in found]})

    rows = sample.select("label", "weight", scored("text", "fold").alias("s")).select("label", "weight", "s.n", "s.found").collect()  # at most 2 x MAX_TRAIN
    best = [(r.weight, r.n, max(r.found, default=0.0)) for r in rows if not r.label]
    k = (sum(w for w, _, _ in best) + 1) / (sum(w * n * math.exp(-s) for w, n, s in best) + 1)
    x, y, weights = (np.array(v, np.float64) for v in zip(*[(evidence(r.n, r.found, k), r.label, r.weight) for r in rows], strict=True))
    return Model(lexicon({n: c.sum(axis=0) for n, c in counts.items()}, totals.sum(axis=0)), k, *logistic(np.log1p(x), y, weights))


def _scanner(lex: Lexicon):
    """text -> (number of words, maximal segments by places of words)."""
    memo = Memo(lex.of, 400_000)

    def scan(text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = word_bytes(text)
        scores = list(map(memo.__getitem__, words))
        if not any(scores):
            return len(words), []
        places = [k for k, s in enumerate(scores) if s]
        return len(words), segments(places, [scores[k] for k in places], lex.neutral)

    return scan


def find(docs: DataFrame, text: str, model: Model) -> tuple[DataFrame, str]:
    """(docs with a struct column, its name): n_words, evidence, probability, and the significant ``passages`` in order.

    A passage has its first character's index, the index after its last, its words, its score and how many as good a clean
    text of this length is expected to have (``expected``, below 1).
    """
    long_texts(docs.sparkSession)
    (made,) = fresh(docs, "toxicity")

    @F.pandas_udf("n_words long, evidence double, probability double, passages array<struct<first:int,after:int,words:int,score:double,expected:double>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scan = _scanner(model.lexicon)
        for texts in parts:
            out = []
            for t in texts:
                n, segs = scan(t)
                e = evidence(n, [s for _, _, s in segs], model.k)
                good = [(a, b, s) for a, b, s in segs if model.k * n * math.exp(-s) < 1]
                spans = [m.span() for m in _WORD.finditer(t)] if good else []
                passages = [{"first": spans[a][0], "after": spans[b][1], "words": b - a + 1, "score": s, "expected": model.k * n * math.exp(-s)} for a, b, s in good]
                out.append((n, e, model.probability(e), passages))
            yield pd.DataFrame(out, columns=["n_words", "evidence", "probability", "passages"])

    return docs.withColumn(made, found.asNondeterministic()(col(text))), made
