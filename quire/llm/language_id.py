"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier (multinomial naive Bayes over hashed byte
trigrams of the lower-cased text, runs of other characters than letters as one space) says whether the text is in one of the languages
whose bit is set. The bits' margins are decoded by logistic loss, each bit weighted by the log odds of its accuracy on the labelled
texts (languages weigh the same; the weights' mean is one): the codeword with the least total loss wins, and a text whose two best losses are
near is flagged as ambiguous.

Trigram counts and the bits' accuracies are taken over all labelled texts by Spark; the model on the driver has languages x
``FEATURES`` counts. All languages are learned; more than ``MOST`` are refused, never cut off. Defined results: a null text, or one
without a letter, is ``und`` with score 0. With one language learned every text gets it; with none every text is ``und``.
Of equal losses the language first in order wins.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, col, fresh, long_texts, released

FEATURES = 1 << 15
MOST = 512  # languages that a model on the driver has room for: 64 MB of counts
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_RUN = re.compile(rb"  +")


def prepared(text: str | None) -> bytes:
    return _RUN.sub(b" ", b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" ") if text else b""


def features(stream: bytes) -> np.ndarray:
    """The feature at each place of a byte stream, of the trigram that begins there."""
    b = np.frombuffer(stream, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


def codewords(languages: int) -> np.ndarray:
    """languages x bits of 0 and 1: the exhaustive code for up to five languages, else 31 columns of a fixed random
    matrix, the one of 200 whose nearest codewords are farthest apart."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 5:
        return np.array([(1, *c) for c in itertools.product((0, 1), repeat=languages - 1)][:-1], np.int8).T
    rng, best = np.random.default_rng(7), (-1, None)
    for _ in range(200):
        m = rng.integers(0, 2, (languages, 31), dtype=np.int8)
        if (m.min(axis=0) == m.max(axis=0)).any():
            continue
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(m, 2))
        best = max(best, (apart, m), key=lambda x: x[0])
    return best[1]


class EcocModel:
    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        """counts: languages x FEATURES. Languages weigh the same in a bit, however much text they have."""
        self.languages, self.code = languages, codewords(len(languages))
        share = counts + smooth
        share = share / share.sum(axis=1, keepdims=True)
        bits = self.code.shape[1]
        self.trust = np.ones(bits)
        self.weights = np.zeros((FEATURES, max(bits, 1)), np.float32)
        for b in range(bits):
            one, zero = (share[self.code[:, b] == v].mean(axis=0) for v in (1, 0))
            self.weights[:, b] = np.log(one) - np.log(zero)

    def weigh(self, right: np.ndarray, texts: np.ndarray) -> None:
        """right: languages x bits, of how many labelled texts a bit was told right; texts: of each language. Unseen languages have no say."""
        seen = texts > 0
        if seen.any() and self.code.shape[1]:
            share = ((right[seen] + 1) / (texts[seen, None] + 2)).mean(axis=0)
            odds = np.log(np.clip(share, 0.51, 0.999) / (1 - np.clip(share, 0.51, 0.999)))
            self.trust = odds / odds.mean()

    def margins(self, streams: list[bytes]) -> np.ndarray:
        """texts x bits: mean log odds a trigram, times the number of trigrams up to 30."""
        out = np.zeros((len(streams), self.weights.shape[1]))
        found = features(b"".join(streams))
        ends = np.cumsum([len(s) for s in streams])
        sums = np.zeros((len(found) + 1, 1))
        for b in range(self.weights.shape[1]):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[:, b][found], dtype=np.float64)))
            first = np.minimum(ends - [len(s) for s in streams], len(found))
            last = np.minimum(np.maximum(first, ends - 2), len(found))
            out[:, b] = (sums[last] - sums[first]) / np.maximum(1, last - first) * np.minimum(30, last - first)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, distance to the second best loss) of each text."""
        sign = self.code.astype(np.float64) * 2 - 1
        bits = self.code.shape[1]
        loss = (self.trust * np.logaddexp(0, -margins[:, None, :bits] * sign[None])).sum(axis=2)
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        ordered = np.sort(loss, axis=1)
        apart = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return loss.argmin(axis=1), chance.max(axis=1), apart


def _counted(languages: list[str]):
    at = {x: k for k, x in enumerate(languages)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        total = np.zeros((len(languages), FEATURES), np.int64)
        for part in parts:
            for language, rows in part.groupby("lang"):
                texts = rows["text"].tolist()
                for start, end in batches(texts, 500_000):
                    total[at[language]] += np.bincount(features(b"\0\0".join(map(prepared, texts[start:end]))), minlength=FEATURES)
        lang, feature = np.nonzero(total)
        if len(lang):
            yield pd.DataFrame({"lang": [languages[k] for k in lang], "feature": feature, "n": total[lang, feature]})

    return run


def _judged(shared):
    """Rows (lang, bit, right, texts): how many of a task's texts have a bit told right."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released()
        m = shared.value
        at = {x: k for k, x in enumerate(m.languages)}
        bits = m.code.shape[1]
        right, texts = np.zeros((len(at), bits), np.int64), np.zeros(len(at), np.int64)
        for part in parts:
            some, labels = part["text"].tolist(), np.array([at[x] for x in part["lang"]], np.int64)
            for start, end in batches(some, 500_000):
                if start < end:
                    own = labels[start:end]
                    told = m.margins([prepared(t) for t in some[start:end]])[:, :bits] > 0
                    np.add.at(right, own, told == m.code[own].astype(bool))
                    np.add.at(texts, own, 1)
        lang, bit = np.nonzero(np.repeat(texts[:, None] > 0, bits, axis=1))
        if len(lang):
            yield pd.DataFrame({"lang": lang, "bit": bit, "right": right[lang, bit], "texts": texts[lang]})

    return run


def fit(docs: DataFrame, text: str, lang: str) -> EcocModel:
    """Learns from all rows with a text and a language. Two passes over them: trigram counts, then the bits' accuracies."""
    spark = docs.sparkSession
    long_texts(spark)
    labelled = docs.select(col(text).alias("text"), col(lang).alias("lang")).where("text is not null and lang is not null")
    languages = sorted(r.lang for r in labelled.select("lang").distinct().limit(MOST + 1).collect())
    if len(languages) > MOST:
        raise ValueError(f"more than {MOST} languages")
    counts = np.zeros((len(languages), FEATURES), np.float32 if len(languages) > 64 else np.float64)
    if languages:
        rows = labelled.mapInPandas(_counted(languages), "lang string, feature int, n long")
        at = {x: k for k, x in enumerate(languages)}
        for language, feature, n in rows.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[at[language], feature] = n
    model = EcocModel(languages, counts)
    if len(languages) > 1:
        right, texts = np.zeros(model.code.shape), np.zeros(len(languages))
        rows = labelled.mapInPandas(_judged(spark.sparkContext.broadcast(model)), "lang int, bit int, right long, texts long")
        for r in rows.groupBy("lang", "bit").agg(F.sum("right").alias("right"), F.sum("texts").alias("texts")).collect():
            right[r.lang, r.bit], texts[r.lang] = r.right, r.texts
        model.weigh(right, texts)
    return model


def identify(docs: DataFrame, text: str, model: EcocModel, margin: float = 1.0) -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1) and lang_ambiguous (clashing names get a leading underscore). No shuffle."""
    long_texts(docs.sparkSession)
    names = fresh(docs, "lang_pred", "lang_score", "lang_ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("p string, s double, a boolean")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        released()
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for series in parts:
            texts, out = series.tolist(), []
            for start, end in batches(texts, 500_000):
                some = texts[start:end]
                known = np.array([bool(t and m.languages and _LETTER.search(t)) for t in some])
                if m.languages:
                    best, chance, apart = m.decode(m.margins([prepared(t) for t in some]))
                else:
                    best, chance, apart = (np.zeros(len(some), int), *np.zeros((2, len(some))))
                out.append(pd.DataFrame({"p": np.where(known, names[best], "und"), "s": np.where(known, chance, 0.0), "a": ~known | (apart < margin)}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"p": [], "s": [], "a": []})

    (made,) = fresh(docs, "predicted")
    out = docs.withColumn(made, predicted(col(text)))
    for name, part in zip(names, "psa", strict=True):
        out = out.withColumn(name, col(made)[part])
    return out.drop(made)
