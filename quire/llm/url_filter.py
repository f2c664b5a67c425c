"""URL filter: rules first, then the ratio of two character language models.

The two models are variable-order Markov chains over the characters of host and path, one of accepted
and one of rejected URLs, smoothed by Witten-Bell interpolation. A URL's score is the difference of its
log-likelihoods divided by its length; a logistic calibration on held-out training URLs turns it into the
probability that the URL is acceptable.

Defined results: a null URL or one without ``://`` has empty host and path and is scored as an empty
string (probability: the calibrated prior of a zero score). If one of the training sets is empty there is nothing to compare;
every URL without a rule is then allowed with a null score.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, materialize

START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is ``host/path``; it fits the host and its subdomains under that path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/ ? #`` or the end; A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host to ``? #`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, else nulls. The rules are few: literals of one expression."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        pattern = F.when(fits, F.lit(r.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


@dataclass
class MarkovModel:
    """``logp`` of seen context + character, ``backoff`` of seen contexts, ``floor`` of a character never seen."""

    order: int
    logp: dict[str, float] = field(default_factory=dict)
    backoff: dict[str, float] = field(default_factory=dict)
    floor: float = 0.0

    @classmethod
    def fit(cls, counts: dict[str, int], order: int, alphabet: int = 256) -> MarkovModel:
        """counts: of all strings of 1 to order + 1 characters. Witten-Bell: a context with T followers leaves T of N + T to shorter ones."""
        model, followers = cls(order), defaultdict(dict)
        for gram, n in counts.items():
            followers[gram[:-1]][gram[-1]] = n
        for context in sorted(followers, key=len):
            seen = followers[context]
            total, kinds = sum(seen.values()), len(seen)
            model.backoff[context] = math.log(kinds / (total + kinds))
            for c, n in seen.items():
                lower = math.exp(model.logp[context[1:] + c]) if context else 1 / alphabet
                model.logp[context + c] = math.log((n + kinds * lower) / (total + kinds))
        model.floor = model.backoff.get("", 0.0) - math.log(alphabet)
        return model

    def log_likelihood(self, text: str) -> float:
        logp, backoff, total = self.logp, self.backoff, 0.0
        text = START + text + END
        for k in range(1, len(text)):
            for start in range(max(0, k - self.order), k + 1):
                if (found := logp.get(text[start : k + 1])) is not None:
                    total += found
                    break
                total += backoff.get(text[start:k], 0.0)
            else:
                total += self.floor - backoff.get("", 0.0)
        return total


@dataclass
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    slope: float = 1.0
    offset: float = 0.0

    def score(self, text: str) -> float:
        """Difference of the log-likelihoods per character, the end counted as one."""
        return (self.accepted.log_likelihood(text) - self.rejected.log_likelihood(text)) / (len(text) + 1)

    def probability(self, score: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * score + self.offset))))


def _runs(padded: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
    return F.filter(F.transform(at, lambda k: F.substring(padded, k, F.lit(n))), lambda g: (F.length(g) == n) & (g != START))


def _grams(text: Column, order: int) -> Column:
    padded = F.concat(F.lit(START), text, F.lit(END))
    return F.flatten(F.array(*[_runs(padded, n) for n in range(1, order + 2)]))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, slightly ridged, by Newton's method; both classes weigh the same. n: how many cases a row stands for."""
    w = n * np.where(y > 0.5, 0.5 / max(1, n[y > 0.5].sum()), 0.5 / max(1, n[y <= 0.5].sum())) * n.sum()
    beta, design = np.zeros(2), np.column_stack([x, np.ones_like(x)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (w * p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (w * (y - p)) - 0.01 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def scored(spark: SparkSession, model: UrlModel, text: Column) -> Column:
    """Struct url_score, url_probability of host and path. The model is broadcast: its size follows the different n-grams of its training URLs."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("url_score double, url_probability double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            s = [m.score(t) for t in texts]
            yield pd.DataFrame({"url_score": s, "url_probability": [m.probability(x) for x in s]}, dtype="float64")

    return score(text)


def fit(labelled: DataFrame, text: str, accepted: str, order: int = 4) -> UrlModel | None:
    """labelled: a string and a boolean column. All distinct strings are used, a fifth of them to calibrate.

    The n-grams are counted by Spark; the driver gets one row for each different n-gram, of ``order`` + 1 characters at most, and
    the number of held-out strings at each score (in thousandths). None if a class is empty.
    """
    rows = labelled.select(col(text).alias("s"), col(accepted).alias("a")).where("s is not null and a is not null").distinct()
    rows = materialize(rows.withColumn("held", F.pmod(F.xxhash64("s", F.lit(1)), F.lit(5)) == 0), "training")
    counts: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for a, g, n in rows.where("not held").select("a", F.explode(_grams(F.col("s"), order)).alias("g")).groupBy("a", "g").count().toLocalIterator():
        counts[a][g] = n
    if not counts[True] or not counts[False]:
        return None
    model = UrlModel(MarkovModel.fit(counts[True], order), MarkovModel.fit(counts[False], order))
    score = scored(rows.sparkSession, model, F.col("s"))["url_score"]
    held = rows.where("held").select("a", F.round(score, 3).alias("x")).groupBy("a", "x").count().collect()
    if len({a for a, _, _ in held}) == 2:
        y, x, n = (np.array(v, np.float64) for v in zip(*sorted(map(tuple, held)), strict=True))
        model.slope, model.offset = _logistic(x, y, n)
        if model.slope <= 0:  # too few held-out URLs to calibrate on
            model.slope, model.offset = 1.0, 0.0
    return model


def filter_urls(df: DataFrame, url: str, rules: list[Rule], model: UrlModel | None, least: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict, url_score and url_probability (clashing names get a leading underscore).

    The model is a broadcast: its size follows the different n-grams of its training URLs, not their number.
    """
    names = fresh(df, "host", "path", "rule", "verdict", "url_score", "url_probability")
    host, path, rule, verdict, score, chance = names
    out = df.withColumn(host, host_of(col(url))).withColumn(path, path_of(col(url)))
    pattern, ruled = rule_of(col(host), col(path), rules)
    out = out.withColumn(rule, pattern)
    if model is None:
        return out.withColumn(verdict, F.coalesce(ruled, F.lit("allow"))).withColumn(score, F.lit(None).cast("double")).withColumn(chance, F.lit(None).cast("double"))
    (made,) = fresh(out, "scored")
    out = out.withColumn(made, scored(df.sparkSession, model, F.concat(col(host), col(path))))
    own = F.when(col(made)["url_probability"] >= least, F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn(verdict, F.coalesce(ruled, own)).withColumn(score, col(made)["url_score"]).withColumn(chance, col(made)["url_probability"]).drop(made)
