"""Quality by weak supervision.

Rules look at a text's measures and vote good (1), bad (-1) or abstain (0). How often each rule gives each vote for good
and for bad texts is estimated by expectation-maximisation over all texts, without labels; the rules are taken
to err independently. A text's posterior probability of being good replaces all-must-pass filtering.

The votes of n rules have at most 3^n patterns, so only pattern counts reach the driver and only a bounded table of posteriors is
joined back. Defined results: a null text is an empty one, with no words; all rules abstain on it and it fails the base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, long_texts, released

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")  # what str.split takes for space too
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_alpha", "n_distinct", "n_shouts")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeated(words: list[str]) -> tuple[int, int]:
    """(words within 3-word windows found twice or more, distinct words)."""
    ids: dict[str, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(code) < 4:
        return 0, len(ids)
    pair = code[:-2] * len(ids) + code[1:-1]
    if len(ids) > 2_000_000:  # the product of three would not fit
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair * len(ids) + code[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    if not same.any():
        return 0, len(ids)
    twice = np.zeros(len(triple), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(code), bool)
    for k in range(3):
        hit[k : k + len(triple)] |= twice
    return int(hit.sum()), len(ids)


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    words = words_of(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    again, distinct = repeated(words)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), again, len(lines),
        sum(map(str.isupper, words)), sum(map(str.isalpha, words)), distinct, text.count("!!"),
    )


def measures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds a struct column of MEASURES."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        released()
        for texts in parts:
            yield pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")

    return df.withColumn(name, measured.asNondeterministic()(col(text)))  # so that a filter on the result doesn't make Spark measure twice


@dataclass(frozen=True)
class Rule:
    """Votes by a ratio of two measures: bad where ``bad`` says so, good where ``good`` does (empty: never). Abstains with fewer than ``least`` words."""

    name: str
    over: str
    under: str
    good: str
    bad: str
    least: int = 20

    def vote(self, m: Column) -> Column:
        x = m[self.over] / F.greatest(m[self.under], F.lit(1))
        voted = F.when(self._test(x, self.bad), -1).when(self._test(x, self.good), 1).otherwise(0)
        return F.when(m["n_words"] < self.least, 0).otherwise(voted)

    @staticmethod
    def _test(x: Column, condition: str) -> Column:
        if not condition:
            return F.lit(False)
        sign, value = condition.split()
        return x < float(value) if sign == "<" else x > float(value)


#: Few rules can speak for a text; the others only against it, and abstain else.
RULES = (
    Rule("symbols", "n_symbols", "n_words", "< 0.01", "> 0.1"),
    Rule("letters", "n_alpha", "n_words", "> 0.7", "< 0.6"),
    Rule("repeats", "n_repeat_words", "n_words", "", "> 0.3"),
    Rule("lines", "n_dup_lines", "n_lines", "", "> 0.4"),
    Rule("capitals", "n_caps", "n_words", "", "> 0.3"),
    Rule("variety", "n_distinct", "n_words", "", "< 0.2"),
    Rule("length", "word_chars", "n_words", "", "> 12.0"),
    Rule("shouts", "n_shouts", "n_words", "", "> 0.1"),
)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how many texts have each.

    Returns (posterior probability of good of each pattern, accuracy of each rule where it votes). It starts from the share
    of good votes, so "good" stays what most rules call good.
    """
    n_rules = patterns.shape[1]
    ups, downs = (patterns > 0).sum(axis=1), (patterns < 0).sum(axis=1)
    posterior = (ups + 0.5) / (ups + downs + 1)
    posterior = np.where(downs > 0, posterior * 0.5, posterior)
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    table = np.zeros((2, n_rules, 3))
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            table[c] = np.einsum("p,prv->rv", weight, seen) + smooth
            table[c] /= table[c].sum(axis=1, keepdims=True)
        prior = (counts @ posterior + smooth) / (counts.sum() + 2 * smooth)
        logs = np.einsum("prv,crv->cp", seen, np.log(table))
        odds = np.log(prior) - np.log(1 - prior) + logs[1] - logs[0]
        after = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(after - posterior).max() < 1e-9
        posterior = after
        if done:
            break
    right = prior * table[1][:, 2] + (1 - prior) * table[0][:, 0]
    wrong = prior * table[1][:, 0] + (1 - prior) * table[0][:, 2]
    return posterior, right / (right + wrong)


def base_failed(m: Column, least_words: int = 50, most_repeat: int = 50) -> Column:
    return (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeat * m["n_words"])


def judge(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str, str]:
    """(docs with a struct of MEASURES, votes and ``quality`` added, the struct's name, the name of ``quality``).

    The texts are measured once for the counts and once for the result; nothing is shuffled but vote patterns.
    """
    long_texts(docs.sparkSession)
    made, votes, quality = fresh(docs, "measures", "votes", "quality")
    measured = measures(docs, text, made)
    voted = measured.withColumn(votes, F.concat_ws(",", *[r.vote(col(made)).cast("string") for r in rules]))
    rows = voted.groupBy(col(votes).alias("v")).count().orderBy("v").collect()  # 3 ** len(rules) at most
    known = {}
    if rows:
        patterns = np.array([[int(x) for x in r.v.split(",")] for r in rows])
        posterior, _ = estimate(patterns, np.array([r["count"] for r in rows], np.float64))
        known = {r.v: float(p) for r, p in zip(rows, posterior, strict=True)}
    table = docs.sparkSession.createDataFrame([(v, p) for v, p in known.items()], f"`{votes}` string, `{quality}` double")
    return voted.join(F.broadcast(table), votes, "left"), made, quality


def keep(docs: DataFrame, text: str, least: float = 0.5) -> DataFrame:
    """The documents that pass the base rules and are probably good; same columns."""
    judged, made, quality = judge(docs, text)
    return judged.where(~base_failed(col(made)) & (col(quality) >= least)).select(*[col(c) for c in docs.columns])
