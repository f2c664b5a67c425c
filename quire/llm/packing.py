"""Packing of tokenised documents into sequences, in order, by dynamic programming.

Documents are put in order of their ids; within a range of that order their tokens form one stream. Window cuts
are chosen among document and sentence ends so that padding plus cut penalties is least: the best start of a window that
ends at a boundary is the least of a sliding range of earlier boundaries, kept in a monotone queue. One
cut inside a sentence is allowed for a penalty between two boundaries, so that a window can always be filled. A window is
padded to its full length unless its length is a power of two; the stream's last window may be cut into such lengths.

A stream is worked off in segments, so memory doesn't follow the length of a document or partition. A segment's end is no
cut: only windows that every best continuation shares are given out, the rest is carried on, so the cuts are those of the
whole stream.

Defined results: a null text is empty and has only the end token. Each id lies in exactly one piece. Strings that the
vocabulary lists as added tokens get those tokens' ids, as in the tokenizers library. Where ranges begin is sampled by
Spark's range sort, so sequence ids can differ between two runs over more than one partition. Repeated rows, and rows with equal or null ids, are packed one
after the other, each whole; all rows of one id are in one range. Result columns whose names the key column has get leading underscores.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import sys
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, col, fresh, kept, long_texts

_LONE = re.compile(r"\s(?:\s|\Z)")
SENTENCE, INSIDE, WINDOW = 1, 8, 4  # penalties of a cut at a sentence end and inside a sentence, and the fee of a window; in tokens of padding
PAIR = INSIDE + WINDOW  # what a whole window before the last one costs, its cut being inside a sentence


class ByteBpe:
    """The ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    The pattern of such a vocabulary always ends a piece before a single space or line feed between words, so
    text is split there and the ids of its words are remembered; other texts are encoded whole.
    """

    def __init__(self, json_path: str, most: int = 300_000):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks, self._added = self._vocabulary(json_path)
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        longest = sorted(self._added, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self._bare = Memo(self._word, most)
        self._spaced = Memo(lambda w: self._word(w, " "), most)
        self._feed = self._ids("\n")

    @staticmethod
    def _vocabulary(json_path: str) -> tuple[dict[bytes, int], dict[str, int]]:
        """(ids of byte strings, ids of added tokens)."""
        if json_path.endswith(".tiktoken"):
            with open(json_path, "rb") as f:
                return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        with open(json_path, encoding="utf-8") as f:
            data = json.load(f)
        if any(x[flag] for x in data["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what stands beside them aren't supported")
        added = {x["content"]: x["id"] for x in data["added_tokens"]}
        return {bytes(back[c] for c in token): n for token, n in data["model"]["vocab"].items() if token not in added}, added

    def _ids(self, text: str) -> bytes:
        return self._bytes(self.encoding.encode_ordinary(text))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str, space: str = "") -> bytes:
        if len(word) > 1 and word[-1] in ".,;:!?" and word[:-1].isalpha():  # a piece ends where letters do
            return (self._spaced if space else self._bare)[word[:-1]] + self._bare[word[-1]]
        return self._ids(space + word)

    def encode(self, text: str) -> bytes:
        if self._special and self._special.search(text):
            parts = self._special.split(text)
            return b"".join(self._bytes([self._added[x]]) if k % 2 else self._plain(x) for k, x in enumerate(parts) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _LONE.search(text):
            return self._ids(text)
        bare, spaced, lines = self._bare, self._spaced, []
        for line in text.split("\n"):
            words = line.split(" ")
            if len(line) > 4000 and max(map(len, words)) > 4000:  # too long to be remembered
                return self._ids(text)
            lines.append(bare[words[0]] + b"".join(map(spaced.__getitem__, words[1:])))
        return self._feed.join(lines)

    def sentence_ends(self) -> np.ndarray:
        """Of each id, whether a sentence may end with it."""
        tokens = [self.encoding.decode_single_token_bytes(k) for k in range(self.encoding.n_vocab)]
        return np.array([t.endswith((b".", b"!", b"?")) or b"\n" in t for t in tokens])


def byte_bpe(json_path: str) -> ByteBpe:
    """One a process: what a worker remembers serves its later tasks too, until another operator's begin."""
    return kept(("byte_bpe", json_path), lambda: ByteBpe(json_path))


def windows(ends: np.ndarray, penalties: np.ndarray, total: int, size: int, last: bool = True) -> list[int]:
    """Cuts of a stream, ascending ends of windows.

    ends: ascending boundaries below ``total``; penalties: of a cut there. If the stream ends at ``total``, so does the last
    window. If it goes on, the cuts are only those that the best cuts have however it does; there may be none yet.
    """
    known = np.concatenate(([0], ends, [total]))
    if (np.diff(known) > size).any():  # no boundary for a whole window: cut anyway
        filled = [np.arange(a + size, b, size) for a, b in zip(known[:-1], known[1:], strict=True) if b - a > size]
        extra = np.concatenate(filled)
        ends = np.concatenate((ends, extra))
        order = np.argsort(ends, kind="stable")
        ends, penalties = ends[order], np.concatenate((penalties, np.full(len(extra), INSIDE)))[order]
    at = np.concatenate(([0], ends)).astype(np.int64)
    to, start = _unpadded(at, total, size)
    place, fee = at.tolist(), [0, *(penalties + WINDOW).tolist()]
    # Per boundary: the least cost of windows up to it, that plus its place, and where the last window (or pair, then ~start) begins.
    cost, values, come = [0.0] * len(place), [0.0] * len(place), [0] * len(place)
    near, far, gone, seen, value = deque(), deque(), 0, 0, 0.0
    for j in range(1, len(place)):
        i, here = j - 1, place[j]
        while near and values[near[-1]] >= value:
            near.pop()
        near.append(i)
        least = here - size
        while place[near[0]] < least:
            near.popleft()
        while place[gone] < least:  # now more than one window away
            passed = values[gone]
            while far and values[far[-1]] >= passed:
                far.pop()
            far.append(gone)
            gone += 1
        first = near[0]
        best = values[first] - least
        if far:
            least -= size
            while far and place[far[0]] < least:
                far.popleft()
            if far and (passed := values[far[0]] - least + PAIR) < best:
                best, first = passed, ~far[0]
        while to[seen] == j:
            i = start[seen]
            if i < 0:
                if (passed := cost[~i] + PAIR) < best:
                    best, first = passed, i
            elif cost[i] < best:
                best, first = cost[i], i
            seen += 1
        cost[j] = best = best + fee[j]
        values[j] = value = best + here
        come[j] = first
    if last:
        j, cuts = _tail(place, cost, total, size)
    else:
        j, cuts = _common(place, come, total - 2 * size), []
    found = []
    while j:
        i = come[j]
        found.append(place[j])
        if i < 0:
            i = ~i
            found.append(place[i] + size)
        j = i
    return found[::-1] + cuts


def _unpadded(at: np.ndarray, total: int, size: int) -> tuple[list[int], list[int]]:
    """(end, start; ~start if a whole window comes before) of windows between boundaries whose length is a power of two below ``size``, by end; one more end closes the list."""
    index = np.full(total + 1, -1, np.int32)
    index[at] = np.arange(len(at))
    ends, starts = [], []
    for p in (1 << k for k in range(size.bit_length() - 1)):
        for n in (p, size + p):
            first = np.searchsorted(at, n)
            i = index[at[first:] - n]
            hit = np.flatnonzero(i >= 0)
            ends.append(hit + first)
            starts.append(i[hit] if n == p else ~i[hit])
    to = np.concatenate(ends)
    order = np.argsort(to, kind="stable")
    return [*to[order].tolist(), -1], np.concatenate(starts)[order].tolist()


def _tail(place: list[int], cost: list[float], total: int, size: int) -> tuple[int, list[int]]:
    """The boundary after which the stream's end is packed best, and the cuts from there: perhaps a whole window, then one padded window or several whose lengths are powers of two."""

    def padded(n: int) -> tuple[float, bool]:
        split = PAIR * (n.bit_count() - 1)
        return (split, True) if split <= size - n else (size - n, False)

    best = None
    for i in range(len(place) - 1, -1, -1):
        n = total - place[i]
        if n > 2 * size:
            break
        whole = n > size
        left = n - size if whole else n
        amount, split = padded(left)
        value = cost[i] + amount + (PAIR if whole else 0)
        if best is None or value < best[0]:
            best = (value, i, whole, split)
    _, i, whole, split = best
    at, cuts = place[i], []
    if whole:
        at += size
        cuts.append(at)
    if split:
        n = total - at
        for k in reversed(range(n.bit_length())):
            if n >> k & 1:
                at += 1 << k
                cuts.append(at)
    else:
        cuts.append(total)
    return i, cuts


def _common(place: list[int], come: list[int], least: int) -> int:
    """The last boundary that the best cuts up to each boundary from ``least`` on have in common."""
    open_ends = [-j for j in range(len(place)) if place[j] >= least]
    heapq.heapify(open_ends)
    while True:
        j = -heapq.heappop(open_ends)
        while open_ends and open_ends[0] == -j:
            heapq.heappop(open_ends)
        if not open_ends:
            return j
        heapq.heappush(open_ends, -max(come[j], ~come[j]))


def _packed(json_path: str, end_id: int, size: int, segment: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(json_path)
        may_end = np.append(bpe.sentence_ends(), [False] * 8)
        closing, sequence = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId() << 33
        # Of each document in hand: key, tokens before what is held, tokens in all, tokens held, whether its end is held
        keys, starts, wholes, sizes, closed, held = [], [], [], [], [], []
        amount, limit = 0, segment

        def flush(last: bool) -> pd.DataFrame | None:
            nonlocal sequence, keys, starts, wholes, sizes, closed, held, amount, limit
            stream = b"".join(held)
            held = [stream]
            ids = np.frombuffer(stream, "<u4")
            bounds = np.cumsum(sizes)
            whole = bounds[np.array(closed)]
            flag = may_end[np.minimum(ids, len(may_end) - 1)]
            flag[whole - 1] = True
            ends = np.flatnonzero(flag[:-1]) + 1
            closes = np.zeros(len(ids) + 1, bool)
            closes[whole] = True
            cuts = np.array(windows(ends, np.where(closes[ends], 0, SENTENCE), len(ids), size, last), np.int64)
            if not len(cuts):
                limit = 2 * amount
                return None
            upto = int(cuts[-1])
            edges = np.union1d(cuts, bounds[bounds < upto])  # ends of pieces
            begins = np.concatenate(([0], edges[:-1]))
            doc = np.searchsorted(bounds, begins, side="right")
            window = np.searchsorted(cuts, begins, side="right")
            first = np.concatenate(([0], bounds[:-1]))
            frame = pd.DataFrame({
                "key": pd.Series([keys[d] for d in doc], dtype=object),
                "start": begins - first[doc] + np.array(starts, np.int64)[doc],
                "length": edges - begins,
                "ids": [stream[4 * a : 4 * b] for a, b in zip(begins.tolist(), edges.tolist(), strict=True)],
                "doc_tokens": np.array(wholes, np.int64)[doc],
                "sequence_id": sequence + window,
                "offset": begins - np.concatenate(([0], cuts[:-1]))[window],
            })
            sequence += len(cuts)
            d = int(np.searchsorted(bounds, upto, side="right"))  # the first document that isn't given out whole
            gone = max(0, upto - int(first[d])) if d < len(bounds) else 0
            keys, starts, wholes, sizes, closed = (x[d:] for x in (keys, starts, wholes, sizes, closed))
            if gone:
                starts[0] += gone
                sizes[0] -= gone
            held, amount = [stream[4 * upto :]], len(ids) - upto
            limit = amount + max(segment, amount)
            return frame

        for part in parts:
            for key, text in zip(part["key"].tolist(), part["text"].tolist(), strict=True):
                coded = (bpe.encode(text) if text else b"") + closing
                whole = len(coded) // 4
                for at in range(0, whole, segment):
                    n = min(segment, whole - at)
                    if at and sizes:  # goes on with a very long document
                        sizes[-1] += n
                        closed[-1] = at + n == whole
                    else:
                        for x, value in ((keys, key), (starts, at), (wholes, whole), (sizes, n), (closed, at + n == whole)):
                            x.append(value)
                    held.append(coded[4 * at : 4 * (at + n)])
                    amount += n
                    if amount >= limit and (frame := flush(False)) is not None:
                        yield frame
        if amount:
            yield flush(True)

    return run


def pack(docs: DataFrame, doc_id: str, text: str, json_path: str, end_id: int = 0, size: int = 1024, segment: int = 1 << 19) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids: little-endian unsigned 32-bit.

    One shuffle: a range sort by doc_id, with a hash of the text among equal ids.
    """
    long_texts(docs.sparkSession)
    rows = docs.select(col(doc_id).alias("key"), col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.repartitionByRange("key").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("key", "tie").select("key", "text")
    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    made = ordered.mapInPandas(_packed(json_path, end_id, size, segment), schema)
    names = fresh(made.select(F.col("key").alias(doc_id)), *made.columns[1:])
    return made.select(F.col("key").alias(doc_id), *[F.col(c).alias(n) for c, n in zip(made.columns[1:], names, strict=True)])
