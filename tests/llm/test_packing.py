"""Packing: ids equal the tokenizer's, nothing is lost, windows obey the limits, cuts are optimal."""

import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(packing.byte_bpe(PATH).encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\u00a0\u2003'sdt.,!?aZé漢١5|<>#") | st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_the_tokenizers(text):
    assert ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_long_words_and_special_strings():
    for text in ("ab" * 9000, "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n b", " <|endoftext|>", "<|endoftext|", "", " ", "a" + " b" * 3000):
        assert ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids
    assert json.load(open(PATH))["model"]["type"] == "BPE"


def cost(cuts, ends, penalties, total, size):
    fee, at, out = dict(zip(ends, penalties)), 0, 0.0
    for c in cuts:
        n = c - at
        assert 1 <= n <= size
        out += packing.WINDOW + (0 if n & (n - 1) == 0 else size - n) + (0 if c == total else fee.get(c, packing.INSIDE))
        at = c
    assert at == total
    return out


def least_cost(ends, penalties, total, size):
    """By trying every earlier boundary, one window back or two with a cut inside; the end may also be cut into powers of two."""
    fee, best = dict(zip(ends, penalties)), {0: 0.0}
    for at in range(size, total):  # where no boundary is near, a window ends anyway
        before = max((e for e in (0, *ends) if e < at), default=0)
        if at not in fee and (at - before) % size == 0 and min((e for e in (*ends, total) if e > before), default=total) > at:
            fee[at] = packing.INSIDE
    for j in sorted({*fee, total}):
        options = []
        for i, value in best.items():
            n = j - i
            for whole in (0, 1):
                left = n - whole * size
                if 1 <= left <= size:
                    amounts = [0 if left & (left - 1) == 0 else size - left]
                    if j == total:
                        amounts.append((packing.INSIDE + packing.WINDOW) * (left.bit_count() - 1))
                    options.append(value + min(amounts) + packing.WINDOW + whole * (packing.WINDOW + packing.INSIDE))
        best[j] = min(options) + fee.get(j, 0) * (j != total)
    return best[total]


def stream(rng):
    size, total = int(rng.choice([16, 64])), int(rng.integers(5, 600))
    ends = np.flatnonzero(rng.random(total - 1) < rng.choice([0.005, 0.05, 0.3])) + 1
    return size, total, ends, rng.integers(0, 3, len(ends))


def test_cuts_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(150):
        size, total, ends, penalties = stream(rng)
        got = packing.windows(ends, penalties, total, size)
        assert cost(got, ends.tolist(), penalties.tolist(), total, size) <= least_cost(ends.tolist(), penalties.tolist(), total, size) + 1e-9


def test_cuts_of_a_stream_in_segments_are_those_of_the_whole():
    rng, shared = np.random.default_rng(6), 0
    for _ in range(100):
        size, total, ends, penalties = stream(rng)
        whole = packing.windows(ends, penalties, total, size)
        cuts, at, upto = [], 0, 0
        while upto < total:
            upto = min(total, upto + int(rng.integers(1, 200)))
            some = (ends > at) & (ends < upto)
            new = packing.windows(ends[some] - at, penalties[some], upto - at, size, last=upto == total)
            shared += bool(new) and upto < total
            cuts += [at + c for c in new]
            at = cuts[-1] if cuts else 0
        assert cost(cuts, ends.tolist(), penalties.tolist(), total, size) == cost(whole, ends.tolist(), penalties.tolist(), total, size)
    assert shared > 50


@pytest.mark.parametrize("segment", [1 << 19, 700, 5000])
def test_every_id_is_in_one_piece(spark, sf_small, segment):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").limit(60)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x y. " * 3000), (None, "no id"), (5000, "twice"), (5000, "twice")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    pieces = packing.pack(rows, "doc_id", "text", PATH, segment=segment).collect()
    assert all(p.length * 4 == len(p.ids) and p.length > 0 for p in pieces)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, text in [(r.doc_id, r.text) for r in rows.collect() if r.doc_id != 5000]:
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts]).tolist()[:-1]]
        got = np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist()
        assert got == [*(REFERENCE.encode(text, add_special_tokens=False).ids if text else []), 0]
        assert {p.doc_tokens for p in parts} == {len(got)}
    assert sorted(p.start for p in by_doc[5000])[:2] == [0, 0] and sum(p.length for p in by_doc[5000]) == 2 * by_doc[5000][0].doc_tokens
    padding = tokens = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts]).tolist()[:-1]]
        n = sum(p.length for p in parts)
        assert n <= 1024
        tokens += n
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding < 0.01 * tokens


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, ids int"), "doc_id", "text", PATH).count() == 0


def test_names_that_clash_and_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "c. d."), (1, "c. d.")], "length long, text string")
    pieces = packing.pack(docs, "length", "text", PATH)
    assert pieces.columns == ["length", "start", "_length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = pieces.collect()
    assert sum(r._length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0) and sum(r.start == 0 for r in rows) == 5


def test_long_runs_without_spaces_are_encoded_word_by_word():
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    text = "\n".join(f"line{k}" for k in range(2000))
    assert bpe.encode(text) == bpe._ids(text) and "line7" in bpe._bare  # no word is long, only what lies between spaces
    for text in ("a " + "b" * 4001 + " c\nd", "x" * 4001, "y" * 4000 + "\n" + "z" * 4000):
        assert bpe.encode(text) == bpe._ids(text)
