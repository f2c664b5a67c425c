"""AES in batches of blocks against the published vectors and the JVM's."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import crypto


@pytest.mark.parametrize(
    ("key", "cipher"),
    [("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"), ("000102030405060708090a0b0c0d0e0f1011121314151617", "dda97ca4864cdfe06eaf70a0ec0d7191"), ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089")],
)
def test_published_vectors(key, cipher):
    assert crypto.aes_cbc_bytes(bytes.fromhex(key), bytes(16) + bytes.fromhex(cipher)).hex() == "00112233445566778899aabbccddeeff"


def test_against_the_jvm(spark):
    rows = [(bytearray(os.urandom(16)), bytearray(os.urandom(n))) for n in (0, 1, 15, 16, 17, 1000, 65_536)]
    df = spark.createDataFrame(rows, "k binary, d binary").select("k", "d", F.aes_encrypt("d", "k", F.lit("CBC"), F.lit("PKCS")).alias("e"))
    for k, d, e in df.collect():
        assert crypto.aes_cbc_bytes(bytes(k), bytes(e)) == bytes(d)


def test_broken_data():
    assert crypto.aes_cbc_bytes(b"k" * 16, b"x" * 31) == crypto.aes_cbc_bytes(b"k" * 5, b"x" * 32) == crypto.aes_cbc_bytes(b"k" * 16, b"") == b""
