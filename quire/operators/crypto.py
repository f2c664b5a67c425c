"""Decryption of the standard security handler: RC4 in Arrow batches, MD5 and AES in the JVM."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Fixed value: the padding string of the standard security handler.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4_bytes(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    stream = bytearray(len(data))
    for k in range(len(data)):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        stream[k] = s[(s[i] + s[j]) & 255]
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(bytes(stream), np.uint8)).tobytes()


@F.pandas_udf(BinaryType())
def _rc4(key: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if k is None or d is None or not len(k) else rc4_bytes(bytes(k), bytes(d)) for k, d in zip(key, data, strict=True)], dtype=object)


def rc4(key: Column, data: Column) -> Column:
    return _rc4(key, data)


def aes_decrypt(key: Column, data: Column) -> Column:
    """CBC with the initial vector in front; null if the padding is wrong."""
    return F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, length: int = 5, encrypt_metadata: bool = True) -> bytes:
    """Revisions 2 to 4."""
    seed = (password + PAD)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    if revision >= 4 and not encrypt_metadata:
        seed += b"\xff" * 4
    key = hashlib.md5(seed).digest()
    if revision < 3:
        return key[:5]
    for _ in range(50):
        key = hashlib.md5(key[:length]).digest()
    return key[:length]


def user_value(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision < 3:
        return rc4_bytes(key, PAD)
    value = hashlib.md5(PAD + file_id).digest()
    for k in range(20):
        value = rc4_bytes(bytes(b ^ k for b in key), value)
    return value.ljust(32, b"\0")


def authenticate_user(password: bytes, owner: bytes, user: bytes, permissions: int, file_id: bytes, revision: int, length: int = 5) -> bytes | None:
    """The file's key, or null if the password is wrong."""
    key = file_key(password, owner, permissions, file_id, revision, length)
    n = 32 if revision < 3 else 16
    return key if user_value(key, file_id, revision)[:n] == user[:n] else None


def digest(data: Column, kind: str) -> Column:
    """Lower-case hex of md5, sha256, sha384 or sha512."""
    return F.md5(data) if kind == "md5" else F.sha2(data, int(kind[3:]))


def object_key(key: bytes, obj: int, gen: int, aes: bool) -> bytes:
    made = hashlib.md5(key + obj.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()
    return made[: min(len(key) + 5, 16)]


def security(entries: dict, file_id: bytes, password: bytes) -> tuple[str, bytes]:
    """(rc4, aes or none; the file's key) of an encryption dictionary; a wrong password or an unknown handler is an error."""
    version, revision = entries.get("V", 0), entries.get("R", 2)
    if entries.get("Filter") != "Standard" or version not in (1, 2, 4):
        raise ValueError("unknown security handler")
    method, bits = "rc4", entries.get("Length", 40) if version > 1 else 40
    if version == 4:
        filters = entries.get("CF", {}).get(entries.get("StmF", "Identity"), {})
        method, bits = {"AESV2": "aes", "V2": "rc4"}.get(filters.get("CFM", "None"), "none"), 128
    given = (entries["O"][:32], entries["U"], entries["P"], file_id, revision, max(5, min(16, bits // 8)))
    key = _opened(password, *given)
    if key is None:
        raise ValueError("wrong password")
    return method, key


@lru_cache(4096, typed=True)
def _opened(password: bytes, *given) -> bytes | None:
    """The key that a user's or owner's password gives; documents encrypted in one go have the same values."""
    return authenticate_user(password, *given) or authenticate_owner(password, *given)


def _owner_key(password: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    return key[: length if revision >= 3 else 5]


def owner_value(owner_password: bytes, user_password: bytes, revision: int, length: int = 5) -> bytes:
    key, value = _owner_key(owner_password, revision, length), (user_password + PAD)[:32]
    for k in range(20 if revision >= 3 else 1):
        value = rc4_bytes(bytes(b ^ k for b in key), value)
    return value


def authenticate_owner(password: bytes, owner: bytes, user: bytes, permissions: int, file_id: bytes, revision: int, length: int = 5) -> bytes | None:
    key, value = _owner_key(password, revision, length), owner
    for k in reversed(range(20 if revision >= 3 else 1)):
        value = rc4_bytes(bytes(b ^ k for b in key), value)
    return authenticate_user(value, owner, user, permissions, file_id, revision, length)


@lru_cache(maxsize=1)
def _aes_tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(S-box, its inverse, products with 9, 11, 13, 14), from the field's rule."""
    powers, x = [], 1
    for _ in range(255):  # 3 generates the field's 255 units
        powers.append(x)
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    logs = {v: k for k, v in enumerate(powers)}
    times = lambda a, b: powers[(logs[a] + logs[b]) % 255] if a and b else 0
    box = np.zeros(256, np.uint8)
    for v in range(256):
        b = powers[-logs[v] % 255] if v else 0
        box[v] = (b ^ (b << 1 | b >> 7) ^ (b << 2 | b >> 6) ^ (b << 3 | b >> 5) ^ (b << 4 | b >> 4) ^ 0x63) & 0xFF
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256, dtype=np.uint8)
    return box, inverse, [np.array([times(v, m) for v in range(256)], np.uint8) for m in (9, 11, 13, 14)]


def aes_cbc_bytes(key: bytes, data: bytes) -> bytes:
    """AES-CBC data with its vector first and PKCS padding, all blocks at once; for what must be opened while a document is parsed. Nothing comes of data that isn't whole blocks."""
    if len(data) < 32 or len(data) % 16 or len(key) not in (16, 24, 32):
        return b""
    box, inverse, (by9, by11, by13, by14) = _aes_tables()
    words, n, round_constant = [list(key[k : k + 4]) for k in range(0, len(key), 4)], len(key) // 4, 1
    rounds = n + 6
    for k in range(n, 4 * (rounds + 1)):
        w = list(words[-1])
        if k % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= round_constant
            round_constant = (round_constant << 1) ^ (0x11B if round_constant & 0x80 else 0)
        elif n > 6 and k % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[k - n], w, strict=True)])
    keys = np.array(words, np.uint8).reshape(rounds + 1, 16)
    whole = np.frombuffer(data, np.uint8).reshape(-1, 16)
    state = whole[1:] ^ keys[rounds]
    moved = [(4 * (c - r) + r) % 16 for c in range(4) for r in range(4)]  # rows turned back
    for k in range(rounds - 1, -1, -1):
        state = inverse[state[:, moved]] ^ keys[k]
        if k:
            a, b, c, d = (state.reshape(-1, 4, 4)[:, :, r] for r in range(4))
            columns = [by14[w] ^ by11[x] ^ by13[y] ^ by9[z] for w, x, y, z in ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))]
            state = np.stack(columns, axis=2).reshape(-1, 16)
    plain = (state ^ whole[:-1]).tobytes()
    return plain[: -plain[-1]] if 1 <= plain[-1] <= 16 else plain
