"""Keyed hashes, keyed indexes and key parsing."""

from __future__ import annotations

import base64
import hashlib
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_RANGE = 999_999
MIN_KEY_BYTES = 32


class KeyError_(ValueError):
    """The key is missing, unreadable or too short."""


def parse_key(text: str) -> bytes:
    """A key of at least 32 bytes from hex or any common base64 form. The text is never part of an error message."""
    s = text.strip()
    if re.fullmatch(r"[0-9a-fA-F]+", s) and len(s) % 2 == 0:
        key = bytes.fromhex(s)
        if len(key) >= MIN_KEY_BYTES:
            return key
    body = s.rstrip("=")
    if re.fullmatch(r"[A-Za-z0-9+/]+|[A-Za-z0-9_\-]+", body) and len(body) % 4 != 1:
        key = base64.urlsafe_b64decode(body.replace("+", "-").replace("/", "_") + "=" * (-len(body) % 4))
        if len(key) >= MIN_KEY_BYTES:
            return key
    raise KeyError_(f"a key of at least {MIN_KEY_BYTES} bytes in hex or base64 is needed")


def key_from_env(name: str) -> bytes:
    if not os.environ.get(name):
        raise KeyError_(f"environment variable {name} holds no key")
    return parse_key(os.environ[name])


def _pads(key: bytes) -> tuple[str, str]:
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in hex, natively; only the derived pads reach the plan, not the key."""
    inner, outer = _pads(key)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256))), 256)


def keyed_hash(key: bytes, scope: str, type_: Column, text: Column) -> Column:
    """First 16 hex digits of the HMAC over scope, type and text, set apart by zero bytes."""
    return F.substring(hmac_sha256(key, F.concat(F.lit(scope + "\0"), type_, F.lit("\0"), text)), 1, 16)


def plain_hash(text: Column) -> Column:
    """First six hex digits of SHA-256: not secret, for comparison only."""
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 6)


def fuzzy(text: Column) -> Column:
    """The form under which occurrences count as the same: trimmed, lower case; final sigma and dotted I as elsewhere."""
    return F.replace(F.lower(F.translate(F.trim(text), "İ", "i")), F.lit("ς"), F.lit("σ"))


def keyed_index(key: bytes, type_: Column, text: Column) -> Column:
    """An index from 1 to 999,999 that depends on key, type and normalised text only, so needs no state."""
    hex_ = F.substring(hmac_sha256(key, F.concat(type_, F.lit("\0"), fuzzy(text))), 1, 16)
    return (F.pmod(F.conv(hex_, 16, 10).cast("decimal(20,0)"), F.lit(INDEX_RANGE)) + 1).cast("int")
