import base64
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import checksums as cs
from palimpsest.functions import crypto, regexlib
from palimpsest.functions import text as tx


def values(spark, rows, fn, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(fn(F.col("s"))).collect()]


def test_checksums(spark):
    assert values(spark, ["321456782", "321456783", "356000000", "602453193", "321 456 782", "", None, "abc"], cs.siren) == [True, False, True, True, True, False, False, False]
    assert values(spark, ["32145678200002", "321.456.782.00002", "32145678200003", "35600000000015", "35600000000014"], cs.siret) == [True, True, False, True, False]
    assert values(spark, ["FR76 3000 1007 9412 3456 7890 185", "fr7630001007941234567890185", "FR12321456782", "FR7630001007941234567890186", "ZZ00", None], cs.iban) == [True, True, False, False, False, False]
    body = "2690575116042"
    good = body + f"{97 - int(body) % 97:02d}"
    assert values(spark, [good, body + "00", "9" + good[1:], good[:3] + "13" + good[5:], None], cs.nir) == [True, False, False, False, False]


def test_generated_identifiers_are_valid(spark):
    df = spark.range(500).select(cs.siren(cs.siren_from(F.col("id") * 7919)).alias("a"), cs.siret(cs.siret_from(cs.siren_from(F.col("id")), F.col("id"))).alias("b"), cs.siren(cs.invalid_reference(F.col("id"))).alias("c"))
    assert [tuple(r) for r in df.distinct().collect()] == [(True, True, False)]


def test_hmac_and_index(spark):
    key = bytes(range(40))
    texts = ["Paul", "é ü", "", "  PAUL "]
    got = values(spark, texts, lambda c: crypto.hmac_sha256(key, c))
    assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    idx = values(spark, texts, lambda c: crypto.keyed_index(key, F.lit("PER"), c))
    want = [int(hmac.new(key, f"PER\0{t.strip().lower()}".encode(), hashlib.sha256).hexdigest()[:16], 16) % 999_999 + 1 for t in texts]
    assert idx == want and idx[0] == idx[3]


def test_keys():
    raw = bytes(range(32))
    for s in (raw.hex(), base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="), f" {raw.hex()} "):
        assert crypto.parse_key(s) == raw
    for bad in ("", "abcd", "zz" * 40 + "!", base64.b64encode(raw[:31]).decode()):
        with pytest.raises(crypto.KeyError_) as e:
            crypto.parse_key(bad)
        assert not bad or bad not in str(e.value)


def test_find_all_positions(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé b1.\n") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None]
    for pattern in (r"[ab]+", r"\d|\n", r"é.?"):
        got = values(spark, texts, lambda c: regexlib.find_all(c, pattern))
        for t, g in zip(texts, got):
            assert (g is None) == (t is None)
            if t is not None:
                assert [(x.text, x.start, x.end) for x in g] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, t)]


def test_dialect(spark):
    assert values(spark, ["é123456789", "a123456789", "x 123456789"], lambda c: c.rlike(regexlib.translate(r"\b\d{9}\b"))) == [True, False, True]
    assert values(spark, ["\rpass=1", "\npass=1"], lambda c: c.rlike(regexlib.translate(r"(?m)^pass"))) == [False, True]
    assert values(spark, ["ſecret", "SECRET"], lambda c: c.rlike(regexlib.translate(r"(?i)secret"))) == [True, True]


def test_words(spark):
    assert values(spark, ["Ab1-é", "XXl", ""], tx.shape) == ["Xxd-x", "XXx", ""]
    assert values(spark, ["Abcd12"], tx.short_shape) == ["Xxd"]
    assert values(spark, ["AB", "Ab", "12", ""], tx.is_all_upper) == [True, False, False, False]
    assert values(spark, ["mailto:x", "http://a/b", "http://a/?q", None], tx.uri_carries_data) == [True, False, True, False]
    assert values(spark, ["01010", "01"], tx.brown_prefixes) == [["0101"], []]
    assert values(spark, ["Avignon", "Lyon"], lambda c: tx.elide("de", c)) == ["d'Avignon", "de Lyon"]
    assert values(spark, ["Caisse de Lyon"], tx.acronym) == ["CL"]
