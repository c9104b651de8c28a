"""Checksums of identifiers, and generators of valid and invalid ones, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}


def digits(s: Column) -> Column:
    """The identifier without blanks, points and hyphens."""
    return F.regexp_replace(s, r"[\s\p{Zs}.\-]", "")


def luhn(s: Column) -> Column:
    """True for a non-empty string of digits that passes Luhn's check; false for null."""
    return F.coalesce(s.rlike(r"^\d+$") & F.call_function("luhn_check", F.when(s.rlike(r"^\d+$"), s)), F.lit(False))


def siren(s: Column) -> Column:
    d = digits(s)
    return F.coalesce((F.length(d) == 9) & luhn(d), F.lit(False))


def digit_sum(d: Column) -> Column:
    return F.aggregate(F.filter(F.split(d, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + c.cast("int"))


def siret(s: Column) -> Column:
    """14 digits passing Luhn; establishments of the postal company have digits that sum to a multiple of five instead."""
    d = digits(s)
    sums = F.when(d.rlike(r"^\d+$"), digit_sum(d)) % 5 == 0
    return F.coalesce(d.rlike(r"^\d{14}$") & F.when(d.startswith("356000000"), sums).otherwise(luhn(d)), F.lit(False))


def mod97(d: Column) -> Column:
    """The remainder by 97 of a string of digits and capital letters, letters counting 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)
    return F.aggregate(F.filter(F.split(d, ""), lambda c: c != ""), F.lit(0), step)


def iban(s: Column) -> Column:
    """Country, check digits and length (where the country's is known; an unknown country is not rejected), remainder 1."""
    d = F.upper(F.regexp_replace(s, r"[\s\p{Zs}\-]", ""))
    table = F.create_map(*[x for k, v in IBAN_LENGTH.items() for x in (F.lit(k), F.lit(v))])
    want = F.try_element_at(table, F.substring(d, 1, 2))
    shaped = d.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$") & F.length(d).between(15, 34) & (want.isNull() | (want == F.length(d)))
    turned = F.concat(F.substring(d, 5, 30), F.substring(d, 1, 4))
    return F.coalesce(shaped & (F.when(shaped, mod97(turned)) == 1), F.lit(False))


def nir(s: Column) -> Column:
    """French social security number: sex, month and department in range, key 97 minus the remainder of the rest."""
    d = F.upper(digits(s))
    body = F.regexp_replace(F.regexp_replace(F.substring(d, 1, 13), "2A", "19"), "2B", "18")
    month = F.substring(d, 4, 2).try_cast("int")
    shaped = d.rlike(r"^[1-478]\d{4}(?:\d{2}|2[AB])\d{8}$")
    # 20 is an unknown month; 30 to 42 and from 50 on are births recorded abroad
    ok_month = month.between(1, 12) | (month == 20) | month.between(30, 42) | (month >= 50)
    key = F.lit(97) - body.try_cast("bigint") % 97
    return F.coalesce(shaped & ok_month & (F.substring(d, 6, 2) != "00") & (key == F.substring(d, 14, 2).try_cast("bigint")), F.lit(False))


def luhn_digit(body: Column) -> Column:
    """The digit that makes `body` pass Luhn's check when put behind it."""
    ds = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    doubled = F.transform(ds, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, c: a + c) % 10, F.lit(10)).cast("string")


def siren_from(number: Column) -> Column:
    """A valid nine-digit identifier made from a number."""
    body = F.lpad((F.pmod(number, F.lit(90_000_000)) + 10_000_000).cast("string"), 8, "0")
    return F.concat(body, luhn_digit(body))


def siret_from(siren_: Column, branch: Column) -> Column:
    body = F.concat(siren_, F.lpad(F.pmod(branch, F.lit(10_000)).cast("string"), 4, "0"))
    return F.concat(body, luhn_digit(body))


def iban_from(country: str, account: Column) -> Column:
    """A valid IBAN of a country for an account of the right number of characters."""
    key = F.lit(98) - mod97(F.concat(account, F.lit(country + "00")))
    return F.concat(F.lit(country), F.lpad(key.cast("string"), 2, "0"), account)


def invalid_reference(number: Column) -> Column:
    """Nine digits that no check accepts: the right check digit plus one."""
    body = F.lpad((F.pmod(number, F.lit(90_000_000)) + 10_000_000).cast("string"), 8, "0")
    return F.concat(body, ((luhn_digit(body).cast("int") + 1) % 10).cast("string"))
