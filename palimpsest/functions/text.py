"""Scalar functions over words: shapes, cases, affixes, elision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def shape(w: Column) -> Column:
    """Upper-case letters as X, lower-case ones as x, digits as d; anything else stays."""
    d = F.regexp_replace(w, r"\p{Nd}", "")
    u = F.regexp_replace(d, r"\p{Lu}", "")
    low = F.regexp_replace(u, r"\p{Ll}", "x")
    return F.replace(F.replace(low, F.lit(""), F.lit("X")), F.lit(""), F.lit("d"))


def short_shape(w: Column) -> Column:
    """The shape with runs of the same sign taken together."""
    return F.regexp_replace(shape(w), r"(.)\1+", "$1")


def suffix(w: Column, n: int) -> Column:
    """The last n characters; the whole word if it is shorter."""
    return F.right(w, F.lit(n))


def prefix(w: Column, n: int) -> Column:
    return F.left(w, F.lit(n))


def is_all_upper(w: Column) -> Column:
    """At least one letter, and every letter upper case."""
    return w.rlike(r"\p{L}") & ~w.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_title(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}")


def is_digits(w: Column) -> Column:
    return w.rlike(r"^\p{Nd}+$")


def has_hyphen(w: Column) -> Column:
    return w.contains("-")


def has_apostrophe(w: Column) -> Column:
    return w.rlike("['’]")


def has_digit(w: Column) -> Column:
    return w.rlike(r"\p{Nd}")


def caps_ratio(w: Column) -> Column:
    """Share of upper-case characters; zero for an empty word."""
    n = F.length(w)
    return F.when(n > 0, F.length(F.regexp_replace(w, r"[^\p{Lu}]", "")) / n).otherwise(F.lit(0.0))


def length_bucket(w: Column) -> Column:
    n = F.length(w)
    return F.when(n <= 2, "short").when(n <= 5, "medium").otherwise("long")


def strip_accents(s: Column) -> Column:
    return F.translate(s, ACCENTED, UNACCENTED)


def acronym(s: Column) -> Column:
    """First letters of the capitalised words."""
    return F.array_join(F.transform(F.filter(F.split(s, r"[\s\-]+"), lambda x: x.rlike(r"^\p{Lu}")), lambda x: F.left(x, F.lit(1))), "")


def elide(article: str, s: Column) -> Column:
    """French elision: 'de' and 'le' lose their vowel before a vowel or a mute h."""
    short = {"de": "d'", "le": "l'", "la": "l'", "que": "qu'"}.get(article, article + " ")
    return F.when(strip_accents(F.lower(F.left(s, F.lit(1)))).isin(*"aeiouyh"), F.concat(F.lit(short), s)).otherwise(F.concat(F.lit(article + " "), s))


def brown_prefixes(path: Column) -> Column:
    """Prefixes of a cluster's bit path at 4, 6, 10 and 20 bits, those that it is long enough for."""
    return F.filter(F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in (4, 6, 10, 20)]), lambda x: x.isNotNull())


def name_runs(s: Column) -> Column:
    """Stretches of letters, apostrophes and hyphens: what can be part of a name."""
    return F.regexp_extract_all(s, F.lit(r"([\p{L}'’\-‐‑]+)"), F.lit(1))


def uri_carries_data(uri: Column) -> Column:
    """True for mail addresses and for URIs with a query, a parameter or an address in them."""
    return F.coalesce(uri.startswith("mailto:") | uri.rlike(r"[?=@]"), F.lit(False))
