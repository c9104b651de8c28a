"""The catalogue of structured detectors, and detection as one projection.

Every pattern is searched on the whole text; matches that pass their check are accepted in the order of the catalogue, then
of their start, unless they overlap something accepted before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import checksums
from palimpsest.functions.regexlib import SPAN, find_all, translate
from palimpsest.operators import spans


@dataclass(frozen=True)
class Detector:
    """A pattern in the automaton dialect. If `outside` is set, the pattern has two groups: what precedes the span, the span.

    `needs` is a cheap expression, for Spark, that every text with a match holds: the others are not searched.
    """

    type: str
    pattern: str
    confidence: float = 1.0
    validate: Callable[[Column], Column] | None = None
    outside: bool = False
    needs: str = ""

    def matches(self, text: Column) -> Column:
        found = find_all(text, translate(self.pattern), "$2", "$1") if self.outside else find_all(text, translate(self.pattern))
        if self.needs:
            found = F.when(text.rlike(self.needs), found).otherwise(spans.empty(f"array<{SPAN}>"))
        if self.validate is not None:
            found = F.filter(found, lambda x: self.validate(x["text"]))
        return F.transform(found, lambda x: F.struct(x["text"].alias("text"), F.lit(self.type).alias("type"), x["start"].alias("start"), x["end"].alias("end"), F.lit(self.confidence).alias("confidence")))


# The patterns of the catalogue, in order of priority.
EMAIL = r"[\w.+\-]+@[\w\-]+(?:\.[a-zA-Z]{2,})+"
IPV6 = (
    r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,7}:"
    r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}"
    r"|:(?::[0-9a-fA-F]{1,4}){1,7}"
    r"|::"
)
IPV4 = r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)){3}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?:\p{Zs}?[A-Z0-9]{4}){2,7}(?:\p{Zs}?[A-Z0-9]{1,4})?\b"
SIRET = r"\b\d{3}\p{Zs}?\d{3}\p{Zs}?\d{3}\p{Zs}?\d{5}\b"
SIREN = r"\b\d{9}\b"
PHONE_PLUS = r"\+[1-9]\d{0,2}(?:[\p{Zs}.\-()\[\]]?\d){6,12}"
PHONE_LOCAL = r"\b0[1-9](?:[\p{Zs}.\-]?\d{2}){4}\b"
JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"
KEY_SK = r"\bsk-[a-zA-Z0-9_-]{20,}\b"
KEY_AKIA = r"\bAKIA[0-9A-Z]{16}\b"
KEY_GH = r"\b(?:ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{82})\b"
KEY_XOX = r"\bxox[baprs]-[0-9a-zA-Z-]{20,}\b"
KEY_PAY = r"\b(?:sk|rk)_(?:live|test)_[a-zA-Z0-9]{24,}\b"
BEARER = r"(?i)(Bearer\s+)([A-Za-z0-9_\-.+/=]{20,})"
SECRET_KV = r"(?im)(^(?:[a-zA-Z_]\w*)?(?:password|passphrase|passwd|pass|credential|cred|private|secret|token)\w*\s*[=:]\s*)(\S{4,})"
SIREN_IN_CONTEXT = r"(?i)(\b(?:SIREN|R\.?C\.?S\.?|SIRET)\b[\s:n°.-]*(?:[\p{Lu}][\p{L}'-]+\s+){0,2})(\d{9}\b)"

BUILTIN = [
    Detector("EMAIL", EMAIL, needs="@"),
    Detector("IPV6", IPV6, needs="::|[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"),
    Detector("IPV4", IPV4, needs=r"\d\.\d{1,3}\.\d"),
    Detector("IBAN", IBAN, validate=checksums.iban, needs=r"[A-Z]{2}\d{2}"),
    Detector("SIRET", SIRET, validate=checksums.siret, needs=r"\d{3}\p{Zs}?\d{3}\p{Zs}?\d{3}"),
    Detector("SIREN", SIREN, validate=checksums.siren, needs=r"\d{9}"),
    Detector("PHONE", PHONE_PLUS, needs=r"\+[1-9]"),
    Detector("PHONE", PHONE_LOCAL, needs="0[1-9]"),
]
SECRETS = [
    Detector("JWT", JWT, 0.99, needs="eyJ"),
    Detector("API_KEY", KEY_SK, 0.99, needs="sk-"),
    Detector("API_KEY", KEY_AKIA, 0.99, needs="AKIA"),
    Detector("API_KEY", KEY_GH, 0.99, needs="ghp_|github_pat_"),
    Detector("API_KEY", KEY_XOX, 0.99, needs="xox[baprs]-"),
    Detector("API_KEY", KEY_PAY, 0.99, needs="[sr]k_(?:live|test)_"),
    Detector("API_KEY", BEARER, 0.99, outside=True, needs="(?iu)bearer"),
    Detector("SECRET", SECRET_KV, 0.95, outside=True, needs="(?iu)pass|cred|private|secret|token"),
]
#: Opt-in: demands a word such as a register's name before the number.
CONTEXTUAL_SIREN = Detector("SIREN", SIREN_IN_CONTEXT, validate=checksums.siren, outside=True)
#: Opt-in: phone numbers with a bracketed area code, which the catalogue misses.
PHONE_BRACKETS = Detector("PHONE", r"\+[1-9]\d{0,2}[\p{Zs}]?\(\d{1,4}\)[\p{Zs}]?\d{3}[\p{Zs}.\-]?\d{4}\b")
ALL = [*BUILTIN, *SECRETS]


def detect(text: Column, detectors: list[Detector] = ALL, existing: Column | None = None) -> Column:
    """Entities of a text: the existing ones, which win, and the detectors' matches, ordered by start.

    A null text has no entities.
    """
    found = [d.matches(text) for d in detectors]
    candidates = F.coalesce(F.concat(*found), spans.empty()) if found else spans.empty()
    base = spans.empty() if existing is None else spans.or_empty(existing)
    return spans.by_start(spans.greedy(base, candidates))


def with_entities(df: DataFrame, col: str = "text", detectors: list[Detector] = ALL, out: str = "entities") -> DataFrame:
    return df.withColumn(out, detect(F.col(col), detectors))


def entity_rows(df: DataFrame, ids: list[str], col: str = "text", detectors: list[Detector] = ALL) -> DataFrame:
    """(ids, text, type, start, end, confidence): one row an entity."""
    return with_entities(df.select(*ids, col), col, detectors, "__e").select(*ids, F.inline("__e"))
