"""Passes over finished outputs: what the first replacement missed of known names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.anonymize import PLACEHOLDER

_ZONE = re.compile(PLACEHOLDER)


def known_forms(mapping: dict[str, str]) -> list[tuple[str, str]]:
    """(surface, placeholder) of a mapping: whole surfaces, and capitalised words of persons' names of several words that no
    two persons share, the longest first."""
    forms = {v: k for k, v in mapping.items() if v and v.strip()}
    owners: dict[str, set[str]] = {}
    for mark, text in mapping.items():
        words = (text or "").split()
        if mark.startswith("⟦PERSON_") and len(words) > 1:
            for w in words:
                if w[:1].isupper() and len(w) > 1:
                    owners.setdefault(w, set()).add(mark)
    for w, marks in owners.items():
        if len(marks) == 1:
            forms.setdefault(w, next(iter(marks)))
    return sorted(forms.items(), key=lambda x: (-len(x[0].encode()), x[0]))


def consistent(text: str, mapping: dict[str, str]) -> str:
    """The output with remaining whole-word occurrences of known forms replaced, in any case, outside placeholders."""
    forms = known_forms(mapping)
    if not text or not forms:
        return text
    by = {s.lower(): p for s, p in reversed(forms)}
    pattern = re.compile(rf"{PLACEHOLDER}|(?<![^\W_])(?:{'|'.join(re.escape(s) for s, _ in forms)})(?![^\W_])", re.I)
    return pattern.sub(lambda m: m.group() if _ZONE.fullmatch(m.group()) else by.get(m.group().lower(), m.group()), text)


def complete_surnames(original: str, output: str, mapping: dict[str, str]) -> str:
    """The output with a name word that stands directly behind its person's placeholder taken into it."""
    for mark, text in mapping.items():
        if not mark.startswith("⟦PERSON_"):
            continue
        for m in re.finditer(re.escape(text) + r"[ \n\r]?([^\W\d_][\w'’\-]*)", original):
            word = m.group(1)
            if word[:1].isupper():
                output = output.replace(mark + word, mark)
    return output


def apply_passes(df: DataFrame, text: str = "text", output: str = "anonymized", mapping: str = "mapping", passes: tuple[str, ...] = ("consistency", "surname")) -> DataFrame:
    """`df` with the passes applied to its output. Each row uses its own mapping; an empty one leaves the output as it is."""

    @F.pandas_udf(T.StringType())
    def run(source: pd.Series, out: pd.Series, maps: pd.Series) -> pd.Series:
        def one(s, o, m):
            if o is None or m is None:
                return o
            m = dict(m)
            if "consistency" in passes:
                o = consistent(o, m)
            if "surname" in passes:
                o = complete_surnames(s or "", o, m)
            return o

        return pd.Series([one(*x) for x in zip(source, out, maps)])

    return df.withColumn(output, run(text, output, mapping)) if passes else df
