"""Verification of outputs: leaks as typed spans, never their text; strict mode as a split of clean and rejected rows."""

from __future__ import annotations

import re
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.regexlib import find_all, translate
from palimpsest.operators import spans
from palimpsest.operators.anonymize import PLACEHOLDER
from palimpsest.operators.detectors import ALL, Detector
from palimpsest.operators.documents import whole_views
from palimpsest.types import LEAKS

KINDS = ("known-entity", "regex-hit", "invalid-utf8", "residual-placeholder-source", "document-entity", "unwritable-region")
REDACTED = r"\[[A-Z_]+_REDACTED\]"
_LEAK_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _leak(kind: str, type_: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), type_.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def safe_zones(output: Column) -> Column:
    """Spans of an output that are placeholders or redaction marks."""
    return F.concat(find_all(output, PLACEHOLDER), find_all(output, REDACTED), find_all(output, "█+"))


def regex_hits(output: Column, detectors: list[Detector] = ALL, validated: bool = False) -> Column:
    """Matches of any pattern outside safe zones; checks of the patterns are not applied unless asked for."""
    zones = safe_zones(output)
    hits = F.concat(*[(d if validated else replace(d, validate=None)).matches(output) for d in detectors])
    out = F.filter(hits, lambda x: ~F.exists(zones, lambda z: spans.overlaps(z, x)))
    return F.transform(out, lambda x: _leak("regex-hit", x["type"], x["start"], x["end"]))


def residual_placeholders(source: Column) -> Column:
    """Placeholders that stood in the source already."""
    return F.transform(find_all(source, PLACEHOLDER), lambda x: _leak("residual-placeholder-source", F.lit(""), x["start"], x["end"]))


@F.pandas_udf(_LEAK_TYPE)
def _known(outputs: pd.Series, surfaces: pd.Series) -> pd.Series:
    zone = re.compile(f"{PLACEHOLDER}|{REDACTED}|█+")

    def one(text, known):
        if not text or known is None or not len(known):
            return []
        by = {k["text"].lower(): k["type"] for k in known if k["text"] and k["text"].strip()}
        if not by:
            return []
        zones = [m.span() for m in zone.finditer(text)]
        pattern = "|".join(map(re.escape, sorted(by, key=lambda x: (-len(x), x))))
        out = []
        for m in re.finditer(rf"(?<![^\W_])(?:{pattern})(?![^\W_])", text, re.IGNORECASE):
            if not any(a < m.end() and m.start() < b for a, b in zones):
                out.append({"kind": "known-entity", "type": by.get(m.group().lower(), ""), "start": m.start(), "end": m.end()})
        return out

    return pd.Series([one(t, k) for t, k in zip(outputs, surfaces)])


def known_entities(output: Column, surfaces: Column) -> Column:
    """Known surfaces (array of text and type) that still stand in an output, whole words in any case, outside safe zones.

    The surfaces are those of the row itself, so nothing is joined. An alternation built for each row has no native form.
    """
    # marked so that the optimizer neither repeats it in an inferred filter nor moves it into a generator
    return _known.asNondeterministic()(output, surfaces)


def verify(df: DataFrame, source: str = "text", output: str = "anonymized", entities: str = "entities", validated: bool = False) -> DataFrame:
    """`df` with `leaks`, ordered by (start, kind). Entities must show their surfaces, as before anonymisation."""
    surfaces = F.transform(spans.or_empty(F.col(entities)), lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type")))
    bad_utf8 = F.when(F.is_valid_utf8(F.col(output)), F.expr(f"cast(array() as {LEAKS})")).otherwise(F.array(_leak("invalid-utf8", F.lit(""), F.lit(0), F.lit(0))))
    all_ = F.concat(known_entities(F.col(output), surfaces), regex_hits(F.col(output), validated=validated), bad_utf8, residual_placeholders(F.col(source)))
    ordinal = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    return df.withColumn("leaks", spans.sort_by(F.coalesce(all_, F.expr(f"cast(array() as {LEAKS})")), lambda x: x["start"], lambda x: F.element_at(ordinal, x["kind"])))


def strict(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): rejected rows lose their output, so that a leak never leaves the job."""
    bad = F.size("leaks") > 0
    return df.where(~bad), df.where(bad).drop("anonymized", "mapping", "original_to_placeholder")


def leaks_by_kind(df: DataFrame) -> DataFrame:
    return df.select(F.explode("leaks").alias("l")).groupBy(F.col("l.kind").alias("kind"), F.col("l.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def document_leaks(segments: DataFrame, document: str = "doc_id", number: str = "seg_no", output: str = "anonymized") -> DataFrame:
    """(document, kind, type, start, end, segments): hits that show only when a document's segments are joined by a blank.

    Segments of one document are joined in one row; a document is bounded by its own size. `segments` lists the segment
    numbers that a hit touches.
    """
    found = whole_views(segments, document, number, output)
    hits = found.select(document, "bounds", F.explode(regex_hits(F.col("view"))).alias("l"))
    touched = F.transform(F.filter("bounds", lambda b: spans.overlaps(b, F.col("l"))), lambda b: b["no"])
    return hits.select(document, F.lit("document-entity").alias("kind"), "l.type", "l.start", "l.end", touched.alias("segments")).where(F.size("segments") > 1)


def unwritable(regions: DataFrame, text: str = "text", writable: str = "writable") -> DataFrame:
    """Detections in regions that can be read but not rewritten, as leaks to report or to mark for redaction."""
    hits = F.transform(regex_hits(F.col(text)), lambda x: x.withField("kind", F.lit("unwritable-region")))
    return regions.where(~F.col(writable)).withColumn("leaks", hits)


PATTERNS = {d.type: translate(d.pattern) for d in ALL}
