"""The whole way from text to verified output as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import anonymize as an
from palimpsest.operators import detectors as dt
from palimpsest.operators import filters as fl
from palimpsest.operators import passes as ps
from palimpsest.operators import spans
from palimpsest.operators import verify as vf


@dataclass
class Options:
    """All knobs of a run. `filters` are functions of (text, entities) to entities, in order."""

    strategy: str = "tag"
    detectors: list[dt.Detector] = field(default_factory=lambda: list(dt.ALL))
    types: list[str] | None = None
    min_confidence: float = 0.0
    max_tokens: int = 0
    preset: str | None = None
    first_names: list[str] = field(default_factory=list)
    stop_words: list[str] = field(default_factory=list)
    filters: list[Callable[[Column, Column], Column]] = field(default_factory=list)
    consistent: bool = True
    key: bytes | None = None
    scope: str = ""
    legacy: bool = False
    escape_collisions: bool = True
    expose_secrets: bool = False
    passes: tuple[str, ...] = ()
    verification: bool = True
    strict: bool = False
    block: int = 6
    replacers: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def run(df: DataFrame, options: Options = Options(), text: str = "text", ids: list[str] | None = None, existing: str | None = None) -> DataFrame:
    """`df` with `anonymized`, `mapping`, `entities` and, if asked for, `leaks`.

    `existing` names a column of entities found before (by a model, by another view), which win over the detectors. In
    strict mode rows with leaks lose their output. A source with a placeholder in it is escaped, or refused with `error`.
    """
    out = df
    if options.escape_collisions and not options.legacy:
        out = out.withColumn("__source", F.col(text)).withColumn(text, an.escape(F.col(text)))
    else:
        out = out.withColumn("__source", F.col(text)).withColumn("error", F.when(an.collision(F.col(text)).isNotNull(), "placeholder in source"))
    found = dt.detect(F.col(text), options.detectors, F.col(existing) if existing else None)
    first, stop = _array([n.lower() for n in options.first_names]), _array(options.stop_words)
    found = fl.preset(options.preset, F.col(text), found, first, stop)
    for f in options.filters:
        found = f(F.col(text), found)
    found = fl.max_tokens(fl.min_confidence(found, options.min_confidence), options.max_tokens)
    found = fl.only_types(found, _array(options.types or []))
    out = out.withColumn("entities", spans.by_start(found))
    mark = an.nonce(*[F.col(i) for i in ids]) if ids else an.nonce(F.col(text))
    out = an.anonymize(out, text, "entities", options.strategy, mark, options.consistent, options.key, options.scope, options.legacy, options.block, options.replacers or None, True)
    if options.passes:
        out = ps.apply_passes(out, text, passes=options.passes)
    if options.verification or options.strict:
        out = vf.verify(out, "__source")
        if options.strict:
            bad = F.size("leaks") > 0
            for c in ("anonymized", "mapping", "original_to_placeholder"):
                out = out.withColumn(c, F.when(~bad, F.col(c)))
    if not options.expose_secrets:
        out = out.withColumn("entities", F.transform("entities", lambda x: F.when(an.is_secret(x["type"]), x.withField("text", F.format_string("[redacted %d bytes]", F.octet_length(x["text"])))).otherwise(x)))
    return out.drop("__source")
