"""Replacing entities: strategies, numbering, sessions, secrets, and the way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.crypto import fuzzy, keyed_hash, keyed_index, plain_hash
from palimpsest.functions.regexlib import find_all
from palimpsest.operators import spans
from palimpsest.types import BLOCK, CLOSE, LABELS, OPEN, PRIORITY, SECRET_TYPES

PLACEHOLDER = r"⟦[A-Za-z0-9_]{1,128}⟧"
LEGACY = r"\[[A-Z_]+_[0-9A-Za-z]+\]"
REDACT_BOUNDS = (1, 64)


def label(type_: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), type_), type_)


def priority(type_: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), type_), F.lit(0))


def is_secret(type_: Column) -> Column:
    return type_.isin(*SECRET_TYPES)


def nonce(*parts: Column, salt: str = "") -> Column:
    """Six hex digits that mark a call's or session's placeholders: derived from its identity, so a rerun gives the same."""
    return F.substring(F.sha2(F.encode(F.concat_ws("\0", *[p.cast("string") for p in parts], F.lit(salt)), "UTF-8"), 256), 1, 6)


def placeholder(type_: Column, index: Column, mark: Column, legacy: bool = False) -> Column:
    if legacy:
        return F.concat(F.lit("["), label(type_), F.lit("_"), index.cast("string"), F.lit("]"))
    return F.concat(F.lit(OPEN), label(type_), F.lit("_"), index.cast("string"), F.lit("_"), mark, F.lit(CLOSE))


def redacted(type_: Column, legacy: bool = False) -> Column:
    return F.concat(F.lit("["), type_, F.lit("_REDACTED]")) if legacy else F.concat(F.lit(OPEN), type_, F.lit("_REDACTED"), F.lit(CLOSE))


def escape(text: Column) -> Column:
    """Placeholder delimiters of a source text made harmless."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("[[")), F.lit(CLOSE), F.lit("]]"))


def collision(text: Column) -> Column:
    """Where the first thing that reads as a placeholder stands in a source text; null if nothing does."""
    return F.try_element_at(F.transform(find_all(text, PLACEHOLDER), lambda x: x["start"]), F.lit(1))


def numbered(entities: Column, consistent: bool = True) -> Column:
    """Entities in order of (priority descending, start), each with `key` and its `index` within its type.

    With `consistent`, the first entity of a normalised text owns it, whatever the types, and later ones share its index.
    Without, every occurrence takes an index and all occurrences of a text show the last one taken. Secrets take none.
    """
    plain = F.filter(spans.or_empty(entities), lambda e: ~is_secret(e["type"]))
    ordered = spans.sort_by(plain, lambda e: -priority(e["type"]), lambda e: e["start"])
    keys = F.transform(ordered, lambda e: fuzzy(e["text"]))
    if consistent:
        owners = F.filter(ordered, lambda e, i: F.array_position(keys, fuzzy(e["text"])) == i + 1)
        return F.transform(owners, lambda e, i: F.struct(fuzzy(e["text"]).alias("key"), e["text"].alias("text"), e["type"].alias("type"), F.size(F.filter(F.slice(owners, F.lit(1), i + 1), lambda o: o["type"] == e["type"])).alias("index")))
    each = F.transform(ordered, lambda e, i: F.struct(e["text"].alias("key"), e["text"].alias("text"), e["type"].alias("type"), F.size(F.filter(F.slice(ordered, F.lit(1), i + 1), lambda o: o["type"] == e["type"])).alias("index")))
    return F.filter(each, lambda x, i: ~F.exists(F.slice(each, i + 2, F.size(each)), lambda y: y["key"] == x["key"]))


def anonymize(
    df: DataFrame,
    text: str = "text",
    entities: str = "entities",
    strategy: str = "tag",
    mark: Column | None = None,
    consistent: bool = True,
    key: bytes | None = None,
    scope: str = "",
    legacy: bool = False,
    block: int = 6,
    replacers: dict[str, Callable[[Column, Column], Column]] | None = None,
    expose_secrets: bool = False,
) -> DataFrame:
    """`df` with `anonymized`, `mapping` (placeholder to original), `original_to_placeholder` and the shown `entities`.

    Strategies: 'tag' and 'consistent' number entities within their type; 'hash' shows a digest, keyed if a key is given;
    'redact' shows a block of fixed length and keeps no mapping; 'keyed' takes the index from a keyed hash, so it needs no
    state. Secrets are always redacted and never mapped. `replacers` map a type to an expression of (text, index). Rows are
    independent; a null text gives null, a text without entities itself.
    """
    if strategy not in ("tag", "consistent", "hash", "redact", "keyed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "keyed" and key is None:
        raise ValueError("the keyed strategy needs a key")
    if not REDACT_BOUNDS[0] <= block <= REDACT_BOUNDS[1]:
        raise ValueError(f"a block has {REDACT_BOUNDS[0]} to {REDACT_BOUNDS[1]} characters")
    mark = F.lit("000000") if mark is None else mark
    ents = spans.by_start(spans.or_empty(F.col(entities)))

    def shown(x: Column) -> Column:
        if strategy == "hash":
            digest = keyed_hash(key, scope, x["type"], x["text"]) if key else plain_hash(x["text"])
            out = F.concat(F.lit(OPEN), x["type"], F.lit("_"), digest, F.lit(CLOSE))
        elif strategy == "redact":
            out = F.lit(BLOCK * block)
        elif strategy == "keyed":
            out = placeholder(x["type"], keyed_index(key, x["type"], x["text"]), mark, legacy)
        else:
            out = placeholder(x["type"], x["index"], mark, legacy)
        for type_, fn in (replacers or {}).items():
            out = F.when(x["type"] == type_, fn(x["text"], x["index"])).otherwise(out)
        return out

    same = fuzzy if consistent else (lambda c: c)
    work = df.withColumn("__own", numbered(F.col(entities), consistent)).withColumn("__map", F.map_from_entries(F.transform("__own", lambda x: F.struct(x["key"], shown(x)))))
    if strategy == "hash" or (strategy == "keyed" and not consistent):
        # the digest depends on the occurrence's own surface, not on its owner's
        repl = lambda x: shown(F.struct(x["text"].alias("text"), x["type"].alias("type"), F.lit(0).alias("index")))
    else:
        repl = lambda x: F.try_element_at(F.col("__map"), same(x["text"]))
    full = lambda x: F.when(is_secret(x["type"]), redacted(x["type"], legacy)).otherwise(repl(x))
    plain = F.filter(ents, lambda x: ~is_secret(x["type"]))
    kept = F.filter(plain, lambda x: x["type"].isin(*(replacers or {"": 0}))) if strategy == "redact" else plain
    pairs = F.array_distinct(F.transform(kept, lambda x: F.struct(repl(x).alias("k"), F.when(F.lit(strategy == "hash"), x["text"]).otherwise(_owner_text(x, same)).alias("v"))))
    surfaces = F.array_distinct(F.transform(kept, lambda x: F.struct(x["text"].alias("k"), repl(x).alias("v"))))
    hidden = ents if expose_secrets else F.transform(ents, lambda x: F.when(is_secret(x["type"]), x.withField("text", F.format_string("[redacted %d bytes]", F.octet_length(x["text"])))).otherwise(x))
    return (
        work.withColumn("anonymized", spans.substitute(F.col(text), ents, full))
        .withColumn("mapping", F.map_from_entries(_last_by_key(pairs)))
        .withColumn("original_to_placeholder", F.map_from_entries(_last_by_key(surfaces)))
        .withColumn(entities, hidden)
        .drop("__own", "__map")
    )


def _owner_text(x: Column, same: Callable[[Column], Column]) -> Column:
    return F.element_at(F.filter(F.col("__own"), lambda o: o["key"] == same(x["text"])), 1)["text"]


def _last_by_key(pairs: Column) -> Column:
    """Pairs with the last value of each key, as maps take no key twice."""
    return F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))


def deanonymize(text: Column, mapping: Column) -> Column:
    """Placeholders replaced by their originals in one pass from left to right; unknown ones stay."""
    return spans.substitute(text, find_all(text, PLACEHOLDER), lambda x: F.coalesce(F.try_element_at(mapping, x["text"]), x["text"]))


def unresolved(text: Column) -> Column:
    """Placeholders left in a restored text, those of redacted secrets apart."""
    return F.filter(F.transform(find_all(text, PLACEHOLDER), lambda x: x["text"]), lambda p: ~p.endswith("_REDACTED" + CLOSE))


SEGMENTS_A_BUCKET = 4096


def number_session(entities: DataFrame, session: str, segment: str) -> DataFrame:
    """(session, key, type, index): numbering across the segments of a session.

    `entities` has session, an integer segment number, text, type, start. The first occurrence of a normalised text by
    (segment, priority descending, start) owns it; owners are numbered within their type in that order. Occurrences are
    combined before the shuffle, and owners are counted in buckets of segments, so that a session that holds a third of all
    rows is no hot group. Rows without session or segment are left out.
    """
    rows = entities.where(F.col(session).isNotNull() & F.col(segment).isNotNull() & ~is_secret(F.col("type")))
    order = F.struct(F.col(segment).alias("seg"), (-priority(F.col("type"))).alias("prio"), F.col("start").alias("start"))
    own = rows.groupBy(F.col(session).alias("session"), fuzzy(F.col("text")).alias("key")).agg(F.min(F.struct(order.alias("o"), F.col("type").alias("type"), F.col("text").alias("text"))).alias("m"))
    own = own.select("session", "key", "m.type", "m.text", "m.o", F.expr(f"m.o.seg div {SEGMENTS_A_BUCKET}").alias("bucket"))
    counts = own.groupBy("session", "type", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("session", "type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("session", "type", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("session", "type", "bucket").orderBy("o"))
    return own.withColumn("rank", rank).join(offsets, ["session", "type", "bucket"]).select("session", "key", "text", "type", (F.col("rank") + F.col("before")).cast("int").alias("index"))
