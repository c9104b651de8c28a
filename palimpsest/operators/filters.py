"""Filters and passes over a row's entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.regexlib import find_all
from palimpsest.operators import spans
from palimpsest.types import ALL_TYPES


def words_in(text: Column) -> Column:
    """Number of blanks plus one in the trimmed text."""
    t = F.trim(text)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def min_confidence(entities: Column, least: Column | float) -> Column:
    return F.filter(entities, lambda e: e["confidence"] >= least)


def max_tokens(entities: Column, most: Column | int) -> Column:
    """Entities of at most so many words; a limit of zero or null keeps all."""
    m = most if isinstance(most, Column) else F.lit(most)
    return F.when(F.coalesce(m, F.lit(0)) <= 0, entities).otherwise(F.filter(entities, lambda e: words_in(e["text"]) <= m))


def min_runes(entities: Column, least: int) -> Column:
    return F.filter(entities, lambda e: F.length(F.trim(e["text"])) >= least)


def blocklist(entities: Column, type_: str, words: list[str]) -> Column:
    """Drop entities of a type whose every word, in lower case, is listed."""
    listed = F.array(*[F.lit(w.lower()) for w in words])
    parts = lambda e: F.split(F.lower(F.trim(e["text"])), r"\s+")
    return F.filter(entities, lambda e: ~((e["type"] == type_) & F.forall(parts(e), lambda w: F.array_contains(listed, w))))


def only_types(entities: Column, types: Column) -> Column:
    """Entities of the listed types; a null or empty list keeps all."""
    return F.when(F.coalesce(F.size(types), F.lit(0)) <= 0, entities).otherwise(F.filter(entities, lambda e: F.array_contains(types, e["type"])))


def skip_types(types: Column) -> Column:
    """The complement of a list of types: what is left to include."""
    return F.array_except(F.array(*[F.lit(t) for t in ALL_TYPES]), F.coalesce(types, F.expr("cast(array() as array<string>)")))


def reclassify(entities: Column, first_names: Column) -> Column:
    """Places of one word that are first names become persons."""
    is_name = lambda e: (e["type"] == "LOC") & ~F.trim(e["text"]).contains(" ") & F.array_contains(first_names, F.lower(F.trim(e["text"])))
    return F.transform(entities, lambda e: F.when(is_name(e), e.withField("type", F.lit("PER"))).otherwise(e))


NAME = r"\p{Lu}[\p{L}'’\-‐‑]*"


def detect_first_names(text: Column, entities: Column, first_names: Column, stop_words: Column | None = None) -> Column:
    """First names outside all entities, of three letters or more and no stop word, as persons."""
    found = F.filter(find_all(text, NAME), lambda x: (F.length(x["text"]) >= 3) & F.array_contains(first_names, F.lower(x["text"])))
    if stop_words is not None:
        found = F.filter(found, lambda x: ~F.array_contains(stop_words, F.lower(x["text"])))
    persons = F.transform(found, lambda x: F.struct(x["text"].alias("text"), F.lit("PER").alias("type"), x["start"].alias("start"), x["end"].alias("end"), F.lit(1.0).alias("confidence")))
    return spans.by_start(spans.greedy(spans.or_empty(entities), F.coalesce(persons, spans.empty())))


def complete_names(text: Column, entities: Column, first_names: Column, stop_words: Column) -> Column:
    """First names alone grow by the next name word: one separator at most, capital first, at least two letters, no stop word,
    not a word of a known place or organisation, touching no other entity."""
    places = F.flatten(F.transform(F.filter(entities, lambda e: e["type"].isin("LOC", "ORG")), lambda e: F.split(F.lower(e["text"]), r"\s+")))

    def grown(e: Column) -> Column:
        word = F.regexp_extract(F.substring(text, e["end"] + 1, F.length(text)), r"^[ \n\r]?(\p{Lu}[\p{L}'’\-‐‑]+)", 1)
        gap = F.when(F.substring(text, e["end"] + 1, 1).rlike(r"^[ \n\r]$"), 1).otherwise(0)
        end = e["end"] + gap + F.length(word)
        free = ~F.exists(entities, lambda o: (o["start"] != e["start"]) & (o["start"] <= end) & (e["end"] + gap <= o["end"]))
        alone = (e["type"] == "PER") & ~F.trim(e["text"]).contains(" ") & F.array_contains(first_names, F.lower(F.trim(e["text"])))
        fits = alone & (F.length(word) >= 2) & free & ~F.array_contains(stop_words, F.lower(word)) & ~F.array_contains(places, F.lower(word))
        return F.when(fits, e.withField("text", spans.placed(text, e["start"], end)).withField("end", end)).otherwise(e)

    return F.transform(entities, grown)


def preset(name: str | None, text: Column, entities: Column, first_names: Column, stop_words: Column) -> Column:
    """'balanced': reclassify, merge, complete; 'high-recall': those and first-name detection; None: nothing."""
    if name is None:
        return entities
    if name not in ("balanced", "high-recall"):
        raise ValueError(f"unknown preset {name!r}")
    out = spans.merge(reclassify(entities, first_names))
    if name == "high-recall":
        out = detect_first_names(text, out, first_names, stop_words)
    return complete_names(text, out, first_names, stop_words)
