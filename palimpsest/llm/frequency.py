"""Frequency of every distinct value or term (problem 5).

Vertical layout: each term owns a compressed bitmap of record identifiers, kept as its non-zero 64-bit words. A word is
`record >> 6`, its bits are set by `record & 63`; containers of 1,024 words (65,536 records) hold a stretch of a term's
words, so no container grows with the data. Words of the same term are merged by union (bitwise or), occurrence counters
beside them by sum, both already on the map side. The document frequency is the cardinality of the bitmap.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import table

#: Bits of a record identifier that select a bit in a word, and a word in a container.
WORD_BITS, CONTAINER_BITS = 6, 16
RARE_RECORDS, COMMON_RECORDS = 1, 5
#: White space as the term form sees it, non-breaking and typographic blanks included.
BLANKS = r"[\s\x1c-\x1f\x85   -     　]+"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def term_of(text: F.Column) -> F.Column:
    """NFC, lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(nfc(text)), BLANKS, " "))


def words(occurrences: DataFrame, keys: list[str], record: str, n: str) -> DataFrame:
    """(keys, word, bits, n): the non-zero words of each term's bitmap with the occurrences they stand for."""
    return (
        occurrences.withColumn("word", F.shiftright(record, WORD_BITS))
        .withColumn("bits", F.expr(f"shiftleft(1L, cast({record} & {(1 << WORD_BITS) - 1} as int))"))
        .groupBy(*keys, "word")
        .agg(F.bit_or("bits").alias("bits"), F.sum(n).alias("n"))
    )


def bitmaps(occurrences: DataFrame, keys: list[str], record: str, n: str) -> DataFrame:
    """(keys, container, bitmap, n): the index itself, one row per term and container of at most 1,024 words."""
    w = words(occurrences, keys, record, n).withColumn("container", F.shiftright("word", CONTAINER_BITS - WORD_BITS))
    return w.groupBy(*keys, "container").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"), F.sum("n").alias("n"))


def frequencies(occurrences: DataFrame, keys: list[str], record: str, n: str = "n") -> DataFrame:
    """(keys, occurrences, records): how often each term occurs and in how many distinct records.

    `record` is a non-null integer; `n` the number of occurrences a row stands for. Repeated rows count as further
    occurrences but not as further records. An empty input gives no rows.
    """
    return words(occurrences, keys, record, n).groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.sum(F.bit_count("bits")).cast("long").alias("records"))


def span_occurrences(synth_docs: DataFrame) -> DataFrame:
    """(label, term, doc_index, n) of all spans; a document delivered twice counts once.

    Spans without text, and documents without index, give nothing. A null label stays null.
    """
    spans = synth_docs.where("doc_index is not null").select("doc_index", F.explode("entities").alias("e")).select("doc_index", "e.label", "e.text", "e.start_off", "e.end_off")
    once = spans.where("text is not null").distinct()
    # the term is made once per distinct written form, so Python sees the vocabulary and not the occurrences
    counted = once.groupBy("doc_index", "label", "text").agg(F.count(F.lit(1)).alias("n"))
    forms = counted.select("text").distinct().select("text", term_of(F.col("text")).alias("term"))
    return counted.join(forms, "text").select("label", "term", "doc_index", "n")


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """(batch_no, label_counts) of the last run of each batch; of runs at the same time, the one with most documents."""
    order = F.struct(F.col("generated_at"), F.coalesce("doc_count", F.lit(-1)), F.coalesce("token_count", F.lit(-1)))
    return manifests.where("batch_no is not null").groupBy("batch_no").agg(F.max_by("label_counts", order).alias("label_counts"))


def manifest_occurrences(manifests: DataFrame) -> DataFrame:
    """(label, term, batch_no, n): term is the tag, label the tag without its scheme prefix."""
    tags = latest_manifests(manifests).select("batch_no", F.explode("label_counts").alias("term", "n"))
    return tags.select(F.regexp_replace("term", "^[A-Z]-", "").alias("label"), "term", "batch_no", F.coalesce("n", F.lit(0)).alias("n"))


def tables(synth_docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """(field_name, label, term, occurrences, records, total): both fields' frequencies with the number of all records."""
    spans = frequencies(span_occurrences(synth_docs), ["label", "term"], "doc_index")
    tags = frequencies(manifest_occurrences(manifests), ["label", "term"], "batch_no")
    docs = synth_docs.where("doc_index is not null").agg(F.count_distinct("doc_index").alias("total"))
    batches = manifests.where("batch_no is not null").agg(F.count_distinct("batch_no").alias("total"))
    # one-row totals: the only broadcast, of fixed size
    a = spans.join(F.broadcast(docs)).select(F.lit("span").alias("field_name"), "*")
    b = tags.join(F.broadcast(batches)).select(F.lit("manifest").alias("field_name"), "*")
    return a.unionByName(b)


def bands(freq: DataFrame) -> DataFrame:
    """`freq` with its band: 'rare' in exactly one record, 'common' in enough records, else null."""
    share = F.when(F.col("field_name") == "span", F.col("records") * 100 >= F.col("total") * 2).otherwise(F.col("records") * 2 >= F.col("total"))
    return freq.withColumn("band", F.when(F.col("records") == RARE_RECORDS, "rare").when((F.col("records") >= COMMON_RECORDS) & share, "common"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = bands(tables(table(spark, sf_dir, "synth_docs"), table(spark, sf_dir, "manifests")))
    return freq.where("band is not null").select("field_name", "label", "term", "band")


def p5_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term of either field, with its band."""
    freq = bands(tables(table(spark, sf_dir, "synth_docs"), table(spark, sf_dir, "manifests")))
    return freq.select("field_name", "label", "term", F.col("occurrences").cast("long").alias("occurrences"), "records", "band")


_SQL = r"""
with s as (select distinct doc_index, e.label as label, e.text as text, e.start_off as a, e.end_off as b
           from (select doc_index, unnest(entities) as e from synth_docs where doc_index is not null) where e.text is not null),
 f as (select label, trim(regexp_replace(lower(nfc_normalize(text)), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as term, doc_index from s),
 m as (select batch_no, max_by(label_counts, (generated_at, coalesce(doc_count, -1), coalesce(token_count, -1))) as lc from manifests where batch_no is not null group by batch_no),
 k as (select batch_no, unnest(map_entries(lc)) as kv from m),
 t as (select 'span' as field_name, label, term, count(*) as occurrences, count(distinct doc_index) as records,
              (select count(distinct doc_index) from synth_docs) as total from f group by label, term
       union all
       select 'manifest', regexp_replace(kv.key, '^[A-Z]-', ''), kv.key, sum(coalesce(kv.value, 0)), count(distinct batch_no),
              (select count(distinct batch_no) from manifests) from k group by kv.key),
 b as (select field_name, label, term, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records,
              case when records = 1 then 'rare'
                   when records >= 5 and case when field_name = 'span' then records * 100 >= total * 2 else records * 2 >= total end then 'common' end as band
       from t)
"""
SQL = {
    "p5_found": _SQL + "select field_name, label, term, band from b where band is not null",
    "p5_frequencies": _SQL + "select field_name, label, term, occurrences, records, band from b",
}

