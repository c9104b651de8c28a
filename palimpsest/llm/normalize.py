"""One form for equal-looking text (problem 2).

Texts are exploded to positioned code points, a broadcast table of decompositions, combining classes and look-alikes is
joined on the code point, combining marks are put in order of their class behind their base, and the strings are rebuilt
and recomposed. The table is bounded by the size of the Unicode database (a few thousand rows), never by the data.

The work is done once per distinct piece of text (a token, or a stretch without blanks of a longer text): canonical
ordering never crosses a blank, so a text's form is the join of the forms of its pieces.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm import canon
from palimpsest.session import checkpoint, table

#: Matched texts up to which they are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_ROWS = 200_000
MAPPING_SCHEMA = "cp string, parts array<struct<ch:string, ccc:int>>"


def mapping(spark: SparkSession) -> DataFrame:
    """The decomposition and look-alike table; its size is bounded by Unicode, so it is safe to broadcast."""
    return F.broadcast(spark.createDataFrame(canon.mapping_rows(), MAPPING_SCHEMA))


@F.pandas_udf(T.StringType())
def recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


def forms(texts: DataFrame, col: str) -> DataFrame:
    """(col, form) for each distinct non-null value of `col`.

    An empty text, or one of invisible characters only, has the empty form. Equal-looking values share a form; case and
    accents are kept. Values of basic printable characters are their own form but for their blanks and look-alikes.
    """
    spark = texts.sparkSession
    distinct = texts.select(F.col(col).alias("__t")).where("__t is not null").distinct()
    odd = F.col("__t").rlike(r"[^\x20-\x7e]")
    # plain ASCII needs no decomposition; everything else goes through its code points
    points = (
        distinct.where(odd)
        .select("__t", F.posexplode(F.split("__t", "")).alias("pos", "cp"))
        .where("cp <> ''")
        .join(mapping(spark), "cp", "left")
        .withColumn("parts", F.coalesce("parts", F.array(F.struct(F.col("cp").alias("ch"), F.lit(0).alias("ccc")))))
        .select("__t", "pos", F.posexplode_outer("parts").alias("sub", "part"))
        .select("__t", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("part.ch", F.lit("")).alias("ch"), F.coalesce("part.ccc", F.lit(0)).alias("ccc"))
    )
    by = Window.partitionBy("__t").orderBy("pos", "sub")
    # the base a mark belongs to: number of bases so far; invisible parts count as neither
    ordered = points.withColumn("base", F.sum(F.when((F.col("ccc") == 0) & (F.col("ch") != ""), 1).otherwise(0)).over(by))
    rebuilt = ordered.groupBy("__t").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ccc", "pos", "sub", "ch"))), lambda x: x["ch"]), "").alias("__f")
    )
    both = rebuilt.select("__t", recompose("__f").alias("__f")).unionByName(distinct.where(~odd).select("__t", F.col("__t").alias("__f")))
    return both.select(F.col("__t").alias(col), F.trim(F.regexp_replace("__f", " +", " ")).alias("form"))


def canonicalize(df: DataFrame, ids: list[str], col: str, out: str = "form") -> DataFrame:
    """`df`'s ids with the one form of its text column, any length of text.

    Rows with the same ids and text come out once. A null text has a null form, an empty one the empty form. Line breaks
    count as blanks. Other columns of `df` are left out, so that none can clash.
    """
    base = df.select(*ids, F.col(col).alias("__text")).distinct().withColumn("__row", F.xxhash64(*ids, "__text"))
    pieces = base.where("__text is not null").select("__row", *ids, "__text", F.posexplode(F.split("__text", r"[\x20\t\r\n]+")).alias("__pos", "__piece"))
    table_ = forms(pieces, "__piece").withColumnRenamed("form", "__form")
    rebuilt = (
        pieces.join(table_, "__piece")
        .groupBy("__row", *ids)
        .agg(F.array_sort(F.collect_list(F.struct("__pos", "__form"))).alias("__parts"))
        .select(*ids, F.trim(F.array_join(F.filter(F.transform("__parts", lambda x: x["__form"]), lambda x: x != ""), " ")).alias(out))
    )
    return rebuilt.unionByName(base.where("__text is null").select(*ids, F.lit(None).cast("string").alias(out)))


def gazetteer_terms(gazetteer: DataFrame) -> DataFrame:
    """(term_id, term): the line up to the first comma, semicolon or tab; comments and empty lines give no term."""
    term = F.trim(F.regexp_extract("line", r"^([^,;\t]*)", 1))
    return gazetteer.where("line is not null and not startswith(ltrim(line), '#')").select("term_id", term.alias("term")).where("term <> ''").distinct()


def lookalike_tokens(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(request_id, tok_no, term_id): tokens whose whole text looks the same as a term but differs in its characters.

    Repeated rows come out once. Null texts and nulls in the keys of a token: a null text matches nothing, null keys are
    kept as they are. Extra columns are ignored.
    """
    terms = gazetteer_terms(gazetteer)
    term_forms = terms.join(forms(terms, "term"), "term").where("form <> ''")
    words = forms(tokens, "text")
    # distinct texts against terms first: the many occurrences of a text are met only once matched
    hits = checkpoint(words.join(term_forms, "form").where("text <> term").select("text", "term_id").distinct())
    if hits.count() <= BROADCAST_ROWS:  # then tokens, most of which match nothing, are not moved at all
        hits = F.broadcast(hits)
    return tokens.select("request_id", "tok_no", "text").join(hits, "text").select("request_id", "tok_no", "term_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_tokens(table(spark, sf_dir, "tokens"), table(spark, sf_dir, "gazetteer"))


def p2_token_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct token text with its one form and how often it occurs."""
    tokens = table(spark, sf_dir, "tokens")
    counts = tokens.where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(forms(tokens, "text"), "text").select("text", "form", "n")


def p2_request_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every request's whole text."""
    return canonicalize(table(spark, sf_dir, "requests"), ["request_id"], "text")
