"""Language of a text by ranked character trigrams (out-of-place distance), among a list of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE = 300
CANDIDATES = ("fr", "en", "es")


def trigrams(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids, gram, n): trigrams of letters, words padded by a blank."""
    clean = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    rows = df.select(*ids, clean.alias("c")).where(F.length("c") >= 3)
    return rows.select(*ids, F.explode(F.transform(F.sequence(F.lit(1), F.length("c") - 2), lambda i: F.substring(F.col("c"), i, F.lit(3)))).alias("gram")).groupBy(*ids, "gram").agg(F.count(F.lit(1)).alias("n"))


def profiles(labelled: DataFrame, lang: str = "lang", text: str = "text", size: int = SIZE) -> DataFrame:
    """(lang, gram, rank): the most frequent trigrams of each language; `size` rows a language, so safe to broadcast."""
    counts = trigrams(labelled, [lang], text)
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select(F.col(lang).alias("lang"), "gram", "rank")


def detect(df: DataFrame, ids: list[str], profiles_: DataFrame, text: str = "text", size: int = SIZE, least: float = 0.02) -> DataFrame:
    """(ids, lang, confidence, reliable): the nearest profile; confidence is its lead over the second, reliable from `least` on.

    Texts without letters do not come out.
    """
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("n"), "gram"))
    own = trigrams(df, ids, text).withColumn("r", rank).where(F.col("r") <= size)
    table = profiles_.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "rank"))).alias("ranks"))
    langs = profiles_.select("lang").distinct().agg(F.array_sort(F.collect_list("lang")).alias("langs"))
    # the profile table has languages x size rows at most
    joined = own.join(F.broadcast(table), "gram", "left").join(F.broadcast(langs))
    each = joined.select(*ids, "r", "ranks", F.explode("langs").alias("lang"))
    dist = F.coalesce(F.abs(F.try_element_at("ranks", F.col("lang")) - F.col("r")), F.lit(size))
    total = each.groupBy(*ids, "lang").agg(F.avg(dist).alias("d"))
    best = total.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("d", "lang"))).alias("o"))
    lead = F.when(F.size("o") > 1, 1 - F.get("o", F.lit(0))["d"] / F.get("o", F.lit(1))["d"]).otherwise(F.lit(1.0))
    return best.select(*ids, F.get("o", F.lit(0))["lang"].alias("lang"), lead.alias("confidence")).withColumn("reliable", F.col("confidence") >= least)


def checked(detected: DataFrame, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """`detected` with `error` where the language is unreliable or no candidate."""
    return detected.withColumn("error", F.when(~F.col("reliable"), "language undetermined").when(~F.col("lang").isin(*candidates), F.concat(F.lit("unsupported language "), F.col("lang"))))
