"""Lines, tokens, sentences, n-grams and context of words, on rows or within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as tx
from palimpsest.functions.regexlib import find_all

#: Tokens: words of letters and digits, any other sign but white space alone. By apostrophe cut or hyphen cut.
SPLIT_APOSTROPHE = r"[\p{L}\p{Nd}][\p{L}\p{Nd}\-‐‑]*['’]?|[^\p{L}\p{Nd}\p{IsWhite_Space}]"
SPLIT_HYPHEN = r"[\p{L}\p{Nd}][\p{L}\p{Nd}'’]*|[^\p{L}\p{Nd}\p{IsWhite_Space}]"
BOUNDARY = (".", "!", "?", "…")


def pattern_for(lang: str) -> str:
    return SPLIT_APOSTROPHE if lang in ("fr", "es") else SPLIT_HYPHEN


def lines(df: DataFrame, ids: list[str], col: str = "text") -> DataFrame:
    """(ids, line_no, line, offset): lines that are not blank, with where they start in the text."""
    first = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<line:string,offset:int>>))")
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("line"), acc["at"].alias("offset")))).alias("out"))
    rows = df.select(*ids, F.posexplode(F.aggregate(F.split(F.col(col), "\n", -1), first, step, lambda a: a["out"])).alias("line_no", "l"))
    return rows.select(*ids, "line_no", "l.line", "l.offset").where(F.col("line").rlike(r"\S"))


def tokenize(text: Column, lang: str = "fr") -> Column:
    """array<struct<text, start, end, is_word>> of a text."""
    return F.transform(find_all(text, pattern_for(lang)), lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["text"].rlike(r"^[\p{L}\p{Nd}]").alias("is_word")))


def token_rows(df: DataFrame, ids: list[str], col: str = "text", lang: str = "fr", words_only: bool = False) -> DataFrame:
    """(ids, line_no, sent_no, tok_no, text, start, end, is_word): tokens in their lines and sentences.

    A sentence ends behind a token of BOUNDARY or with its line. Everything is found within the line's own row.
    """
    ls = lines(df, ids, col)
    toks = ls.select(*ids, "line_no", "offset", tokenize(F.col("line"), lang).alias("toks"))
    first = F.expr("named_struct('s', 0, 'out', cast(array() as array<struct<text:string,start:int,end:int,is_word:boolean,sent_no:int>>))")

    def step(acc: Column, x: Column) -> Column:
        row = F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["is_word"].alias("is_word"), acc["s"].alias("sent_no"))
        return F.struct((acc["s"] + F.when(x["text"].isin(*BOUNDARY), 1).otherwise(0)).alias("s"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = toks.select(*ids, "line_no", "offset", F.posexplode(F.aggregate("toks", first, step, lambda a: a["out"])).alias("tok_no", "t"))
    out = rows.select(*ids, "line_no", "t.sent_no", "tok_no", "t.text", (F.col("t.start") + F.col("offset")).alias("start"), (F.col("t.end") + F.col("offset")).alias("end"), "t.is_word")
    return out.where("is_word") if words_only else out


def ngrams(tokens: DataFrame, by: list[str], order: str, word: str = "text") -> DataFrame:
    """Bigrams of neighbouring words within `by`."""
    w = Window.partitionBy(*by).orderBy(order)
    return tokens.withColumn("second", F.lead(word).over(w)).where("second is not null").select(*by, F.col(word).alias("first"), "second")


def vocabulary(tokens: DataFrame, word: str = "text", min_count: int = 1, limit: int | None = None) -> DataFrame:
    """(word, n): counts in lower case, of at least min_count; with a limit, the most frequent, ties by word."""
    counts = tokens.groupBy(F.lower(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return counts if limit is None else counts.orderBy(F.desc("n"), "word").limit(limit)


def context(tokens: DataFrame, by: list[str], order: str, word: str = "word", reach: int = 2) -> DataFrame:
    """Words at each distance up to `reach`, with BOS and EOS beyond the ends, bigrams, position flags and title runs."""
    w = Window.partitionBy(*by).orderBy(order)
    out = tokens
    for k in range(1, reach + 1):
        out = out.withColumn(f"prev{k}", F.coalesce(F.lower(F.lag(word, k).over(w)), F.lit("BOS"))).withColumn(f"next{k}", F.coalesce(F.lower(F.lead(word, k).over(w)), F.lit("EOS")))
    rn = F.row_number().over(w)
    out = out.withColumn("position", F.when(rn == 1, "first").when(rn == 2, "second").when(F.lead(word).over(w).isNull(), "last").otherwise("inner"))
    out = out.withColumn("island", F.sum(F.when(tx.is_title(F.col(word)), 0).otherwise(1)).over(w))
    run = F.sum(F.when(tx.is_title(F.col(word)), 1).otherwise(0)).over(Window.partitionBy(*by, "island"))
    out = out.withColumn("title_run", F.when(tx.is_title(F.col(word)), F.when(run >= 5, "5+").otherwise(run.cast("string"))).otherwise("0"))
    return out.withColumn("bigram_left", F.concat_ws(" ", "prev1", F.lower(word))).withColumn("bigram_right", F.concat_ws(" ", F.lower(word), "next1")).drop("island")


def gazetteer_hits(tokens: DataFrame, terms: DataFrame, by: list[str], order: str, word: str = "word") -> DataFrame:
    """Tokens with the list that their word, or a run of two or three words from here on, stands in.

    `terms`: name, term (lower case), n. Spark chooses the join from the terms' size.
    """
    w = Window.partitionBy(*by).orderBy(order)
    one, two, three = F.lower(word), F.concat_ws(" ", F.lower(word), F.lower(F.lead(word, 1).over(w))), F.concat_ws(" ", F.lower(word), F.lower(F.lead(word, 1).over(w)), F.lower(F.lead(word, 2).over(w)))
    grams = tokens.withColumn("g", F.array(F.struct(F.lit(1).alias("len"), one.alias("term")), F.struct(F.lit(2).alias("len"), two.alias("term")), F.struct(F.lit(3).alias("len"), three.alias("term"))))
    flat = grams.select(*by, order, F.explode("g").alias("g")).select(*by, order, "g.len", "g.term")
    hits = flat.join(terms.select("name", "term", "n"), "term")
    grade = F.when(F.col("n") > 10000, "common").when(F.col("n") > 1000, "medium").when(F.col("n") == 1, "unique").otherwise("rare")
    return hits.select(*by, order, "len", "name", "term", grade.alias("grade"))
