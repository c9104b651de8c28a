"""Readers of annotated corpora, word lists and vectors, as DataFrames of lines in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.tags import iob1_to_iob2


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, line): the lines of whole text files, numbered within their file."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n", -1)).alias("line_no", "line"))


def conll(lines: DataFrame, word_col: int = 0, tag_col: int = -1, separator: str = "\t") -> DataFrame:
    """(path, sent_id, pos, word, tag) of column files: blank lines end sentences, document marks are skipped, a missing tag is O.

    `lines`: path, line_no, line.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    mark = F.col("line").startswith("-DOCSTART-")
    stop = (F.trim("line") == "") | mark
    rows = lines.withColumn("sent", F.sum(F.when(stop, 1).otherwise(0)).over(w)).where(~stop)
    parts = F.split("line", separator.replace("|", r"\|"), -1)
    tag = F.when(F.size(parts) > 1, F.element_at(parts, tag_col) if tag_col < 0 else F.get(parts, F.lit(tag_col)))
    out = rows.select("path", "sent", "line_no", F.get(parts, F.lit(word_col)).alias("word"), F.coalesce(F.when(F.trim(tag) != "", F.trim(tag)), F.lit("O")).alias("tag"))
    dense = F.dense_rank().over(Window.partitionBy("path").orderBy("sent")) - 1
    return out.withColumn("sent_id", dense).withColumn("pos", F.row_number().over(Window.partitionBy("path", "sent").orderBy("line_no")) - 1).select("path", "sent_id", "pos", "word", "tag")


def wikiner(lines: DataFrame, word_col: int = 0, tag_col: int = -1) -> DataFrame:
    """(path, sent_id, pos, word, tag) of files with one sentence a line, tokens 'form|pos|tag'; inside tags that begin become
    beginnings. Blank lines and comments are skipped."""
    rows = lines.where("trim(line) <> '' and not startswith(line, '//')")
    toks = rows.select("path", F.col("line_no").alias("sent_id"), F.posexplode(F.split(F.trim("line"), " +")).alias("pos", "tok"))
    parts = F.split("tok", r"\|")
    tag = F.element_at(parts, tag_col) if tag_col < 0 else F.get(parts, F.lit(tag_col))
    out = toks.where(F.size(parts) >= 2).select("path", "sent_id", "pos", F.get(parts, F.lit(word_col)).alias("word"), tag.alias("tag"))
    return iob1_to_iob2(out, ["path", "sent_id"], "pos")


def word_lists(lines: DataFrame) -> DataFrame:
    """(name, term, n) of lines (name, line) of several lists: terms up to the first comma, semicolon or tab, in lower case,
    repeated ones counted."""
    rows = lines.where("not startswith(ltrim(line), '#')").select("name", F.lower(F.trim(F.regexp_extract("line", r"^([^,;\t]*)", 1))).alias("term")).where("term <> ''")
    return rows.groupBy("name", "term").agg(F.count(F.lit(1)).alias("n"))


def word_list(lines: DataFrame, name: str, least: int = 1) -> DataFrame:
    """(name, term, n) of one list, of terms that stand there at least so often."""
    return word_lists(lines.withColumn("name", F.lit(name))).where(F.col("n") >= least)


def to_conll(tokens: DataFrame, sentence: str, order: str, separator: str = "\t") -> DataFrame:
    """(path, line_no, line): tokens (word, tag) as lines of a column file, a blank line behind each sentence.

    Lines are numbered within their sentence's own stretch, so no order of the whole is made; a sentence has less than two to
    the twentieth lines.
    """
    sents = tokens.groupBy(sentence).agg(F.array_sort(F.collect_list(F.struct(order, "word", "tag"))).alias("t"))
    rows = sents.select(sentence, F.posexplode(F.concat(F.transform("t", lambda x: F.concat_ws(separator, x["word"], x["tag"])), F.array(F.lit("")))).alias("k", "line"))
    return rows.select(F.lit("").alias("path"), (F.col(sentence) * (1 << 20) + F.col("k")).alias("line_no"), "line")


def to_jsonl(docs: DataFrame, *columns: str) -> DataFrame:
    """(line): documents as JSON objects, one a line."""
    return docs.select(F.to_json(F.struct(*columns)).alias("line"))


def to_clusters(paths: DataFrame) -> DataFrame:
    """(line): words (word, path, n) as lines of a cluster file."""
    return paths.select(F.concat_ws("\t", "path", "word", F.col("n").cast("string")).alias("line"))


def clusters(lines: DataFrame) -> DataFrame:
    """(word, path): bit paths of words; the last line of a word counts."""
    parts = F.split(F.col("line"), r"\s+")
    rows = lines.where(F.size(parts) >= 2).select("line_no", F.get(parts, F.lit(0)).alias("bits"), F.lower(F.get(parts, F.lit(1))).alias("word"))
    return rows.groupBy("word").agg(F.max_by("bits", "line_no").alias("path"))


def vectors(lines: DataFrame) -> DataFrame:
    """(word, vec): a word and its numbers, separated by blanks; lines with fewer than two numbers are skipped."""
    parts = F.split(F.trim("line"), " +")
    return lines.where(F.size(parts) > 2).select(F.lower(F.get(parts, F.lit(0))).alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))


def weighted_list(lines: DataFrame) -> DataFrame:
    """(value, weight, attributes): generator lists, tab-separated, attributes as JSON; a missing weight is 1."""
    parts = F.split(F.col("line"), "\t", -1)
    rows = lines.where("trim(line) <> '' and not startswith(line, '#')")
    return rows.select(F.get(parts, F.lit(0)).alias("value"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("weight"), F.from_json(F.get(parts, F.lit(2)), "map<string,string>").alias("attributes"))


def tesseract(lines: DataFrame) -> DataFrame:
    """(path, page, line_id, x, y, width, height, confidence, word): recognised words of a TSV report, confidence from 0 to 1."""
    p = F.split(F.col("line"), "\t", -1)
    num = lambda k: F.get(p, F.lit(k)).try_cast("double")
    rows = lines.where((F.size(p) >= 12) & (F.get(p, F.lit(0)).try_cast("int") == 5))
    line_id = F.concat_ws("-", *[F.get(p, F.lit(k)) for k in (1, 2, 3, 4)])
    return rows.select("path", num(1).cast("int").alias("page"), line_id.alias("line_id"), num(6).alias("x"), num(7).alias("y"), num(8).alias("width"), num(9).alias("height"), (F.greatest(num(10), F.lit(0.0)) / 100).alias("confidence"), F.get(p, F.lit(11)).alias("word")).where("trim(word) <> ''")


def recognised_lines(words: DataFrame, least: float = 0.0) -> DataFrame:
    """(path, page, line_id, text, words): words of enough confidence joined by blanks from left to right, each with its span."""
    grouped = words.where(F.col("confidence") >= least).groupBy("path", "page", "line_id").agg(F.array_sort(F.collect_list(F.struct("x", "y", "width", "height", "word"))).alias("w"))
    first = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,x:double,y:double,width:double,height:double>>))")
    step = lambda a, v: F.struct((a["at"] + F.length(v["word"]) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(v["word"])).alias("end"), v["x"].alias("x"), v["y"].alias("y"), v["width"].alias("width"), v["height"].alias("height")))).alias("out"))
    return grouped.select("path", "page", "line_id", F.array_join(F.transform("w", lambda v: v["word"]), " ").alias("text"), F.aggregate("w", first, step, lambda a: a["out"]).alias("words"))


def boxes_of(lines: DataFrame, spans: DataFrame, keys: list[str], padding: float = 0.15) -> DataFrame:
    """Boxes to blacken: of each word that a span of its line touches, padded by a share of its height."""
    hit = lines.join(spans, keys).select(*keys, "start", "end", F.explode("words").alias("w")).where("w.start < end and start < w.end")
    pad = F.col("w.height") * padding
    return hit.select(*keys, (F.col("w.x") - pad).alias("x"), (F.col("w.y") - pad).alias("y"), (F.col("w.width") + 2 * pad).alias("width"), (F.col("w.height") + 2 * pad).alias("height"))
