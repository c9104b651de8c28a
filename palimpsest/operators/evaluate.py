"""Quality of detection and statistics of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVALUATED = ("PER", "LOC", "ORG", "MISC")


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(b * p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    p = F.when(F.col("predicted") > 0, F.col("matched") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("gold") > 0, F.col("matched") / F.col("gold")).otherwise(F.lit(0.0))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1)).withColumn("f2", f_beta(F.col("precision"), F.col("recall"), 2))


def scores(gold: DataFrame, predicted: DataFrame, ids: list[str]) -> DataFrame:
    """(type, gold, predicted, matched, precision, recall, f1, f2) by type and, as 'ALL', for all predictions.

    A match has the same ids, type, start and end. Only the evaluated types can match; all predictions count in the total.
    """
    key = [*ids, "type", "start", "end"]
    g = gold.select(*key).distinct().where(F.col("type").isin(*EVALUATED)).withColumn("g", F.lit(1))
    p = predicted.select(*key).distinct().withColumn("p", F.lit(1))
    both = g.join(p, key, "full").select("type", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    counts = both.groupBy("type").agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum(F.col("g") * F.col("p")).alias("matched"))
    total = counts.agg(F.lit("ALL").alias("type"), F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"), F.sum("matched").alias("matched"))
    return _rates(counts.unionByName(total))


def entropy(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, distinct_values, mean_words, entropy): Shannon entropy in bits of a label's values, counted in two levels."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(label).alias("label"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    words = F.size(F.split(F.trim(F.col("value")), r"\s+"))
    total = counts.groupBy("label").agg(F.sum("n").alias("total"))
    joined = counts.join(total, "label")
    p = F.col("n") / F.col("total")
    return joined.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_values"), (F.sum(F.col("n") * words) / F.sum("n")).alias("mean_words"), (-F.sum(p * F.log2(p))).alias("entropy"))


def duplicate_rate(df: DataFrame, col: str) -> DataFrame:
    """(rows, distinct_rows, rate): the share of rows that repeat an earlier one."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum(F.col("n") - 1) / F.sum("n")).alias("rate"))


def span_violations(docs: DataFrame, doc: str = "doc_index", entities: str = "entities") -> DataFrame:
    """(doc, kind, n): degenerate, overlapping, blank-edged and unlabelled spans of annotated documents."""
    e = F.col(entities)
    sorted_ = F.array_sort(F.transform(e, lambda x: F.struct(x["start_off"].alias("a"), x["end_off"].alias("b"))))
    kinds = {
        "degenerate": F.size(F.filter(e, lambda x: x["end_off"] <= x["start_off"])),
        "overlap": F.size(F.filter(sorted_, lambda x, i: F.exists(F.slice(sorted_, F.lit(1), i), lambda y: y["b"] > x["a"]))),
        "blank-edge": F.size(F.filter(e, lambda x: x["text"].rlike(r"^\s|\s$"))),
        "unlabelled": F.size(F.filter(e, lambda x: x["label"].isNull() | (x["label"] == ""))),
    }
    rows = docs.where(e.isNotNull()).select(doc, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in kinds.items()])).alias("v"))
    return rows.select(doc, "v.kind", "v.n").where("n > 0")


def split_without_leak(df: DataFrame, text: str, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """`df` without repeated texts and with `split` train, dev or test by the text's hash: a text is in one split only."""
    u = F.pmod(F.xxhash64(text), F.lit(10_000)) / 10_000
    return df.dropDuplicates([text]).withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "dev").otherwise("test"))


def contaminated(evaluation: DataFrame, training: DataFrame, text: str) -> DataFrame:
    """Evaluation rows whose normalised text stands in training."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return evaluation.withColumn("__k", norm).join(training.select(norm.alias("__k")).distinct(), "__k", "left_semi").drop("__k")
