"""Tag schemes of sequence labelling: parsing, conversion, repair, decoding to spans, projection of spans to tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tag_prefix(tag: Column) -> Column:
    return F.when(tag.rlike("^[BIES]-"), F.substring(tag, 1, 1)).otherwise(F.lit("O"))


def tag_type(tag: Column) -> Column:
    return F.when(tag.rlike("^[BIES]-"), F.substring(tag, 3, 100)).otherwise(F.lit(""))


def iob1_to_iob2(tags: DataFrame, by: list[str], order: str, tag: str = "tag") -> DataFrame:
    """An inside tag begins an entity if the tag before it is of another type."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(tag_type(F.lag(tag).over(w)), F.lit(""))
    return tags.withColumn(tag, F.when((tag_prefix(F.col(tag)) == "I") & (before != tag_type(F.col(tag))), F.concat(F.lit("B-"), tag_type(F.col(tag)))).otherwise(F.col(tag)))


def bio_to_bioes(tags: DataFrame, by: list[str], order: str, tag: str = "tag") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    after = F.lead(tag).over(w)
    goes_on = F.coalesce((tag_prefix(after) == "I") & (tag_type(after) == tag_type(F.col(tag))), F.lit(False))
    new = F.when(tag_prefix(F.col(tag)) == "B", F.when(goes_on, "B").otherwise("S")).when(tag_prefix(F.col(tag)) == "I", F.when(goes_on, "I").otherwise("E"))
    return tags.withColumn(tag, F.coalesce(F.concat(new, F.lit("-"), tag_type(F.col(tag))), F.col(tag)))


def bioes_to_bio(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(tag, "^S-", "B-"), "^E-", "I-")


def normalize_tags(tag: Column) -> Column:
    """Null, empty and unknown tags become O."""
    return F.when(tag.rlike(r"^[BIES]-.+"), tag).otherwise(F.lit("O"))


def repair(tags: Column) -> Column:
    """Ordered tags with every inside tag that follows nothing of its type made a beginning; repaired tags count."""

    def step(acc: Column, t: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("O"))
        orphan = (tag_prefix(t) == "I") & ((tag_prefix(last) == "O") | (tag_type(last) != tag_type(t)))
        return F.concat(acc, F.array(F.when(orphan, F.concat(F.lit("B-"), tag_type(t))).otherwise(t)))

    return F.aggregate(tags, F.expr("cast(array() as array<string>)"), step)


_STATE = "named_struct('out', cast(array() as array<struct<type:string,first:int,last:int,confidence:double>>))"


def decode(tokens: Column) -> Column:
    """array<struct<type, first, last, confidence>> of ordered tokens with `tag` and `confidence`, in either scheme.

    The confidence of several tokens is the running half mean (c + m) / 2 from the first on.
    """

    def step(acc: Column, x: Column) -> Column:
        out = acc["out"]
        last = F.try_element_at(out, F.lit(-1))
        p, t = tag_prefix(x["tag"]), tag_type(x["tag"])
        new = F.struct(t.alias("type"), x["i"].alias("first"), x["i"].alias("last"), x["confidence"].alias("confidence"))
        goes_on = p.isin("I", "E") & F.coalesce((last["last"] == x["i"] - 1) & (last["type"] == t), F.lit(False))
        grown = F.struct(t.alias("type"), last["first"].alias("first"), x["i"].alias("last"), ((last["confidence"] + x["confidence"]) / 2).alias("confidence"))
        return F.struct(F.when(p == "O", out).when(goes_on, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(new))).alias("out"))

    indexed = F.transform(tokens, lambda x, i: F.struct(x["tag"].alias("tag"), x["confidence"].cast("double").alias("confidence"), i.alias("i")))
    return F.aggregate(indexed, F.expr(_STATE), step, lambda a: a["out"])


def sentence_arrays(tokens: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """(by, toks): the tokens of each sentence in order, without repeated rows."""
    once = tokens.groupBy(*by, order).agg(F.min("word").alias("word"), F.min("tag").alias("tag"))
    return once.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "word", "tag"))).alias("toks"))


def project(tokens: Column, entities: Column, scheme: str = "BIO") -> Column:
    """Tags of tokens (start, end) from annotated spans: any overlap counts, the first token of a span begins it."""

    def tag_of(t: Column, i: Column) -> Column:
        hit = F.try_element_at(F.filter(entities, lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"])), F.lit(1))
        first = ~F.exists(F.slice(tokens, F.lit(1), i), lambda o: (hit["start"] < o["end"]) & (o["start"] < hit["end"]))
        last = ~F.exists(F.slice(tokens, i + 2, F.size(tokens)), lambda o: (hit["start"] < o["end"]) & (o["start"] < hit["end"]))
        bio = F.when(first, "B-").otherwise("I-")
        pre = bio if scheme == "BIO" else F.when(first & last, "S-").when(first, "B-").when(last, "E-").otherwise("I-")
        return F.when(hit.isNull(), "O").otherwise(F.concat(pre, hit["type"]))

    return F.transform(tokens, tag_of)


def violations(tags: DataFrame, by: list[str], order: str, tag: str = "tag", known: list[str] | None = None) -> DataFrame:
    """(by, order, kind): inside tags that follow nothing of their type, and types outside a known set."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.lag(tag).over(w), F.lit("O"))
    orphan = tag_prefix(F.col(tag)).isin("I", "E") & ((tag_prefix(before) == "O") | (tag_type(before) != tag_type(F.col(tag))))
    kind = F.when(orphan, "orphan")
    if known:
        kind = F.when((tag_type(F.col(tag)) != "") & ~tag_type(F.col(tag)).isin(*known), "unknown-type").otherwise(kind)
    return tags.withColumn("kind", kind).where("kind is not null").select(*by, order, "kind")
