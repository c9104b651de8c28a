"""Documents of several segments: samples, joined views, projection of what a view finds back to its segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import detectors as dt
from palimpsest.operators import spans

HYPHENATED = r"\p{L}-$"


def sample_text(segments: DataFrame, doc: str, number: str, text: str = "text", limit: int = 4000) -> DataFrame:
    """(doc, sample): segments joined by line breaks until `limit` bytes are reached; for telling a document's language."""
    before = F.coalesce(F.sum(F.octet_length(text) + 1).over(Window.partitionBy(doc).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = segments.where(F.col(text).isNotNull()).withColumn("__b", before).where(F.col("__b") < limit)
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, text))), lambda x: x[text]), "\n").alias("sample"))


def joined_pair(left: Column, right: Column) -> Column:
    """Two segments as running text: a word cut by a hyphen at the end of the first is put together."""
    cut = left.rlike(HYPHENATED) & right.rlike(r"^\p{Ll}")
    return F.when(cut, F.concat(F.regexp_replace(left, "-$", ""), right)).otherwise(F.concat(left, F.lit(" "), right))


def pair_views(segments: DataFrame, doc: str, number: str, text: str = "text") -> DataFrame:
    """(doc, number, next_number, view, cut, first_length): each segment with the one behind it."""
    w = Window.partitionBy(doc).orderBy(number)
    rows = segments.withColumn("next_number", F.lead(number).over(w)).withColumn("next_text", F.lead(text).over(w)).where("next_text is not null")
    cut = F.col(text).rlike(HYPHENATED) & F.col("next_text").rlike(r"^\p{Ll}")
    return rows.select(doc, number, "next_number", joined_pair(F.col(text), F.col("next_text")).alias("view"), cut.alias("cut"), F.length(text).alias("first_length"))


def whole_views(segments: DataFrame, doc: str, number: str, text: str = "text") -> DataFrame:
    """(doc, view, bounds): all segments of a document joined by blanks, with the number, start and end of each.

    A document is bounded by its own size; a null segment counts as empty.
    """
    joined = segments.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(number).cast("bigint").alias("no"), F.coalesce(text, F.lit("")).alias("t")))).alias("s"))
    first = F.expr("named_struct('at', 0, 'b', cast(array() as array<struct<no:bigint,start:int,end:int>>))")

    def bound(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["t"])
        return F.struct((end + 1).alias("at"), F.concat(acc["b"], F.array(F.struct(x["no"].alias("no"), acc["at"].alias("start"), end.alias("end")))).alias("b"))

    return joined.select(doc, F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("view"), F.aggregate("s", first, bound, lambda a: a["b"]).alias("bounds"))


def detect_in_views(segments: DataFrame, doc: str, number: str, text: str = "text", detectors: list[dt.Detector] = dt.ALL) -> DataFrame:
    """`segments` with entities found in the segment or in a view of it with a neighbour, reconciled: recall can only grow.

    What a pair finds across the border is cut at it, and each part goes to its segment.
    """
    single = dt.with_entities(segments, text, detectors, "entities")
    pairs = pair_views(segments, doc, number, text)
    found = pairs.select(doc, number, "next_number", "cut", "first_length", F.explode(dt.detect(F.col("view"), detectors)).alias("e"))
    # where the second segment starts in the view, and how the first one's positions stand
    gap = F.when(F.col("cut"), F.col("first_length") - 1).otherwise(F.col("first_length") + 1)
    first_end = F.when(F.col("cut"), F.col("first_length") - 1).otherwise(F.col("first_length"))
    across = found.where((F.col("e.start") < first_end) & (F.col("e.end") > gap))
    a = across.select(doc, F.col(number), F.col("e.type").alias("type"), F.col("e.start").alias("start"), F.col("first_length").alias("end"), F.col("e.confidence").alias("confidence"))
    b = across.select(doc, F.col("next_number").alias(number), F.col("e.type").alias("type"), F.lit(0).alias("start"), (F.col("e.end") - gap).alias("end"), F.col("e.confidence").alias("confidence"))
    extra = a.unionByName(b).groupBy(doc, number).agg(F.collect_list(F.struct("type", "start", "end", "confidence")).alias("__x"))
    joined = single.join(extra, [doc, number], "left")
    shaped = F.transform(F.coalesce("__x", F.expr("cast(array() as array<struct<type:string,start:int,end:int,confidence:double>>)")), lambda x: F.struct(spans.placed(F.col(text), x["start"], x["end"]).alias("text"), x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["confidence"].alias("confidence")))
    return joined.withColumn("entities", spans.reconcile(F.col("entities"), shaped)).drop("__x")


def report(segments: DataFrame, doc: str, entities: str = "entities") -> DataFrame:
    """(doc, segments, entity_counts): segments and entities by type of each document."""
    n = segments.groupBy(doc).agg(F.count(F.lit(1)).alias("segments"))
    counts = segments.select(doc, F.explode(F.transform(entities, lambda e: e["type"])).alias("type")).groupBy(doc, "type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("entity_counts"))
    return n.join(maps, doc, "left")


def page_class(images: Column, visible: Column, invisible: Column) -> Column:
    """'raster' for a page covered by images with little visible text, 'hybrid' if it has invisible text as well."""
    scanned = (images >= 0.5) & (visible < 100)
    return F.when(scanned & (invisible > 0), "hybrid").when(scanned, "raster").otherwise("normal")


def blocks(lines: DataFrame, page: list[str], y: str = "y") -> DataFrame:
    """`lines` with `block`: a new one where the gap to the line above is under half or over one and a half of the median gap."""
    w = Window.partitionBy(*page).orderBy(F.desc(y))
    gaps = lines.withColumn("gap", F.lag(y).over(w) - F.col(y))
    positive = gaps.where("gap > 0").groupBy(*page).agg(F.array_sort(F.collect_list("gap")).alias("g"))
    median = positive.select(*page, F.element_at("g", F.expr("cast(size(g) div 2 + 1 as int)")).alias("median"))
    joined = gaps.join(median, page, "left")
    new = F.when(F.col("gap").isNull(), 1).when((F.col("gap") < 0.5 * F.col("median")) | (F.col("gap") > 1.5 * F.col("median")), 1).otherwise(0)
    return joined.withColumn("block", F.sum(new).over(Window.partitionBy(*page).orderBy(F.desc(y)))).drop("gap", "median")
