"""Further queries of the core: documents, models, languages, stores, generators, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import _ANN, _OK, KEY, _lit, _once, annotated, gazetteer, query, spread_texts
from palimpsest.functions import text as tx
from palimpsest.operators import anonymize as an
from palimpsest.operators import brown, crf, langid
from palimpsest.operators import detectors as dt
from palimpsest.operators import documents as dc
from palimpsest.operators import evaluate as ev
from palimpsest.operators import filters as fl
from palimpsest.operators import spans as sp
from palimpsest.operators import tags as tg
from palimpsest.operators import verify as vf
from palimpsest.operators.features import STOP_WORDS, Extractor
from palimpsest.plans import pipeline
from palimpsest.session import ensure_checkpoint_dir, table
from palimpsest.sources import vault
from palimpsest.streaming import numbering
from palimpsest.synth import generate
from palimpsest.synth.template import parse


# --- documents of several segments: a post's blocks ----------------------------------------------------------------------
def segments(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seg_no, text): the blocks of posts."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("seg_no", "text"))


_SEG = r"seg as (select doc_id, unnest(string_split_regex(text, '\n[\t\n\x0b\f\r ]*\n')) as text, generate_subscripts(string_split_regex(text, '\n[\t\n\x0b\f\r ]*\n'), 1) - 1 as seg_no from documents where text is not null)"


@query("segments_per_doc", f"with {_SEG} select doc_id, count(*) as segments, cast(sum(length(text)) as bigint) as chars from seg group by doc_id")
def segments_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"))


@query("document_samples", f"with {_SEG}, b as (select *, coalesce(sum(strlen(text) + 1) over (partition by doc_id order by seg_no rows between unbounded preceding and 1 preceding), 0) as b from seg) select doc_id, string_agg(text, chr(10) order by seg_no) as sample from b where b < 400 group by doc_id")
def document_samples(spark: SparkSession, d: str) -> DataFrame:
    return dc.sample_text(segments(spark, d), "doc_id", "seg_no", "text", 400)


@query("pair_views", f"with {_SEG}, p as (select *, lead(text) over (partition by doc_id order by seg_no) as nx from seg) select doc_id, cast(seg_no as int) as seg_no, case when regexp_matches(text, '\\p{{L}}-$') and regexp_matches(nx, '^\\p{{Ll}}') then text[:-2] || nx else text || ' ' || nx end as view from p where nx is not null")
def pair_views(spark: SparkSession, d: str) -> DataFrame:
    return dc.pair_views(segments(spark, d), "doc_id", "seg_no").select("doc_id", "seg_no", "view")


@query("entities_in_views")
def entities_in_views(spark: SparkSession, d: str) -> DataFrame:
    """Entities by type when every block is read alone and with its neighbour."""
    found = dc.detect_in_views(segments(spark, d), "doc_id", "seg_no", detectors=dt.BUILTIN)
    return found.select(F.explode("entities").alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("document_report", f"with {_SEG}, e as (select doc_id, unnest(regexp_extract_all(text, {_lit(dt.EMAIL)})) as v from seg), c as (select doc_id, count(*) as n from e group by doc_id) select s.doc_id, count(*) as segments, coalesce(max(c.n), 0) as emails from seg s left join c using (doc_id) group by s.doc_id")
def document_report(spark: SparkSession, d: str) -> DataFrame:
    rows = dt.with_entities(segments(spark, d), detectors=[x for x in dt.BUILTIN if x.type == "EMAIL"])
    return dc.report(rows, "doc_id").select("doc_id", "segments", F.coalesce(F.try_element_at("entity_counts", F.lit("EMAIL")), F.lit(0)).cast("long").alias("emails"))


@query("document_leaks")
def document_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Hits that show only when the blocks of a post are joined."""
    rows = an.anonymize(dt.with_entities(segments(spark, d)), mark=an.nonce(F.col("doc_id")))
    return vf.document_leaks(rows).select("doc_id", "kind", "type", "start", "end", "segments")


@query("unwritable_regions", f"select source, count(*) as regions, cast(sum(len(regexp_extract_all(text, {_lit(dt.EMAIL)}))) as bigint) as hits from documents where text is not null and source = 'ledger' group by source")
def unwritable_regions(spark: SparkSession, d: str) -> DataFrame:
    """Hits in posts of the board that is taken as read-only."""
    rows = table(spark, d, "documents").where("text is not null").withColumn("writable", F.col("source") != "ledger")
    found = vf.unwritable(rows).withColumn("emails", F.size(F.filter("leaks", lambda x: x["type"] == "EMAIL")))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("regions"), F.sum("emails").alias("hits"))


@query("strict_split")
def strict_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows that strict mode lets out and refuses."""
    out = pipeline.run(spread_texts(spark, d), pipeline.Options(strict=True), ids=["src", "rec_id"])
    return out.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count("anonymized").alias("clean"))


@query("reconciled_views")
def reconciled_views(spark: SparkSession, d: str) -> DataFrame:
    """Two detections of every text, by the built-in detectors and by all: widest first, the first on ties, the rest disjoint."""
    rows = spread_texts(spark, d).withColumn("a", dt.detect(F.col("text"), dt.BUILTIN)).withColumn("b", dt.detect(F.col("text")))
    return rows.select("src", "rec_id", F.inline(sp.reconcile(F.col("a"), F.col("b")))).select("src", "rec_id", "type", "start", "end")


@query("merged_spans")
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """The entities found in every text, contiguous ones taken together."""
    rows = spread_texts(spark, d).withColumn("e", dt.detect(F.col("text")))
    return rows.select("src", "rec_id", F.inline(sp.merge(sp.by_start(F.col("e"))))).select("src", "rec_id", "text", "type", "start", "end")


# --- entity passes -------------------------------------------------------------------------------------------------------
def _first_names(spark: SparkSession, d: str) -> DataFrame:
    """One row with the first names of the gazetteer: a fixed list."""
    return gazetteer(spark, d).where("name = 'per_first'").agg(F.array_sort(F.collect_list("term")).alias("first_names"))


@query("first_names_found", r"""with g as (select lower(trim(regexp_extract(line, '^([^,;\t]*)', 1))) as term from gazetteer where name = 'per_first' and not starts_with(ltrim(line), '#')), """
       r"""req as (select request_id, min(text) as text from requests group by request_id), m as (select request_id, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}''’\-‐‑]*')) as w from req)
 select request_id, w as name, count(*) as n from m where length(w) >= 3 and lower(w) in (select term from g) group by all""")
def first_names_found(spark: SparkSession, d: str) -> DataFrame:
    reqs = _once(spark, d).select("request_id", "text").join(F.broadcast(_first_names(spark, d)))
    found = reqs.select("request_id", F.explode(fl.detect_first_names(F.col("text"), sp.empty(), F.col("first_names"))).alias("e"))
    return found.groupBy("request_id", F.col("e.text").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("presets")
def presets(spark: SparkSession, d: str) -> DataFrame:
    """Persons found in requests by each preset."""
    stop = F.array(*[F.lit(w) for v in STOP_WORDS.values() for w in v.split()])
    reqs = _once(spark, d).select("request_id", "text").join(F.broadcast(_first_names(spark, d)))
    base = dt.detect(F.col("text"), dt.BUILTIN)
    out = None
    for name in ("balanced", "high-recall"):
        e = reqs.select(F.explode(fl.preset(name, F.col("text"), base, F.col("first_names"), stop)).alias("e")).groupBy(F.lit(name).alias("preset"), F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
        out = e if out is None else out.unionByName(e)
    return out


@query("completed_names")
def completed_names(spark: SparkSession, d: str) -> DataFrame:
    """First names found in every request, grown by the name word that follows."""
    stop = F.array(*[F.lit(w) for v in STOP_WORDS.values() for w in v.split()])
    reqs = _once(spark, d).select("request_id", "text").join(F.broadcast(_first_names(spark, d)))
    rows = reqs.withColumn("e", fl.detect_first_names(F.col("text"), sp.empty(), F.col("first_names")))
    names = rows.select("request_id", F.explode(fl.complete_names(F.col("text"), F.col("e"), F.col("first_names"), stop)).alias("x"))
    return names.where("x.type = 'PER'").select("request_id", "x.text", "x.start", "x.end")


@query("blocklisted", "select type, count(*) as n from (select distinct response_id, e.type as type, e.text as text, e.confidence as c from (select response_id, unnest(entities) as e from responses)) where not (type = 'PER' and list_has_all(['claire','hugo','nora'], string_split_regex(lower(trim(text)), '[ ]+'))) group by type")
def blocklisted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses").select("response_id", "entities").distinct()
    kept = rows.select("response_id", F.explode(F.array_distinct(fl.blocklist(F.col("entities"), "PER", ["claire", "hugo", "nora"]))).alias("e")).select("response_id", "e.*").distinct()
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# --- models --------------------------------------------------------------------------------------------------------------
def _sentences(spark: SparkSession, d: str) -> DataFrame:
    toks = annotated(spark, d).groupBy("sent_id", "split").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("t"))
    return toks.select("sent_id", "split", F.transform("t", lambda x: x["word"]).alias("words"), tg.repair(F.transform("t", lambda x: tg.bioes_to_bio(x["tag"]))).alias("tags"))


CRF_SENTENCES = 250


@query("crf_scores")
def crf_scores(spark: SparkSession, d: str) -> DataFrame:
    """Quality by type, on test sentences, of a model trained on a bounded sample of training sentences."""
    sents = _sentences(spark, d)
    sample = [(list(r["words"]), list(r["tags"])) for r in sents.where("split = 'train'").orderBy(F.xxhash64("sent_id"), "sent_id").limit(CRF_SENTENCES).collect()]
    extractor = Extractor("fr")
    model = crf.train(sample[: int(0.85 * len(sample))], sample[int(0.85 * len(sample)) :], extractor, epochs=4, min_count=2)
    test = crf.predict(sents.where("split = 'test'"), model, extractor)
    shaped = lambda tags: F.transform(tags, lambda t: F.struct(t.alias("tag"), F.lit(1.0).alias("confidence")))
    rows = lambda tags: test.select("sent_id", F.explode(tg.decode(shaped(F.col(tags)))).alias("s")).select("sent_id", "s.type", F.col("s.first").alias("start"), (F.col("s.last") + 1).alias("end"))
    gold = sents.where("split = 'test'").select("sent_id", F.explode(tg.decode(shaped(F.col("tags")))).alias("s")).select("sent_id", "s.type", F.col("s.first").alias("start"), (F.col("s.last") + 1).alias("end"))
    return ev.scores(gold, rows("tags"), ["sent_id"])


@query("emission_scores", f"with {_ANN}, f as (select sent_id, pos, 'suf=' || right(lower(word), 3) as feature from ann), w as (select 'suf=' || right(lower(word), 3) as feature, {_OK} as label, count(*) as w from ann group by all) select sent_id, pos, label, cast(sum(w) as double) as score from f join w using (feature) group by all")
def emission_scores(spark: SparkSession, d: str) -> DataFrame:
    a = annotated(spark, d).withColumn("feature", F.concat(F.lit("suf="), F.right(F.lower("word"), F.lit(3))))
    weights = a.groupBy("feature", F.col("tag").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return crf.emission_scores(a.select("sent_id", "pos", "feature", F.lit(1.0).alias("value")), weights, ["sent_id", "pos"])


@query("pruned_weights", f"with {_ANN}, w as (select 'suf=' || right(lower(word), 3) as feature, {_OK} as label, count(*) as w from ann group by all) select count(*) as n, cast(sum(case when w >= 5 then 1 else 0 end) as bigint) as kept from w")
def pruned_weights(spark: SparkSession, d: str) -> DataFrame:
    a = annotated(spark, d).groupBy(F.right(F.lower("word"), F.lit(3)).alias("f"), "tag").agg(F.count(F.lit(1)).alias("w"))
    return a.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.abs("w") >= 5, 1).otherwise(0)).cast("long").alias("kept"))


@query("brown_clusters")
def brown_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Bit paths of the words of annotated sentences that stand there five times or more, with their prefixes: of the 20,000
    most frequent at most, in 1,000 clusters."""
    uni, bi = brown.counts(annotated(spark, d), ["sent_id"], "pos", "word", 5, 20_000)
    paths = brown.cluster(uni, bi, 1_000)
    df = spark.createDataFrame(sorted(paths.items()), "word string, path string")
    return df.select("word", "path", tx.brown_prefixes(F.col("path")).alias("prefixes"))


@query("embedding_buckets", "select vec_id, [case when v > 1 then 'xl' when v > 0.3 then 'lg' when v > -0.3 then 'sm' when v > -1 then 'nl' else 'xn' end for v in embedding[1:10]] as buckets from embeddings")
def embedding_buckets(spark: SparkSession, d: str) -> DataFrame:
    bucket = lambda v: F.when(v > 1, "xl").when(v > 0.3, "lg").when(v > -0.3, "sm").when(v > -1, "nl").otherwise("xn")
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), bucket).alias("buckets"))


@query("language_trigrams")
def language_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """How often the trigram ranks of three languages agree with the declared language of posts."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("declared", F.substring(F.lower("lang"), 1, 2))
    known = docs.where(F.col("declared").isin(*langid.CANDIDATES))
    prof = langid.profiles(known.select(F.col("declared").alias("lang"), "text"))
    found = langid.checked(langid.detect(known, ["doc_id"], prof))
    return found.join(known.select("doc_id", "declared"), "doc_id").groupBy("declared", "lang").agg(F.count(F.lit(1)).alias("n"))


# --- stores and generators -----------------------------------------------------------------------------------------------
@query("mapping_store_roundtrip", "select count(*) as n, count(*) as same, cast(0 as bigint) as expired from (select response_id, any_value(mapping) from responses where mapping is not null group by response_id)")
def mapping_store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sealed mappings open to themselves, and not once expired."""
    rows = table(spark, d, "responses").where("mapping is not null").select("response_id", F.to_json("mapping").alias("j")).groupBy("response_id").agg(F.min("j").alias("j")).withColumn("mapping", F.from_json("j", "map<string,string>"))
    store = vault.seal(rows, "response_id", "mapping", KEY, 1_700_000_000, 3600)
    opened = vault.unseal(store, KEY, 1_700_000_100).join(rows.select(F.col("response_id").cast("string").alias("id"), "j"), "id")
    late = vault.unseal(store, KEY, 1_800_000_000).agg(F.count(F.lit(1)).alias("expired"))
    return opened.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.to_json("mapping") == F.col("j"), 1).otherwise(0)).cast("long").alias("same")).join(F.broadcast(late))


@query("session_states", "select session_id, 1 as version, count(*) as n from (select session_id, request_id from requests where session_id is not null group by all) group by session_id")
def session_states(spark: SparkSession, d: str) -> DataFrame:
    """Session state as JSON and back."""
    s = table(spark, d, "requests").where("session_id is not null").select("session_id", "request_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    empty = F.expr("cast(map() as map<string,string>)")
    rows = s.withColumn("nonce", an.nonce(F.col("session_id"))).withColumn("counters", F.create_map(F.lit("EMAIL"), F.col("n"))).withColumn("m", empty)
    back = vault.session_from_json(vault.session_json(rows, "nonce", "counters", "m", "m"))
    return back.select("session_id", F.col("session.version").alias("version"), F.col("session.counters")["EMAIL"].cast("long").alias("n"))


TEMPLATE = """type: facture
lang: fr
source: exemple
weight: 1.0
---
{{ORG:seller|form=juridique_capital}} {{siret:seller}}
{{PER:buyer|form=civ_prenom_nom}}{{pad:2-6}}{{ADDR:buyer|form=inline}}
[?contact]Contact : {{PER:contact|form=prenom_nom}} - {{email:c|from=contact}}
[/]
@block lignes
{{decoy:designation}}{{pad:2-4}}{{amount:total}}
@end
{{LINES:lignes:1-3}}Le {{date:issue|format=long}}, IBAN {{iban:seller}}
"""


@query("synthetic_corpus", "select 2000 as docs, cast(0 as bigint) as misplaced, cast(0 as bigint) as bad_siret")
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A generated corpus holds its spans where it says, and valid identifiers."""
    from palimpsest.functions import checksums

    docs = generate.corpus(spark, [parse("facture", TEMPLATE)], 2000, seed=7)
    bad = F.size(F.filter("entities", lambda e: F.substring(F.col("text"), e["start_off"] + 1, e["end_off"] - e["start_off"]) != e["text"]))
    siret = F.regexp_extract("text", r"\b(\d{14})\b", 1)
    return docs.agg(F.count(F.lit(1)).cast("int").alias("docs"), F.sum(bad).cast("long").alias("misplaced"), F.sum(F.when(checksums.siret(siret), 0).otherwise(1)).cast("long").alias("bad_siret"))


# --- streams -------------------------------------------------------------------------------------------------------------
def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """A stream run to its end into files of the shared folder, read back."""
    out = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _request_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "requests").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/requests.parquet*")


@query("stream_keyed")
def stream_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Requests pseudonymised without state as a stream."""
    return _drained(spark, numbering.stateless(_request_stream(spark, d).select("request_id", "text"), KEY, detectors=dt.BUILTIN).select("request_id", "anonymized"))


@query("stream_numbered")
def stream_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Entities of requests numbered within their session as a stream, with state."""
    return _drained(spark, numbering.numbered(_request_stream(spark, d), detectors=dt.BUILTIN, timeout="NoTimeout"))
