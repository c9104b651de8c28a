"""All queries of the core with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import checksums, crypto
from palimpsest.functions import text as tx
from palimpsest.functions.regexlib import find_all, translate
from palimpsest.operators import anonymize as an
from palimpsest.operators import detectors as dt
from palimpsest.operators import evaluate as ev
from palimpsest.operators import filters as fl
from palimpsest.operators import spans as sp
from palimpsest.operators import tags as tg
from palimpsest.operators import tokens as tk
from palimpsest.operators import verify as vf
from palimpsest.session import spread, table
from palimpsest.sources import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = bytes(range(32))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _once(spark: SparkSession, d: str) -> DataFrame:
    """Requests once each: a request delivered again comes with the same text."""
    return table(spark, d, "requests").groupBy("request_id").agg(F.min("text").alias("text"), F.min("session_id").alias("session_id"), F.min("received_at").alias("received_at"))


_REQ = "req as (select request_id, min(text) as text, min(session_id) as session_id, min(received_at) as received_at from requests group by request_id)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- detectors, one query a pattern, on posts and requests -------------------------------------------------------------
_TEXTS = "texts as (select 'documents' as src, doc_id as rec_id, text from documents union all select 'requests', request_id, min(text) from requests group by request_id)"


def texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text")
    return docs.unionByName(_once(spark, d).select(F.lit("requests").alias("src"), F.col("request_id").alias("rec_id"), "text"))


def spread_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same, over all cores where few files hold them: for the whole catalogue of detectors."""
    return spread(texts(spark, d).where("text is not null"))


def _detector(name: str, pattern: str, group: int = 0) -> None:
    sql = f"with {_TEXTS}, m as (select src, rec_id, unnest(regexp_extract_all(text, {_lit(pattern)}, {group})) as value from texts) select src, rec_id, value, count(*) as n from m group by src, rec_id, value"

    @query(f"detect_{name}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = translate(pattern)
        found = texts(spark, d).where(F.col("text").rlike(p)).select("src", "rec_id", F.explode(find_all(F.col("text"), p, f"${group}" if group == 0 else "$2", "" if group == 0 else "$1")).alias("m"))
        return found.groupBy("src", "rec_id", F.col("m.text").alias("value")).agg(F.count(F.lit(1)).alias("n"))


for _name, _pattern, _group in (
    ("email", dt.EMAIL, 0), ("ipv4", dt.IPV4, 0), ("ipv6", dt.IPV6, 0), ("iban_shape", dt.IBAN, 0), ("siret_shape", dt.SIRET, 0), ("siren_shape", dt.SIREN, 0),
    ("phone_plus", dt.PHONE_PLUS, 0), ("phone_local", dt.PHONE_LOCAL, 0), ("jwt", dt.JWT, 0), ("key_sk", dt.KEY_SK, 0), ("key_akia", dt.KEY_AKIA, 0), ("key_gh", dt.KEY_GH, 0),
    ("key_xox", dt.KEY_XOX, 0), ("key_pay", dt.KEY_PAY, 0), ("bearer", dt.BEARER, 2), ("secret_kv", dt.SECRET_KV, 2), ("siren_in_context", dt.SIREN_IN_CONTEXT, 2),
):
    _detector(_name, _pattern, _group)

# Pieces of SQL shared by the equivalents of entity queries: detectors whose matches cannot overlap each other's.
_LUHN = "list_sum([case when i % 2 = 1 then (case when cast(substr(reverse({d}), i + 1, 1) as int) * 2 > 9 then cast(substr(reverse({d}), i + 1, 1) as int) * 2 - 9 else cast(substr(reverse({d}), i + 1, 1) as int) * 2 end) else cast(substr(reverse({d}), i + 1, 1) as int) end for i in range(0, length({d}))]) % 10 = 0"


@query("entity_counts_by_type")
def entity_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the whole catalogue by source and type, with the records that hold them."""
    rows = dt.entity_rows(spread_texts(spark, d), ["src", "rec_id"])
    return rows.groupBy("src", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec_id").alias("records"))


@query("email_domain_topk", rf"with {_TEXTS}, m as (select lower(unnest(regexp_extract_all(text, {_lit('@([A-Za-z0-9_-]+(?:[.][a-zA-Z]{2,})+)')}, 1))) as domain from texts) select domain, count(*) as n from m group by domain order by n desc, domain limit 20")
def email_domain_topk(spark: SparkSession, d: str) -> DataFrame:
    domains = texts(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("@([A-Za-z0-9_-]+(?:[.][a-zA-Z]{2,})+)"), F.lit(1))).alias("domain"))
    return domains.groupBy(F.lower("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(20)


@query("docs_with_pii_by_source", f"select source, count(*) as docs, sum(case when regexp_matches(text, {_lit(dt.EMAIL)}) then 1 else 0 end) as with_email, sum(case when regexp_matches(text, {_lit(dt.PHONE_PLUS)}) then 1 else 0 end) as with_phone from documents where text is not null group by source")
def docs_with_pii_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    has = lambda p: F.sum(F.when(F.col("text").rlike(translate(p)), 1).otherwise(0))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), has(dt.EMAIL).alias("with_email"), has(dt.PHONE_PLUS).alias("with_phone"))


@query("entity_spans", f"""with {_TEXTS}, p as (select src, rec_id, regexp_extract_all(text, {_lit(dt.EMAIL)}) as ms, regexp_split_to_array(text, {_lit(dt.EMAIL)}) as gaps from texts where regexp_matches(text, {_lit(dt.EMAIL)})),
 e as (select src, rec_id, ms, gaps, unnest(range(1, len(ms) + 1)) as k from p),
 s as (select src, rec_id, ms[k] as value, coalesce(list_sum([length(gaps[i]) for i in range(1, k + 1)]), 0) + coalesce(list_sum([length(ms[i]) for i in range(1, k)]), 0) as a from e)
 select src, rec_id, value, cast(a as int) as start_pos, cast(a + length(value) as int) as end_pos from s""")
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    found = texts(spark, d).where(F.col("text").rlike(dt.EMAIL)).select("src", "rec_id", F.explode(find_all(F.col("text"), dt.EMAIL)).alias("m"))
    return found.select("src", "rec_id", F.col("m.text").alias("value"), F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos"))


# --- replacing -----------------------------------------------------------------------------------------------------------
def _redacted(pattern: str, with_: str) -> str:
    return f"with {_TEXTS} select src, rec_id, regexp_replace(text, {_lit(pattern)}, {_lit(with_)}, 'g') as masked from texts where regexp_matches(text, {_lit(pattern)})"


@query("mask_email_redact", _redacted(dt.EMAIL, "██████"))
def mask_email_redact(spark: SparkSession, d: str) -> DataFrame:
    email = [x for x in dt.ALL if x.type == "EMAIL"]
    rows = dt.with_entities(texts(spark, d).where(F.col("text").rlike(dt.EMAIL)), detectors=email)
    return an.anonymize(rows, strategy="redact").select("src", "rec_id", F.col("anonymized").alias("masked"))


@query("hash_phone", rf"""with {_TEXTS}, p as (select src, rec_id, regexp_extract_all(text, {_lit(dt.PHONE_PLUS)}) as ms, regexp_split_to_array(text, {_lit(dt.PHONE_PLUS)}) as gaps from texts where regexp_matches(text, {_lit(dt.PHONE_PLUS)}))
 select src, rec_id, list_reduce(list_prepend(gaps[1], [('⟦PHONE_' || substr(sha256(ms[i]), 1, 6) || '⟧') || gaps[i + 1] for i in range(1, len(ms) + 1)]), lambda x, y: x || y) as masked from p""")
def hash_phone(spark: SparkSession, d: str) -> DataFrame:
    phone = [x for x in dt.BUILTIN if x.pattern == dt.PHONE_PLUS]
    rows = dt.with_entities(texts(spark, d).where(F.col("text").rlike(dt.PHONE_PLUS)), detectors=phone)
    return an.anonymize(rows, strategy="hash").select("src", "rec_id", F.col("anonymized").alias("masked"))


@query("numbering_per_doc", f"""with {_TEXTS}, m as (select src, rec_id, unnest(regexp_extract_all(text, {_lit(dt.EMAIL)})) as value, generate_subscripts(regexp_extract_all(text, {_lit(dt.EMAIL)}), 1) as pos from texts),
 f as (select src, rec_id, lower(trim(value)) as key, min(pos) as pos, min_by(value, pos) as value from m group by src, rec_id, lower(trim(value)))
 select src, rec_id, value, cast(row_number() over (partition by src, rec_id order by pos) as int) as idx from f""")
def numbering_per_doc(spark: SparkSession, d: str) -> DataFrame:
    rows = dt.with_entities(texts(spark, d).where(F.col("text").rlike(dt.EMAIL)), detectors=[x for x in dt.ALL if x.type == "EMAIL"])
    return rows.select("src", "rec_id", F.explode(an.numbered(F.col("entities"))).alias("o")).select("src", "rec_id", F.col("o.text").alias("value"), F.col("o.index").alias("idx"))


@query("numbering_per_session", f"""with {_REQ}, m as (select session_id, request_id, unnest(regexp_extract_all(text, {_lit(dt.EMAIL)})) as value, generate_subscripts(regexp_extract_all(text, {_lit(dt.EMAIL)}), 1) as pos from req where session_id is not null),
 f as (select session_id, lower(trim(value)) as key, min((request_id, pos)) as o, min_by(value, (request_id, pos)) as value from m group by session_id, lower(trim(value)))
 select session_id, key, value, cast(row_number() over (partition by session_id order by o) as int) as idx from f""")
def numbering_per_session(spark: SparkSession, d: str) -> DataFrame:
    rows = dt.entity_rows(_once(spark, d), ["session_id", "request_id"], detectors=[x for x in dt.ALL if x.type == "EMAIL"])
    return an.number_session(rows, "session_id", "request_id").select(F.col("session").alias("session_id"), "key", F.col("text").alias("value"), F.col("index").alias("idx"))


@query("anonymize_tag")
def anonymize_tag(spark: SparkSession, d: str) -> DataFrame:
    rows = dt.with_entities(spread(texts(spark, d)))
    return an.anonymize(rows, mark=an.nonce(F.col("src"), F.col("rec_id"))).select("src", "rec_id", "anonymized", F.size("mapping").alias("mapped"))


@query("anonymize_keyed")
def anonymize_keyed(spark: SparkSession, d: str) -> DataFrame:
    rows = dt.with_entities(spread(texts(spark, d)), detectors=dt.BUILTIN)
    return an.anonymize(rows, strategy="keyed", key=KEY).select("src", "rec_id", "anonymized")


@query("roundtrip_ok", f"with {_TEXTS} select src, count(*) as n, cast(0 as bigint) as broken from texts where text is not null group by src")
def roundtrip_ok(spark: SparkSession, d: str) -> DataFrame:
    """Restoring gives back every text, but for the case of an owner that a later occurrence shares."""
    rows = an.anonymize(dt.with_entities(spread_texts(spark, d), detectors=dt.BUILTIN), mark=an.nonce(F.col("src"), F.col("rec_id")))
    ok = F.lower(an.deanonymize(F.col("anonymized"), F.col("mapping"))) == F.lower("text")
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("broken"))


@query("residual_leaks")
def residual_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks left in outputs of the whole catalogue, by kind and type."""
    rows = dt.with_entities(spread_texts(spark, d))
    out = an.anonymize(rows, mark=an.nonce(F.col("src"), F.col("rec_id")), expose_secrets=True)
    return vf.leaks_by_kind(vf.verify(out))


@query("response_leaks", rf"select type, count(*) as n from (select 'EMAIL' as type, unnest(regexp_extract_all(text, {_lit(dt.EMAIL)})) from responses union all select 'PHONE', unnest(regexp_extract_all(text, {_lit(dt.PHONE_PLUS)})) from responses) group by type")
def response_leaks(spark: SparkSession, d: str) -> DataFrame:
    """What the old engine left behind in its answers: hits of two patterns outside placeholders."""
    two = [x for x in dt.BUILTIN if x.pattern in (dt.EMAIL, dt.PHONE_PLUS)]
    hits = table(spark, d, "responses").select(F.explode(vf.regex_hits(F.col("text"), two)).alias("l"))
    return hits.groupBy(F.col("l.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("placeholder_use", r"with m as (select response_id, unnest(regexp_extract_all(text, '⟦[A-Za-z0-9_]{1,128}⟧')) as p from responses) select regexp_extract(p, '⟦([A-Z0-9]+?)_', 1) as label, count(*) as n, count(distinct p) as distinct_n from m group by 1")
def placeholder_use(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "responses").select(F.explode(F.transform(find_all(F.col("text"), an.PLACEHOLDER), lambda x: x["text"])).alias("p"))
    return m.groupBy(F.regexp_extract("p", "⟦([A-Z0-9]+?)_", 1).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("distinct_n"))


@query("deanonymize_responses", r"with m as (select response_id, map_entries(mapping) as kv, text from responses where mapping is not null and text is not null) select response_id, case when len(kv) = 0 then text else list_reduce(list_prepend(struct_pack(key := text, value := ''), kv), lambda acc, x: struct_pack(key := replace(acc.key, x.key, x.value), value := '')).key end as restored from m")
def deanonymize_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses").where("mapping is not null and text is not null")
    return rows.select("response_id", an.deanonymize(F.col("text"), F.col("mapping")).alias("restored"))


@query("entity_filters", """with e as (select response_id, unnest(entities) as e from responses), q as (select distinct request_id, min(coalesce(min_confidence, 0.0)) over (partition by request_id) as mc from requests), r as (select response_id, request_id from responses)
 select e.e.type as type, count(*) as n, cast(sum(case when e.e.confidence >= q.mc then 1 else 0 end) as bigint) as confident, cast(sum(case when length(trim(e.e.text)) - length(replace(trim(e.e.text), ' ', '')) + 1 <= 2 then 1 else 0 end) as bigint) as short
 from (select distinct response_id, e from e) e join (select distinct response_id, request_id from r) r using (response_id) join q using (request_id) group by 1""")
def entity_filters(spark: SparkSession, d: str) -> DataFrame:
    """Entities of responses that the request's confidence and a limit of two words would keep."""
    limits = table(spark, d, "requests").groupBy("request_id").agg(F.min(F.coalesce("min_confidence", F.lit(0.0))).alias("mc"))
    rows = table(spark, d, "responses").select("response_id", "request_id", "entities").distinct().join(limits, "request_id")
    kept = rows.select(F.array_distinct("entities").alias("e"), "mc")
    by_type = lambda e, name: kept.select(F.explode(e).alias("x")).groupBy(F.col("x.type").alias("type")).agg(F.count(F.lit(1)).alias(name))
    counts = by_type(F.col("e"), "n").join(by_type(fl.min_confidence(F.col("e"), F.col("mc")), "confident"), "type", "left").join(by_type(fl.max_tokens(F.col("e"), 2), "short"), "type", "left")
    return counts.select("type", "n", F.coalesce("confident", F.lit(0)).cast("long").alias("confident"), F.coalesce("short", F.lit(0)).cast("long").alias("short"))


@query("skip_types_complement", "with a as (select unnest(['PER','LOC','ORG','MISC','EMAIL','IPV4','IPV6','IBAN','SIRET','SIREN','PHONE','API_KEY','JWT','SECRET']) as t), r as (select request_id, any_value(skip_types) as s from requests group by request_id) select t as type, cast(sum(case when r.s is not null and list_contains(r.s, t) then 0 else 1 end) as bigint) as kept_by from a, r group by t")
def skip_types_complement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "requests").groupBy("request_id").agg(F.any_value("skip_types").alias("s"))
    return rows.select(F.explode(fl.skip_types(F.col("s"))).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("kept_by"))


# --- checksums and keys on the star schema ------------------------------------------------------------------------------
_C = "(select c_custkey as k, lpad(cast(c_custkey * 7919 % 1000000000 as varchar), 9, '0') as s from customer)"


@query("luhn_on_keys", f"select k, s, {_LUHN.format(d='s')} as ok from {_C}")
def luhn_on_keys(spark: SparkSession, d: str) -> DataFrame:
    s = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), s.alias("s"), checksums.luhn(s).alias("ok"))


@query("siren_generated", f"with g as (select c_custkey as k, lpad(cast(c_custkey % 90000000 + 10000000 as varchar), 8, '0') as b from customer) select k, b || s.c as siren from g, lateral (select cast((10 - list_sum([case when i % 2 = 0 then (case when cast(substr(reverse(b), i + 1, 1) as int) * 2 > 9 then cast(substr(reverse(b), i + 1, 1) as int) * 2 - 9 else cast(substr(reverse(b), i + 1, 1) as int) * 2 end) else cast(substr(reverse(b), i + 1, 1) as int) end for i in range(0, 8)]) % 10) % 10 as varchar) as c) s")
def siren_generated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), checksums.siren_from(F.col("c_custkey")).alias("siren"))


@query("generated_all_valid", "select count(*) as n, count(*) as siren_ok, count(*) as siret_ok, count(*) as iban_ok, cast(0 as bigint) as wrong_ok from supplier")
def generated_all_valid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    siren = checksums.siren_from(k)
    iban = checksums.iban_from("FR", F.lpad((k * 104729).cast("string"), 23, "0"))
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return table(spark, d, "supplier").agg(
        F.count(F.lit(1)).alias("n"), yes(checksums.siren(siren)).alias("siren_ok"), yes(checksums.siret(checksums.siret_from(siren, k))).alias("siret_ok"), yes(checksums.iban(iban)).alias("iban_ok"), yes(checksums.siren(checksums.invalid_reference(k))).alias("wrong_ok")
    )


@query("french_iban_checked", rf"""with {_TEXTS}, m as (select src, rec_id, unnest(regexp_extract_all(text, {_lit(dt.IBAN)})) as v from texts), d as (select src, rec_id, v, regexp_replace(v, '[\s\p{{Zs}}]', '', 'g') as s from m),
 t as (select *, substr(s, 5) || substr(s, 1, 4) as t from d)
 select src, rec_id, v as value, s[1:2] = 'FR' and length(s) = 27 and list_reduce(list_prepend(0, [case when ascii(substr(t, i, 1)) > 57 then ascii(substr(t, i, 1)) - 55 else ascii(substr(t, i, 1)) - 48 end for i in range(1, length(t) + 1)]), lambda a, x: (case when x > 9 then a * 100 + x else a * 10 + x end) % 97) = 1 as ok, count(*) as n from t where s[1:2] = 'FR' group by all""")
def french_iban_checked(spark: SparkSession, d: str) -> DataFrame:
    m = texts(spark, d).select("src", "rec_id", F.explode(find_all(F.col("text"), translate(dt.IBAN))).alias("m")).select("src", "rec_id", F.col("m.text").alias("value")).where("value like 'FR%'")
    return m.groupBy("src", "rec_id", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("ok", checksums.iban(F.col("value")))


_PADS = crypto._pads(KEY)


@query("hmac_customer", f"select c_custkey, substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('s' || chr(0) || 'PER' || chr(0) || c_name)))), 1, 16) as h from customer")
def hmac_customer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", crypto.keyed_hash(KEY, "s", F.lit("PER"), F.col("c_name")).alias("h"))


@query("keyed_index_customer", f"select c_custkey, cast(('0x' || substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('PER' || chr(0) || lower(trim(c_name))))))  , 1, 16))::ubigint % 999999 + 1 as int) as idx from customer")
def keyed_index_customer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", crypto.keyed_index(KEY, F.lit("PER"), F.col("c_name")).alias("idx"))


@query("plain_hash_part", "select p_partkey, substr(sha256(p_name), 1, 6) as h from part")
def plain_hash_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", crypto.plain_hash(F.col("p_name")).alias("h"))


# --- tokens and words ----------------------------------------------------------------------------------------------------
_TOK = r"[\p{L}\p{Nd}][\p{L}\p{Nd}\-‐‑]*['’]?"


@query("words_per_doc", f"select doc_id, cast(len(regexp_extract_all(text, {_lit(_TOK)})) as int) as words from documents where text is not null")
def words_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(tk.tokenize(F.col("text"), "fr"), lambda t: t["is_word"])).alias("words"))


_WORDS = f"w as (select doc_id, unnest(regexp_extract_all(text, {_lit(_TOK)})) as w, generate_subscripts(regexp_extract_all(text, {_lit(_TOK)}), 1) as pos from documents)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_TOK})"), F.lit(1))).alias("pos", "w"))


@query("vocab_topk", f"with {_WORDS} select lower(w) as word, count(*) as n from w where regexp_full_match(w, '[a-zA-Z]+') group by 1 having count(*) >= 5 order by n desc, word limit 200")
def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    return tk.vocabulary(_words(spark, d).where(F.col("w").rlike("^[a-zA-Z]+$")), "w", 5, 200)


@query("bigram_topk", f"with {_WORDS}, b as (select w as first, lead(w) over (partition by doc_id order by pos) as second from w) select first, second, count(*) as n from b where second is not null group by all order by n desc, first, second limit 100")
def bigram_topk(spark: SparkSession, d: str) -> DataFrame:
    return tk.ngrams(_words(spark, d), ["doc_id"], "pos", "w").groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "first", "second").limit(100)


_SH = r"regexp_replace(regexp_replace(regexp_replace({w}, '\p{{Nd}}', chr(1), 'g'), '\p{{Lu}}', chr(2), 'g'), '\p{{Ll}}', 'x', 'g')"


@query("token_shapes", f"with s as (select replace(replace({_SH.format(w='text')}, chr(2), 'X'), chr(1), 'd') as shape from tokens where is_word) select shape, count(*) as n from s group by shape")
def token_shapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tokens").where("is_word").groupBy(tx.shape(F.col("text")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("word_flags", r"select text, regexp_matches(text, '^\p{Lu}') as title, regexp_matches(text, '^\p{Nd}+$') as digits, contains(text, '-') as hyphen, regexp_matches(text, '\p{Nd}') as has_digit, right(text, 3) as suf3, left(text, 3) as pre3, case when length(text) <= 2 then 'short' when length(text) <= 5 then 'medium' else 'long' end as bucket, count(*) as n from tokens where is_word group by all")
def word_flags(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("text")
    counts = table(spark, d, "tokens").where("is_word").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("text", tx.is_title(w).alias("title"), tx.is_digits(w).alias("digits"), tx.has_hyphen(w).alias("hyphen"), tx.has_digit(w).alias("has_digit"), tx.suffix(w, 3).alias("suf3"), tx.prefix(w, 3).alias("pre3"), tx.length_bucket(w).alias("bucket"), "n")


@query("tokens_match_source", "with t as (select distinct request_id, tok_no, text, start_off, end_off from tokens) select count(*) as n, cast(sum(case when substr(src, start_off + 1, end_off - start_off) = t.text then 0 else 1 end) as bigint) as wrong from t join (select request_id, min(text) as src from requests group by request_id) using (request_id)")
def tokens_match_source(spark: SparkSession, d: str) -> DataFrame:
    """Every token is the stretch of its source that its positions name."""
    t = table(spark, d, "tokens").select("request_id", "tok_no", "text", "start_off", "end_off").distinct()
    j = t.join(_once(spark, d).select("request_id", F.col("text").alias("src")), "request_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(sp.placed(F.col("src"), F.col("start_off"), F.col("end_off")) == F.col("text"), 0).otherwise(1)).cast("long").alias("wrong"))


@query("lines_per_doc", r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, cast(count(*) as bigint) as lines, cast(sum(length(line)) as bigint) as chars from l where regexp_matches(line, '[^\t\n\f\r \x0b]') group by doc_id")
def lines_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return tk.lines(table(spark, d, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


_ANN = "ann as (select sent_id, pos, min(word) as word, min(tag) as tag, min(split) as split, min(source) as source from annotated_tokens group by sent_id, pos)"


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Annotated tokens once each, with null tags as O."""
    rows = table(spark, d, "annotated_tokens").groupBy("sent_id", "pos").agg(F.min("word").alias("word"), F.min("tag").alias("tag"), F.min("split").alias("split"), F.min("source").alias("source"))
    return rows.withColumn("tag", tg.normalize_tags(F.col("tag")))


@query("context_windows", f"with {_ANN} select sent_id, pos, coalesce(lower(lag(word) over w), 'BOS') as prev1, coalesce(lower(lead(word) over w), 'EOS') as next1, coalesce(lower(lag(word, 2) over w), 'BOS') as prev2, case when row_number() over w = 1 then 'first' when row_number() over w = 2 then 'second' when lead(word) over w is null then 'last' else 'inner' end as position from ann window w as (partition by sent_id order by pos)")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    return tk.context(annotated(spark, d), ["sent_id"], "pos").select("sent_id", "pos", "prev1", "next1", "prev2", "position")


@query("title_runs", rf"with {_ANN}, i as (select *, regexp_matches(word, '^\p{{Lu}}') as t, sum(case when regexp_matches(word, '^\p{{Lu}}') then 0 else 1 end) over (partition by sent_id order by pos) as island from ann), r as (select t, sum(case when t then 1 else 0 end) over (partition by sent_id, island) as run from i) select case when not t then '0' when run >= 5 then '5+' else cast(cast(run as int) as varchar) end as title_run, count(*) as n from r group by 1")
def title_runs(spark: SparkSession, d: str) -> DataFrame:
    return tk.context(annotated(spark, d), ["sent_id"], "pos").groupBy("title_run").agg(F.count(F.lit(1)).alias("n"))


_OK = "case when regexp_matches(tag, '^[BIES]-.+') then tag else 'O' end"


@query("bio_to_bioes", f"with {_ANN}, a as (select sent_id, pos, {_OK} as tag from ann), l as (select *, lead(tag) over (partition by sent_id order by pos) as nx from a) select sent_id, pos, case when tag[1] = 'B' then (case when coalesce(nx, 'O') = 'I-' || substr(tag, 3) then 'B' else 'S' end) || substr(tag, 2) when tag[1] = 'I' then (case when coalesce(nx, 'O') = 'I-' || substr(tag, 3) then 'I' else 'E' end) || substr(tag, 2) else tag end as tag from l")
def bio_to_bioes(spark: SparkSession, d: str) -> DataFrame:
    return tg.bio_to_bioes(annotated(spark, d), ["sent_id"], "pos").select("sent_id", "pos", "tag")


@query("bioes_to_bio", f"with {_ANN}, a as (select sent_id, pos, {_OK} as tag from ann) select regexp_replace(regexp_replace(tag, '^S-', 'B-'), '^E-', 'I-') as tag, count(*) as n from a group by 1")
def bioes_to_bio(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).groupBy(tg.bioes_to_bio(F.col("tag")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("iob_to_iob2", f"with {_ANN}, a as (select sent_id, pos, {_OK} as tag from ann), l as (select *, lag(tag) over (partition by sent_id order by pos) as pv from a) select sent_id, pos, case when tag[1] = 'I' and coalesce(case when pv = 'O' then '' else substr(pv, 3) end, '') <> substr(tag, 3) then 'B-' || substr(tag, 3) else tag end as tag from l")
def iob_to_iob2(spark: SparkSession, d: str) -> DataFrame:
    return tg.iob1_to_iob2(annotated(spark, d), ["sent_id"], "pos").select("sent_id", "pos", "tag")


@query("tag_violations", f"with {_ANN}, a as (select sent_id, pos, {_OK} as tag from ann), l as (select *, coalesce(lag(tag) over (partition by sent_id order by pos), 'O') as pv from a) select sent_id, pos, 'orphan' as kind from l where tag[1] in ('I', 'E') and (pv = 'O' or substr(pv, 3) <> substr(tag, 3))")
def tag_violations(spark: SparkSession, d: str) -> DataFrame:
    return tg.violations(annotated(spark, d), ["sent_id"], "pos")


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    arrays = annotated(spark, d).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("toks"))
    fixed = arrays.withColumn("tags", tg.repair(F.transform("toks", lambda x: tg.bioes_to_bio(x["tag"]))))
    each = F.transform("toks", lambda x, i: F.struct(F.get(F.col("tags"), i).alias("tag"), F.lit(1.0).alias("confidence")))
    return fixed.select("sent_id", "toks", F.explode(tg.decode(each)).alias("s")).select("sent_id", "toks", "s.*")


@query("decoded_spans", f"""with {_ANN}, a as (select sent_id, pos, word, regexp_replace(regexp_replace({_OK}, '^S-', 'B-'), '^E-', 'I-') as tag from ann),
 l as (select *, coalesce(lag(tag) over (partition by sent_id order by pos), 'O') as pv from a), b as (select *, case when tag[1] = 'B' or (tag[1] = 'I' and (pv = 'O' or substr(pv, 3) <> substr(tag, 3))) then 1 else 0 end as st from l),
 g as (select *, sum(st) over (partition by sent_id order by pos) as sid from b where tag <> 'O') select sent_id, substr(min(tag), 3) as type, string_agg(word, ' ' order by pos) as text, count(*) as tokens from g group by sent_id, sid, substr(tag, 3)""")
def decoded_spans(spark: SparkSession, d: str) -> DataFrame:
    words = F.transform(F.slice("toks", F.col("first") + 1, F.col("last") - F.col("first") + 1), lambda x: x["word"])
    return _decoded(spark, d).select("sent_id", "type", F.array_join(words, " ").alias("text"), (F.col("last") - F.col("first") + 1).cast("long").alias("tokens"))


@query("label_counts", f"with {_ANN} select {_OK} as tag, split, count(*) as n, count(distinct sent_id) as sentences from ann group by all")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).groupBy("tag", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sent_id").alias("sentences"))


# --- gazetteers ----------------------------------------------------------------------------------------------------------
def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """(name, term, n): terms in lower case, cut at the first separator, comments left out, repeated ones counted."""
    return corpora.word_lists(table(spark, d, "gazetteer").where("line is not null"))


_GAZ = r"gaz as (select name, lower(trim(regexp_extract(line, '^([^,;\t]*)', 1))) as term, count(*) as n from gazetteer where line is not null and not starts_with(ltrim(line), '#') group by all having term <> '')"


@query("gazetteer_terms", f"with {_GAZ} select name, term, n from gaz")
def gazetteer_terms(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer(spark, d)


@query("gazetteer_semi_join", f"with {_GAZ} select request_id, tok_no from (select distinct request_id, tok_no, text from tokens) t where lower(text) in (select term from gaz where name = 'per_first')")
def gazetteer_semi_join(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokens").select("request_id", "tok_no", "text").distinct().withColumn("term", F.lower("text"))
    return t.join(gazetteer(spark, d).where("name = 'per_first'"), "term", "left_semi").select("request_id", "tok_no")


@query("gazetteer_ngrams", f"with {_ANN}, {_GAZ}, w as (select sent_id, pos, lower(word) as a, lower(word) || ' ' || lower(lead(word) over s) as b, lower(word) || ' ' || lower(lead(word) over s) || ' ' || lower(lead(word, 2) over s) as c from ann window s as (partition by sent_id order by pos)), u as (select sent_id, pos, 1 as len, a as term from w union all select sent_id, pos, 2, b from w union all select sent_id, pos, 3, c from w) select sent_id, pos, len, name, term from u join gaz using (term)")
def gazetteer_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return tk.gazetteer_hits(annotated(spark, d), gazetteer(spark, d), ["sent_id"], "pos").select("sent_id", "pos", "len", "name", "term")


# --- quality, statistics -------------------------------------------------------------------------------------------------
@query("prf_scores", f"""with {_ANN}, g as (select sent_id, pos, substr({_OK}, 3) as type from ann where {_OK} <> 'O'), p as (select sent_id, pos, substr({_OK}, 3) as type from ann where {_OK} <> 'O' and regexp_matches(word, '^\\p{{Lu}}')),
 j as (select coalesce(g.type, p.type) as type, case when g.sent_id is not null and g.type in ('PER','LOC','ORG','MISC') then 1 else 0 end as g, case when p.sent_id is not null then 1 else 0 end as p from g full join p on g.sent_id = p.sent_id and g.pos = p.pos and g.type = p.type),
 c as (select type, sum(g) as gold, sum(p) as predicted, sum(g * p) as matched from j group by type union all select 'ALL', sum(g), sum(p), sum(g * p) from j)
 select type, cast(gold as bigint) as gold, cast(predicted as bigint) as predicted, cast(matched as bigint) as matched, round(2 * matched / (gold + predicted), 6) as f1 from c""")
def prf_scores(spark: SparkSession, d: str) -> DataFrame:
    """Token spans against a baseline that takes capitalised tokens only."""
    a = annotated(spark, d).where("tag <> 'O'").select("sent_id", "word", tg.tag_type(F.col("tag")).alias("type"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return ev.scores(a, a.where(tx.is_title(F.col("word"))), ["sent_id"]).select("type", "gold", "predicted", "matched", F.round("f1", 6).alias("f1"))


@query("value_entropy", "with c as (select event_type as label, cast(user_id as varchar) as value, count(*) as n from events where user_id is not null group by all), t as (select label, sum(n) as total from c group by label) select c.label, cast(sum(n) as bigint) as n, count(*) as distinct_values, round(-sum(n / total * log2(n / total)), 6) + 0.0 as entropy from c join t on c.label = t.label group by c.label")
def value_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("value"))
    return ev.entropy(rows, "event_type", "value").select("label", "n", "distinct_values", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query("span_entropy", "with s as (select distinct doc_index, e.label as label, e.text as text, e.start_off as a from (select doc_index, unnest(entities) as e from synth_docs)), c as (select label, text, count(*) as n from s where text is not null group by all), t as (select label, sum(n) as total from c group by label) select c.label, cast(sum(n) as bigint) as n, count(*) as distinct_values, round(-sum(n / total * log2(n / total)), 6) + 0.0 as entropy from c join t on c.label is not distinct from t.label group by c.label")
def span_entropy(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "synth_docs").select("doc_index", F.explode("entities").alias("e")).select("doc_index", "e.label", "e.text", "e.start_off").distinct()
    return ev.entropy(s, "label", "text").select("label", "n", "distinct_values", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query("span_violations", "with d as (select doc_index, entities from (select doc_index, entities, row_number() over (partition by doc_index order by num_tokens) as r from synth_docs) where r = 1) select doc_index, 'degenerate' as kind, cast(len(list_filter(entities, lambda x: x.end_off <= x.start_off)) as int) as n from d where len(list_filter(entities, lambda x: x.end_off <= x.start_off)) > 0 union all select doc_index, 'unlabelled', cast(len(list_filter(entities, lambda x: x.label is null or x.label = '')) as int) from d where len(list_filter(entities, lambda x: x.label is null or x.label = '')) > 0 union all select doc_index, 'blank-edge', cast(len(list_filter(entities, lambda x: coalesce(regexp_matches(x.text, '^[\\t\\n\\x0b\\f\\r ]|[\\t\\n\\x0b\\f\\r ]$'), false))) as int) from d where len(list_filter(entities, lambda x: coalesce(regexp_matches(x.text, '^[\\t\\n\\x0b\\f\\r ]|[\\t\\n\\x0b\\f\\r ]$'), false))) > 0 union all select doc_index, 'overlap', cast(count(*) as int) from (select doc_index, s.a as a, max(s.b) over (partition by doc_index order by s.a, s.b rows between unbounded preceding and 1 preceding) as before from (select doc_index, unnest(list_transform(entities, lambda x: struct_pack(a := x.start_off, b := x.end_off))) as s from d)) where before > a group by doc_index")
def span_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "synth_docs").withColumn("r", F.row_number().over(Window.partitionBy("doc_index").orderBy("num_tokens"))).where("r = 1")
    return ev.span_violations(docs)


@query("duplicate_rate", "with c as (select text, count(*) as n from documents group by text) select cast(sum(n) as bigint) as rows, count(*) as distinct_rows, round(sum(n - 1) / sum(n), 9) as rate from c")
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return ev.duplicate_rate(table(spark, d, "documents"), "text").withColumn("rate", F.round("rate", 9))


@query("contaminated_documents", r"with n as (select doc_id, trim(regexp_replace(lower(text), '[\t\n\x0b\f\r ]+', ' ', 'g'), ' ') as k, source from documents) select doc_id from n where source = 'lounge' and k in (select k from n where source <> 'lounge' and k is not null)")
def contaminated_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return ev.contaminated(docs.where("source = 'lounge'"), docs.where("source <> 'lounge'"), "text").select("doc_id")


@query("uri_carries_data", r"with u as (select distinct unnest(regexp_extract_all(text, '(?:https?://|mailto:|www\.)[^\s\]<>\"]+')) as uri from documents) select uri, starts_with(uri, 'mailto:') or regexp_matches(uri, '[?=@]') as carries from u")
def uri_carries_data(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"((?:https?://|mailto:|www\.)[^\s\]<>\"]+)"), F.lit(1))).alias("uri")).distinct()
    return u.select("uri", tx.uri_carries_data(F.col("uri")).alias("carries"))


@query("latest_manifests", "select batch_no, max(generated_at) as generated_at, max_by(doc_count, (generated_at, coalesce(doc_count, -1))) as doc_count, count(distinct generated_at) as runs from manifests where batch_no is not null group by batch_no")
def latest_manifests(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").where("batch_no is not null")
    return m.groupBy("batch_no").agg(F.max("generated_at").alias("generated_at"), F.max_by("doc_count", F.struct("generated_at", F.coalesce("doc_count", F.lit(-1)))).alias("doc_count"), F.count_distinct("generated_at").alias("runs"))


def queries() -> dict[str, Query]:
    from palimpsest import catalog_more, catalog_ops  # noqa: F401  register further queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from palimpsest import catalog_more, catalog_ops  # noqa: F401

    return dict(SQL)


__all__ = ["Column", "queries", "oracle_sql"]
