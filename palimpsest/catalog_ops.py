"""Queries of single operators over whole tables: detectors on values made from keys, checksums, filters, spans, tags,
line formats of corpora, document views and leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import _ANN, _LUHN, _OK, _lit, _once, annotated, query
from palimpsest.functions import checksums
from palimpsest.functions import text as tx
from palimpsest.operators import crf
from palimpsest.operators import detectors as dt
from palimpsest.operators import documents as dc
from palimpsest.operators import filters as fl
from palimpsest.operators import spans as sp
from palimpsest.operators import tags as tg
from palimpsest.operators import tokens as tk
from palimpsest.operators import verify as vf
from palimpsest.session import table
from palimpsest.sources import corpora

# --- detectors that the given texts hardly touch, on one made text a customer; every third is a near miss --------------------
_H = "sha256(cast(c_custkey as varchar))"
_D14 = "lpad(cast(c_custkey * 829393951 % 100000000000000 as varchar), 14, '0')"
_D9 = "lpad(cast(c_custkey * 7919 % 1000000000 as varchar), 9, '0')"
#: Name: pattern, group of the span, SQL of the made text (functions that Spark and DuckDB share, `h` being a hash).
MADE = {
    "ipv6": (dt.IPV6, 0, "case when c_custkey % 3 = 0 then concat('at ', substr(h, 1, 4), ':', substr(h, 5, 4), ' off') when c_custkey % 3 = 1 then concat('at ', substr(h, 1, 4), '::', substr(h, 5, 3), ' up') else concat('at ', substr(h, 1, 4), ':', substr(h, 5, 4), ':', substr(h, 9, 4), ':', substr(h, 13, 4), ':', substr(h, 17, 4), ':', substr(h, 21, 4), ':', substr(h, 25, 4), ':', substr(h, 29, 4), ' up') end"),
    "siret": (dt.SIRET, 0, "case when c_custkey % 3 = 0 then concat('no ', d14, '1') when c_custkey % 3 = 1 then concat('no ', d14, ' paid') else concat('no ', substr(d14, 1, 3), ' ', substr(d14, 4, 3), ' ', substr(d14, 7, 3), ' ', substr(d14, 10, 5), '.') end"),
    "jwt": (dt.JWT, 0, "case when c_custkey % 3 = 0 then concat('eyJ', substr(h, 1, 9), '.eyJ', substr(h, 13, 14), '.x') else concat('auth eyJ', substr(h, 1, 12), '.eyJ', substr(h, 13, 14), '.', substr(h, 30, 10), ' end') end"),
    "key_sk": (dt.KEY_SK, 0, "case when c_custkey % 3 = 0 then concat('sk-', substr(h, 1, 19)) else concat('use sk-', substr(h, 1, 24), ', now') end"),
    "key_akia": (dt.KEY_AKIA, 0, "case when c_custkey % 3 = 0 then concat('AKIA', upper(substr(h, 1, 17))) else concat('id AKIA', upper(substr(h, 1, 16)), '.') end"),
    "key_gh": (dt.KEY_GH, 0, "case when c_custkey % 3 = 0 then concat('ghp_', substr(h, 1, 35)) when c_custkey % 3 = 1 then concat('x ghp_', substr(h, 1, 36)) else concat('github_pat_', h, substr(h, 1, 18), ' y') end"),
    "key_xox": (dt.KEY_XOX, 0, "case when c_custkey % 3 = 0 then concat('xoxz-', substr(h, 1, 24)) else concat('bot xoxb-', substr(h, 1, 24), ' y') end"),
    "key_pay": (dt.KEY_PAY, 0, "case when c_custkey % 3 = 0 then concat('sk_live_', substr(h, 1, 20)) else concat('pay rk_test_', substr(h, 1, 26)) end"),
    "bearer": (dt.BEARER, 2, "case when c_custkey % 3 = 0 then concat('Bearer ', substr(h, 1, 19)) else concat('BEARER  ', substr(h, 1, 30), ' x') end"),
    "secret_kv": (dt.SECRET_KV, 2, "case when c_custkey % 3 = 0 then concat('my password = ', substr(h, 1, 9)) else concat('a', chr(10), 'db_password = ', substr(h, 1, 9), ' x') end"),
    "siren_in_context": (dt.SIREN_IN_CONTEXT, 2, "case when c_custkey % 3 = 0 then concat('FINESS ET ', d9) else concat('RCS : Dijon ', d9, '.') end"),
}
_DETECTORS = {d.pattern: d for d in [*dt.ALL, dt.CONTEXTUAL_SIREN]}


def _made(name: str) -> None:
    pattern, group, made = MADE[name]
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    checked = f" where {_LUHN.format(d=digits)}" if name.startswith("sire") else ""
    sql = f"with c as (select c_custkey, {_H} as h, {_D14} as d14, {_D9} as d9 from customer), t as (select c_custkey, {made} as text from c), m as (select c_custkey, unnest(regexp_extract_all(text, {_lit(pattern)}, {group})) as value, text from t) select c_custkey, value, cast(strpos(text, value) - 1 as int) as start_pos from m{checked}"

    @query(f"made_{name}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"), F.expr("lpad(cast(c_custkey * 829393951L % 100000000000000L as string), 14, '0')").alias("d14"), F.expr("lpad(cast(c_custkey * 7919 % 1000000000 as string), 9, '0')").alias("d9"))
        found = c.select("c_custkey", F.explode(_DETECTORS[pattern].matches(F.expr(made))).alias("m"))
        return found.select("c_custkey", F.col("m.text").alias("value"), F.col("m.start").alias("start_pos"))


for _name in MADE:
    _made(_name)


# --- checksums ---------------------------------------------------------------------------------------------------------------
_NIR_BODY = "concat(cast(c_custkey % 10 as {s}), lpad(cast(c_custkey % 89 as {s}), 2, '0'), lpad(cast(c_custkey * 7 % 100 as {s}), 2, '0'), case when c_custkey % 17 = 0 then '2A' when c_custkey % 19 = 0 then '2B' else lpad(cast(c_custkey * 13 % 100 as {s}), 2, '0') end, lpad(cast(c_custkey % 1000 as {s}), 3, '0'), lpad(cast(c_custkey * 3 % 1000 as {s}), 3, '0'))"
_NIR_NUM = "cast(replace(replace(body, '2A', '19'), '2B', '18') as bigint)"


@query("nir_checksum", f"""with b as (select c_custkey, {_NIR_BODY.format(s='varchar')} as body from customer), k as (select *, 97 - {_NIR_NUM} % 97 as k from b),
 n as (select *, concat(body, lpad(cast(case when c_custkey % 5 = 0 then k % 97 + 1 else k end as varchar), 2, '0')) as nir, cast(substr(body, 4, 2) as int) as m from k)
 select c_custkey, nir, substr(body, 1, 1) in ('1', '2', '3', '4', '7', '8') and (m between 1 and 12 or m = 20 or m between 30 and 42 or m between 50 and 99) and substr(body, 6, 2) <> '00' and cast(substr(nir, 14, 2) as bigint) = k as ok from n""")
def nir_checksum(spark: SparkSession, d: str) -> DataFrame:
    """Social security numbers made from keys, of every month code and with Corsican departments, some with a wrong key."""
    b = table(spark, d, "customer").select("c_custkey", F.expr(_NIR_BODY.format(s="string")).alias("body")).withColumn("k", F.expr(f"97 - {_NIR_NUM} % 97"))
    nir = F.expr("concat(body, lpad(cast(case when c_custkey % 5 = 0 then k % 97 + 1 else k end as string), 2, '0'))")
    return b.select("c_custkey", nir.alias("nir"), checksums.nir(nir).alias("ok"))


_COUNTRIES = sorted(checksums.IBAN_LENGTH)
_REST = "list_reduce(list_prepend(cast(0 as bigint), [cast(case when ascii(substr({t}, i, 1)) > 57 then ascii(substr({t}, i, 1)) - 55 else ascii(substr({t}, i, 1)) - 48 end as bigint) for i in range(1, length({t}) + 1)]), lambda a, x: (case when x > 9 then a * 100 + x else a * 10 + x end) % 97)"


@query("iban_by_country", f"""with c as (select c_custkey, {_COUNTRIES}[cast(c_custkey % {len(_COUNTRIES)} as int) + 1] as cc, {[checksums.IBAN_LENGTH[c] for c in _COUNTRIES]}[cast(c_custkey % {len(_COUNTRIES)} as int) + 1] as n from customer),
 a as (select *, lpad(cast(c_custkey * 104729 as varchar), n - 4 - (case when c_custkey % 7 = 0 then 1 else 0 end), '0') as acc from c), k as (select *, acc || cc || '00' as t0 from a), i as (select *, cc || lpad(cast(98 - {_REST.format(t='t0')} as varchar), 2, '0') || acc as iban from k),
 j as (select *, substr(iban, 5) || substr(iban, 1, 4) as t1 from i) select c_custkey, iban, length(iban) = n and {_REST.format(t='t1')} = 1 as ok from j""")
def iban_by_country(spark: SparkSession, d: str) -> DataFrame:
    """An account number of every country in turn, with the right check digits; every seventh is one sign short."""
    pick = F.expr(f"cast(c_custkey % {len(_COUNTRIES)} as int)")
    cc, n = F.get(F.array(*map(F.lit, _COUNTRIES)), pick), F.get(F.array(*[F.lit(checksums.IBAN_LENGTH[c]) for c in _COUNTRIES]), pick)
    rows = table(spark, d, "customer").select("c_custkey", cc.alias("cc"), n.alias("n"))
    acc = F.expr("lpad(cast(c_custkey * 104729 as string), n - 4 - (case when c_custkey % 7 = 0 then 1 else 0 end), '0')")
    check = F.lpad((F.lit(98) - checksums.mod97(F.concat(acc, "cc", F.lit("00")))).cast("string"), 2, "0")
    made = rows.select("c_custkey", F.concat("cc", check, acc).alias("iban"))
    return made.select("c_custkey", "iban", checksums.iban(F.col("iban")).alias("ok"))


# --- words -------------------------------------------------------------------------------------------------------------------
@query("token_kinds", f"with l as (select request_id, unnest(string_split(min(text), chr(10))) as line from requests group by request_id), t as (select unnest(regexp_extract_all(line, {_lit(tk.SPLIT_HYPHEN.replace(chr(92) + 'p{IsWhite_Space}', chr(92) + 's' + chr(92) + 'x{0b}' + chr(92) + 'x{85}' + chr(92) + 'p{Z}'))})) as text from l) select text, regexp_matches(text, '^[\\p{{L}}\\p{{Nd}}]') as is_word, count(*) as n from t group by all")
def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of requests, in lines and sentences, by text and kind."""
    rows = tk.token_rows(_once(spark, d), ["request_id"], lang="en")
    return rows.groupBy("text", "is_word").agg(F.count(F.lit(1)).alias("n"))


@query("more_word_flags", r"select text, regexp_matches(text, '\p{L}') and not regexp_matches(text, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') as all_upper, regexp_matches(text, '[''’]') as apostrophe, round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(text), 6) as caps, count(*) as n from tokens where is_word group by text")
def more_word_flags(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("text")
    counts = table(spark, d, "tokens").where("is_word").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("text", tx.is_all_upper(w).alias("all_upper"), tx.has_apostrophe(w).alias("apostrophe"), F.round(tx.caps_ratio(w), 6).alias("caps"), "n")


@query("plain_letters", f"select term_id, translate(line, {_lit(tx.ACCENTED)}, {_lit(tx.UNACCENTED)}) as plain from gazetteer where line is not null")
def plain_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gazetteer").where("line is not null").select("term_id", tx.strip_accents(F.col("line")).alias("plain"))


@query("name_runs", r"with m as (select request_id, unnest(regexp_extract_all(text, '[\p{L}''’\-‐‑]+')) as run from (select request_id, min(text) as text from requests group by request_id)) select run, count(*) as n, count(distinct request_id) as requests from m group by run")
def name_runs(spark: SparkSession, d: str) -> DataFrame:
    m = _once(spark, d).select("request_id", F.explode(tx.name_runs(F.col("text"))).alias("run"))
    return m.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("requests"))


@query("acronyms", r"select item_id, list_reduce(list_prepend('', [left(w, 1) for w in string_split_regex(text, '[\t\n\x0b\f\r \-]+') if regexp_matches(w, '^\p{Lu}')]), lambda a, x: a || x) as acronym from bench_items where text is not null")
def acronyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bench_items").where("text is not null").select("item_id", tx.acronym(F.col("text")).alias("acronym"))


@query("path_prefixes", "with p as (select p_partkey, left(lpad(bin(p_partkey * 2654435761), 40, '0'), cast(p_partkey % 40 as int)) as path from part) select p_partkey, list_filter([case when length(path) >= n then left(path, n) end for n in [4, 6, 10, 20]], lambda x: x is not null) as prefixes from p")
def path_prefixes(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr("left(lpad(bin(p_partkey * 2654435761L), 40, '0'), cast(p_partkey % 40 as int))")
    return table(spark, d, "part").select("p_partkey", tx.brown_prefixes(path).alias("prefixes"))


@query("word_bigrams", f"with {_ANN} select sent_id, pos, concat_ws(' ', coalesce(lower(lag(word) over w), 'BOS'), lower(word)) as bigram_left, concat_ws(' ', lower(word), coalesce(lower(lead(word) over w), 'EOS')) as bigram_right from ann window w as (partition by sent_id order by pos)")
def word_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return tk.context(annotated(spark, d), ["sent_id"], "pos").select("sent_id", "pos", "bigram_left", "bigram_right")


# --- entities of responses -----------------------------------------------------------------------------------------------------
_RESP = "r as (select distinct response_id, entities from responses where entities is not null)"


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "responses").where("entities is not null").select("response_id", "entities").distinct()


@query("long_entities", f"with {_RESP} select response_id, cast(len(list_filter(entities, lambda e: length(trim(e.text)) >= 8)) as int) as long, cast(len(list_filter(entities, lambda e: list_contains(['PER', 'EMAIL'], e.type))) as int) as chosen, cast(len(entities) as int) as every from r")
def long_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of at least eight characters, of two types, and of no type asked for."""
    e, none = F.col("entities"), F.expr("cast(null as array<string>)")
    return _responses(spark, d).select("response_id", F.size(fl.min_runes(e, 8)).alias("long"), F.size(fl.only_types(e, F.array(F.lit("PER"), F.lit("EMAIL")))).alias("chosen"), F.size(fl.only_types(e, none)).alias("every"))


_FIRST = r"f as (select distinct lower(trim(regexp_extract(line, '^([^,;\t]*)', 1))) as term from gazetteer where name = 'per_first' and line is not null and not starts_with(ltrim(line), '#'))"


@query("reclassified", f"with {_RESP}, {_FIRST}, e as (select response_id, unnest(entities) as e from r), k as (select response_id, case when e.type = 'LOC' and not contains(trim(e.text), ' ') and lower(trim(e.text)) in (select term from f) then 'PER' else e.type end as type from e) select type, count(*) as n, count(distinct response_id) as responses from k group by type")
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    """Types of entities once places that are first names count as persons; the list of first names is a fixed table."""
    from palimpsest.catalog import gazetteer

    names = gazetteer(spark, d).where("name = 'per_first'").agg(F.array_sort(F.collect_set("term")).alias("first_names"))
    rows = _responses(spark, d).join(F.broadcast(names)).select("response_id", F.explode(fl.reclassify(F.col("entities"), F.col("first_names"))).alias("e"))
    return rows.groupBy(F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("response_id").alias("responses"))


# --- spans and tags ------------------------------------------------------------------------------------------------------------
_TOKS = "t as (select distinct request_id, tok_no, start_off as a, end_off as b from tokens where is_word and request_id is not null)"


def _word_arrays(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokens").where("is_word and request_id is not null").select("request_id", "tok_no", "start_off", "end_off").distinct()
    return t.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(F.col("tok_no"), F.col("start_off").alias("start"), F.col("end_off").alias("end")))).alias("toks"))


@query("clipped_words", f"with {_TOKS}, c as (select request_id, tok_no, greatest(a, 13) - 13 as start_pos, least(b, 57) - 13 as end_pos from t) select request_id, tok_no, cast(start_pos as int) as start_pos, cast(end_pos as int) as end_pos from c where start_pos < end_pos")
def clipped_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of every request as seen from the stretch 13 to 57 of its text."""
    shaped = F.transform("toks", lambda x: F.struct(x["tok_no"].cast("string").alias("type"), x["start"].alias("start"), x["end"].alias("end"), F.lit(1.0).alias("confidence")))
    rows = _word_arrays(spark, d).select("request_id", F.explode(sp.clip(shaped, F.lit(13), F.lit(57))).alias("x"))
    return rows.select("request_id", F.col("x.type").cast("int").alias("tok_no"), F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"))


_MAIL = f"""q as (select request_id, min(text) as text from requests group by request_id), p as (select request_id, regexp_extract_all(text, {_lit(dt.EMAIL)}) as ms, regexp_split_to_array(text, {_lit(dt.EMAIL)}) as gaps from q where regexp_matches(text, {_lit(dt.EMAIL)})),
 k as (select request_id, ms, gaps, unnest(range(1, len(ms) + 1)) as k from p), m as (select request_id, coalesce(list_sum([length(gaps[i]) for i in range(1, k + 1)]), 0) + coalesce(list_sum([length(ms[i]) for i in range(1, k)]), 0) as a, length(ms[k]) as n from k)"""


@query("projected_tags", f"with {_TOKS}, {_MAIL}, j as (select t.request_id, t.tok_no, min(m.a) as span from t left join m on t.request_id = m.request_id and t.a < m.a + m.n and m.a < t.b group by all), f as (select *, row_number() over (partition by request_id, span order by tok_no) as r from j) select request_id, tok_no, case when span is null then 'O' when r = 1 then 'B-EMAIL' else 'I-EMAIL' end as tag from f")
def projected_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of every request's words from the mail addresses found in its text."""
    mails = dt.with_entities(_once(spark, d), detectors=[x for x in dt.BUILTIN if x.type == "EMAIL"]).select("request_id", "entities")
    rows = _word_arrays(spark, d).join(mails, "request_id").withColumn("tags", tg.project(F.col("toks"), F.col("entities")))
    each = F.transform("toks", lambda x, i: F.struct(x["tok_no"].alias("tok_no"), F.get(F.col("tags"), i).alias("tag")))
    return rows.select("request_id", F.explode(each).alias("x")).select("request_id", "x.tok_no", "x.tag")


@query("span_confidence", f"""with {_ANN}, a as (select sent_id, pos, row_number() over (partition by sent_id order by pos) - 1 as i, regexp_replace(regexp_replace({_OK}, '^S-', 'B-'), '^E-', 'I-') as tag from ann),
 l as (select *, coalesce(lag(tag) over (partition by sent_id order by pos), 'O') as pv from a), b as (select *, case when tag[1] = 'B' or (tag[1] = 'I' and (pv = 'O' or substr(pv, 3) <> substr(tag, 3))) then 1 else 0 end as st from l),
 g as (select *, sum(st) over (partition by sent_id order by pos) as sid from b where tag <> 'O') select sent_id, substr(min(tag), 3) as type, cast(min(i) as int) as first, round(list_reduce(list((i % 4 + 1) / 4.0 order by pos), lambda x, y: (x + y) / 2), 9) as confidence from g group by sent_id, sid, substr(tag, 3)""")
def span_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of decoded spans as the running half mean of their tokens' confidence, here made from the position."""
    arrays = annotated(spark, d).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("toks"))
    fixed = arrays.withColumn("tags", tg.repair(F.transform("toks", lambda x: tg.bioes_to_bio(x["tag"]))))
    each = F.transform("tags", lambda t, i: F.struct(t.alias("tag"), ((i % 4 + 1) / F.lit(4.0)).alias("confidence")))
    return fixed.select("sent_id", F.explode(tg.decode(each)).alias("s")).select("sent_id", "s.type", "s.first", F.round("s.confidence", 9).alias("confidence"))


# --- line formats of corpora, as lines made from whole tables ------------------------------------------------------------------
@query("conll_lines", f"with {_ANN}, a as (select sent_id, row_number() over (partition by sent_id order by pos) - 1 as pos, word, {_OK} as tag from ann), k as (select sent_id, dense_rank() over (order by sent_id) - 1 as s from (select distinct sent_id from a)) select cast(k.s as int) as sent_id, cast(pos as int) as pos, word, tag from a join k using (sent_id)")
def conll_lines(spark: SparkSession, d: str) -> DataFrame:
    """Annotated sentences written as one column file and read again: sentences keep their order, words their tags."""
    lines = corpora.to_conll(annotated(spark, d).where("word is not null"), "sent_id", "pos")
    return corpora.conll(lines).select(F.col("sent_id").cast("int").alias("sent_id"), F.col("pos").cast("int").alias("pos"), "word", "tag")


@query("wikiner_lines", f"with {_ANN}, a as (select sent_id, row_number() over (partition by sent_id order by pos) - 1 as pos, word, {_OK} as tag from ann), l as (select *, lag(tag) over (partition by sent_id order by pos) as pv from a) select sent_id, cast(pos as int) as pos, word, case when tag[1] = 'I' and coalesce(case when pv = 'O' then '' else substr(pv, 3) end, '') <> substr(tag, 3) then 'B-' || substr(tag, 3) else tag end as tag from l")
def wikiner_lines(spark: SparkSession, d: str) -> DataFrame:
    """Annotated sentences written with one a line and read again."""
    sents = annotated(spark, d).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("t"))
    # blanks within a word would end it
    lines = sents.select(F.lit("x").alias("path"), F.col("sent_id").alias("line_no"), F.array_join(F.transform("t", lambda x: F.concat_ws("|", F.replace(x["word"], F.lit(" "), F.lit("\u2420")), F.lit("X"), x["tag"])), " ").alias("line"))
    return corpora.wikiner(lines).select("sent_id", "pos", F.replace("word", F.lit("\u2420"), F.lit(" ")).alias("word"), "tag")


@query("cluster_lines", "with l as (select c_custkey as n, bin(c_custkey % 1000 + 1) as bits, lower('Word' || cast(c_custkey % 700 as varchar)) as word from customer) select word, max_by(bits, n) as path from l group by word")
def cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of bit paths and words; the last line of a word counts."""
    line = F.expr("concat(bin(c_custkey % 1000 + 1), '\t', 'Word', cast(c_custkey % 700 as string), '\t', cast(c_custkey as string))")
    return corpora.clusters(table(spark, d, "customer").select(F.col("c_custkey").alias("line_no"), line.alias("line")))


@query("vector_lines", "select 'v' || cast(vec_id as varchar) as word, cast(len(embedding) as int) as size, round(cast(embedding[1] as double), 4) as first, round(cast(embedding[len(embedding)] as double), 4) as last from embeddings")
def vector_lines(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as lines of numbers and read again."""
    line = F.concat_ws(" ", F.concat(F.lit("V"), F.col("vec_id").cast("string")), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))
    v = corpora.vectors(table(spark, d, "embeddings").select(line.alias("line")))
    return v.select("word", F.size("vec").alias("size"), F.round(F.element_at("vec", 1), 4).alias("first"), F.round(F.element_at("vec", -1), 4).alias("last"))


@query("weighted_lines", "select p_name as value, case when p_partkey % 3 = 0 then 1.0 else cast(p_size as double) end as weight, count(*) as n from part where trim(p_name) <> '' and not starts_with(p_name, '#') group by all")
def weighted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Generator lists with and without weights."""
    line = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("\t", "p_name", F.col("p_size").cast("string")))
    return corpora.weighted_list(table(spark, d, "part").select(line.alias("line"))).groupBy("value", "weight").agg(F.count(F.lit(1)).alias("n"))


_OCR = "o as (select request_id, tok_no, text, start_off, end_off, 40 + (request_id + tok_no) % 60 as conf from (select distinct request_id, tok_no, text, start_off, end_off from tokens where is_word and text is not null and not regexp_matches(text, '[\\s\\x{0b}]|\\p{Z}')))"


def _ocr(spark: SparkSession, d: str) -> DataFrame:
    """Words of requests as lines of a recognition report: a line a request, a pixel a character."""
    t = table(spark, d, "tokens").where("is_word and text is not null").where(~F.col("text").rlike(r"[\s\p{Z}]")).select("request_id", "tok_no", "text", "start_off", "end_off").distinct()
    line = F.concat_ws("\t", F.lit("5"), F.lit("1"), F.col("request_id").cast("string"), F.lit("1"), F.lit("1"), F.col("tok_no").cast("string"), F.col("start_off").cast("string"), F.lit("0"), (F.col("end_off") - F.col("start_off")).cast("string"), F.lit("10"), (40 + (F.col("request_id") + F.col("tok_no")) % 60).cast("string"), "text")
    return corpora.tesseract(t.select(F.lit("x").alias("path"), line.alias("line")))


@query("recognised_words", f"with {_OCR} select word, count(*) as n, cast(sum(conf) as bigint) as confidence, cast(sum(width) as double) as width from (select text as word, conf, end_off - start_off as width from o) group by word")
def recognised_words(spark: SparkSession, d: str) -> DataFrame:
    return _ocr(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence") * 100).cast("long").alias("confidence"), F.sum("width").alias("width"))


@query("recognised_lines", f"with {_OCR} select '1-' || cast(request_id as varchar) || '-1-1' as line_id, string_agg(text, ' ' order by start_off) as text, cast(count(*) as int) as words from o where conf >= 60 group by request_id")
def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    """Recognised words of enough confidence as lines."""
    return corpora.recognised_lines(_ocr(spark, d), 0.6).select("line_id", "text", F.size("words").alias("words"))


@query("blackened_boxes", f"with {_OCR}, p as (select *, coalesce(sum(length(text) + 1) over (partition by request_id order by start_off rows between unbounded preceding and 1 preceding), 0) as pos0 from o) select '1-' || cast(request_id as varchar) || '-1-1' as line_id, start_off - 1.5 as x, end_off - start_off + 3.0 as width from p where pos0 < 30 and 11 < pos0 + length(text)")
def blackened_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the words that the stretch 11 to 30 of every recognised line touches."""
    lines = corpora.recognised_lines(_ocr(spark, d))
    marks = lines.select("path", "page", "line_id", F.lit(11).alias("start"), F.lit(30).alias("end"))
    return corpora.boxes_of(lines, marks, ["path", "page", "line_id"]).select("line_id", "x", "width")


# --- documents and leaks -------------------------------------------------------------------------------------------------------
@query("whole_views", r"with s as (select doc_id, unnest(string_split_regex(text, '\n[\t\n\x0b\f\r ]*\n')) as text, generate_subscripts(string_split_regex(text, '\n[\t\n\x0b\f\r ]*\n'), 1) - 1 as no from documents where text is not null) select doc_id, string_agg(text, ' ' order by no) as view, cast(count(*) as int) as segments from s group by doc_id")
def whole_views(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of a post as one running text."""
    from palimpsest.catalog_more import segments

    return dc.whole_views(segments(spark, d), "doc_id", "seg_no").select("doc_id", "view", F.size("bounds").alias("segments"))


_PARTS = "concat('call +33 6', lpad(cast(c_custkey % 100 as {s}), 2, '0')) as a, concat(lpad(cast(c_custkey * 37 % 1000000 as {s}), 6, '0'), case when c_custkey % 4 = 0 then '' else ' now' end) as b"


@query("split_phone_leaks", f"with c as (select c_custkey, {_PARTS.format(s='varchar')} from customer), t as (select c_custkey, a || ' ' || b as text from c), m as (select c_custkey, text, regexp_extract(text, {_lit(dt.PHONE_PLUS)}) as v from t) select c_custkey as doc_id, 'PHONE' as type, cast(strpos(text, v) - 1 as int) as start_pos, cast(strpos(text, v) - 1 + length(v) as int) as end_pos from m where v <> ''")
def split_phone_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that stand in two segments and show only when these are joined."""
    c = table(spark, d, "customer").selectExpr("c_custkey as doc_id", *_PARTS.format(s="string").replace(" as a, concat(lpad", " as a|concat(lpad").split("|"))
    segs = c.select("doc_id", F.posexplode(F.array("a", "b")).alias("seg_no", "anonymized"))
    return vf.document_leaks(segs).where("type = 'PHONE'").select("doc_id", "type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("source_placeholders", r"select response_id, cast(len(regexp_extract_all(text, '⟦[A-Za-z0-9_]{1,128}⟧')) as int) as n from (select distinct response_id, text from responses where text is not null) where regexp_matches(text, '⟦[A-Za-z0-9_]{1,128}⟧')")
def source_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders that stand in a text already."""
    rows = table(spark, d, "responses").where("text is not null").select("response_id", "text").distinct()
    return rows.select("response_id", F.size(vf.residual_placeholders(F.col("text"))).alias("n")).where("n > 0")


@query("known_in_source", r"with q as (select request_id, min(text) as text from requests group by request_id), r as (select distinct response_id, request_id, entities from responses where entities is not null), x as (select response_id, regexp_replace(q.text, '⟦[A-Za-z0-9_]{1,128}⟧|\[[A-Z_]+_REDACTED\]|█+', '⟦', 'g') as source, unnest(entities) as ent from r join q using (request_id)) select distinct response_id from x where trim(ent.text) <> '' and regexp_matches(source, '(?i)(?:^|[^\p{L}\p{N}])' || regexp_escape(ent.text) || '(?:$|[^\p{L}\p{N}])')")
def known_in_source(spark: SparkSession, d: str) -> DataFrame:
    """Responses of which an entity stands, as a whole word in any case, in the text that was asked about."""
    rows = table(spark, d, "responses").where("entities is not null").select("response_id", "request_id", "entities").distinct().join(_once(spark, d).select("request_id", "text"), "request_id")
    surfaces = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type")))
    return rows.select("response_id", F.size(vf.known_entities(F.col("text"), surfaces)).alias("n")).where("n > 0").select("response_id").distinct()


@query("kept_weights", f"with {_ANN}, w as (select right(lower(word), 3) as f, {_OK} as label, count(*) as w from ann where word is not null group by all) select label, count(*) as n, cast(sum(case when w >= 5 then 1 else 0 end) as bigint) as kept from w group by label")
def kept_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a model that pruning keeps, by label; the model's features are word ends, a bounded set."""
    import numpy as np

    rows = annotated(spark, d).where("word is not null").groupBy(F.right(F.lower("word"), F.lit(3)).alias("f"), F.col("tag").alias("label")).agg(F.count(F.lit(1)).alias("w")).toPandas()
    labels = sorted(rows["label"].unique())
    weights: dict[str, np.ndarray] = {}
    for r in rows.itertuples():
        weights.setdefault(r.f, np.zeros(len(labels)))[labels.index(r.label)] = r.w
    model = crf.Model(labels, weights, np.zeros((len(labels), len(labels))), {})
    nonzero = lambda m: np.sum([w != 0 for w in m.weights.values()], axis=0).tolist() if m.weights else [0] * len(labels)
    out = list(zip(labels, nonzero(model), nonzero(model.prune(5))))
    return spark.createDataFrame(out, "label string, n bigint, kept bigint")

