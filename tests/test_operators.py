import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import anonymize as an
from palimpsest.operators import brown, crf, documents, evaluate, filters, langid, passes, spans, tags, tokens
from palimpsest.operators import detectors as dt
from palimpsest.operators import verify as vf
from palimpsest.operators.features import Extractor
from palimpsest.plans import pipeline
from palimpsest.session import checkpoint
from palimpsest.types import ENTITIES

TEXT = "Mail a.b@c.org, ip 192.168.1.10 and A.B@C.ORG\nDB_PASSWORD=hunter22 tel +33612345678 end"


def found(spark, text, detectors=dt.ALL):
    return [(e.type, e.text) for e in spark.createDataFrame([(text,)], "text string").select(dt.detect(F.col("text"), detectors).alias("e")).first().e]


HITS = [
    ("x a.b+c@d-e.co.uk y", [("EMAIL", "a.b+c@d-e.co.uk")]), ("256.1.1.1", []), ("at 10.0.0.255.", [("IPV4", "10.0.0.255")]), ("fe80::1 z", [("IPV6", "fe80::")]), ("IBAN FR76 3000 1007 9412 3456 7890 185", [("IBAN", "FR76 3000 1007 9412 3456 7890 185")]),
    ("n 321 456 782 00002", [("SIRET", "321 456 782 00002")]), ("n 321456782.", [("SIREN", "321456782")]), ("n 321456783.", []), ("06 12-34 56 78", [("PHONE", "06 12-34 56 78")]), ("+33612345678", [("PHONE", "+33612345678")]),
    ("eyJabcdefghijk.eyJabcdefghijk.sig", [("JWT", "eyJabcdefghijk.eyJabcdefghijk.sig")]), ("sk-" + "a" * 24, [("API_KEY", "sk-" + "a" * 24)]), ("AKIA" + "A" * 16, [("API_KEY", "AKIA" + "A" * 16)]), ("bearer  " + "x" * 24, [("API_KEY", "x" * 24)]),
    ("db_pass: abcd", [("SECRET", "abcd")]), ("say pass: abcd", []), ("ghp_" + "a1" * 18, [("API_KEY", "ghp_" + "a1" * 18)]), (None, []), ("", []),
]


def test_detectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HITS)], "id int, text string")
    got = {r.id: [(e.type, e.text) for e in r.entities] for r in dt.with_entities(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(HITS)}


def test_contextual_number(spark):
    assert found(spark, "RCS : Dijon 321456782", [dt.CONTEXTUAL_SIREN]) == [("SIREN", "321456782")]
    assert found(spark, "FINESS ET 602453193", [dt.CONTEXTUAL_SIREN]) == []


def run(spark, text, **options):
    df = dt.with_entities(spark.createDataFrame([(text,)], "text string"))
    return an.anonymize(df, **options).first()


def test_strategies(spark):
    r = run(spark, TEXT)
    assert r.anonymized == "Mail ⟦EMAIL_1_000000⟧, ip ⟦IPV4_1_000000⟧ and ⟦EMAIL_1_000000⟧\nDB_PASSWORD=⟦SECRET_REDACTED⟧ tel ⟦PHONE_1_000000⟧ end"
    assert r.mapping == {"⟦EMAIL_1_000000⟧": "a.b@c.org", "⟦IPV4_1_000000⟧": "192.168.1.10", "⟦PHONE_1_000000⟧": "+33612345678"}
    assert r.original_to_placeholder["A.B@C.ORG"] == "⟦EMAIL_1_000000⟧"
    assert "[redacted 8 bytes]" in [e.text for e in r.entities] and "hunter22" not in str((r.anonymized, r.mapping, r.original_to_placeholder, r.entities))
    assert run(spark, TEXT, strategy="redact").mapping == {} and run(spark, TEXT, strategy="redact").anonymized.count("█" * 6) == 4
    assert run(spark, TEXT, consistent=False).anonymized.startswith("Mail ⟦EMAIL_1_000000⟧") and "⟦EMAIL_2_000000⟧" in run(spark, TEXT, consistent=False).anonymized
    assert run(spark, TEXT, legacy=True).anonymized.startswith("Mail [EMAIL_1], ip [IPV4_1]")
    keyed = run(spark, TEXT, strategy="keyed", key=bytes(32)).anonymized
    assert keyed == run(spark, TEXT, strategy="keyed", key=bytes(32)).anonymized
    assert run(spark, TEXT, replacers={"EMAIL": lambda t, i: F.concat(F.lit("mail"), i.cast("string"))}).anonymized.startswith("Mail mail1, ip")
    assert run(spark, None).anonymized is None and run(spark, "").anonymized == ""
    with pytest.raises(ValueError):
        run(spark, TEXT, strategy="other")
    with pytest.raises(ValueError):
        run(spark, TEXT, block=65)


def test_same_text_without_consistency_shares_the_last_index(spark):
    assert run(spark, "a@b.co a@b.co", consistent=False).anonymized == "⟦EMAIL_2_000000⟧ ⟦EMAIL_2_000000⟧"


def test_round_trip_and_leaks(spark):
    rng = random.Random(2)
    pieces = ["a.b@c.org", "192.168.1.10", "+33612345678", " été ", "⟦x", "\n", "word", "321456782", "::", ".", "A.B@C.ORG"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))) for i in range(120)]
    df = dt.with_entities(spark.createDataFrame(rows, "id int, text string"), detectors=dt.BUILTIN)
    out = an.anonymize(df, mark=an.nonce(F.col("id")))
    for r in out.select("text", an.deanonymize(F.col("anonymized"), F.col("mapping")).alias("back"), an.unresolved(F.col("text")).alias("u")).collect():
        assert r.back.lower() == r.text.lower() and r.u == []
    leaks = vf.verify(checkpoint(passes.apply_passes(out, passes=("consistency",)))).select(F.explode("leaks").alias("l")).where("l.kind = 'known-entity'").count()
    assert leaks == 0


def test_verification(spark):
    e = [("Jean Dupont", "PER", 0, 11, 1.0)]
    df = spark.createDataFrame([("Jean Dupont ⟦EMAIL_1_abcdef⟧", "Bonjour JEAN DUPONT, Jeanne, 321456783 et ⟦PERSON_1_a⟧", e), ("x", "ok", [])], f"text string, anonymized string, entities {ENTITIES}")
    got = [[(x.kind, x.type, x.start, x.end) for x in r.leaks] for r in vf.verify(df).collect()]
    assert got == [[("known-entity", "PER", 8, 19), ("residual-placeholder-source", "", 12, 28), ("regex-hit", "SIREN", 29, 38)], []]
    clean, bad = vf.strict(vf.verify(df))
    assert clean.count() == 1 and "anonymized" not in bad.columns


def test_session_numbers(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(20_000), f"u{rng.randrange(150)}@x.org", rng.choice(["EMAIL", "PER"]), rng.randrange(50)) for _ in range(900)] + [(None, 1, "a", "PER", 0), ("s1", None, "a", "PER", 0), ("s1", 1, "k", "SECRET", 0)]
    df = spark.createDataFrame(rows, "session string, seg long, text string, type string, start int")
    got = {(r.session, r.key): (r.type, r["index"]) for r in an.number_session(df, "session", "seg").collect()}
    want, counts = {}, {}
    order = {"PER": 4}
    for s, seg, t, y, a in sorted((r for r in rows if r[0] and r[1] is not None and r[3] != "SECRET"), key=lambda r: (r[0], r[1], -order.get(r[3], 0), r[4], r[3], r[2])):
        if (s, t) not in want:
            counts[s, y] = counts.get((s, y), 0) + 1
            want[s, t] = (y, counts[s, y])
    assert got == want


def test_filters(spark):
    e = [("Paris", "LOC", 0, 5, 0.4), ("Jean de la Tour", "PER", 6, 21, 0.9), ("Claire", "LOC", 22, 28, 0.8)]
    df = spark.createDataFrame([(e,)], f"e {ENTITIES}")
    names = lambda c: [x.text for x in df.select(c.alias("o")).first().o]
    c = F.col("e")
    assert names(filters.min_confidence(c, 0.5)) == ["Jean de la Tour", "Claire"]
    assert names(filters.max_tokens(c, 2)) == ["Paris", "Claire"] and len(names(filters.max_tokens(c, 0))) == 3
    assert names(filters.min_runes(c, 6)) == ["Jean de la Tour", "Claire"]
    assert names(filters.blocklist(c, "LOC", ["paris"])) == ["Jean de la Tour", "Claire"]
    assert [x.type for x in df.select(filters.reclassify(c, F.array(F.lit("claire"))).alias("o")).first().o] == ["LOC", "PER", "PER"]
    assert names(filters.only_types(c, F.array(F.lit("PER")))) == ["Jean de la Tour"]


def test_merge_and_reconcile_are_stable(spark):
    rng = random.Random(4)
    for _ in range(5):
        e = [("x", rng.choice(["PER", "LOC"]), a, a + rng.randrange(1, 5), 1.0) for a in (rng.randrange(30) for _ in range(8))]
        df = spark.createDataFrame([(e, e[:3])], f"a {ENTITIES}, b {ENTITIES}")
        once = df.select(spans.reconcile(F.col("a"), F.col("b")).alias("r")).first().r
        assert all(x.end <= y.start for x, y in zip(once, once[1:]))


def test_tags(spark):
    rows = [(1, i, w, t) for i, (w, t) in enumerate([("a", "I-PER"), ("b", "I-PER"), ("c", "O"), ("d", "B-LOC"), ("e", "I-ORG"), ("f", "I-ORG")])]
    df = spark.createDataFrame(rows, "sent_id int, pos int, word string, tag string")
    ordered = lambda d: [r.tag for r in d.orderBy("pos").collect()]
    two = tags.iob1_to_iob2(df, ["sent_id"], "pos")
    assert ordered(two) == ["B-PER", "I-PER", "O", "B-LOC", "B-ORG", "I-ORG"]
    five = tags.bio_to_bioes(two, ["sent_id"], "pos")
    assert ordered(five) == ["B-PER", "E-PER", "O", "S-LOC", "B-ORG", "E-ORG"]
    assert ordered(five.withColumn("tag", tags.bioes_to_bio(F.col("tag")))) == ordered(two)
    arr = df.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("t"))
    assert arr.select(tags.repair(F.col("t")).alias("t")).first().t == ordered(two)
    toks = F.expr("array(named_struct('tag','B-PER','confidence',1.0D), named_struct('tag','I-PER','confidence',0.5D), named_struct('tag','I-PER','confidence',0.5D), named_struct('tag','O','confidence',1.0D))")
    d = spark.range(1).select(tags.decode(toks).alias("d")).first().d
    assert [(x.type, x.first, x.last, x.confidence) for x in d] == [("PER", 0, 2, 0.625)]
    assert [r.kind for r in tags.violations(df, ["sent_id"], "pos").collect()] == ["orphan", "orphan"]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "L'homme sous-marin. Fini…\n\n  Oui 2")], "id int, text string")
    got = [(r.text, r.start, r.end, r.line_no, r.sent_no) for r in tokens.token_rows(df, ["id"]).orderBy("start").collect()]
    assert got == [("L'", 0, 2, 0, 0), ("homme", 2, 7, 0, 0), ("sous-marin", 8, 18, 0, 0), (".", 18, 19, 0, 0), ("Fini", 20, 24, 0, 1), ("…", 24, 25, 0, 1), ("Oui", 29, 32, 2, 0), ("2", 33, 34, 2, 0)]
    assert tokens.token_rows(df, ["id"], lang="en").where("text = 'sous'").count() == 1


def _toy():
    rng = random.Random(5)
    names, verbs = ["Nora", "Hugo", "Paul", "Rosa"], ["runs", "sleeps", "sings"]
    out = []
    for _ in range(60):
        out.append(([rng.choice(names), rng.choice(names).upper(), rng.choice(verbs), "in", "Brest"], ["B-PER", "I-PER", "O", "O", "B-LOC"]))
    return out


def test_crf_learns_and_saves(spark, tmp_path):
    data = _toy()
    ex = Extractor("en")
    model = crf.train(data[:40], data[40:50], ex, epochs=3)
    assert crf.token_f1(model, data[50:], ex) > 0.95
    em = model.emissions(ex.sentence(data[0][0]))
    assert abs(model.marginals(em).sum(axis=1) - 1).max() < 1e-9
    df = spark.createDataFrame([(1, data[0][0]), (2, []), (3, None)], "id int, words array<string>")
    rows = {r.id: r.tags for r in crf.predict(df, model, ex).collect()}
    assert rows == {1: data[0][1], 2: [], 3: []}
    crf.save(spark, model.prune(0.001), str(tmp_path / "m"))
    again = crf.load(spark, str(tmp_path / "m"))
    assert again.predict(ex.sentence(data[1][0]))[0] == data[1][1]
    assert crf.config_warnings(model, Extractor("fr")) and not crf.config_warnings(model, ex)


def test_crf_gradient_is_right():
    data = _toy()[:1]
    ex = Extractor("en", window=1)
    m = crf.Model(["O", "B-PER", "I-PER", "B-LOC", "I-LOC"])
    fs, ys = ex.sentence(data[0][0]), [["O", "B-PER", "I-PER", "B-LOC", "I-LOC"].index(t) for t in data[0][1]]
    g, t, base = crf.gradient(m, fs, ys)
    import numpy as np

    for name in list(g)[:5]:
        m.weights[name] = np.zeros(5)
        m.weights[name][1] += 1e-5
        assert abs((crf.gradient(m, fs, ys)[2] - base) / 1e-5 - g[name][1]) < 1e-3
        del m.weights[name]


def test_crf_distributed(spark):
    df = spark.createDataFrame([(w, t) for w, t in _toy()], "words array<string>, tags array<string>").repartition(3)
    m = crf.train_distributed(df, Extractor("en"), ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"], epochs=4)
    assert crf.token_f1(m, _toy()[:20], Extractor("en")) > 0.9


def test_brown_separates_kinds():
    words = {"n": ["nora", "hugo", "paul"], "v": ["runs", "sings", "sits"]}
    rng = random.Random(6)
    bi, uni = {}, {}
    for _ in range(600):
        a, b = rng.choice(words["n"]), rng.choice(words["v"])
        bi[a, b] = bi.get((a, b), 0) + 1
        bi[b, "the"] = bi.get((b, "the"), 0) + 1
        for w in (a, b, "the"):
            uni[w] = uni.get(w, 0) + 1
    paths = brown.cluster(sorted(uni.items(), key=lambda x: (-x[1], x[0])), bi, 3)
    assert set(paths) == set(uni) and len(set(paths.values())) == len(paths)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(paths[a], paths[b])) if x != y), min(len(paths[a]), len(paths[b])))
    assert common("nora", "hugo") > common("nora", "runs")


def test_language(spark):
    rows = [("fr", "le chat est dans la maison avec les enfants et ils jouent"), ("en", "the cat is in the house with the children and they play"), ("es", "el gato está en la casa con los niños y ellos juegan")]
    prof = langid.profiles(spark.createDataFrame(rows * 3, "lang string, text string"))
    df = spark.createDataFrame([(1, "les enfants jouent dans la maison"), (2, "they play in the house"), (3, "los niños juegan en la casa"), (4, ""), (5, None)], "id int, text string")
    assert {r.id: r.lang for r in langid.checked(langid.detect(df, ["id"], prof)).collect()} == {1: "fr", 2: "en", 3: "es"}


def test_views(spark):
    df = spark.createDataFrame([(1, 0, "write to a.b@c"), (1, 1, ".org now"), (1, 2, "sous-"), (1, 3, "marin 192.168."), (1, 4, "x")], "doc_id int, seg_no int, text string")
    views = [r.view for r in documents.pair_views(df, "doc_id", "seg_no").orderBy("seg_no").collect()]
    assert views[2] == "sousmarin 192.168."
    cut = spark.createDataFrame([(1, 0, "tel +33 612-"), (1, 1, "345678 ok")], "doc_id int, seg_no int, text string")
    got = {r.seg_no: [e.text for e in r.entities] for r in documents.detect_in_views(spark.createDataFrame([(1, 0, "tel +33 612"), (1, 1, "345678 ok")], "doc_id int, seg_no int, text string"), "doc_id", "seg_no", detectors=dt.BUILTIN).collect()}
    assert got == {0: ["+33 612"], 1: ["345678"]}
    assert documents.detect_in_views(cut.limit(0), "doc_id", "seg_no").count() == 0
    assert documents.sample_text(df, "doc_id", "seg_no", limit=16).first().sample == "write to a.b@c\n.org now"


def test_passes():
    mapping = {"⟦PERSON_1_a⟧": "Jean Dupont", "⟦PERSON_2_a⟧": "Anne Leroy", "⟦EMAIL_1_a⟧": "x@y.fr"}
    assert passes.consistent("⟦PERSON_1_a⟧ puis DUPONT et jean dupont, Dupontel", mapping) == "⟦PERSON_1_a⟧ puis ⟦PERSON_1_a⟧ et ⟦PERSON_1_a⟧, Dupontel"
    assert passes.complete_surnames("Jean Dupont Martin est", "⟦PERSON_1_a⟧Martin est", mapping) == "⟦PERSON_1_a⟧ est"


def test_scores(spark):
    gold = spark.createDataFrame([(1, "PER", 0, 4), (1, "LOC", 5, 9), (2, "PER", 0, 3)], "id int, type string, start int, end int")
    pred = spark.createDataFrame([(1, "PER", 0, 4), (1, "PER", 5, 9), (2, "EMAIL", 0, 3)], "id int, type string, start int, end int")
    rows = {r.type: (r.gold, r.predicted, r.matched) for r in evaluate.scores(gold, pred, ["id"]).collect()}
    assert rows == {"PER": (2, 2, 1), "LOC": (1, 0, 0), "EMAIL": (0, 1, 0), "ALL": (3, 3, 1)}


def test_pipeline(spark):
    df = spark.createDataFrame([(1, "⟦EMAIL_1_x⟧ mail a@b.co, token: abcdef"), (2, None)], "id int, text string")
    rows = {r.id: r for r in pipeline.run(df, pipeline.Options(passes=("consistency",), types=["EMAIL"], strict=True), ids=["id"]).collect()}
    assert rows[1].anonymized is None and [x.kind for x in rows[1].leaks] == ["residual-placeholder-source"]
    assert rows[2].anonymized is None
    ok = pipeline.run(spark.createDataFrame([(1, "mail a@b.co")], "id int, text string"), pipeline.Options(strict=True), ids=["id"]).first()
    assert ok.anonymized.startswith("mail ⟦EMAIL_1_") and ok.leaks == []


def test_brown_query_takes_every_frequent_word(spark):
    from palimpsest import catalog_more
    from palimpsest.catalog import annotated

    d = "/root/testdata/sf0.01"
    want = {r["word"] for r in tokens.vocabulary(annotated(spark, d), "word", 5).collect()}
    got = [r.word for r in catalog_more.brown_clusters(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 120


def test_brown_merges_lose_least():
    """The first merge is the one of all pairs that leaves most mutual information, counted anew."""
    import math

    for seed in range(5):
        rng = random.Random(seed)
        words = [f"w{k}" for k in range(7)]
        bi = {(a, b): rng.randint(1, 9_999) for a in words for b in words if rng.random() < 0.7}

        def information(of):
            cell, out, into = {}, {}, {}
            for (a, b), n in bi.items():
                for m, k in ((cell, (of[a], of[b])), (out, of[a]), (into, of[b])):
                    m[k] = m.get(k, 0) + n
            return sum(n * math.log(n / (out[a] * into[b])) for (a, b), n in cell.items())

        best = max(((a, b) for k, a in enumerate(words) for b in words[k + 1 :]), key=lambda p: information({w: p[0] if w == p[1] else w for w in words}))
        paths = brown.cluster([(w, 9 - k) for k, w in enumerate(words)], bi, 7)
        assert paths[best[0]][:-1] == paths[best[1]][:-1]


SPANS = "array<struct<text:string,type:string,start:int,end:int,confidence:double>>"


def test_reconcile_written_cases(spark):
    rows = [(1, [("abcdefghij", "X", 0, 10, 1.0)], [("cde", "Y", 2, 5, 1.0), ("uvwxy", "Y", 20, 25, 1.0)]), (2, [("abcd", "X", 0, 4, 1.0)], [("abcd", "Z", 0, 4, 1.0), ("ef", "Y", 4, 6, 1.0)])]
    df = spark.createDataFrame(rows, f"id int, a {SPANS}, b {SPANS}").select("id", F.inline(spans.reconcile(F.col("a"), F.col("b"))))
    assert {tuple(r) for r in df.select("id", "type", "start", "end").collect()} == {(1, "X", 0, 10), (1, "Y", 20, 25), (2, "X", 0, 4), (2, "Y", 4, 6)}


def test_merge_written_cases(spark):
    rows = [(1, [("Jean ", "PER", 0, 5, 0.9), ("Dupont", "PER", 5, 11, 0.5)]), (2, [("V", "ORG", 0, 1, 0.9), ("al", "LOC", 1, 3, 0.5), ("x", "PER", 4, 5, 0.5)])]
    df = spark.createDataFrame(rows, f"id int, a {SPANS}").select("id", F.inline(spans.merge(F.col("a"))))
    assert {tuple(r) for r in df.select("id", "text", "type", "start", "end").collect()} == {(1, "Jean Dupont", "PER", 0, 11), (2, "Val", "ORG", 0, 3), (2, "x", "PER", 4, 5)}


def test_page_class_written_cases(spark):
    df = spark.createDataFrame([(1, 0.9, 10, 0), (2, 0.5, 99, 40), (3, 0.9, 100, 40), (4, 0.4, 0, 9)], "id int, images double, visible int, invisible int")
    got = df.select("id", documents.page_class(F.col("images"), F.col("visible"), F.col("invisible")))
    assert {tuple(r) for r in got.collect()} == {(1, "raster"), (2, "hybrid"), (3, "normal"), (4, "normal")}


def test_csv_header_written_cases():
    from palimpsest.sources import csvtext

    for text, separator, header in (("nom;ville\nPaul;Brest 2\n", ";", True), ("1,2\n3,4\n", ",", False), ("name\tmail\nx\ta@b.co\n", "\t", True), ("a,b\nc,d\n", ",", False)):
        r = csvtext.read_rows(text)
        assert (csvtext.sniff_separator(text), csvtext.looks_like_header(r[0], r[1])) == (separator, header)


def test_complete_names_written_cases(spark):
    rows = [(1, "Claire Martel est là", [("Claire", "PER", 0, 6, 1.0)]), (2, "Hugo est là", [("Hugo", "PER", 0, 4, 1.0)]), (3, "Nora Brest", [("Nora", "PER", 0, 4, 1.0), ("Brest", "LOC", 5, 10, 1.0)])]
    names, stop = F.array(F.lit("claire"), F.lit("hugo"), F.lit("nora")), F.array(F.lit("est"))
    df = spark.createDataFrame(rows, f"id int, t string, e {SPANS}").select("id", F.explode(filters.complete_names(F.col("t"), F.col("e"), names, stop)).alias("x"))
    assert {tuple(r) for r in df.where("x.type = 'PER'").select("id", "x.text").collect()} == {(1, "Claire Martel"), (2, "Hugo"), (3, "Nora")}


def test_queries_of_spans_read_their_whole_tables(spark):
    import __spark_entry__ as entry
    from palimpsest import catalog
    from palimpsest.session import table

    d, names = "/root/testdata/sf0.001", entry.queries()
    assert not {"page_classes", "csv_header_cases"} & set(names)
    want = set()
    for r in catalog.texts(spark, d).where("text is not null").withColumn("entities", dt.detect(F.col("text"))).collect():
        kept = []
        for e in sorted(r.entities, key=lambda e: e.start):
            if kept and kept[-1][3] == e.start and (kept[-1][1] == e.type or e.type == "LOC"):
                kept[-1] = (kept[-1][0] + e.text, kept[-1][1], kept[-1][2], e.end)
            else:
                kept.append((e.text, e.type, e.start, e.end))
        want |= {(r.src, r.rec_id, *k) for k in kept}
    assert {tuple(r) for r in names["merged_spans"](spark, d).collect()} == want and want
    texts = {r.request_id: r.text for r in table(spark, d, "requests").collect()}
    grown = names["completed_names"](spark, d).collect()
    assert all(texts[r.request_id][r.start : r.end] == r.text for r in grown) and any(" " in r.text for r in grown)
    last = {}
    found = names["reconciled_views"](spark, d).collect()
    for r in sorted(found, key=lambda r: (r.src, r.rec_id, r.start)):
        assert r.start >= last.get((r.src, r.rec_id), 0)
        last[r.src, r.rec_id] = r.end
    assert {r.src for r in found} == {"documents", "requests"}
