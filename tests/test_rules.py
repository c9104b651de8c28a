import random

import pytest
from pyspark.sql import functions as F

from palimpsest import session
from palimpsest.functions import checksums as cs
from palimpsest.functions.regexlib import MARK, find_all
from palimpsest.operators import detectors as dt
from palimpsest.operators import documents as dc
from palimpsest.sources import corpora
from palimpsest.synth import generate


def test_months_of_social_security_numbers(spark):
    def number(month):
        body = f"185{month:02d}75116042"
        return body + f"{97 - int(body) % 97:02d}"

    got = [r.ok for r in spark.createDataFrame([(m, number(m)) for m in range(100)], "m int, s string").orderBy("m").select(cs.nir(F.col("s")).alias("ok")).collect()]
    assert got == [1 <= m <= 12 or m == 20 or 30 <= m <= 42 or m >= 50 for m in range(100)]


@pytest.mark.parametrize("form", list(generate.PERSON_FORMS))
def test_titles_and_labels_stay_outside_names(form):
    writer = generate.Writer(generate.DEFAULT_LISTS, random.Random(5))
    pieces = writer.person(_value(form))
    names = [t for t, named in pieces if named]
    rest = "".join(t for t, named in pieces if not named)
    assert len(names) == (2 if form in ("nom_naissance", "nom_prenom_etiquette", "couple") else 1)
    for n in names:
        assert not any(x in n.split() for x in ("M.", "Mme", "Dr", "Pr", "Me", "(Née", "Prénom", ":")) and "(" not in n
    if form.startswith(("civ", "titre")) or form == "nom_naissance":
        assert rest.split()[0] in ("M.", "Mme", "Dr", "Pr", "Me")


def _value(form):
    class Asked:
        kind, slot = "PER", "x"

        @staticmethod
        def arg(name, default=None):
            return form if name == "form" else default

    return Asked()


def test_private_use_signs_stay_in_spans(spark):
    text = f"a{MARK}b@x.org {MARK}{MARK} c@y.org"
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(find_all(F.col("t"), r"[^ @]+@[^ ]+").alias("m")).collect()[0].m
    assert [(x.text, x.start, x.end) for x in found] == [(f"a{MARK}b@x.org", 0, 9), ("c@y.org", 13, 20)]
    assert all(text[x.start : x.end] == x.text for x in found)


def test_needs_rules_no_match_out(spark):
    """Every detector finds the same with and without its cheap test."""
    from dataclasses import replace

    texts = ["::1 x", "fe80::1", "1:2:3:4:5:6:7:8", "10.0.0.1", "FR76 3000 1007 9412 3456 7890 185", "321 456 782 00002", "321456782", "+33612345678", "06.12.34.56.78", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c", "sk-" + "a" * 22, "AKIA" + "A" * 16, "ghp_" + "a" * 36, "xoxb-" + "1" * 20, "rk_live_" + "a" * 24, "bearer " + "a" * 20, "my_PASSWORD=hunter22", "apiſecret=hunter22", "a.b+c@d.org", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for d in dt.ALL:
        both = df.select(F.coalesce(d.matches(F.col("t")), F.array()).cast("string").alias("a"), F.coalesce(replace(d, needs="").matches(F.col("t")), F.array()).cast("string").alias("b")).collect()
        assert all(r.a == r.b for r in both), d.type


def test_whole_views_and_corpus_lines(spark):
    segs = spark.createDataFrame([(1, 0, "ab"), (1, 2, None), (1, 1, "cd"), (2, 0, "")], "doc int, no int, text string")
    rows = {r.doc: (r.view, [tuple(b) for b in r.bounds]) for r in dc.whole_views(segs, "doc", "no").collect()}
    assert rows == {1: ("ab cd ", [(0, 0, 2), (1, 3, 5), (2, 6, 6)]), 2: ("", [(0, 0, 0)])}
    toks = spark.createDataFrame([(7, 0, "a", "B-X"), (7, 1, "b", "O"), (9, 0, "c", "O")], "s bigint, pos int, word string, tag string")
    back = corpora.conll(corpora.to_conll(toks, "s", "pos")).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.pos, r.word, r.tag) for r in back] == [(0, 0, "a", "B-X"), (0, 1, "b", "O"), (1, 0, "c", "O")]
    assert [r.line for r in corpora.to_jsonl(toks.where("s = 9"), "word", "tag").collect()] == ['{"word":"c","tag":"O"}']
    paths = spark.createDataFrame([("01", "w", 3)], "path string, word string, n int")
    assert corpora.clusters(corpora.to_clusters(paths).withColumn("line_no", F.lit(0))).collect()[0].path == "01"


def test_spread_keeps_rows(spark):
    df = spark.range(100)
    assert session.spread(df).count() == 100 and session.spread(df.distinct()).count() == 100
