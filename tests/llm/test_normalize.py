import unicodedata

from palimpsest.llm import canon, normalize


def forms(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.text: r.form for r in normalize.forms(df, "text").collect()}


def test_forms_agree_with_python(spark):
    texts = ["Flanoard", "Fｌanｏard", "ｽｶｸﾘ", "ｶﾞ", "Pel­kéville﻿", "Jo​nas ", "a ́b", "é", "ẹ́", "ẹ́", "덴쮈", unicodedata.normalize("NFD", "덴쮈"), "", "  a  b ", "​", "Κesbecοurt", "x" * 5000 + "é"]
    got = forms(spark, texts + texts)
    assert got == {t: canon.skeleton(t) for t in texts}
    assert got["ẹ́"] == got["ẹ́"]
    assert got["Κesbecοurt"] == "Kesbecourt"


def test_lookalike_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "Flanoаrd", "x"), (1, 0, "Flanoаrd", "x"), (1, 1, "Flanoard", "x"), (1, 2, "FLANOARD", "x"), (1, 3, None, "x"), (2, 0, "Val\u00a0Tam", "x")], "request_id long, tok_no int, text string, term_id string")
    gaz = spark.createDataFrame([(1, "Flanoard;3"), (2, "# Flanoard"), (3, "Val Tam\t7"), (4, None), (5, "Flanoard"), (6, "")], "term_id int, line string")
    got = sorted(tuple(r) for r in normalize.lookalike_tokens(tokens, gaz).collect())
    assert got == [(1, 0, 1), (1, 0, 5), (2, 0, 3)]
    assert normalize.lookalike_tokens(tokens.limit(0), gaz).count() == 0


def test_canonicalize_whole_texts(spark):
    df = spark.createDataFrame([(1, "Ｈello\n wörld​ "), (1, "Ｈello\n wörld​ "), (2, None), (3, ""), (4, "a\tb")], "form int, text string")
    got = sorted(((r["form"], r["out"]) for r in normalize.canonicalize(df, ["form"], "text", "out").collect()), key=str)
    assert got == [(1, "Hello wörld"), (2, None), (3, ""), (4, "a b")]
