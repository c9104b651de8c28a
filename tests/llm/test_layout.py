import random

from palimpsest.llm import language, layout, pii, sampling

POST = "rook-12 wrote:\n> [b]Bold[/b] text &amp; more​\n> wraps <br/>here\n\nOwn words <font color=red>with</font> ｆｕｌｌ é width\r\n\n[quote=x]inner &laquo;q&raquo; text[/quote] after\n\n-- \nsig < not a tag"


def test_text_without_positions_is_that_of_flow():
    rng = random.Random(1)
    for _ in range(200):
        lines = POST.split("\n")
        rng.shuffle(lines)
        text = "\n".join(lines)
        bs = layout.blocks(text)
        skip = layout.quoted(text, bs)
        for block in bs:
            for s in ((), skip):
                assert layout.flow_text(text, block, s) == layout.flow(text, block, skip=s).text


def test_a_long_tag_is_markup():
    text = "a <font color=" + "x" * 5000 + ">b</font> c"
    assert layout.flow_text(text, layout.blocks(text)[0]) == "a b c"


def test_left_parses_change_nothing():
    ident = language.seeded()
    for text in ("the others had waited for us", "nous avons attendu", "wir haben es gewusst und then we left", "友だちのように", "xx qq", "он ждал us there", "", "ß"):
        full = {code: a.phrases(text) * a.bits / max(1, len(text)) for code, a in ident.automata.items()}
        order = sorted(full, key=lambda c: (full[c], c))
        best, confidence, rates = ident._classify(text)
        assert best == order[0] == ident._language_of(text)
        assert confidence == (round(1 - full[order[0]] / full[order[1]], 6) if full[order[1]] else 0.0)
        for code in full:
            # exact, or a lower bound that is no longer near the best
            assert rates[code] == full[code] or full[code] >= rates[code] > full[order[0]] / language.MARGIN


def test_numbers_beside_each_other():
    spans = lambda s: {s[a:b] for a, b in pii._number_spans(s, 0, len(s))}
    assert spans("0612345678") == {"0612345678"}
    assert {"0612345678", "0698765432"} <= spans("0612345678/0698765432")
    assert {"+33 6 12 34 56 78", "06 98 76 54 32"} <= spans("+33 6 12 34 56 78 06 98 76 54 32")
    assert {"0612345678", "0698765432", "0611111111", "0622222222"} <= spans("0612345678 0698765432 0611111111 0622222222")


def test_smallest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    whole = [r.k for r in df.orderBy(sampling.F.xxhash64("k"), "k").limit(100).collect()]
    assert [r.k for r in sampling.smallest(df, 100, "k").collect()] == whole
    assert sampling.smallest(df.limit(0), 10, "k").count() == 0 and sampling.smallest(df.limit(7), 10, "k").count() == 7
