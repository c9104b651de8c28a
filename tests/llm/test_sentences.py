import pytest

from palimpsest.llm import sentences as s

CASES = [
    "Mr. Dalby told us it costs 3.50 € incl. tax.| See fig. 4 first!|  Done",
    "She wrote \"wait...\" and left.| \"Is it finished?\" asked Dr. Weiss.| (It worked.)| Fine",
    "Il a dit : « Pas aujourd'hui. »| Cela coûte 3,54 € env., port compris.| Oui",
    "Es kam am 3. Oktober an, z. B. bei Val.| „Noch nicht!“, kam als Antwort.| Gut",
    "他只说：“今天不行。”|我觉得很好，大约是3.5%。|“弄好了吗？”版主问。|好",
    "「もう終わりましたか？」と聞きました。|はい",
    "खाता गिर गया।| “हो गया?” उसने पूछा।| डॉ. साहब आए।| ठीक",
    "Это стоит ок. 3,5 тыс. руб., т. е. недорого.| «Готово?» — спросил он.| Да",
    "قال د. سمير إن المسافة قصيرة.| هل رأى أحد هذا؟| نعم",
    "ผมคิดว่าซุปนี้อร่อยประมาณ 3.5 เปอร์เซ็นต์| ราคา 50 บาทต่อชิ้นครับ| เท่าที่รู้ซุปนี้ดี",
    "Lt. Harrow met Gen. Weyland at Ft. Dunmore.| Sen. Abbot came later.| Done",
    "នេះជាប្រយោគទីមួយ។| នេះជាប្រយោគទីពីរ។| ចប់",
    "ဒါက ပထမ စာကြောင်းပါ။| ဒါက ဒုတိယ စာကြောင်းပါ။| ပြီးပြီ",
    "ይህ የመጀመሪያው ነው።| ይህ ሁለተኛው ነው።| አበቃ",
    "Τι ώρα είναι;| Δεν ξέρω.| Καλά",
    "ຂ້ອຍກິນເຂົ້າແລ້ວ| ຂ້ອຍຢາກນອນ",
    "We follow e.g. p. p. p. p. p. p. p. p. p. p. p. p. p. p. p. 5 here.| Done",
]


def test_any_script_is_read():
    """Blocks of any script, with blanks and without, alone and mixed: no failure, and ends in order within the text."""
    for chars in ("\u0e01\u0e32", "\u0ea5\u0eb2", "\u1780\u17b6", "\u1000\u102c", "\u1200", "\u0f40", "\u0633", "\u0915", "\uac00", "\u3042", "\u4e00", "\u0e2f\u0ebd", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")):
        for text in (f"{chars * 3} {chars * 4} {chars}", f"Hello {chars * 2} {chars}. World {chars}! {chars * 3} x", f"{chars}។ {chars}။ {chars}", f"{chars * 2} \"{chars} {chars}\" {chars}"):
            found = s.ends(text)
            assert found == sorted(set(found)) and all(0 < e < len(text) for e in found)


def test_quotes_and_brackets_of_any_length():
    inside = "It rained all day. " * 30
    assert s.ends(f'He wrote "{inside}and so on" to us. Then he left') == [len(f'He wrote "{inside}and so on" to us.')]
    assert s.ends(f"He left ({inside}really). Then we ate") == [len(f"He left ({inside}really).")]
    assert s.ends('A 5" pipe broke. Another 7" pipe held. Good') == [len('A 5" pipe broke.'), len('A 5" pipe broke. Another 7" pipe held.')]


def test_learning():
    texts = ["Siehe Absch. vier und Absch. fünf. Der Rest kommt... vermutlich morgen.", "Nach Absch. drei kommt Absch. sechs. Er kam... vermutlich nie. Und dann... Vermutlich."] * 3
    learnt = s.learn_from(texts)
    assert "absch" in learnt.abbreviations and "vermutlich" in learnt.carry
    assert s.ends("er las absch. zwei. es war gut", learnt) == [len("er las absch. zwei.")]
    thai = ["ผมชนะแล้ว", "เขาชนะเกม", "ทีมชนะอีก", "เราชนะรถ", "วันชนะมา", "คนชนะดี"]
    words = s.learn_from(thai * 3).words
    assert "ชนะ" in words
    # the particle within the word is none
    assert s.lattice("ทีมชนะ", words)[-1] == ("ชนะ", "") and s.lattice("ดีนะ", words)[-1][1] == "final"


def test_learning_reads_every_text(spark):
    """More texts than any sample held: what only just passes its counts, each time in other texts, is learnt all the same."""
    names = ["".join(("abc"[i // 9], "def"[i // 3 % 3], "ghi"[i % 3], "q")) for i in range(27)]
    thai = [f"{a}ชนะ{b}" for a, b in (("ผม", "แล้ว"), ("เขา", "เกม"), ("ทีม", "อีก"), ("เรา", "รถ"), ("วัน", "มา"))]
    rare = [f"Nummer {k} steht bei {n}. vier hier. Oder? Dann {n.upper()}... {n}x bald." for n in names for k in range(4)]
    texts = [f"Post {i} is here. It says nothing." for i in range(21_000)] + rare + thai
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string").repartition(5)
    learnt = s.learn(df)
    assert learnt == s.learn_from(texts)
    assert set(names) <= learnt.abbreviations and {f"{n}x" for n in names} <= learnt.carry and "ชนะ" in learnt.words


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    text = case.replace("|", "")
    want, at = [], 0
    for part in case.split("|")[:-1]:
        at += len(part)
        want.append(at)
    assert s.ends(text) == want


def test_wraps_quotes_code_and_signatures():
    text = "rook-12:\n> One line that\n> wraps. Two\n> ends.\n\n$ make -j4 all. Now\n\nA<br/>bad. Came &quot;done.&quot; Eh\n\n-- \nX. Y"
    got = [text[:e].rsplit("\n", 1)[-1] for e in s.ends(text)]
    assert got == ["> wraps.", "A<br/>bad.", "A<br/>bad. Came &quot;done.&quot;"]


def test_units_lose_nothing(spark):
    df = spark.createDataFrame([(1, "One. Two!\n\nThree"), (2, None), (3, ""), (4, "   "), (5, "word " * 20000 + ".")], "id int, text string")
    rows = s.sentence_units(df, ["id"]).orderBy("id", "sent_no").collect()
    assert [(r.id, r.sentence) for r in rows if r.id == 1] == [(1, "One."), (1, "Two!"), (1, "Three")]
    assert {r.id for r in rows} == {1, 5}
    assert s.sentence_ends(df.limit(0), ["id"]).count() == 0
