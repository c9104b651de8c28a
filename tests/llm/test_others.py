import random

import pytest
from pyspark.sql import functions as F_

from palimpsest.llm import frequency, language, leakage, overlap, packing, pii, subjects


def test_language_cross_parsing():
    ident = language.seeded()
    for code, text in {"en": "we should not wait for the others", "de": "wir haben nichts davon gewusst", "pt": "não havia nada que fazer", "ja": "友だちのように接するべきです", "th": "ผมคิดว่าต้องทำอีกครั้ง", "ru": "им надо было сказать об этом"}.items():
        assert ident.classify(language.prepare(text))[0] == code
    a = language.Automaton("abcbc")
    assert a.phrases("abc") == 1 and a.phrases("bcb") == 1 and a.phrases("cab") == 2 and a.phrases("xx") == 2
    a.extend("d")
    assert a.phrases("bcd") == 1
    assert [language.code_of(x) for x in ("en_GB", "français", "German", "und", "", None, "zho")] == ["en", "fr", "de", None, None, None, "zh"]


def test_language_segments(spark):
    text = "We should not have waited for the others to come back home.\n\nNous aurions dû attendre que les autres soient rentrés à la maison.\n\n-- \nX Y"
    df = spark.createDataFrame([("d", 1, text, "en"), ("d", 1, text, "en"), ("d", 2, None, "fr"), ("d", 3, "", None), ("d", 4, text, None)], "src string, rec_id long, text string, lang string")
    rows = {r.rec_id: [(s.seg_no, s.lang) for s in r.segs if s.differs] for r in language.segments(df).collect()}
    assert rows == {1: [(1, "fr")], 2: [], 3: [], 4: [(0, "en"), (1, "fr")]}


def test_frequencies_against_counting(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(0, 200_000), 1) for _ in range(3000)] + [("b", 5, 1)] * 3
    df = spark.createDataFrame(rows, "term string, rec long, n int")
    got = {r.term: (r.occurrences, r.records) for r in frequency.frequencies(df, ["term"], "rec").collect()}
    assert got == {t: (sum(1 for x in rows if x[0] == t), len({x[1] for x in rows if x[0] == t})) for t in "abc"}
    maps = frequency.bitmaps(df, ["term"], "rec", "n").collect()
    back = {(m.term, (w.word << 6) + b) for m in maps for w in m.bitmap for b in range(64) if w.bits >> b & 1}
    assert back == {(t, r) for t, r, _ in rows}
    assert frequency.frequencies(df.limit(0), ["term"], "rec").count() == 0


def test_changes():
    a = "the old mayor of the town sold nine hundred boxes of red ink".split()
    assert overlap.changes(a, a, 2) == 0
    assert overlap.changes(a, [*a[:3], "x", *a[3:]], 2) == 1
    assert overlap.changes(a, ["theold", *a[2:]], 2) == 0
    assert overlap.changes(a, a[::-1], 2) == 3


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    sents = []
    for i in range(160):
        if i < 80 or rng.random() < 0.3:
            ws = [rng.choice(vocab) for _ in range(rng.randint(1, 24))]
        else:
            ws = list(sents[rng.randrange(80)][1])
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        sents.append((i, ws, "train" if i < 80 else rng.choice(["dev", "test"])))
    rows = [(i, p, w, "O", s, "x") for i, ws, s in sents for p, w in enumerate(ws)] + [(0, 0, sents[0][1][0], "O", "train", "x"), (999, 0, None, None, "dev", None), (998, None, "a", None, None, None)]
    df = spark.createDataFrame(rows, "sent_id long, pos int, word string, tag string, split string, source string")
    got = {tuple(r) for r in overlap.overlaps(df).collect()}
    want = set()
    for i, a, s in sents[:80]:
        for j, b, _ in sents[80:]:
            most = max(len(a), len(b)) // overlap.WORDS_PER_CHANGE
            if overlap.changes(a, b, most) <= most:
                want.add((i, j))
    assert got == want and len(want) > 20
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_overlaps_of_short_sentences(spark):
    """Words added, dropped, replaced, joined and cut around the lengths where one change more is allowed, also with words too
    short for a shingle to stay."""
    rng = random.Random(11)
    rows, pairs = [], []
    for i in range(160):
        most = rng.choice([2, 3, 6, 11])
        word = lambda most=most: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, most)))
        a = [word() for _ in range(rng.choice([7, 8, 10, 15, 16, 23, 24]))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k, kind = rng.randrange(len(b)), rng.choice("adrjc")
            if kind == "a":
                b.insert(k, word())
            elif kind == "d":
                del b[k]
            elif kind == "r":
                b[k] = word()
            elif kind == "j":
                b[k : k + 2] = ["".join(b[k : k + 2])]
            elif len(b[k]) > 1:
                b[k : k + 1] = [b[k][:1], b[k][1:]]
        pairs.append((a, b))
        rows += [(2 * i, p, w, "O", "train", "x") for p, w in enumerate(a)] + [(2 * i + 1, p, w, "O", "test", "x") for p, w in enumerate(b)]
    df = spark.createDataFrame(rows, "sent_id long, pos int, word string, tag string, split string, source string")
    want = set()
    for i, (a, _) in enumerate(pairs):
        for j, (_, b) in enumerate(pairs):
            most = max(len(a), len(b)) // overlap.WORDS_PER_CHANGE
            if overlap.changes(a, b, most) <= most:
                want.add((min(2 * i, 2 * j + 1), max(2 * i, 2 * j + 1)))
    assert {tuple(r) for r in overlap.overlaps(df).collect()} == want and len(want) > 60


def test_prefixes_cover_every_partner():
    """Stock sentences with few rare words, one word added, dropped, joined or cut, where another change becomes allowed: a
    partner within the allowed changes always holds one of the prefix's shingles unbroken."""
    rng = random.Random(2)
    stock = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    frequency_ = lambda h: (h % 97).astype(float)
    seen = 0
    for _ in range(4000):
        n = rng.choice([5, 7, 8, 15, 16, 23, 24, 40])
        a = [rng.choice(stock) if rng.random() < 0.8 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 6))) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            k, kind = rng.randrange(len(b)), rng.choice("adrjc")
            if kind == "a":
                b.insert(k, rng.choice(stock))
            elif kind == "d" and len(b) > 1:
                del b[k]
            elif kind == "r":
                b[k] = rng.choice(stock)
            elif kind == "j":
                b[k : k + 2] = ["".join(b[k : k + 2])]
            elif len(b[k]) > 1:
                b[k : k + 1] = [b[k][:1], b[k][1:]]
        if not overlap.alike(a, b):
            continue
        seen += 1
        eights = len(b) // overlap.WORDS_PER_CHANGE
        have = {g for size in overlap.SIZES for g in overlap.shingle_hashes(overlap._chars(b), size).tolist()}
        if not eights:
            have.add(overlap.whole_hash(b))
        assert any(g in have for g, _, partner in overlap.prefix(a, frequency_) if partner == eights)
    assert seen > 1000


def test_overlap_report_counts_copies(spark):
    line = "the old mayor of the town sold nine hundred boxes of red ink".split()
    other = [*line[:-1], "blue"]
    sents = [(1, "train", "a", line), (2, "train", "a", line), (3, "train", None, other), (4, "dev", "b", line), (5, "dev", "b", other), (6, "test", "c", ["quite", "another"]), (7, "train", "a", line), (7, "dev", "b", line)]
    df = spark.createDataFrame([(i, p, w, s, src, 1) for i, s, src, ws in sents for p, w in enumerate(ws)], "sent_id long, pos int, word string, split string, source string, key int")
    got = {(r.eval_split, r.eval_source, r.train_source): (r.pairs, r.eval_sentences) for r in overlap.report(df).collect()}
    assert got == {("dev", "b", "a"): (8, 3), ("dev", "b", None): (3, 3)}
    assert len(overlap.overlaps(df).collect()) == 11


def test_sketch_and_bitmap_come_to_the_driver_as_bytes(spark):
    """Full sketches and bitmaps of the largest size, which the driver gathers in a few times their bytes, and what they hold."""
    import tracemalloc

    import numpy as np

    rng = random.Random(3)
    rows = [("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)) for _ in range(3000)]
    rows = [list(r) for r in rows]
    words = spark.createDataFrame([(r,) for r in rows], "words array<string>").repartition(9)
    index = spark.range(0, 300_000).select((F_.xxhash64("id")).alias("gram"))
    overlap.frequency_sketch(words.limit(1), 17)
    tracemalloc.start()
    sketch = overlap.frequency_sketch(words, overlap.SKETCH_BITS[1])
    bitmap = overlap.prefix_bitmap(index, overlap.BITMAP_BITS[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    batch = overlap.Batch(rows)
    counts = np.zeros(1 << overlap.SKETCH_BITS[1])
    for size in overlap.SIZES:
        np.add.at(counts, (batch.shingles(size)[0] & np.uint64(len(counts) - 1)).astype(np.int64), 1)
    near = overlap.FREQUENCIES[sketch]
    assert ((near == 0) == (counts == 0)).all() and (np.abs(near - counts) <= 0.13 * counts + 0.01).all()
    bits = np.zeros(1 << overlap.BITMAP_BITS[1], bool)
    bits[[r.gram & (len(bits) - 1) for r in index.collect()]] = True
    assert (np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool) == bits).all()


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    items, texts = [], []
    for i in range(12):
        p = [word() for _ in range(40)]
        items.append((i, "Read the text. " + " ".join(p).capitalize() + ". What is right?"))
        texts.append(p)
    items.append((50, items[0][1].replace("What is right?", "Which one?")))
    keep = lambda k, n, c: [("zz" if j in c else w) for j, w in enumerate(texts[k][5 : 5 + n])]
    docs = [(1, "Hi!\n> " + "\n> ".join(" ".join(keep(0, 20, (3, 9))[a : a + 5]) for a in range(0, 20, 5)), 0), (2, " ".join(keep(1, 20, (1, 5, 9))), 0), (3, " ".join(keep(2, 12, ())), 0), (4, " ".join(keep(3, 30, ())).upper(), 0), (5, None, 0), (6, "", 0), (7, "Read the text. What is right?", 0)]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string, passage int")
    got = {tuple(r) for r in leakage.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0), (1, 50), (4, 3)}


def test_leaks_against_brute_force(spark):
    """Windows with words replaced, dropped and added, in passages of several lengths, some of common words."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    ps = [[rng.choice(words) for _ in range(rng.choice([6, 12, 20, 23, 40]))] for _ in range(14)]
    docs = []
    for i in range(160):
        p = rng.choice(ps)
        n = min(len(p), rng.choice([18, 20, 22, 30]))
        at = rng.randrange(len(p) - n + 1)
        part = p[at : at + n]
        for _ in range(rng.randint(0, 3)):
            k, kind = rng.randrange(len(part)), rng.choice("rda")
            part[k : k + 1] = {"r": ["zzz"], "d": [], "a": [part[k], "zzz"]}[kind]
            part = part or ["zzz"]
        docs.append((i, " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 30))), *part, *(rng.choice(words) for _ in range(rng.randint(0, 30)))])))
    want = set()
    for i, text in docs:
        for k, p in enumerate(ps):
            n = min(len(p), leakage.WINDOW)
            if any(leakage.within(p[s : s + n], text.split(), leakage.allowed(len(p))) for s in range(len(p) - n + 1)):
                want.add((i, k))
    block = leakage.Passages([([k], p) for k, p in enumerate(ps)])
    got = {tuple(r) for r in leakage._leaks_of(spark.createDataFrame(docs, "doc_id long, text string"), block).distinct().collect()}
    assert got == want and 60 < len(want) < len(docs) * 2


def _best(items, capacity):
    n = len(items)
    best = [(1, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for m in range(1 << n):
        for i in range(n):
            if not m >> i & 1:
                b, u = best[m]
                new = (b, u + items[i]) if u + items[i] <= capacity else (b + 1, items[i])
                best[m | 1 << i] = min(best[m | 1 << i], new)
    return best[-1][0]


def test_packing_near_optimum():
    rng = random.Random(2)
    extra = 0
    for _ in range(150):
        capacity = rng.choice([20, 30, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        plan = packing.solve(counts, capacity)
        packed = {}
        for pattern, times in plan:
            assert sum(s * q for s, q in pattern) <= capacity
            for s, q in pattern:
                packed[s] = packed.get(s, 0) + q * times
        assert packed == counts
        assert packing.containers_in(plan) <= packing.containers_in(packing.best_fit(counts, capacity))
        extra += packing.containers_in(plan) - _best(items, capacity)
    assert extra <= 1


def test_packing_dominance_is_exact():
    """What the reduction fixes belongs to some optimum: fixed containers and the optimum of the rest make the optimum."""
    rng = random.Random(8)
    fixed = 0
    for _ in range(400):
        capacity = rng.choice([20, 36, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(2, 9))]
        bag = packing._Bag({x: items.count(x) for x in items})
        w = rng.choice(bag.sizes)
        bag.take(w, 1)
        mates = packing._dominating(bag, w, capacity)
        if mates is None:
            continue
        fixed += 1
        rest = list(items)
        for x in (w, *mates):
            rest.remove(x)
        assert w + sum(mates) <= capacity
        assert 1 + (_best(rest, capacity) if rest else 0) == _best(items, capacity)
    assert fixed > 200
    assert packing.containers_in(packing.solve({7: 2, 6: 1, 4: 1}, 36)) == 1


def test_packing_rows(spark):
    rng = random.Random(4)
    docs = [(i, "a b, c" if i % 7 == 0 else None, None if i % 7 == 0 else rng.randint(0, 70)) for i in range(500)] + [(900, "w " * 50, None), (901, None, None), (900, "w " * 50, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens int")
    kinds = spark.createDataFrame([("s", 32), ("l", 100), ("bad", 0), (None, 5)], "container_kind string, capacity int")
    rows = packing.pack(df, kinds).collect()
    for kind, capacity in (("s", 32), ("l", 100)):
        mine = [r for r in rows if r.container_kind == kind]
        fill: dict[int, int] = {}
        for r in mine:
            fill[r.container_no] = fill.get(r.container_no, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        assert {r.doc_id for r in mine} == {d[0] for d in docs}
        assert len({(r.doc_id, r.piece_no) for r in mine}) == len(mine)
        assert len(fill) <= -(-sum(fill.values()) // capacity) * 1.05 + 1
    assert packing.pack(df, kinds.limit(0)).count() == 0


def test_semi_markov_sums():
    segs = [pii.Segment(0, 2, "PER", ("a",)), pii.Segment(1, 3, "ID", ("b",)), pii.Segment(3, 4, "ID", ("c",))]
    model = pii.SemiCRF({"a": 0.5, "b": 1.0, "c": -0.3})
    from math import exp

    sets = [(), (0,), (1,), (2,), (0, 2), (1, 2)]
    weight = {s: exp(sum((0.5, 1.0, -0.3)[k] for k in s)) for s in sets}
    z = sum(weight.values())
    want = [sum(w for s, w in weight.items() if k in s) / z for k in range(3)]
    assert model.marginals(segs, [1.0] * 3) == pytest.approx(want)
    assert [(x.start, x.type) for x in model.decode(segs)] == [(1, "ID")]


def test_pii_end_to_end(spark):
    asked, told = [], []
    rng = random.Random(6)
    first, last = ["Nora", "Hugo", "Alice", "Paul"], ["Dalberg", "Morvan", "Sandoz", "Keller"]
    for i in range(120):
        f, n = rng.choice(first), rng.choice(last)
        mail, tel = f"{f.lower()}.{n.lower()}@post.test", f"+33 6 {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)}"
        asked.append((i, f"Mr. {n} met {f} {n} and the list mentions {n} twice. Call {tel} or write to {mail} now."))
        told.append((i, i, f"Mr. ⟦PERSON_1_a⟧ met ⟦PERSON_2_a⟧ and the list mentions {n} twice. Call ⟦PHONE_1_a⟧ or write to ⟦EMAIL_1_a⟧ now.", [("PER", n), ("PER", f"{f} {n}"), ("PHONE", tel), ("EMAIL", mail)]))
    req = spark.createDataFrame(asked, "request_id long, text string")
    resp = spark.createDataFrame(told, "response_id long, request_id long, text string, entities array<struct<type:string,text:string>>")
    gaz = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate([("per_first", w) for w in first] + [("per_last", w) for w in last])], "term_id int, name string, line string")
    text = "Mr. Keller met Alice Morvan and the list mentions Sandoz twice.\n> Call +33 6 12 34\n> 56 78 now. Ticket 123."
    recs = spark.createDataFrame([("d", 1, text), ("d", 1, text), ("d", 2, None), ("d", 3, "")], "src string, rec_id long, text string")
    out = {r.rec_id: r for r in pii.detect(recs, gaz, req, resp).collect()}
    found = [(x.pii_type, text[x.start_pos : x.end_pos]) for x in out[1]["items"]]
    assert found == [("PER", "Keller"), ("PER", "Alice Morvan"), ("PHONE", "+33 6 12 34\n> 56 78")]
    assert out[2]["items"] == [] and out[3]["items"] == []
    from pyspark.sql import functions as F

    masked = pii.detect(recs, gaz, req, resp).where("rec_id = 1").select(pii.mask(F.col("text"), F.col("items")).alias("m")).first().m
    assert masked == "Mr. ⟦PER_1⟧ met ⟦PER_2⟧ and the list mentions Sandoz twice.\n> Call ⟦PHONE_3⟧ now. Ticket 123."


def test_subjects_held_out_accuracy():
    rng = random.Random(8)
    words = {s: [f"{s}{k}" for k in "abcdefghij"] for s in ("law", "sport", "music")}
    common = "the and with from this that have been some more".split()
    say = lambda s: [rng.choice(words[s] if rng.random() < 0.4 else common) for _ in range(14)]
    docs = []
    for _ in range(300):
        s = rng.choice(list(words))
        docs.append(([("en", say(s))], {s if rng.random() < 0.85 else rng.choice(list(words))}))
    m = subjects.train(sorted(words), docs, [([("en", [rng.choice(common) for _ in range(10)])], set()) for _ in range(40)])
    right = sum([x for x, _ in m.accept("en", say(s))] == [s] for s in list(words) * 60)
    assert right >= 150
    assert not m.accept("en", ["the", "and", "with", "this"] * 3)


def test_subjects_learn_from_every_document(spark):
    """Counts of executors make the models that `train` makes of all documents, in however many parts they come."""
    import numpy as np

    rng = random.Random(9)
    letters = "abcdefghij"
    words = {s: [s + x + y for x in letters for y in "klmno"] for s in ("law", "sport", "music")}
    common = "the and with from this that have been some more".split()
    say = lambda s: " ".join(rng.choice(words[s] if s and rng.random() < 0.4 else common) for _ in range(14))
    docs, labels = [], []
    for i in range(400):
        s = rng.choice([*words, None])
        docs.append((i, say(s) + "\n\n" + say(s)))
        if s and i % 3:
            labels.append((i, s.upper() if i % 2 else s))
            if i % 7 == 0:
                labels.append((i, rng.choice(list(words))))
    d = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    rows = subjects.paragraphs(d, spark.createDataFrame(labels, "doc_id long, subject string")).repartition(7).cache()
    got = subjects.train_on(sorted(words), rows, [("en", ["law", "the", "lawak"])])
    at = sorted((r for r in rows.select("*", F_.xxhash64("doc_id").alias("h")).collect()), key=lambda r: r.h)
    pick = lambda on: [([(p.lang, p.words) for p in r.ps], set(r.ls or [])) for r in at if (r.ls is None) != on]
    last = (1 << 64) * (1 - subjects.HELD_OUT) - (1 << 63)
    early, late = [r for r in at if r.ls is not None and r.h <= last], [r for r in at if r.ls is not None and r.h > last]
    share, subjects.HELD_OUT = subjects.HELD_OUT, (len(late) - 0.5) / (len(early) + len(late))
    try:
        want = subjects.train(sorted(words), pick(True), pick(False), [("en", ["law", "the", "lawak"])])
    finally:
        subjects.HELD_OUT = share
    assert {k: (len(t[0]), set(t[1])) for k, t in got.tables.items()} == {k: (len(t[0]), set(t[1])) for k, t in want.tables.items()}
    for lang, (word, pair, matrix) in want.tables.items():
        w, p, m = got.tables[lang]
        assert all(np.allclose(m[w[x]], matrix[k], atol=1e-4) for x, k in word.items()) and all(np.allclose(m[p[x]], matrix[k], atol=1e-4) for x, k in pair.items())
    assert np.allclose(got.margins, want.margins) and got.second == want.second


def test_subjects_have_no_sample(spark):
    """More documents than any sample held: words of the last ones are known to the models."""
    docs = [(i, f"plain talk of the day and of the night here {'zq' if i >= 10_400 else 'ab'} court judge") for i in range(10_800)]
    rows = subjects.paragraphs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, "law") for i, _ in docs], "doc_id long, subject string"))
    counted = []
    init = subjects.Models.__init__

    def spy(self, names, counts):
        counted.append(dict(counts))
        init(self, names, counted[-1].items())

    subjects.Models.__init__ = spy
    try:
        subjects.train_on(["law", "sport"], rows)
    finally:
        subjects.Models.__init__ = init
    held = round(10_800 * subjects.HELD_OUT)
    assert abs(sum(n for (_, h, w, k), n in counted[0].items() if h is not None and w == "judge") - (10_800 - held)) < 300


def test_own_paragraphs():
    text = "a said:\n> quoted\n\n[quote=x]no[/quote]\n\nMine. [b]Yes[/b]\n\n$ make all\n\n-- \nName"
    assert subjects.own_paragraphs(text) == ["Mine. Yes"]
    assert subjects.own_paragraphs(None) == [] and subjects.own_paragraphs("") == []
