"""Missing or wrong language labels (problem 3).

Cross-parsing entropy. For each language a suffix automaton is built from labelled text. A text is parsed against it
greedily into the longest phrases that occur in the language's text; the language that needs the fewest phrases a letter
wins, phrases being weighted by the logarithm of the size of the language's text; the distance to the second gives the
confidence.

The labelled text is a bounded sample of the records themselves (SAMPLE_ROWS rows a language, SAMPLE_CHARS characters a
language). As labels can be wrong, a block is taken into its language's sample only if automata of the short texts below
agree with its label. Classification reads every block of every record as a whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm import layout
from palimpsest.llm.canon import plain
from palimpsest.llm.sampling import ample, below
from palimpsest.session import spread, table

#: Bounds of the labelled sample, by language: rows, and characters of training text.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 32_000
#: Characters of a sampled row that the sample may take.
ROW_CHARS = 20_000
#: Letters that a block must have, and how much cheaper another language must be than the declared one.
MIN_LETTERS, MARGIN = 30, 0.97
#: Share of the sample that trains the automata which check the labels of the rest.
FIRST_CHARS = 8_000

# Codes and names of each language, by two-letter code.
NAMES = {
    "en": "en eng english anglais inglés ingles englisch inglês английский 英语 英語 الإنجليزية",
    "fr": "fr fra fre french français francais francés frances französisch francês французский 法语 フランス語 الفرنسية",
    "es": "es spa esp spanish español espanol castellano espagnol spanisch espanhol испанский 西班牙语 スペイン語 الإسبانية",
    "de": "de deu ger german deutsch allemand alemán aleman alemão немецкий 德语 ドイツ語 الألمانية",
    "pt": "pt por portuguese português portugues portugais portugués portugiesisch португальский 葡萄牙语 ポルトガル語 البرتغالية",
    "ru": "ru rus russian русский russe ruso russisch russo 俄语 ロシア語 الروسية",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 普通话 chinois chino chinesisch chinês китайский zh-hans zh-hant 中国語 الصينية",
    "ja": "ja jpn jp japanese 日本語 japonais japonés japones japanisch japonês японский 日语 اليابانية",
    "th": "th tha thai ไทย ภาษาไทย thaï thailandés thailändisch тайский 泰语 タイ語 التايلاندية",
    "hi": "hi hin hindi हिन्दी हिंदी хинди 印地语 ヒンディー語 الهندية",
    "ar": "ar ara arabic العربية عربي arabe árabe arabisch арабский 阿拉伯语 アラビア語",
}
# A short text of each language, with which the sample's labels are checked.
SEED = {
    "en": "All people are born free and have the same rights. They should treat each other as friends, with reason and with care. I think that this is what you would want when something goes wrong with it at home or at work, and we should have been told about it before the end of the day. What is your name? Where were you last night? There was nothing that could be done for them, so she went back and waited until the others had left. It turned out that the part needs another one by then, which is not more than those who asked had been given.",
    "fr": "Tous les gens naissent libres et ont les mêmes droits. Ils doivent se traiter les uns les autres comme des amis, avec raison et avec soin. Je crois que c'est ce que vous voulez quand quelque chose ne va pas à la maison ou au travail, et nous aurions dû être prévenus avant la fin de la journée. Quel est votre nom ? Où étiez-vous hier soir ? Il n'y avait rien que l'on puisse faire pour eux, alors elle est rentrée et a attendu que les autres soient partis. Il paraît que cette partie demande une autre fois, selon le manuel, depuis deux ans.",
    "es": "Todas las personas nacen libres y tienen los mismos derechos. Deben tratarse unos a otros como amigos, con razón y con cuidado. Creo que esto es lo que usted quiere cuando algo va mal en la casa o en el trabajo, y nos lo tendrían que haber dicho antes del final del día. ¿Cómo se llama? ¿Dónde estaba usted anoche? No había nada que se pudiera hacer por ellos, así que ella volvió y esperó hasta que los demás se fueron. Parece que la parte pide otra vez, según el manual, desde hace dos años, al menos para mí.",
    "de": "Alle Menschen sind frei geboren und haben die gleichen Rechte. Sie sollen einander wie Freunde behandeln, mit Vernunft und mit Sorge. Ich glaube, dass es das ist, was man will, wenn zu Hause oder bei der Arbeit etwas nicht stimmt, und wir hätten es vor dem Ende des Tages wissen sollen. Wie heißen Sie? Wo waren Sie gestern Abend? Es gab nichts, was man für sie tun konnte, also ging sie zurück und wartete, bis die anderen weg waren. Soweit ich weiß, braucht der Teil noch eine zweite Runde, was nach den Versuchen auch nicht seltsam ist.",
    "pt": "Todas as pessoas nascem livres e têm os mesmos direitos. Devem tratar-se umas às outras como amigas, com razão e com cuidado. Acho que isto é o que você quer quando alguma coisa não vai bem em casa ou no trabalho, e deviam ter-nos dito antes do fim do dia. Qual é o seu nome? Onde estava ontem à noite? Não havia nada que se pudesse fazer por eles, então ela voltou e esperou até que os outros saíssem. Parece que a parte pede outra vez, segundo o manual, há dois anos, pelo menos para mim, o que não é nada estranho.",
    "ru": "Все люди рождаются свободными и имеют одинаковые права. Они должны относиться друг к другу как друзья, с умом и с заботой. Мне кажется, что это то, чего вы хотите, когда дома или на работе что-то идёт не так, и нам надо было сказать об этом до конца дня. Как вас зовут? Где вы были вчера вечером? Для них ничего нельзя было сделать, поэтому она вернулась и ждала, пока остальные не ушли. Почти сразу после этого выяснилось, что нужна ещё одна часть.",
    "zh": "所有人生来都是自由的，有同样的权利。大家应该像朋友一样，用理性和关心对待彼此。我觉得这就是你在家里或者工作中出了问题的时候想要的，我们应该在今天结束以前知道这件事。你叫什么名字？昨天晚上你在哪里？我们没有办法帮他们做什么，所以她回去了，一直等到别人都走了。据我所知，这个部分还要再做一次，说实话，真的很奇怪，谢谢您的回复。",
    "ja": "すべての人は生まれながらに自由で、同じ権利を持っています。友だちのように、理性と思いやりを持って、お互いに接するべきです。家や仕事で何かがうまくいかないとき、これがあなたの望むことだと思います。一日が終わる前に私たちに知らせるべきでした。お名前は何ですか。昨日の夜はどこにいましたか。彼らのためにできることは何もなかったので、彼女は戻って、ほかの人が帰るまで待ちました。正直に言うと、もう一度必要です。ありがとうございます。",
    "th": "ทุกคนเกิดมามีอิสระและมีสิทธิเท่ากัน ควรปฏิบัติต่อกันเหมือนเพื่อน ด้วยเหตุผลและความใส่ใจ ผมคิดว่านี่คือสิ่งที่คุณต้องการเมื่อมีอะไรผิดพลาดที่บ้านหรือที่ทำงาน และเราควรได้รู้ก่อนหมดวัน คุณชื่ออะไร เมื่อคืนคุณอยู่ที่ไหน ไม่มีอะไรที่ทำให้พวกเขาได้ เธอจึงกลับไปและรอจนคนอื่นออกไปแล้ว เท่าที่รู้ต้องทำอีกครั้งหลังจากนี้ ขอบคุณมากครับ",
    "hi": "सभी लोग स्वतंत्र पैदा होते हैं और उनके अधिकार समान हैं। उन्हें एक दूसरे के साथ मित्रों की तरह, बुद्धि और ध्यान से व्यवहार करना चाहिए। मुझे लगता है कि जब घर में या काम पर कुछ गलत हो जाता है तब आप यही चाहते हैं, और हमें दिन के अंत से पहले बताया जाना चाहिए था। आपका नाम क्या है? कल रात आप कहाँ थे? उनके लिए कुछ नहीं किया जा सकता था, इसलिए वह वापस गई और दूसरों के जाने तक रुकी रही। सच कहूँ तो इसे एक बार फिर करना पड़ेगा।",
    "ar": "يولد جميع الناس أحرارا ولهم نفس الحقوق. وعليهم أن يعامل بعضهم بعضا مثل الأصدقاء، بالعقل والعناية. أظن أن هذا ما تريده عندما يحدث خطأ ما في البيت أو في العمل، وكان يجب أن نعرف ذلك قبل نهاية اليوم. ما اسمك؟ أين كنت مساء أمس؟ لم يكن هناك شيء يمكن عمله من أجلهم، فعادت وانتظرت حتى ذهب الآخرون. بصراحة، يحتاج هذا إلى مرة أخرى بعد ذلك، شكرا جزيلا على الرد.",
}
_NAME = {n: code for code, row in NAMES.items() for n in row.split()}
_NOISE = re.compile(r"\S*@\S*|\b(?:https?://|www\.)\S+|[\w.\-+]+\s?[(\[]at[)\]]\s?\S+|\d+")
_AT = re.compile(r"@|[(\[]at[)\]]")
_NOISE_WITHOUT_AT = re.compile(r"\b(?:https?://|www\.)\S+|\d+")
_PIECE = re.compile(r"[.!?…]+\s+|[。！？।]|(?<=[฀-๿]) (?=[A-Z])")
_ASCII = re.compile(r"[a-z]{3}")
LATIN = ("en", "fr", "es", "de", "pt")
_GAPS = re.compile(r"[\W_]+")


def code_of(label: str | None) -> str | None:
    """The two-letter code of a declared language, however written; None for none or an unknown one."""
    if not label:
        return None
    s = label.strip().casefold()
    return _NAME.get(s) or _NAME.get(re.split(r"[-_ ]", s)[0])


def prepare(text: str) -> str:
    """Letters in comparable form with single blanks: what the automata are built from and parsed with."""
    noise = _NOISE if _AT.search(text) else _NOISE_WITHOUT_AT
    return _GAPS.sub(" ", plain(noise.sub(" ", text))).strip()


class Automaton:
    """Suffix automaton of a text: accepts exactly its factors."""

    def __init__(self, text: str):
        self.next, self.link, self.size, self.last = [{}], [-1], [0], 0
        self.extend(text)

    def extend(self, text: str) -> None:
        """Append to the text; the automaton then accepts the factors of the whole."""
        nxt, link, size, last = self.next, self.link, self.size, self.last
        for c in text:
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last
        self.known = dict.fromkeys(map(ord, nxt[0]))
        self.bits = math.log2(max(2, size[last]))

    def phrases(self, text: str, most: float = math.inf) -> int:
        """Phrases of the greedy parse into longest factors; an unknown character is a phrase of its own.

        The parse is left as soon as it is sure to take more than `most` phrases; what comes out is then above `most`.
        """
        nxt = self.next
        root = nxt[0]
        if most < len(text):
            strange = len(text.translate(self.known))  # each a phrase of its own, whatever stands beside it
            if strange > most:
                return strange
        n, here = 0, root
        for c in text:
            k = here.get(c)
            if k is None:
                n += here is not root
                if n > most:
                    return n
                k = root.get(c)
                if k is None:
                    n += 1
                    here = root
                    continue
            here = nxt[k]
        return n + (here is not root)


class Identifier:
    """Automata of several languages; classifies prepared text."""

    def __init__(self, texts: dict[str, str]):
        self.automata = {code: Automaton(t) for code, t in sorted(texts.items()) if t}
        self.order = list(self.automata)
        self.classify = lru_cache(20_000)(self._classify)
        self.language_of = lru_cache(20_000)(self._language_of)

    def rates(self, text: str) -> dict[str, float]:
        """Bits a letter that each language needs; a lower bound where it is neither among the two best nor near the best."""
        n = max(1, len(text))
        rates: dict[str, float] = {}
        best = second = math.inf
        for code in self.order:
            a = self.automata[code]
            limit = max(second, best / MARGIN)
            rates[code] = rate = a.phrases(text, limit * n / a.bits) * a.bits / n
            if rate < best:
                best, second = rate, best
            elif rate < second:
                second = rate
        return rates

    def _language_of(self, text: str) -> str:
        """The language alone: every parse is left as soon as it is worse than the best one."""
        n = max(1, len(text))
        best, found = math.inf, ""
        for code in self.order:
            a = self.automata[code]
            rate = a.phrases(text, best * n / a.bits) * a.bits / n
            if rate < best or (rate == best and code < found):
                best, found = rate, code
        self.order.remove(found)
        self.order.insert(0, found)
        return found

    def _classify(self, text: str) -> tuple[str, float, dict[str, float]]:
        """(language, confidence, rates); confidence is the share of the second's phrases that the first saves."""
        rates = self.rates(text)
        order = sorted(rates.items(), key=lambda x: (x[1], x[0]))
        second = order[1][1] if len(order) > 1 else 1.0
        # the next text is likely in the same language: parsing with it first only saves time
        self.order.remove(order[0][0])
        self.order.insert(0, order[0][0])
        return order[0][0], round(1 - order[0][1] / second, 6) if second else 0.0, rates


@lru_cache(2)
def seeded() -> Identifier:
    return Identifier({code: prepare(t) for code, t in SEED.items()})


@lru_cache(2)
def _trained(texts: tuple[tuple[str, str], ...]) -> Identifier:
    return Identifier(dict(texts))


def block_texts(text: str) -> Iterator[tuple[int, str, int]]:
    """(block, prepared running text, letters of the whole block) of each block with running text."""
    for k, block in enumerate(layout.blocks(text)):
        lines = [x for x in block if x.kind == "text"]
        if lines:
            body = prepare(layout.flow_text(text, lines))
            if len(body) >= 4:
                yield k, body, sum(c.isalpha() for c in text[block[0].start : block[-1].end])


@F.pandas_udf(T.StringType())
def _known(lang: pd.Series) -> pd.Series:
    return lang.map(code_of)


def training_texts(recs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(code, text) for each language: the short text, and blocks of a bounded sample whose label it confirms."""
    # how many rows each label has: a label that is no usual name of a language has no code
    counts = recs.where("text <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("code", _known("lang")).where("code is not null").groupBy("code").agg(F.sum("n").alias("n"), F.collect_list("lang").alias("langs")).collect()
    if not counts:
        return _agreeing([], seeded(), SAMPLE_CHARS)
    order = F.xxhash64("src", "rec_id")
    narrowed = F.lit(None).cast("string")
    for r in counts:  # at most one for each language
        narrowed = F.when(F.col("lang").isin(r.langs) & below(order, ample(SAMPLE_ROWS, r.n)), r.code).otherwise(narrowed)
    by = Window.partitionBy("code").orderBy(order, "rec_id")
    rows = (
        recs.where("text <> ''").withColumn("code", narrowed).where("code is not null")
        .select("code", "src", "rec_id", F.substring("text", 1, ROW_CHARS).alias("text"))
        .withColumn("rn", F.row_number().over(by))
        .where(F.col("rn") <= SAMPLE_ROWS)
        .orderBy("code", "rn")
        .collect()
    )
    blocks_ = []
    for r in rows:
        for block in layout.blocks(r.text):
            whole = layout.flow_text(r.text, [x for x in block if x.kind == "text"])
            if len(prepare(whole)) >= MIN_LETTERS:
                blocks_.append((r.code, tuple(x for x in map(prepare, _PIECE.split(whole)) if x)))
    first = _agreeing(blocks_, seeded(), FIRST_CHARS)
    return _agreeing(blocks_, Identifier(dict(first)), SAMPLE_CHARS)


def _agreeing(labelled: list[tuple[str, tuple[str, ...]]], check: Identifier, most: int) -> tuple[tuple[str, str], ...]:
    """(code, text): distinct blocks that the classifier puts to their label's language, up to `most` characters each.

    Remarks in another language or script are left out of them.
    """
    texts = {code: [prepare(t)] for code, t in SEED.items()}
    size = {code: len(v[0]) for code, v in texts.items()}
    for code, pieces in dict.fromkeys(labelled):
        if size[code] < most:
            best, confidence, _ = check.classify(" ".join(pieces))
            if best != code or confidence < 0.03:
                continue
            for piece in pieces:
                other, sure, _ = check.classify(piece)
                if (other == code or sure < 0.1) and (code in LATIN or not _ASCII.search(piece)):
                    texts[code].append(piece)
                    size[code] += len(piece) + 1
    return tuple((code, " ".join(v)[:most]) for code, v in sorted(texts.items()))


_SEGMENT = T.ArrayType(T.StructType([
    T.StructField("seg_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("letters", T.IntegerType()), T.StructField("differs", T.BooleanType()),
]))


def segments(recs: DataFrame, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(src, rec_id, declared, segs): the language of every block of running text, with confidence.

    `recs` has src, rec_id, text, lang. A null or empty text has no segments; repeated rows come out as often as they are
    given, so that texts need not be shuffled to find them (the queries take equal results together); `declared` is null where no language, or an unknown one, is declared. `differs` is set where a block of at least MIN_LETTERS letters
    is in another language than declared.
    """
    texts = texts or training_texts(recs)
    model = recs.sparkSession.sparkContext.broadcast(texts)  # bounded: languages x SAMPLE_CHARS

    def find(text: pd.Series, lang: pd.Series) -> pd.Series:
        ident = _trained(model.value)

        def one(t, label):
            code, out = code_of(label), []
            for k, body, letters in block_texts(t or ""):
                best, conf, rates = ident.classify(body)
                if code in rates and best != code and rates[best] > MARGIN * rates[code]:
                    best, conf = code, 0.0
                out.append({"seg_no": k, "lang": best, "confidence": conf, "letters": letters, "differs": letters >= MIN_LETTERS and best != code})
            return out

        return pd.Series([one(t, x) for t, x in zip(text, lang)])

    rows = spread(recs.select("src", "rec_id", "text", "lang"))
    # marked as not deterministic so that the optimiser does not plan it again for a filter on its result
    return rows.select("src", "rec_id", _known("lang").alias("declared"), F.pandas_udf(find, _SEGMENT).asNondeterministic()("text", "lang").alias("segs"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text", "lang")
    reqs = table(spark, sf_dir, "requests").select(F.lit("requests").alias("src"), F.col("request_id").alias("rec_id"), "text", F.col("language").alias("lang")).distinct()
    return docs.unionByName(reqs)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = segments(records(spark, sf_dir)).select("src", "rec_id", F.explode("segs").alias("s"))
    return segs.where("s.differs").select("src", "rec_id", "s.seg_no", "s.lang").distinct()


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the language of most of its letters, the confidence in it, and its number of languages."""
    segs = segments(records(spark, sf_dir)).distinct()
    by_lang = segs.select("src", "rec_id", "declared", F.explode_outer("segs").alias("s")).groupBy("src", "rec_id", "declared", F.col("s.lang").alias("lang")).agg(F.sum("s.letters").alias("letters"), F.avg("s.confidence").alias("confidence"))
    return by_lang.groupBy("src", "rec_id", "declared").agg(
        F.max_by("lang", F.struct("letters", "lang")).alias("lang"), F.max_by("confidence", F.struct("letters", "lang")).alias("confidence"), F.count("lang").alias("languages")
    )
