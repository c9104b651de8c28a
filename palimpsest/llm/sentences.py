"""Sentence boundaries across languages and scripts (problem 1).

Scripts with closing marks: every terminator (with the quotes and brackets that close behind it) is a node of a lattice, every pair of
nodes an edge whose cost tells how badly the stretch between them reads as one sentence: unclosed quotes or brackets,
an abbreviation or a number at its end, a small letter at its start. The cheapest path through the lattice of a block
gives its boundaries.

Scripts without spaces or closing marks (Thai, Lao): each stretch between gaps is cut into words by the cheapest path through
a lattice of dictionary words, and a gap is a boundary by the word before it (final particles, units, ties) and the word
after it (openers). Khmer, Burmese, Tibetan and Ethiopic have marks of their own and go by them.

What lists cannot hold is learnt from the texts themselves (`learn`), by counts over all of them: the dictionary of the word lattice,
abbreviations (words whose stop is followed by a small letter) and words that carry a sentence on behind an ellipsis.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import layout
from palimpsest.session import spread, table

# Abbreviations that a sentence does not end with.
NEVER_LAST = {
    "en": "mr mrs ms dr prof st rev lt gen col sgt capt maj sen gov rep hon ft mt fig figs vol vols p pp no nos vs e.g i.e approx cf ca ed eds sec ch est resp al viz eq dept",
    "fr": "m mm mme mmes mlle dr pr me p pp p.ex c.-à-d c.-a-d env fig chap cf vol art n no av bd st ste réf ref tél tel",
    "es": "sr sra srta sres dr dra prof d dña pág pag págs p p.ej aprox fig cap cf vol art núm num n.º n.ª av avda c tel vid",
    "de": "hr fr hrn dr prof z.b z d.h d u.a s abb vgl ca bzw nr bd kap inkl exkl evtl ggf sog u i.d.r str tel st b h a",
    "pt": "sr sra dr dra prof pág pag págs p p.ex aprox fig cap cf vol art núm n.º av tel v",
    "ru": "г г-н г-жа др т т.е т.к т.н см стр рис ок проф им ул тел напр тыс гл млн млрд в",
    "ar": "د أ م ص ج",
    "hi": "डॉ कि कि.मी श्री सु रु प्रो पृ कु",
}
# Abbreviations that a sentence may end with, when what follows looks like a start.
MAYBE_LAST = "etc usw etc a.m p.m u.s u.k u.s.a inc ltd co corp jr sr руб км кг д т.д т.п др o.ä u.s.w env incl km kg h jh jan feb aug sept oct nov dec bd u.a ee.uu s.a no"
# Month names behind which a day's ordinal stands in German and its neighbours.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts mal klasse"
# Small words that carry a sentence on behind an ellipsis.
CARRIES_ON = "or and but so then which that who when if because than even ou et mais enfin donc o y pero enfin e mas ou oder und aber angeblich dass weil или и но а почти"
# Thai particles that close a sentence, words that open one, words that tie a phrase to what precedes or follows.
THAI_FINAL = "ครับ ค่ะ คะ ครับผม จ้า จ้ะ นะ นะครับ นะคะ แล้ว ไหม ไหมคะ ไหมครับ เลย ด้วย สิ ล่ะ หรอก แหละ กัน อีก ทีเดียว"
THAI_OPENING = "ผม ฉัน ดิฉัน เรา เขา เธอ มัน คุณ ผมคิดว่า ฉันคิดว่า เท่าที่รู้ จริงๆ จริงๆแล้ว แต่ เมื่อวาน เมื่อวานเรา วันนี้ พรุ่งนี้ ตอนนี้ มีใคร ขอโทษ ขอบคุณ สวัสดี ติดต่อ โทร โทรมาที่ ราคา รุ่น ใบงาน ส่ง ดู ลอง หมายเลข เบอร์ ถ้า หาก"
THAI_TIE = "และ หรือ ที่ ซึ่ง อัน เพราะ เพราะว่า โดย ของ ใน กับ แก่ จาก ถึง ว่า เช่น ได้แก่ คือ เป็น เพื่อ ตาม ต่อ ประมาณ หลังจาก หลังจากลอง"
THAI_UNIT = "ครั้ง เปอร์เซ็นต์ บาท คน ตัว อัน ชิ้น วัน เดือน ปี ชั่วโมง นาที วินาที กิโลเมตร กิโลกรัม เมตร กม กก บาทต่อชิ้น ทุกวัน ทุก ได้ ได้เลย อีกครั้ง ปิด ปิดแล้ว ออก"

_NEVER = {w for v in NEVER_LAST.values() for w in v.split()}
_MAYBE = set(MAYBE_LAST.split())
_MONTHS = set(MONTHS.split())
_CARRY = set(CARRIES_ON.split())

# The same kinds of words in Lao.
LAO_FINAL, LAO_OPENING, LAO_TIE = "ແລ້ວ ບໍ ບໍ່ ເດີ ນະ ແດ່ ຈ້າ ເລີຍ ນຳ", "ຂ້ອຍ ພວກເຮົາ ເຈົ້າ ລາວ ແຕ່ ຖ້າ ມື້ນີ້ ມື້ວານນີ້ ຂອບໃຈ ສະບາຍດີ", "ແລະ ຫຼື ທີ່ ຊຶ່ງ ເພາະ ໃນ ຂອງ ກັບ ຈາກ ວ່າ ເຊັ່ນ ຄື ເປັນ ເພື່ອ"

#: Entries of a task's tallies from which they are handed on, to be added up behind the shuffle.
TALLY_ENTRIES = 200_000
#: Occurrences and share that make a learnt abbreviation or carrying word; occurrences, neighbours on either side and longest
#: clusters of a learnt dictionary word.
LEARN_COUNT, LEARN_SHARE = 4, 0.6
WORD_COUNT, WORD_NEIGHBOURS, WORD_CLUSTERS = 5, 3, 8

_OPEN = {"“": "”“", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "〈": "〉", "《": "》"}
# all closing marks of Unicode (property Sentence_Terminal), and the ellipsis
_MARKS = "".join(c for c in map(chr, range(0x10000)) if regex.match(r"\p{Sentence_Terminal}", c)) + "…॥"
_TERM = re.compile(f"[{re.escape(_MARKS)}]+")
_GREEK_TERM = re.compile(f"[{re.escape(_MARKS)};\u037e]+")
#: Marks behind which no blank need stand: those of scripts that have their own.
_OWN_MARKS = set(_MARKS) - set(".!?…．﹒‼‽⁇⁈⁉")
_WORD_BEFORE = re.compile(r"[^\s([{（「『“„«\"]*$")
_CLOSER = "”’\"»›」』)]）】〉》'"
_WIDE = "。！？｡"
_THAI = re.compile(r"[\u0e00-\u0eff]")
_THAI_STRETCH = re.compile(r"[\u0e00-\u0eff](?:[\u0e00-\u0eff\s\d.,%]*[\u0e00-\u0eff])?")
_CLUSTER = re.compile(r"[\u0e40-\u0e44\u0ec0-\u0ec4]?[^\u0e40-\u0e44\u0ec0-\u0ec4][\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd]*|.", re.S)
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_NEXT_WORD = re.compile(r"[^\W\d_][\w'’\-]*")


def _pairs(s: str) -> list[tuple[int, int]]:
    """Matching quotes and brackets; those without a partner are left out.

    A straight quote opens where a blank or a bracket stands before it and closes elsewhere.
    """
    out, stack = [], []
    straight = -1
    for m in re.finditer(r"[“”„«»‹›「」『』()\[\]（）【】〈〉《》\"]", s):
        c, i = m.group(), m.start()
        if c == '"':
            opens = (not i or s[i - 1] in " \t([{“„«—–-") and i + 1 < len(s) and not s[i + 1].isspace()
            if straight >= 0 and not opens:
                out.append((straight, i))
                straight = -1
            elif opens:
                straight = i
            continue
        closed = False
        for k in range(len(stack) - 1, -1, -1):
            o, oc = stack[k]
            if c in _OPEN[oc] and not (c == oc):
                out.append((o, i))
                del stack[k:]
                closed = True
                break
        if not closed and c in _OPEN:
            stack.append((i, c))
    return out


class _Node:
    __slots__ = ("at", "end", "cost", "skip")

    def __init__(self, at: int, end: int, cost: float, skip: float):
        self.at, self.end, self.cost, self.skip = at, end, cost, skip


def spaced(s: str, learnt: Learnt | None = None) -> list[int]:
    """Ends of sentences in running text of a spaced script, or of one with wide terminators; the last end is included."""
    pairs = _pairs(s)
    words = _NEXT_WORD.findall(s)
    upper = sum(w[0].isupper() for w in words)
    cased = any(w[0].isupper() or w[0].islower() for w in words)
    low = cased and words[0][0].islower() and upper <= 0.2 * len(words)  # sentences start without capitals
    danda = "।" in s
    learnt = learnt or NOTHING
    greek = len(_GREEK.findall(s)) * 2 > sum(c.isalpha() for c in s)
    nodes: list[_Node] = []
    for m in (_GREEK_TERM if greek else _TERM).finditer(s):
        a, b = m.start(), m.end()
        marks = m.group()
        # closing quotes and brackets that belong to the sentence
        end = b
        while True:
            e = end
            if e < len(s) and s[e] in _CLOSER:
                if s[e] == '"' and not any(y == e for _, y in pairs):
                    break
                end = e + 1
            elif e + 1 < len(s) and s[e] in "   " and s[e + 1] in "»›":
                end = e + 2
            elif end > b and e < len(s) and s[e] in ".!?…" and end - b <= 2:
                # a mark behind a bracket, as in ".)": the later mark ends the sentence
                break
            else:
                break
        if end < len(s) and s[end] in ".!?…。！？,;:，、；：":
            continue
        rest = s[end:].lstrip()
        space = end < len(s) and s[end].isspace()
        if not rest:
            nodes.append(_Node(a, end, 0.0, 0.0))
            continue
        inner = [(x, y) for x, y in pairs if x < a and y >= b]
        around = [y - x for x, y in inner if y >= end]
        wide = all(c in _WIDE or c in "！？" for c in marks) or (marks[-1] in "!?…" and _is_wide(s, a))
        if not space and not wide and marks[-1] not in _OWN_MARKS:
            continue
        first = rest[0]
        opener = re.match(r"[\"“„«‹「『(\[（¿¡‘'\s]*", rest).end()
        head = rest[opener : opener + 40]
        nxt = _NEXT_WORD.match(head)
        word = nxt.group() if nxt else ""
        cost = 0.0
        if around:  # strictly inside a quotation or a bracket; one of many sentences' length may have another partner
            cost += 12 * min(1.0, 800 / min(around))
        if first in "—–-" and not (len(rest) > 1 and rest[1] in "¡¿"):
            cost += 4
        if first in ",;:，、；：%)]»”）":
            cost += 6
        # what closes here, and how it was opened
        closing = [x for x, y in inner if b <= y < end]
        if closing:
            x = min(closing)
            before = s[:x].rstrip()
            at_start = not before or before[-1] in ".!?…。！？।؟" or (before[-1] in _CLOSER and any(n.end == len(before) for n in nodes))
            quote = s[x] not in "([（【"
            if quote and at_start:
                cost += 4 if (low or not word or not word[0].isupper()) else -0.5
            elif quote and before and before[-1] in ":：":
                cost -= 2
            elif not at_start and low:
                cost += 4
            if quote and wide_script(head) and re.match(r"と|って|という|说|問|问|道", head):
                cost += 4
        if not wide and marks[-1] in ".…" or (marks[-1] in ".…" and "…" in marks):
            dots = marks.strip("!?")
            w = _WORD_BEFORE.search(s[:a]).group().strip("'’\"“«(").casefold()
            bare = w.rstrip(".")
            last = re.split(r"[-‐]", bare)[-1] if bare not in _NEVER else bare
            if dots in ("...", "…", "....") or len(dots) > 1:
                if word and word[0].islower() and not low:
                    cost += 4
                elif word and word.casefold() in _CARRY and word[0].islower():
                    cost += 4
                elif word and low and word.casefold() in learnt.carry:
                    cost += 4
            elif marks == "." and end == b:
                if bare in _NEVER:
                    cost += 6
                elif bare in learnt.abbreviations:
                    cost += 3
                elif len(bare) == 1 and bare.isalpha():
                    cost += 3.5 if word[:1].isupper() or low or not cased or not word else 5
                elif bare in _MAYBE or re.fullmatch(r"(?:\w\.)+\w", bare):
                    cost += 3 if (low or not word or not word[0].isupper()) else 0.8 if "." not in bare else 2.2
                elif bare[-1:].isdigit() and word.casefold() in _MONTHS and re.fullmatch(r"\d{1,2}", bare):
                    cost += 6
                elif danda and _deva(s[a - 1 : a]):
                    cost += 6
                elif last in _NEVER and last != bare and len(last) <= 3:
                    cost += 1.5
        if word and word[0].islower() and not low and cased:
            cost += 3 if marks[-1] in ".…" or closing else 2.2
        elif first.isdigit() and not low and cased:
            cost += 0.4
        nodes.append(_Node(a, end, cost, 1.0))
    return _cheapest(s, nodes)


def wide_script(s: str) -> bool:
    return bool(re.match(r"[぀-ヿ一-鿿]", s))


def _is_wide(s: str, a: int) -> bool:
    return a > 0 and bool(re.match(r"[぀-ヿ一-鿿」』”）]", s[a - 1]))


def _deva(c: str) -> bool:
    return "ऀ" <= c <= "ॿ"


def _cheapest(s: str, nodes: list[_Node]) -> list[int]:
    """The cheapest path from the start to the end through the terminators.

    Taking a node costs what speaks against it; passing it over costs 1.9 by its own evidence, any number of them in a row; a
    stretch without a letter or digit is no sentence. Passed-over nodes cost by differences of sums, so the best earlier node
    is a running minimum and the whole takes time in proportion to the nodes.
    """
    if not nodes:
        return []
    n = len(nodes)
    spans = [0] + [x.end for x in nodes]
    signs = [0] * (n + 1)  # letters and digits before each node
    skipped = [0.0] * (n + 1)
    for k in range(n):
        signs[k + 1] = signs[k] + sum(c.isalnum() for c in s[spans[k] : spans[k + 1]])
        skipped[k + 1] = skipped[k] + 1.9 * nodes[k].skip
    best = [0.0] * (n + 1)
    back = [0] * (n + 1)
    ready, bare = (math.inf, 0), (0.0, 0)  # least best - skipped of nodes with signs behind them, and of those without
    for j in range(1, n + 1):
        if signs[j] > signs[j - 1]:
            ready, bare = min(ready, bare), (math.inf, 0)
        cost, i = min(ready, (bare[0] + 5, bare[1]))
        best[j], back[j] = cost + nodes[j - 1].cost + skipped[j - 1], i
        bare = min(bare, (best[j] - skipped[j], j))
    # the path may end at any node, what follows being an unfinished sentence
    j = min(range(n + 1), key=lambda k: best[k] + skipped[n] - skipped[k])
    out = []
    while j:
        out.append(nodes[j - 1].end)
        j = back[j]
    return out[::-1]


class Learnt(NamedTuple):
    """What is learnt from texts: abbreviations, words that carry a sentence on, and words of scripts without spaces."""

    abbreviations: frozenset[str]
    carry: frozenset[str]
    words: frozenset[str]


NOTHING = Learnt(frozenset(), frozenset(), frozenset())


class _Tally:
    """What one text or many have of a word: how often it speaks for being learnt and against it, and its neighbours.

    Of the neighbours on each side, WORD_NEIGHBOURS different ones are kept: enough to know, also after adding tallies up,
    whether there are as many.
    """

    __slots__ = ("yes", "no", "before", "behind")

    def __init__(self):
        self.yes = self.no = 0
        self.before: set[str] = set()
        self.behind: set[str] = set()


def tallies(texts: Iterable[str], most: float = math.inf) -> Iterator[dict[tuple[str, str], _Tally]]:
    """Tallies of texts by (kind, word), handed on whenever there are `most` of them; those of one key are to be added up.

    Kinds: 'stop', a word with a single stop, by the case of the letter that follows; 'dots', the word behind an ellipsis, by
    its case; 'word', a stretch of Thai or Lao clusters.
    """
    found: dict[tuple[str, str], _Tally] = defaultdict(_Tally)
    for text in texts:
        for block in layout.blocks(text):
            for run in layout.runs(block):
                _tally(layout.flow_text(text, run), found)
        if len(found) >= most:
            yield found
            found = defaultdict(_Tally)
    yield found


def _tally(f: str, found: dict[tuple[str, str], _Tally]) -> None:
    if _THAI.search(f):
        for gap in re.findall(r"[\u0e00-\u0eff]+", f):
            cs = _CLUSTER.findall(gap)
            for i in range(len(cs)):
                for j in range(i + 1, min(len(cs), i + WORD_CLUSTERS) + 1):
                    x = found["word", "".join(cs[i:j])]
                    x.yes += 1
                    if len(x.before) < WORD_NEIGHBOURS:
                        x.before.add(cs[i - 1] if i else "^")
                    if len(x.behind) < WORD_NEIGHBOURS:
                        x.behind.add(cs[j] if j < len(cs) else "$")
        return
    seen = [("stop", m[1], m[2]) for m in re.finditer(r"(?<!\w)([^\W\d_]{2,6})\.\s+([^\W\d_])", f)]
    seen += [("dots", m[1], m[1][0]) for m in re.finditer(r"(?:\.\.\.|…)\s+([^\W\d_]+)", f)]
    if not seen:
        return
    words = _NEXT_WORD.findall(f)
    if sum(w[0].isupper() for w in words) <= 0.05 * len(words):
        return
    for kind, word, letter in seen:
        x = found[kind, word.casefold()]
        if letter.islower():
            x.yes += 1
        else:
            x.no += 1


def learn_from(texts: list[str]) -> Learnt:
    """`Learnt` of texts.

    A word is an abbreviation if its single stop is followed by a small letter in most cases, in texts that start sentences
    with capitals; a word carries on if most often small behind an ellipsis. Words of Thai and Lao are stretches of clusters
    that recur beside different neighbours on both sides and are not made of two shorter ones.
    """
    found = next(tallies(texts))
    often = {k: x for k, x in found.items() if x.yes >= LEARN_COUNT and x.yes >= LEARN_SHARE * (x.yes + x.no)}
    free = {k: x for k, x in found.items() if x.yes >= WORD_COUNT and len(x.before) >= WORD_NEIGHBOURS and len(x.behind) >= WORD_NEIGHBOURS}
    return _learnt([k for k in often if k[0] != "word"] + [k for k in free if k[0] == "word"])


def _learnt(found: list[tuple[str, str]]) -> Learnt:
    """`Learnt` from the (kind, word) that pass their counts."""
    of = lambda kind: frozenset(w for k, w in found if k == kind)
    return Learnt(of("stop"), of("dots"), _simple(of("word")))


def _simple(free: frozenset[str]) -> frozenset[str]:
    """Of stretches that recur, those of several clusters that are not made of two shorter words."""
    known = set(_thai_words())
    words: set[str] = set()
    for w in sorted(free - known, key=lambda x: (len(x), x)):
        if len(_CLUSTER.findall(w)) > 1 and not any((w[:k] in known or w[:k] in words) and (w[k:] in known or w[k:] in words) for k in range(1, len(w))):
            words.add(w)
    return frozenset(words)


@cache
def _thai_words() -> dict[str, str]:
    kinds = {}
    for kind, row in (("tie", THAI_TIE), ("unit", THAI_UNIT), ("final", THAI_FINAL), ("open", THAI_OPENING), ("tie", LAO_TIE), ("final", LAO_FINAL), ("open", LAO_OPENING)):
        for w in row.split():
            kinds[w] = kind
    return kinds


@lru_cache(50_000)
def lattice(chunk: str, learnt: frozenset[str] = frozenset()) -> tuple[tuple[str, str], ...]:
    """(word, kind) along the cheapest path: listed words cost 1, learnt ones 1.1, unknown clusters 1.2 each."""
    words = _thai_words()
    cs = _CLUSTER.findall(chunk)
    n = len(cs)
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for i in range(n):
        w = ""
        for j in range(i + 1, min(n, i + _LONGEST) + 1):
            w += cs[j - 1]
            cost = 1.0 if w in words else 1.1 if w in learnt else 1.2 if j == i + 1 else math.inf
            if best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, (i, words.get(w, ""))
    out = []
    j = n
    while j:
        i, kind = back[j]
        out.append(("".join(cs[i:j]), kind))
        j = i
    return tuple(out[::-1])


#: Clusters of the longest word that the lattice tries.
_LONGEST = 14


def _edges(chunk: str, learnt: frozenset[str]) -> tuple[str, str]:
    """Kinds of the first and the last word of a stretch; none of an empty one."""
    path = lattice(chunk, learnt)
    return (path[0][1], path[-1][1]) if path else ("", "")


def unspaced(s: str, words: frozenset[str] = frozenset()) -> list[int]:
    """Ends of sentences in text of a script without closing marks: gaps classified by the words beside them."""
    out = []
    chunks = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", s)]
    for (left, _, le), (right, _, _) in zip(chunks, chunks[1:]):
        lt, rt = bool(_THAI.match(left[-1])), bool(_THAI.match(right[0]))
        core = left.rstrip("\"'”’)»")
        if core and core[-1] in "!?…" or core.endswith("..."):
            out.append(le)
            continue
        if left[-1] in "”\"»)" and rt:
            continue
        if not lt and not rt:
            continue
        first = _edges(_thai_run(right, True), words)[0] if rt else ""
        last = _edges(_thai_run(left, False), words)[1] if lt else ""
        if lt and rt:
            if last == "tie" or (first == "tie" and last != "final"):
                continue
            if first == "unit" and last != "final" and len(left) <= 3:
                continue
            if "\u0e80" <= left[-1] and not (last == "final" or first == "open"):
                continue  # Lao also sets gaps between phrases
            out.append(le)
        elif lt and last == "final" and re.match(r"[^\W\d_]{2}", right) and right[0].isupper():
            out.append(le)
        elif not lt and rt and first == "open" and _closed(left):
            out.append(le)
    return out


def _closed(left: str) -> bool:
    return left[-1] in "!?…%"


def _thai_run(chunk: str, first: bool) -> str:
    found = re.findall(r"[\u0e00-\u0eff]+", chunk)
    return (found[0] if first else found[-1]) if found else ""


def ends(text: str, learnt: Learnt = NOTHING) -> list[int]:
    """Positions just after each sentence that another one follows in the same block."""
    out = []
    for block in layout.blocks(text):
        for run in layout.runs(block):
            f = layout.flow(text, run)
            if len(f.text) < 4:
                continue
            found = boundaries(f.text, learnt)
            out += [f.ends[e - 1] for e in found if any(c.isalnum() for c in f.text[e:])]
    return out


def boundaries(s: str, learnt: Learnt = NOTHING) -> list[int]:
    """Ends of sentences in running text, whatever its scripts: stretches of each kind of script are treated apart."""
    thai = len(_THAI.findall(s))
    if not thai:
        return spaced(s, learnt)
    if thai * 2 >= sum(c.isalpha() for c in s):
        return sorted({*unspaced(s, learnt.words), *[e for e in spaced(s, learnt) if e < len(s.rstrip()) and _latin_side(s, e)]})
    inside = {m.start() + e for m in _THAI_STRETCH.finditer(s) for e in unspaced(m.group(), learnt.words)}
    return sorted({*spaced(s, learnt), *inside})


def _latin_side(s: str, e: int) -> bool:
    left, right = s[:e].rstrip(".!?…"), s[e:].lstrip()
    return bool(left and right and not _THAI.match(left[-1]) and left[-1].isalpha() and right[0].isupper())


def units(text: str, learnt: Learnt = NOTHING) -> list[tuple[int, int, int]]:
    """(block, start, end) of every sentence unit: all text but code, signatures and attribution lines, nothing lost.

    A unit may reach over a line break or a quote prefix; its positions are those of the source.
    """
    out = []
    for b, block in enumerate(layout.blocks(text)):
        for run in layout.runs(block):
            f = layout.flow(text, run)
            at = 0
            for e in [*boundaries(f.text, learnt), len(f.text)]:
                piece = f.text[at:e]
                if piece.strip():
                    a = at + len(piece) - len(piece.lstrip())
                    z = at + len(piece.rstrip())
                    out.append((b, f.starts[a], f.ends[z - 1]))
                at = e
    return out


_UNIT = T.ArrayType(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec_id, text) of all posts and requests; a request delivered more than once comes once."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text")
    reqs = table(spark, sf_dir, "requests").select(F.lit("requests").alias("src"), F.col("request_id").alias("rec_id"), "text").distinct()
    return docs.unionByName(reqs)


_TALLY = "kind string, word string, yes bigint, no bigint, before array<string>, behind array<string>"


def learn(recs: DataFrame, col: str = "text") -> Learnt:
    """`Learnt` of all texts: counted on the executors; what passes the counts comes to the driver, as with `learn_from`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in tallies((t for rows in batches for t in rows["t"]), TALLY_ENTRIES):
            yield pd.DataFrame([(*k, x.yes, x.no, sorted(x.before), sorted(x.behind)) for k, x in found.items()], columns=["kind", "word", "yes", "no", "before", "behind"])

    texts = spread(recs.select(F.col(col).alias("t")).where("t <> ''"))
    different = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    counts = texts.mapInPandas(count, _TALLY).groupBy("kind", "word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), different("before"), different("behind"))
    often = (F.col("yes") >= LEARN_COUNT) & (F.col("yes") >= LEARN_SHARE * (F.col("yes") + F.col("no")))
    free = (F.col("yes") >= WORD_COUNT) & (F.col("before") >= WORD_NEIGHBOURS) & (F.col("behind") >= WORD_NEIGHBOURS)
    return _learnt([(r.kind, r.word) for r in counts.where(F.when(F.col("kind") == "word", free).otherwise(often)).select("kind", "word").collect()])


def sentence_ends(recs: DataFrame, ids: list[str], col: str = "text", learnt: Learnt | None = None) -> DataFrame:
    """(ids, end_pos): one row per boundary between two sentences of a block.

    Null and empty texts give none, repeated rows come out once, texts of any length are read as a whole. Without `learnt`
    it is learnt from `recs`.
    """
    shared = recs.sparkSession.sparkContext.broadcast(learnt or learn(recs, col))  # words and abbreviations only

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ends(t, shared.value))

    rows = spread(recs.select(*ids, F.col(col).alias("__text")).where("__text <> ''"))
    return rows.select(*ids, F.explode(F.pandas_udf(find, T.ArrayType(T.IntegerType())).asNondeterministic()("__text")).alias("end_pos")).distinct()


def sentence_units(recs: DataFrame, ids: list[str], col: str = "text", learnt: Learnt | None = None) -> DataFrame:
    """(ids, sent_no, block, start_pos, end_pos, sentence): every text as its sentences, in order."""
    shared = recs.sparkSession.sparkContext.broadcast(learnt or learn(recs, col))

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"block": b, "start_pos": s, "end_pos": e} for b, s, e in units(t, shared.value)])

    rows = spread(recs.select(*ids, F.col(col).alias("__text")).where("__text <> ''")).select(*ids, "__text", F.posexplode(F.pandas_udf(find, _UNIT).asNondeterministic()("__text")).alias("sent_no", "u"))
    return rows.select(*ids, "sent_no", "u.block", "u.start_pos", "u.end_pos", F.expr("substring(__text, u.start_pos + 1, u.end_pos - u.start_pos)").alias("sentence"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_ends(records(spark, sf_dir), ["src", "rec_id"])


def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(records(spark, sf_dir), ["src", "rec_id"])
