"""Personal information inside free text (problem 4).

Semi-Markov conditional random field. Candidate segments of bounded length (a whole address, a whole name, a whole number
in its groups) are scored by weights of features of the span as a whole: its shape, checksums, gazetteer membership of its
words, what it could be extended by, the words before and behind it. Dynamic programming over the segments of a stretch of
text chooses boundaries and types together: the best set of segments that do not overlap.

The weights are trained here, on a bounded sample of TRAIN_REQUESTS requests, against what the old engine replaced in
responses. Its labels are incomplete and partly of a wrong type, so a label of a doubtful type stands for every type that
the span can have, weighed by the model itself: gradients are expectations over segmentations that agree with the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import layout
from palimpsest.llm.canon import plain
from palimpsest.llm.normalize import gazetteer_terms
from palimpsest.llm.sampling import ample, below, smallest
from palimpsest.session import spread, table

#: Bound of the training sample, in requests; passes over it; step size and L2 penalty.
TRAIN_REQUESTS, PASSES, RATE, PENALTY = 4_000, 7, 0.25, 1e-4
#: Candidates of the sample that a feature must stand in to get a weight.
MIN_COUNT = 5
#: Digits of the longest telephone number, and of the longest identity number (an IBAN's).
MOST_DIGITS, MOST_ID_DIGITS = 15, 30
TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "PER")
#: Types the old engine's labels can stand for; the other labels stand for any type.
LABEL_TYPES = {"EMAIL": ("EMAIL",), "PHONE": ("PHONE",), "IBAN": ("ID",), "SIREN": ("ID",), "SIRET": ("ID",), "NIR": ("ID",)}

# Titles before a surname.
TITLES = "mr mrs ms miss dr prof sir m mm mme mlle me sr sra srta dra don doña hr hrn fr frau herr г-н г-жа г-h д-р д-p डॉ श्री د السيد г-ha"
# Words for streets, before the name and as its last word or ending.
STREET_BEFORE = r"rue|avenue|av\.?|bd\.?|boulevard|chemin|allée|allee|impasse|place|quai|route|cours|calle|c/|avda\.?|avenida|plaza|paseo|camino|carrera|ronda|rua|travessa|largo|praça|praca|estrada|rotunda|via|viale|piazza|ул\.|улица|пр\.|проспект"
STREET_LAST = r"street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|court|square|way|close|terrace|boulevard|blvd\.?|place|row|crescent"
STREET_END = r"straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|stieg"
_FLAT = r"(?:flat|apt\.?|apartment|unit|suite|room)\s\d{1,4}[a-z]?"
_NUM = r"\d{1,4}(?:\s?(?:bis|ter|quater)\b|\s?[a-d]\b)?"
_W = r"[^\W\d_][\w'’\-]*"
_NAME = rf"(?:(?:de\sla|de\slos|de|des|du|del|da|do|dos|das|la|le|les|of|d')\s?)?{_W}(?:\s{_W}){{0,3}}?"
_ADDRESS = [
    # number, then street word and name; the name may be several words
    rf"(?:{_FLAT},?\s)?(?:n[º°o]\.?\s)?{_NUM},?\s(?:{STREET_BEFORE})\s{_NAME}(?=$|[\W\d]|\s)",
    # number, name, street word at the end
    rf"(?:{_FLAT},?\s)?{_NUM}\s{_W}(?:\s{_W}){{0,2}}?\s(?:{STREET_LAST})(?!\w)",
    # street word, name, number
    rf"(?:{STREET_BEFORE})\s?{_NAME},?\s(?:n\.?[º°o]\.?\s?|№\s?)?{_NUM}(?!\w)",
    # compound street name, number
    rf"(?:(?:am|an\sder|auf\sdem|im|in\sder|zum|zur)\s)?{_W}(?:{STREET_END})\s{_NUM}(?!\w)",
]
_TAILS = {
    "floor": re.compile(r",?\s\d{1,2}\.?[º°ªo](?:\s?[A-D]\b)?", re.I),
    "flat": re.compile(rf"[.,]?\s{_FLAT}", re.I),
    "post": re.compile(rf",?\s(?:[A-Z]{{1,2}}-)?\d{{4,6}}\s(?={_W})", re.I),
    "town": re.compile(rf",?\s(?:(?:san|port|val|st|saint|bad|new|ober)[\s\-])?{_W}", re.I),
    "code": re.compile(r",?\s\d{4,6}(?!\w)"),
}
_ADDR = [re.compile(p, re.I) for p in _ADDRESS]
_HAS_STREET = re.compile(rf"(?<![^\W\d_])(?:{STREET_BEFORE}|{STREET_LAST})(?![^\W\d_])|(?:{STREET_END})(?![^\W\d_])", re.I)

_L = r"[A-Za-z0-9_À-ɏ]"
_AT = r"\s?@\s?|\s?[\[(]\s?(?:at|arroba|chez)\s?[\])]\s?"
_DOT = r"\.|\s?[\[(]\s?(?:dot|punto|point|punkt|ponto)\s?[\])]\s?"
_EMAIL = re.compile(rf"{_L}(?:[\w.+\-]*{_L})?(?P<at>{_AT}){_L}(?:[\w\-]*{_L})?(?:(?P<dot>{_DOT}){_L}(?:[\w\-]*{_L})?)+", re.I)
_NUMBER = re.compile(r"(?<![^\W_])(?:\+\s?)?\(?\d+\)?(?:[\s.\-/]{1,2}\(?\d+\)?|\(\d+\)|(?<=\))\d+)*(?:-?[A-Za-z](?![^\W_]))?")
_CODE = re.compile(r"(?<![^\W_])[A-Za-z]{1,3}\s?\d{6,9}(?![^\W_])|(?<![^\W_])[A-Za-z]{2}\d{2}(?:\s?(?=[A-Za-z]{0,3}\d)[A-Za-z0-9]{1,4}){3,8}(?![^\W_])")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|\S")
_TITLE = set(TITLES.split())


class Segment(NamedTuple):
    start: int
    end: int
    type: str
    features: tuple[str, ...]


class Names:
    """Gazetteer words by list, in comparable form; bounded by the gazetteer, which is a fixed table."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.kinds: dict[str, str] = {}
        self.cache: dict[str, str] = {}
        for kind, term in rows:
            for word in [term, *re.split(r"[\s]", term)] if kind.startswith("per") else [term]:
                k = {"per_first": "F", "per_last": "L", "loc": "P", "org": "O"}.get(kind, "M")
                key = plain(word)
                if len(key) > 1 and self.kinds.get(key) not in ("F", "L"):
                    self.kinds[key] = k

    def kind(self, word: str) -> str:
        k = self.cache.get(word)
        if k is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            k = self.cache[word] = self._kind(word)
        return k

    def _kind(self, word: str) -> str:
        key = plain(word)
        k = self.kinds.get(key)
        if k is None and "-" in key:
            parts = {self.kinds.get(x) for x in key.split("-")}
            k = "L" if "L" in parts else None
        return k or ""


def _iban(s: str) -> bool:
    s = re.sub(r"\s", "", s).upper()
    if not 15 <= len(s) <= 34 or not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]+", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _number_spans(s: str, a: int, b: int) -> list[tuple[int, int]]:
    """The stretches of a run of digit groups that can be one number.

    A run of up to MOST_DIGITS digits is one number. In a longer one, several may stand beside each other: every run of whole
    groups within that bound is a candidate as well, and the model chooses.
    """
    n = sum(c.isdigit() for c in s[a:b])
    if n < 7:
        return []
    if n <= MOST_DIGITS:
        return [(a, b)]
    out = [(a, b)] if n <= MOST_ID_DIGITS else []
    groups = [(m.start() + a, m.end() + a) for m in re.finditer(r"\+?\s?\(?\d+\)?", s[a:b])]
    for i, (x, _) in enumerate(groups):
        digits = 0
        for g, y in groups[i:]:
            digits += sum(c.isdigit() for c in s[g:y])
            if digits > MOST_DIGITS:
                break
            if digits >= 7:
                out.append((x + (s[x] == " "), y))
    return out


def _number_features(s: str) -> list[str]:
    digits = re.sub(r"\D", "", s)
    groups = re.findall(r"\d+", s)
    seps = re.sub(r"[\dA-Za-z]+", "9", s)
    f = [f"sig={'.'.join(str(len(g)) for g in groups)}|{seps}", f"sep={''.join(sorted(set(re.sub('[0-9A-Za-z]', '', s))))}", f"n={len(digits)}", f"lead={s[:2]}", f"groups={min(len(groups), 7)}"]
    if s[-1:].isalpha():
        f.append("letter_last")
        if len(digits) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == s[-1].upper():
            f.append("letter_checks")
    if s[:1].isalpha():
        f.append(f"letters_first={len(re.match('[A-Za-z]+', s).group())}")
    if len(digits) == 15 and digits[0] in "12":
        f.append("social" + ("_checks" if 97 - int(digits[:13]) % 97 == int(digits[13:]) else ""))
    return f


class Finder:
    """Candidate segments with their features."""

    def __init__(self, names: Names):
        self.names = names

    def _context(self, tokens: list[str], i: int, j: int, kind: str) -> list[str]:
        """Features of the words around the tokens i to j."""
        low = lambda k: plain(tokens[k]) if 0 <= k < len(tokens) else "^"
        mask = lambda k: "9" if low(k).isdigit() else low(k)
        p1, p2, n1, n2 = mask(i - 1), mask(i - 2), mask(j), mask(j + 1)
        f = [f"p1={p1}", f"p2={p2} {p1}", f"n1={n1}", f"n2={n1} {n2}"]
        title = p1 in _TITLE or (p1 == "." and p2 in _TITLE)
        if title:
            f.append("title")
        if kind == "PER" and p1 == ".":
            f.append(f"p3={mask(i - 3)} {p2}")
        return f

    def candidates(self, s: str) -> list[Segment]:
        spans = [(m.start(), m.end()) for m in _TOKEN.finditer(s)]
        tokens = [s[a:b] for a, b in spans]
        starts = {a: k for k, (a, _) in enumerate(spans)}
        ends = {b: k + 1 for k, (_, b) in enumerate(spans)}
        out: dict[tuple[int, int, str], tuple[str, ...]] = {}

        def near(a: int, b: int) -> tuple[int, int]:
            i = starts.get(a)
            if i is None:
                i = next((k for k, (x, y) in enumerate(spans) if x <= a < y), 0)
            j = ends.get(b)
            if j is None:
                j = next((k + 1 for k, (x, y) in enumerate(spans) if x < b <= y), len(spans))
            return i, j

        def add(a: int, b: int, kind: str, f: list[str]) -> None:
            i, j = near(a, b)
            out[a, b, kind] = tuple(f"{kind}:{x}" for x in ["bias", *f, *self._context(tokens, i, j, kind)])

        if "@" in s or re.search(r"[\[(]\s?(?:at|arroba|chez)\s?[\])]", s, re.I):
            at = 0
            while m := _EMAIL.search(s, at):
                f = [f"at={re.sub(' ', '_', m['at'].lower())}", f"dot={re.sub(' ', '_', m['dot'].lower())}", f"tld={re.split('[^a-z]', m.group().lower())[-1]}", f"local={'.' in m.group().split(m['at'])[0] or len(m.group().split(m['at'])[0]) > 3}"]
                if m.start() and re.match(r"[\w.+\-]", s[m.start() - 1]):
                    f.append("cut")
                if m["at"].startswith(" ") and m["at"].strip() == "@" and not m["at"].endswith(" "):
                    f.append("lopsided")
                add(m.start(), m.end(), "EMAIL", f)
                at = m.start() + max(1, len(re.match(r"\w+", m.group()).group()) if re.match(r"\w+", m.group()) else 1)
        if any(c.isdigit() for c in s):
            for rx in (_NUMBER, _CODE):
                for m in rx.finditer(s):
                    for a, b in _number_spans(s, *m.span()):
                        text = s[a:b]
                        while text.count("(") != text.count(")") and text[0] == "(":
                            a, text = a + 1, text[1:]
                        if text.count(")") > text.count("("):
                            text = text.rstrip(")")
                            b = a + len(text)
                        f = _number_features(text)
                        for kind in ("PHONE", "ID"):
                            add(a, b, kind, [*f, *(["iban"] if kind == "ID" and _iban(text) else [])])
            if _HAS_STREET.search(s):
                self._addresses(s, add)
        self._persons(s, spans, tokens, add)
        return [Segment(a, b, k, f) for (a, b, k), f in out.items()]

    def _addresses(self, s: str, add) -> None:
        low = not any(c.isupper() for c in s)
        for n, rx in enumerate(_ADDR):
            at = 0
            while m := rx.search(s, at):
                at = m.start() + 1
                a = m.start()
                if a and s[a - 1].isalnum():
                    continue
                at = m.start() + max(1, len(re.match(r"\w*", m.group()).group()))
                stops = {m.end(): ["core"]}
                # names of several words: every longer reading up to four words
                e = m.end()
                if n == 0:
                    for w in re.finditer(rf"[\s\-]{_W}", s[e : e + 60]):
                        if w.start() + e != max(stops) or len(stops) > 3:
                            break
                        stops[e + w.end()] = ["longer"]
                for e in list(stops):
                    self._tails(s, e, stops[e], stops)
                for e, path in stops.items():
                    text = s[a:e]
                    kind_next = self._next(s, e)
                    last = re.split(r"[\s,]+", text)[-1]
                    words = re.findall(_W, text)
                    f = [f"form={n}", f"path={'+'.join(path)}", f"next={kind_next}", f"last={self._word(last)}", f"form_next={n}{kind_next}", f"path_next={path[-1]}{kind_next}", f"low={low}"]
                    if any(w[0].islower() for w in words[1:] if len(w) > 3 and not re.fullmatch(rf"(?:{STREET_BEFORE}|{STREET_LAST}|des|chemin|bis|flat|apt)", w, re.I)) and not low:
                        f.append("low_inside")
                    if re.search(r"[.!?]\s", text) and not re.search(r"(?:ave|av|st|rd|bd|avda|blvd|str|c|n)\.\s", text, re.I):
                        f.append("stop_inside")
                    if re.search(rf"(?i)(?:{_FLAT}),?\s$", s[max(0, a - 16) : a]):
                        f.append("flat_before")
                    if n == 1 and re.search(r"(?i)\bst\.\s", text):
                        f.append("saint")
                    add(a, e, "ADDRESS", f)

    def _word(self, w: str) -> str:
        return "9" * min(len(w), 6) if w.isdigit() else (self.names.kind(w) or ("C" if w[:1].isupper() else "c")) + ("d" if any(c.isdigit() for c in w) else "")

    def _tails(self, s: str, e: int, path: list[str], stops: dict[int, list[str]]) -> None:
        """Everything that may still belong to an address that ends at e, up to a bounded number of parts."""
        if len(path) > 5 or len(stops) > 40:
            return
        for kind, rx in _TAILS.items():
            m = rx.match(s, e)
            if not m:
                continue
            end = m.end()
            if kind == "town":
                word = m.group().lstrip(", ")
                if not m.group().startswith(",") and path[-1] not in ("post", "town", "flat") and not word[:1].isupper():
                    continue
                if path.count("town") > 2:
                    continue
            new = [*path, kind]
            if kind == "post":
                self._tails(s, end - 1, new, stops)
            elif end not in stops:
                stops[end] = new
                self._tails(s, end, new, stops)

    def _next(self, s: str, e: int) -> str:
        """What an address that ends at e could be extended by."""
        for kind, rx in _TAILS.items():
            if m := rx.match(s, e):
                if kind == "town":
                    w = m.group().lstrip(", ")
                    kind += ("_cap" if w[:1].isupper() else "_low") + ("_comma" if m.group().startswith(",") else "") + ("_gaz" if self.names.kind(w) else "")
                return kind
        return "none"

    def _persons(self, s: str, spans: list[tuple[int, int]], tokens: list[str], add) -> None:
        n = len(tokens)
        kinds = []
        for w in tokens:
            if not w[0].isalpha():
                kinds.append("." if w == "." else "," if w == "," else "")
                continue
            k = self.names.kind(w) if len(w) > 1 else ""
            case = "U" if w.isupper() and len(w) > 1 else "T" if w[0].isupper() else "l"
            kinds.append(("I" if len(w) == 1 else "") + k + case)
        for i in range(n):
            k = kinds[i]
            if not k or k in (".", ","):
                continue
            named = k[0] in "FL"
            titled = i and (plain(tokens[i - 1]) in _TITLE or (tokens[i - 1] == "." and i > 1 and plain(tokens[i - 2]) in _TITLE))
            if not (named or (k[0] in "IMPO" and k != "Il" and k[-1] != "l") or (titled and k[-1] != "l") or k == "Il"):
                continue
            shape, has = [], False
            j = i
            while j < n and j - i < 7:
                k = kinds[j]
                if k == "." and (not shape or shape[-1][0] != "I"):
                    break
                if k == "," and (j - i != 1 or kinds[i][0] != "L"):
                    break
                if not k or (k[-1] == "l" and k[0] not in "FLI"):
                    break
                if j > i and k not in (".", ",") and spans[j][0] - spans[j - 1][1] > 2:
                    break
                if k not in (".", ",") and j > i and spans[j][0] == spans[j - 1][1] and shape[-1] not in (".", ","):
                    break
                shape.append(k)
                has = has or k[0] in "FL"
                j += 1
                if k in (".", ",") or (k[0] == "I" and j == i + 1):
                    continue
                if not (has or titled):
                    continue
                nxt = kinds[j] if j < n and spans[j][0] - spans[j - 1][1] == 1 else ""
                prev = kinds[i - 1] if i and kinds[i - 1] and spans[i][0] - spans[i - 1][1] <= 1 else ""
                f = [f"shape={' '.join(shape)}", f"parts={' '.join(x[0] if x[0] in 'FLIPOM.,' else 'c' for x in shape)}", f"next={nxt}", f"prev={prev}", f"len={len(shape)}"]
                if len(shape) == 1:
                    f += [f"lone={shape[0]} {x}" for x in self._context(tokens, i, j, "PER")[:4:2]]
                    f.append(f"lone_title={bool(titled)}")
                a, b = spans[i][0], spans[j - 1][1]
                add(a, b, "PER", f)
        return


class SemiCRF:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, seg: Segment) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in seg.features)

    def decode(self, segs: list[Segment]) -> list[Segment]:
        """The best set of segments without overlap; text outside segments scores zero."""
        segs = sorted(segs, key=lambda x: (x.end, x.start, x.type))
        marks = [0] + sorted({x.end for x in segs})
        at = {e: k for k, e in enumerate(marks)}
        best = [0.0] * len(marks)
        take: list[Segment | None] = [None] * len(marks)
        k = 0
        for x in segs:
            e = at[x.end]
            while k < e:
                k += 1
                best[k], take[k] = best[k - 1], None
            v = best[_floor(marks, x.start)] + self.score(x)
            if v > best[e]:
                best[e], take[e] = v, x
        out = []
        k = len(marks) - 1
        while k > 0:
            if (x := take[k]) is not None:
                out.append(x)
                k = _floor(marks, x.start)
            else:
                k -= 1
        return out[::-1]

    def marginals(self, segs: list[Segment], factor: list[float]) -> list[float]:
        """Probability of each segment under exp(score) * factor, by forward and backward sums over segmentations."""
        marks = [-1] + sorted({x.end for x in segs})
        at = {e: k for k, e in enumerate(marks)}
        psi = [math.exp(min(30.0, self.score(x))) * f for x, f in zip(segs, factor)]
        by_end: dict[int, list[int]] = defaultdict(list)
        for n, x in enumerate(segs):
            by_end[at[x.end]].append(n)
        m = len(marks)
        alpha = [1.0] * m
        before = [_floor(marks, x.start) for x in segs]
        for k in range(1, m):
            alpha[k] = alpha[k - 1] + sum(alpha[before[n]] * psi[n] for n in by_end[k])
        beta = [0.0] * m
        beta[m - 1] = 1.0
        for k in range(m - 1, 0, -1):
            beta[k - 1] += beta[k]
            for n in by_end[k]:
                beta[before[n]] += beta[k] * psi[n]
        z = alpha[m - 1]
        return [alpha[before[n]] * psi[n] * beta[at[x.end]] / z for n, x in enumerate(segs)]


def _floor(marks: list[int], x: int) -> int:
    from bisect import bisect_right

    return bisect_right(marks, x) - 1


def train(texts: list[tuple[list[Segment], list[tuple[int, int, str]]]]) -> SemiCRF:
    """Weights from (candidates, labels as start, end, label) of stretches of text, by stochastic gradient.

    The gradient is the difference of two expectations of the features: over segmentations that hold every labelled span
    (and no other segment that overlaps or adds to them) and over all segmentations. Seeds give the types a start.
    """
    w: dict[str, float] = defaultdict(float)
    for t, names in (("EMAIL", ("bias",)), ("PHONE", ("lead=+3", "lead=+4", "lead=+1", "lead=00", "lead=06", "lead=(5")), ("ID", ("iban", "letter_last", "letters_first=2")), ("ADDRESS", ("bias",)), ("PER", ("bias", "title"))):
        for n in names:
            w[f"{t}:{n}"] = 2.0 if t == "EMAIL" else 0.7
    w["EMAIL:cut"] = w["ADDRESS:flat_before"] = -2.0
    model = SemiCRF(w)
    seen = Counter(name for segs, _ in texts for x in segs for name in x.features)
    texts = [([Segment(x.start, x.end, x.type, tuple(n for n in x.features if seen[n] >= MIN_COUNT or n in w)) for x in segs], labels) for segs, labels in texts]
    grad2: dict[str, float] = defaultdict(float)
    for turn in range(PASSES):
        for segs, labels in texts:
            if not segs:
                continue
            wanted = {(a, b): LABEL_TYPES.get(t) for a, b, t in labels}
            factor = []
            for x in segs:
                types = wanted.get((x.start, x.end), ())
                factor.append(1.0 if types is None or x.type in types else 0.0)
            free = model.marginals(segs, [1.0] * len(segs))
            # labelled spans are certain; among the types a span can have, the model weighs
            total: dict[tuple[int, int], float] = defaultdict(float)
            for x, f in zip(segs, factor):
                if f:
                    total[x.start, x.end] += math.exp(min(30.0, model.score(x)))
            for x, f, p in zip(segs, factor, free):
                q = math.exp(min(30.0, model.score(x))) / total[x.start, x.end] if f else 0.0
                g = q - p
                if abs(g) < 1e-3:
                    continue
                for name in x.features:
                    grad2[name] += g * g
                    w[name] += RATE * (g - PENALTY * w[name]) / math.sqrt(1e-3 + grad2[name])
    return SemiCRF({k: round(v, 4) for k, v in w.items() if abs(v) > 1e-3})


def stretches(text: str) -> list[layout.Flow]:
    """Running text in its one form, by stretch: lines of text that flow into each other, each line of a signature alone."""
    out = []
    for block in layout.blocks(text):
        group: list[layout.Line] = []
        for line in block:
            if line.kind == "text":
                group.append(line)
                continue
            if group:
                out.append(layout.flow(text, group, fold=True))
                group = []
            if line.kind in ("sig", "code", "notice"):
                out.append(layout.flow(text, [line], fold=True))
        if group:
            out.append(layout.flow(text, group, fold=True))
    return [f for f in out if len(f.text) > 2]


def find(text: str, finder: Finder, model: SemiCRF) -> list[tuple[str, int, int]]:
    """(type, start, end) of every item in a text."""
    out = []
    for f in stretches(text):
        segs = finder.candidates(f.text)
        if segs:
            out += [(x.type, f.starts[x.start], f.ends[x.end - 1]) for x in model.decode(segs)]
    return sorted(out, key=lambda x: x[1:])


_PLACEHOLDER = re.compile(r"⟦[^⟧]*⟧|█+")


def aligned(source: str, answer: str, entities: list[tuple[str, str]]) -> list[tuple[int, int, str]] | None:
    """Spans of the source that the answer replaced, with the label of the entity of that text; None if they don't align."""
    labels: dict[str, str] = {}
    for label, text in entities:
        labels.setdefault(text, label)
    parts = _PLACEHOLDER.split(answer)
    if not source.startswith(parts[0]):
        return None
    at, out = len(parts[0]), []
    for k, part in enumerate(parts[1:], 1):
        end = len(source) - len(part) if k == len(parts) - 1 else source.find(part, at + 1)
        if end < at or source[end : end + len(part)] != part or not part and k < len(parts) - 1:
            return None
        out.append((at, end, labels.get(source[at:end], "")))
        at = end + len(part)
    return out


def training_sample(requests: DataFrame, responses: DataFrame) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, labels) of a bounded sample of answered requests, by hash order."""
    # narrowed by the hash before anything is shuffled
    near = below(F.xxhash64("request_id"), ample(2 * TRAIN_REQUESTS, requests.count()))
    requests, responses = requests.where(near), responses.where(near)
    asked = requests.where("text <> ''").groupBy("request_id").agg(F.min("text").alias("source"))
    rows = (
        responses.where("text is not null and entities is not null").groupBy("request_id").agg(F.min_by(F.struct("text", "entities"), "response_id").alias("r"))
        .join(asked, "request_id")
        .select("request_id", "source", F.col("r.text").alias("answer"), F.col("r.entities").alias("entities"))
    )
    rows = smallest(rows, TRAIN_REQUESTS, "request_id").collect()
    out = []
    for r in rows:
        spans = aligned(r.source, r.answer, [(e.type, e.text) for e in r.entities if e.text])
        if spans is not None:
            out.append((r.source, spans))
    return out


def fit(sample: list[tuple[str, list[tuple[int, int, str]]]], finder: Finder) -> SemiCRF:
    data = []
    for text, spans in sample:
        for f in stretches(text):
            segs = finder.candidates(f.text)
            if not segs:
                continue
            where = {(f.starts[x.start], f.ends[x.end - 1]): (x.start, x.end) for x in segs}
            labels = [(*where[a, b], t) for a, b, t in spans if (a, b) in where]
            # a stretch in which a label is no candidate would teach that it is nothing
            inside = [1 for a, b, _ in spans if f.starts[0] <= a and b <= f.ends[-1]]
            if len(inside) == len(labels):
                data.append((segs, labels))
    return train(data)


def gazetteer_rows(gazetteer: DataFrame) -> list[tuple[str, str]]:
    """The gazetteer's (list, term) rows: a fixed table."""
    terms = gazetteer_terms(gazetteer)
    return [(r.name, r.term) for r in gazetteer.select("term_id", "name").distinct().join(terms, "term_id").orderBy("term_id").select("name", "term").collect()]


_ITEM = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))


def detect(recs: DataFrame, gazetteer: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(src, rec_id, text, items): the items of every record, in order.

    A null or empty text has no items; repeated rows come out as often as they are given, so that texts need not be
    shuffled to find them (`p4_found` takes equal results together). Texts of any length are read as a whole. Without
    training rows the seeds alone decide.
    """
    names = gazetteer_rows(gazetteer)
    model = fit(training_sample(requests, responses), Finder(Names(names)))
    shared = recs.sparkSession.sparkContext.broadcast((names, model.weights))  # bounded by the sample: about a megabyte

    def items(texts: pd.Series) -> pd.Series:
        rows, weights = shared.value
        finder, crf = Finder(Names(rows)), SemiCRF(weights)
        return texts.map(lambda t: [{"pii_type": k, "start_pos": a, "end_pos": b} for k, a, b in find(t, finder, crf)] if t else [])

    rows = spread(recs.select("src", "rec_id", "text"))
    # marked as not deterministic so that the optimiser does not plan it again for a filter on its result
    return rows.select("src", "rec_id", "text", F.pandas_udf(items, _ITEM).asNondeterministic()("text").alias("items"))


def mask(text: F.Column, items: F.Column) -> F.Column:
    """The text with every item replaced by a typed placeholder numbered within its type, the rest untouched."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("no"))
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start_pos"] - acc["at"]), F.lit("⟦"), x["pii_type"], F.lit("_"), (acc["no"] + 1).cast("string"), F.lit("⟧")).alias("out"),
        x["end_pos"].alias("at"),
        (acc["no"] + 1).alias("no"),
    )
    return F.aggregate(items, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.sentences import records

    return detect(records(spark, sf_dir), table(spark, sf_dir, "gazetteer"), table(spark, sf_dir, "requests"), table(spark, sf_dir, "responses"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).select("src", "rec_id", F.explode("items").alias("i")).select("src", "rec_id", "i.*").distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text with its items replaced by typed placeholders."""
    return _inputs(spark, sf_dir).select("src", "rec_id", mask(F.col("text"), F.col("items")).alias("masked"), F.size("items").alias("items"))
