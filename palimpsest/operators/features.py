"""Features of words for sequence labelling: lexical, contextual, gazetteer, cluster and vector features of a sentence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Small words, name particles and abbreviations by language.
STOP_WORDS = {
    "en": "the a an and or but of in on at to for from by with as is are was were be been this that these those it he she they we you i his her their our my not no",
    "fr": "le la les un une des du de et ou mais en dans sur à au aux pour par avec est sont était ce cet cette ces il elle ils elles nous vous je son sa ses leur notre ne pas",
    "es": "el la los las un una unos unas de del y o pero en a al por para con es son era este esta estos estas él ella ellos nosotros yo su sus nuestro no",
}
PARTICLES = {"en": "of van von de", "fr": "de du des d' le la van von", "es": "de del de la y van von"}
ABBREVIATIONS = {"en": "mr mrs ms dr prof st inc ltd co jr sr", "fr": "m mm mme mlle dr me pr st ste", "es": "sr sra srta dr dra d dña st sta"}

_DIGIT = re.compile(r"\d")


def shape(w: str) -> str:
    return "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.islower() else c for c in w)


def short_shape(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", shape(w))


@dataclass
class Extractor:
    """Features of every token of a sentence, as name to value. `schema` 0 keeps the length flag of single characters."""

    lang: str = "fr"
    window: int = 2
    schema: int = 1
    gazetteers: dict[str, dict[str, int]] = field(default_factory=dict)
    clusters: dict[str, str] = field(default_factory=dict)
    vectors: dict[str, list[float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.stop = set(STOP_WORDS.get(self.lang, "").split())
        self.particles = set(PARTICLES.get(self.lang, "").split())
        self.abbreviations = set(ABBREVIATIONS.get(self.lang, "").split())

    def sentence(self, words: list[str]) -> list[dict[str, float]]:
        low = [w.lower() for w in words]
        title = [w[:1].isupper() for w in words]
        shapes = [shape(w) for w in words]
        runs = self._runs(title)
        out = []
        n = len(words)
        for i, w in enumerate(words):
            at = lambda k, seq=low: seq[k] if 0 <= k < n else ("BOS" if k < 0 else "EOS")
            f: dict[str, float] = {"bias": 1.0, f"lower={low[i]}": 1.0, f"shape={shapes[i]}": 1.0, f"short={short_shape(w)}": 1.0}
            for k in range(1, min(4, len(w)) + 1):
                f[f"suf{k}={low[i][-k:]}"] = f[f"pre{k}={low[i][:k]}"] = 1.0
            f[f"len={'short' if len(w) <= 2 else 'medium' if len(w) <= 5 else 'long'}"] = 1.0
            if self.schema == 0 and len(w) == 1:
                f["single"] = 1.0
            letters = [c for c in w if c.isalpha()]
            for name, value in (
                ("upper", bool(letters) and all(c.isupper() for c in letters)), ("title", title[i]), ("digit", w.isdigit()), ("hyphen", "-" in w), ("apostrophe", "'" in w or "’" in w),
                ("hasdigit", bool(_DIGIT.search(w))), ("caps", sum(c.isupper() for c in w) / max(1, len(w))), ("first", i == 0), ("midcap", i > 0 and title[i]),
            ):
                f[name] = float(value)
            for k in range(1, self.window + 1):
                for sign, j in (("-", i - k), ("+", i + k)):
                    f[f"w{sign}{k}={at(j)}"] = 1.0
                    if 0 <= j < n:
                        f[f"title{sign}{k}"] = float(title[j])
                        f[f"short{sign}{k}={short_shape(words[j])}"] = 1.0
                        if len(words[j].encode()) >= 3:
                            f[f"suf{sign}{k}={low[j][-3:]}"] = 1.0
            f[f"b-={at(i - 1)} {low[i]}"] = f[f"b+={low[i]} {at(i + 1)}"] = f[f"b--={at(i - 2)} {at(i - 1)}"] = f[f"b++={at(i + 1)} {at(i + 2)}"] = 1.0
            f[f"pos={'first' if i == 0 else 'second' if i == 1 else 'last' if i == n - 1 else 'inner'}"] = 1.0
            if title[i]:
                f[f"run={'5+' if runs[i] >= 5 else runs[i]}"] = 1.0
                if i and title[i - 1]:
                    f["titlepair"] = 1.0
                if i + 1 < n and title[i + 1]:
                    f["titlepair+"] = 1.0
            self._lists(f, low, i)
            self._cluster(f, low, i)
            self._vector(f, low, i)
            for name, group in (("stop", self.stop), ("particle", self.particles), ("abbreviation", self.abbreviations)):
                if low[i].rstrip(".") in group:
                    f[name] = 1.0
            out.append(f)
        return out

    @staticmethod
    def _runs(title: list[bool]) -> list[int]:
        out, i = [0] * len(title), 0
        while i < len(title):
            j = i
            while j < len(title) and title[j]:
                j += 1
            out[i:j] = [j - i] * (j - i)
            i = max(j, i + 1)
        return out

    def _lists(self, f: dict[str, float], low: list[str], i: int) -> None:
        for name, terms in self.gazetteers.items():
            n = terms.get(low[i])
            if n is not None:
                f[f"gaz={name}"] = f[f"gaz={name}:{'common' if n > 10000 else 'medium' if n > 1000 else 'unique' if n == 1 else 'rare'}"] = 1.0
            for size in (2, 3):
                for start in range(max(0, i - size + 1), i + 1):
                    if start + size <= len(low) and " ".join(low[start : start + size]) in terms:
                        f[f"gazseq={name}:{'B' if start == i else 'I'}"] = 1.0

    def _cluster(self, f: dict[str, float], low: list[str], i: int) -> None:
        for sign, j in (("", i), ("-", i - 1), ("+", i + 1)):
            path = self.clusters.get(low[j]) if 0 <= j < len(low) else None
            if path:
                for k in (4, 6, 10, 20):
                    if len(path) >= k:
                        f[f"brown{sign}{k}={path[:k]}"] = 1.0

    def _vector(self, f: dict[str, float], low: list[str], i: int) -> None:
        for sign, j, dims in (("", i, 10), ("-", i - 1, 5), ("+", i + 1, 5)):
            vec = self.vectors.get(low[j]) if 0 <= j < len(low) else None
            for k, v in enumerate((vec or [])[:dims]):
                f[f"vec{sign}{k}={'xl' if v > 1 else 'lg' if v > 0.3 else 'sm' if v > -0.3 else 'nl' if v > -1 else 'xn'}"] = 1.0
