"""Tables behind the one form of equal-looking text.

All tables come from rules over the Unicode database of Python, except the look-alike letters, which are fixed values.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

# Letters that look like a basic Latin letter, by the letter they look like.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀᏆ", "J": "ЈᎫͿ",
    "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅᏚՏ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ",
    "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιɩı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛզ", "s": "ѕ", "u": "υսʋ", "v": "ѵν", "w": "ԝա", "x": "х", "y": "уүγ", "'": "’ʼ‘ʹ′", "-": "‐‑‒–−⁃", ".": "․",
}
# Characters without ink that no category marks as such.
INKLESS = "͏ᅟᅠ឴឵᠋᠌᠍᠏⁥ㅤﾠ￰"

LOOKS = {ord(c): ord(to) for to, row in LOOKALIKES.items() for c in row}


def invisible(c: str) -> bool:
    """Format characters, variation selectors and fillers: no ink and no width."""
    cp = ord(c)
    return (
        c in INKLESS
        or unicodedata.category(c) == "Cf"
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0000 <= cp <= 0xE0FFF
        or (unicodedata.category(c) == "Cc" and c not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85")
    )


def blank(c: str) -> bool:
    return c.isspace() or unicodedata.category(c) == "Zs" or c == "⠀"


@cache
def pieces(c: str) -> tuple[tuple[str, int], ...]:
    """Code points with combining classes to which one character is reduced; empty for an invisible one."""
    if blank(c):
        return ((" ", 0),)
    if invisible(c):
        return ()
    out = []
    for d in unicodedata.normalize("NFKD", c):
        if invisible(d):
            continue
        d = " " if blank(d) else chr(LOOKS.get(ord(d), ord(d)))
        out.append((d, unicodedata.combining(d)))
    return tuple(out)


@cache
def mapping_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """Every code point that does not simply stand for itself: the decomposition table, bounded by Unicode's size.

    Precomposed Hangul stands for itself: recomposition would give it back.
    """
    rows = []
    for cp in range(1, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or 0xE0000 <= cp <= 0xE0FFF:
            continue
        c = chr(cp)
        if unicodedata.category(c) in ("Cn", "Co"):
            continue
        p = pieces(c)
        if p != ((c, 0),):
            rows.append((c, [tuple(x) for x in p]))
    rows += [(chr(cp), []) for cp in range(0xE0000, 0xE0080)]
    rows += [(chr(cp), []) for cp in range(0xE0100, 0xE01F0)]
    return rows


@cache
def fold_char(c: str) -> str:
    """The characters, accents kept, that one character reads as; empty for an invisible one."""
    return unicodedata.normalize("NFC", "".join(d for d, _ in pieces(c)))


class _Fold(dict):
    def __missing__(self, cp: int) -> str:
        self[cp] = out = fold_char(chr(cp))
        return out


FOLD = _Fold()


def skeleton(text: str) -> str:
    """The one form: what `canonicalize` gives, for a single text in Python."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split(" ")).strip(" ") if "  " not in text else re.sub(" +", " ", text).strip(" ")
    out = unicodedata.normalize("NFC", "".join(d for c in text for d, _ in pieces(c)))
    return re.sub(" +", " ", out).strip(" ")


class _Plain(dict):
    """Case, accents and look-alikes removed: for comparison of words."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        out = "".join(d for d, k in pieces(c) if not k and unicodedata.category(d) != "Mn").casefold()
        out = unicodedata.normalize("NFKD", out)
        self[cp] = out = "".join(d for d in out if unicodedata.category(d) != "Mn")
        return out


PLAIN = _Plain()
LOWER_ONLY = {cp: chr(cp).lower() for cp in range(128)}


def plain(text: str) -> str:
    """Text in lower case without accents, marks, invisible characters and look-alikes."""
    return text.lower() if text.isascii() else text.translate(PLAIN)
