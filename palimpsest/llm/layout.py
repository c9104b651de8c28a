"""The layout of posts: blocks, quotes, signatures, code, attribution lines and markup, with positions kept.

A block is a stretch of lines between lines that hold only white space. `flow` turns lines into running text without
quote prefixes, markup and invisible characters, and says for each of its characters where it stands in the source.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from palimpsest.llm.canon import FOLD, invisible


class Line(NamedTuple):
    start: int  # of the line
    body: int  # after the quote prefix
    end: int  # before the line break
    depth: int  # of quote prefixes
    kind: str  # text, code, sig, attribution or notice


_PREFIX = re.compile(r"(?:[ \t]*>)+[ \t]?")
_RULE_SIGNS = ("-", "—", "_", "~", "=", "*")
_RULE = re.compile(r"(?:--[ \t]?|—|_{3,}|~{3,}|={3,}|\*{3,}|-{3,})\s*")
_ATTRIBUTION = re.compile(r"@?[\w.\-]{2,40}:|.{0,160}\b(?:wrote|writes|said|schrieb|a écrit|escribió|escreveu|написал|пишет)\s?:", re.I)
_NOTICE = re.compile(r"\[(?:removed|deleted)[^\]]*\]|\*{2,}[^*]{1,60}\*{2,}", re.I)
_MARKUP = r"</?(?:b|i|u|s|em|strong|span|font|blockquote|p|div|code|pre|a|small|big|sub|sup|img|ul|ol|li|tt)\b[^<>\n]*>|\[/?(?:b|i|u|s|quote|url|img|size|color|code|list|font|center)(?:=[^\]\n]*)?\]"
_BREAK = r"<br\s*/?>"
_ENTITY = r"&(?:quot|amp|lt|gt|nbsp|apos|laquo|raquo|hellip|#\d{1,6}|#x[0-9a-fA-F]{1,6});"
_CODE = re.compile(
    r"\s*(?:\$ \S|>>> |(?:GET|POST|PUT|DELETE|PATCH|HEAD) /|(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL)\b.*(?:0x|\bline \d|:\d)|(?:def|class|for|while|if|elif|with|function|fn)\b[^.!?]*[:{](?:\s.*)?$"
    r"|(?:import|from) [\w.]+(?: import .*)?$|return\b.*[;()]|#include\b|[A-Za-z_][\w.\[\]]*\s*[-+*/]?=\s*\S.*$|.*[;{}]\s*$|\s*at [\w.$]+\(.*\)$|Traceback \()"
)
_TAGS = re.compile(_MARKUP + "|" + _BREAK, re.I)
_SPECIAL = re.compile(f"(?P<tag>{_MARKUP})|(?P<br>{_BREAK})|(?P<ent>{_ENTITY})", re.I)
_ODD = re.compile(r"[^\x20-\x7e]")
_MARK = re.compile(r"[\u0300-\u036f]")
_OPEN_QUOTE = re.compile(r"\[quote(?:=[^\]\n]*)?\]|<blockquote\b[^<>]*>|(\[/quote\]|</blockquote\s*>)", re.I)


def blocks(text: str) -> list[list[Line]]:
    """The lines of each block of a text, in order."""
    out: list[list[Line]] = []
    block: list[Line] = []
    sig = False
    at = 0
    for raw in text.split("\n"):
        start, at = at, at + len(raw) + 1
        if not raw.strip():
            if block:
                out.append(block)
            block, sig = [], False
            continue
        end = start + len(raw.rstrip("\r"))
        m = _PREFIX.match(raw) if ">" in raw else None
        body = start + (m.end() if m else 0)
        depth = m.group().count(">") if m else 0
        s = text[body:end].strip()
        # the first and the last sign rule most patterns out
        if not sig and s[:1] in _RULE_SIGNS and _RULE.fullmatch(s):
            sig = True
        if sig:
            kind = "sig"
        elif s[:1] in ("[", "*") and _NOTICE.fullmatch(s):
            kind = "notice"
        elif s[-1:] == ":" and _ATTRIBUTION.fullmatch(s):
            kind = "attribution"
        elif _CODE.match(_TAGS.sub("", s) if "<" in s or "[" in s else s):
            kind = "code"
        else:
            kind = "text"
        block.append(Line(start, body, end, depth, kind))
    if block:
        out.append(block)
    return out


def quoted(text: str, bs: list[list[Line]]) -> list[tuple[int, int]]:
    """The spans within quote tags; a quote left open ends with its block."""
    if "[quote" not in text.lower() and "<blockquote" not in text.lower():
        return []
    spans, stack = [], []
    ends = [b[-1].end for b in bs]
    for m in _OPEN_QUOTE.finditer(text):
        if m.group(1):
            if stack:
                a = stack.pop()
                if not stack:
                    spans.append((a, m.end()))
        else:
            stack.append(m.start())
    if stack:
        spans.append((stack[0], next((e for e in ends if e >= stack[0]), len(text))))
    return spans


class Flow(NamedTuple):
    text: str
    starts: list[int]  # for each character, where it starts in the source
    ends: list[int]  # and ends


def _plain_run(text: str, a: int, b: int, fold: bool, out: list[str], starts: list[int], ends: list[int]) -> None:
    run = text[a:b]
    # runs that stay as they are, by far most, are taken whole
    if not _ODD.search(run) or (run.translate(FOLD if fold else _VISIBLE) == run and not (fold and _MARK.search(run))):
        out.append(run)
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))
        return
    for i, c in enumerate(run, a):
        if " " <= c <= "~":
            f = c
        elif fold:
            f = FOLD[ord(c)]
        else:
            f = "" if invisible(c) else c
        if not f:
            continue
        if fold and "̀" <= f <= "ͯ" and out:  # a mark: recompose with its base
            import unicodedata

            base = out[-1]
            whole = unicodedata.normalize("NFC", base[-1] + f) if base else f
            if base and len(whole) == 1:
                out[-1] = base[:-1] + whole
                ends[-1] = i + 1
                continue
        out.append(f)
        starts.extend([i] * len(f))
        ends.extend([i + 1] * len(f))


def flow(text: str, lines: list[Line], fold: bool = False, skip: list[tuple[int, int]] = ()) -> Flow:
    """Running text of lines: prefixes and markup left out, entities resolved, lines joined by one blank.

    With `fold`, characters come in their one form (see `canon`). Spans of `skip` are left out.
    """
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for k, line in enumerate(lines):
        a, b = line.body, line.end
        if k:
            out.append(" ")
            starts.append(lines[k - 1].end)
            ends.append(a)
        parts = [(a, b)]
        for x, y in skip:
            parts = [p for u, v in parts for p in ((u, min(v, x)), (max(u, y), v)) if p[0] < p[1]]
        for u, v in parts:
            at = u
            for m in _SPECIAL.finditer(text, u, v):
                _plain_run(text, at, m.start(), fold, out, starts, ends)
                at = m.end()
                if m.lastgroup == "tag":
                    continue
                c = " " if m.lastgroup == "br" else html.unescape(m.group())
                c = " " if c == "\xa0" else c
                if len(c) == 1:
                    out.append(c)
                    starts.append(m.start())
                    ends.append(m.end())
            _plain_run(text, at, v, fold, out, starts, ends)
    return Flow("".join(out), starts, ends)


class _Visible(dict):
    """Invisible characters to nothing, others to themselves."""

    def __missing__(self, cp: int) -> int | None:
        self[cp] = out = None if invisible(chr(cp)) else cp
        return out


_VISIBLE = _Visible()


def _resolved(m: re.Match) -> str:
    if m.lastgroup == "tag":
        return ""
    c = " " if m.lastgroup == "br" else html.unescape(m.group())
    return " " if c == "\xa0" else c if len(c) == 1 else ""


def unmarked(s: str) -> str:
    """Text without markup and invisible characters, entities resolved: what `flow` gives where no positions are asked for."""
    if "<" in s or "[" in s or "&" in s:
        s = _SPECIAL.sub(_resolved, s)
    return s if s.isascii() and s.isprintable() else s.translate(_VISIBLE)


def flow_text(text: str, lines: list[Line], skip: list[tuple[int, int]] = ()) -> str:
    """The text of `flow`, without positions and much faster."""
    if not skip:
        return " ".join(unmarked(text[line.body : line.end]) for line in lines)
    out = []
    for line in lines:
        parts = [(line.body, line.end)]
        for x, y in skip:
            parts = [p for u, v in parts for p in ((u, min(v, x)), (max(u, y), v)) if p[0] < p[1]]
        out.append("".join(unmarked(text[u:v]) for u, v in parts))
    return " ".join(out)


def runs(block: list[Line]) -> list[list[Line]]:
    """Stretches of neighbouring lines of running text in a block."""
    out: list[list[Line]] = []
    last = False
    for line in block:
        if line.kind == "text":
            if last:
                out[-1].append(line)
            else:
                out.append([line])
        last = line.kind == "text"
    return out
