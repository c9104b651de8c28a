"""Templates of synthetic documents: a head of `key: value` lines, a line `---`, and a body.

In the body `{{KIND:slot|key=value}}` stands for a value, annotated if KIND is in capitals; `{{pad:n-m}}` for blanks;
`[?name] ... [/]` for a section that may be left out; `[!noise] ... [/]` for text that may be spread; `@block name ... @end`
declares lines that `{{LINES:name:n-m}}` repeats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Kinds of values, the labels of annotated ones, families of organisations.
LABELS = {"PER": "PER", "ORG": "ORG", "ADDR": "LOC"}
KINDS = {"PER", "ORG", "ADDR", "date", "amount", "ref", "siret", "siren", "iban", "email", "phone", "decoy"}
FAMILIES = {"sante", "social", "administration", "commerce", "technique", "assurance"}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Value:
    kind: str
    slot: str
    args: tuple[tuple[str, str], ...] = ()

    @property
    def label(self) -> str:
        return LABELS.get(self.kind, "")

    def arg(self, name: str, default: str = "") -> str:
        return dict(self.args).get(name, default)


@dataclass(frozen=True)
class Pad:
    least: int
    most: int


@dataclass(frozen=True)
class Repeat:
    block: str
    least: int
    most: int


@dataclass(frozen=True)
class Section:
    name: str
    body: tuple
    noise: bool = False


@dataclass
class Template:
    name: str
    head: dict[str, str] = field(default_factory=dict)
    blocks: dict[str, list[tuple]] = field(default_factory=dict)
    body: tuple = ()

    @property
    def weight(self) -> float:
        return float(self.head.get("weight", 1.0))


_PIECE = re.compile(r"\{\{(?P<value>[^{}]*)\}\}|\[\?(?P<section>[\w\-]+)\]|\[!(?P<noise>[\w\-]+)\]|(?P<close>\[/\])")


def _range(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d+)(?:-(\d+))?", text.strip())
    if not m:
        raise TemplateError(f"not a range: {text!r}")
    low, high = int(m.group(1)), int(m.group(2) or m.group(1))
    if low > high:
        raise TemplateError(f"range upside down: {text!r}")
    return low, high


def _value(text: str, blocks: dict[str, list[tuple]]) -> Value | Pad | Repeat:
    first, *args = text.split("|")
    kind, _, slot = first.partition(":")
    kind = kind.strip()
    if kind == "pad":
        return Pad(*_range(slot))
    if kind == "LINES":
        name, _, span = slot.rpartition(":")
        name = name or next(iter(blocks), "")
        if name not in blocks:
            raise TemplateError(f"no block {name!r}")
        return Repeat(name, *_range(span))
    if kind not in KINDS:
        raise TemplateError(f"unknown placeholder {kind!r}")
    pairs = []
    for a in args:
        key, eq, value = a.partition("=")
        if not eq:
            raise TemplateError(f"argument without value: {a!r}")
        if key.strip() == "famille" and value.strip() not in FAMILIES:
            raise TemplateError(f"unknown family {value!r}")
        pairs.append((key.strip(), value.strip()))
    return Value(kind, slot.strip() or kind, tuple(pairs))


def _nodes(text: str, blocks: dict[str, list[tuple]]) -> tuple:
    stack: list[tuple[str | None, bool, list]] = [(None, False, [])]
    at = 0
    for m in _PIECE.finditer(text):
        if m.start() > at:
            stack[-1][2].append(Text(text[at : m.start()]))
        at = m.end()
        if m["value"] is not None:
            stack[-1][2].append(_value(m["value"], blocks))
        elif m["section"] or m["noise"]:
            stack.append((m["section"] or m["noise"], m["noise"] is not None, []))
        else:
            if len(stack) == 1:
                raise TemplateError("section closed that was not opened")
            name, noise, body = stack.pop()
            stack[-1][2].append(Section(name, tuple(body), noise))
    if len(stack) > 1:
        raise TemplateError(f"section {stack[-1][0]!r} is not closed")
    if at < len(text):
        stack[-1][2].append(Text(text[at:]))
    return tuple(stack[0][2])


def parse(name: str, source: str) -> Template:
    head_text, rule, body = source.replace("\r\n", "\n").partition("\n---\n")
    if not rule:
        raise TemplateError(f"{name}: no line '---' behind the head")
    t = Template(name)
    for line in head_text.splitlines():
        if line.strip():
            key, colon, value = line.partition(":")
            if not colon:
                raise TemplateError(f"{name}: head line without colon: {line!r}")
            t.head[key.strip()] = value.strip()
    declared = re.findall(r"(?ms)^@block (\S+)\n(.*?)^@end *$\n?", body)
    rest = re.sub(r"(?ms)^@block \S+\n.*?^@end *$\n?", "", body)
    if re.search(r"(?m)^@(?:block|end)\b", rest):
        raise TemplateError(f"{name}: block without end")
    for block, lines in declared:
        t.blocks[block] = [_nodes(line, t.blocks) for line in lines.splitlines()]
    t.body = _nodes(rest, t.blocks)
    return t
