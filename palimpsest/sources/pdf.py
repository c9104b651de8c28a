"""Text of simple PDF files: content streams, text operators, ToUnicode maps, lines and blanks.

Covers files with uncompressed or deflated streams and classic or object-stream layout. Encrypted files, scanned pages and
rewriting need a PDF library and are not covered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Piece(NamedTuple):
    page: int
    x: float
    y: float
    size: float
    text: str


_OBJ = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_ESC = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}
_OPS = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


def _stream(body: bytes) -> tuple[bytes, bytes] | None:
    m = _STREAM.match(body)
    if not m:
        return None
    head, data = m.groups()
    if b"FlateDecode" in head:
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            return None
    return head, data


def objects(data: bytes) -> dict[int, bytes]:
    """Bodies of all objects, those inside object streams included."""
    found = {int(n): body for n, body in _OBJ.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (s := _stream(body)):
            head, text = s
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, head).group(1)) for k in (b"N", b"First"))
            numbers = list(map(int, text[:first].split()[: 2 * n]))
            at = numbers[1::2] + [len(text) - first]
            for k, num in enumerate(numbers[::2]):
                found.setdefault(num, text[first + at[k] : first + at[k + 1]])
    return found


def cmap(text: bytes) -> dict[int, str]:
    """Character codes to text, from single and range mappings."""
    out: dict[int, str] = {}
    word = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[int(a, 16)] = word(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            base = word(c)
            for k in range(min(int(b, 16) - int(a, 16), 0xFFFF) + 1):
                out[int(a, 16) + k] = base[:-1] + chr(ord(base[-1]) + k) if base else ""
    return out


def decode(token: bytes, codes: dict[int, str] | None) -> str:
    """A string operand: by the font's map if it has one, UTF-16 with a byte order mark, else Latin-1."""
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m.group(1), 8) & 255]), token[1:-1])
        raw = re.sub(rb"\\(.)", lambda m: _ESC.get(m.group(1), m.group(1).decode("latin-1")).encode("latin-1"), raw, flags=re.S)
    if codes:
        width = 2 if max(codes, default=0) > 255 else 1
        return "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def pieces(data: bytes) -> list[Piece]:
    """Pieces of text with page and position, in the order of the content."""
    obj = objects(data)
    ref = lambda b, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m.group(1))] if (m := re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, b)) else []
    fonts: dict[int, dict[int, str]] = {}
    for n, body in obj.items():
        if b"/ToUnicode" in body and (to := ref(body, b"ToUnicode")) and (s := _stream(obj.get(to[0], b""))):
            fonts[n] = cmap(s[1])
    out = []
    pages = [n for n, b in sorted(obj.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    for page, n in enumerate(pages):
        body = obj[n]
        res = body + b"".join(obj.get(r, b"") for r in ref(body, b"Resources"))
        names = {m[0]: fonts.get(int(m[1]), {}) for m in re.findall(rb"/(\w+)\s+(\d+)\s+0\s+R", res)}
        content = b"\n".join(s[1] for r in ref(body, b"Contents") if (s := _stream(obj.get(r, b""))))
        out += _show(content, names, page)
    return out


def _show(content: bytes, fonts: dict[bytes, dict[int, str]], page: int) -> list[Piece]:
    out: list[Piece] = []
    args: list[bytes] = []
    x = y = lx = ly = lead = 0.0
    size, codes = 10.0, {}
    num = lambda k: float(args[k]) if len(args) >= -k and re.fullmatch(rb"[-+]?\d*\.?\d+", args[k]) else 0.0
    for m in _OPS.finditer(content):
        t = m.group()
        if not re.fullmatch(rb"[A-Za-z'\"*]+", t):
            args.append(t)
            continue
        if t == b"BT":
            x = y = lx = ly = 0.0
        elif t == b"Tf" and len(args) >= 2:
            codes, size = fonts.get(args[-2][1:], {}), num(-1)
        elif t in (b"Td", b"TD"):
            lx, ly = lx + num(-2), ly + num(-1)
            x, y = lx, ly
            lead = -num(-1) if t == b"TD" else lead
        elif t == b"Tm":
            lx, ly = num(-2), num(-1)
            x, y = lx, ly
        elif t == b"TL":
            lead = num(-1)
        elif t == b"T*":
            ly -= lead
            x, y = lx, ly
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                ly -= lead
                x, y = lx, ly
            text = ""
            for a in args:
                if a[:1] in b"(<":
                    text += decode(a, codes)
                elif re.fullmatch(rb"[-+]?\d*\.?\d+", a) and t == b"TJ" and float(a) < -200 and text and not text.endswith(" "):
                    text += " "
            if text:
                out.append(Piece(page, x, y, size, text))
                x += 0.5 * size * len(text)
        args = []
    return out


def lines(data: bytes) -> list[tuple[int, float, str]]:
    """(page, y, text) of lines: pieces of about the same height, a blank where one starts anew or leaves a gap."""
    out: list[tuple[int, float, str]] = []
    end = 0.0
    for p in pieces(data):
        if out and out[-1][0] == p.page and abs(out[-1][1] - p.y) <= 3:
            gap = p.x < end - p.size or p.x - end > 0.2 * p.size
            out[-1] = (p.page, out[-1][1], out[-1][2] + (" " if gap and not out[-1][2].endswith(" ") else "") + p.text)
        else:
            out.append((p.page, p.y, p.text))
        end = p.x + 0.5 * p.size * len(p.text)
    return [(a, b, t) for a, b, t in out if t.strip()]


SEGMENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("seg_no", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("y", T.DoubleType()), T.StructField("text", T.StringType())])


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, seg_no, page, y, text): the lines of PDF files; a file without readable text gives none."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *line) for p, b in zip(batch["path"], batch["content"]) for i, line in enumerate(lines(bytes(b)))]
            yield pd.DataFrame(rows, columns=SEGMENTS.names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(split, SEGMENTS)
