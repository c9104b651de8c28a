"""Office documents: text segments of DOCX and ODT files, rewriting, and removal of what is hidden in them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ODT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
SEGMENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("seg_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])


def _parse(data: bytes) -> ET.Element:
    if b"<!ENTITY" in data or b"<!DOCTYPE" in data:
        raise ValueError("documents with entity declarations are refused")
    for prefix, uri in re.findall(rb'xmlns:([\w\-]+)="([^"]+)"', data[:20_000]):
        try:
            ET.register_namespace(prefix.decode(), uri.decode())
        except ValueError:
            pass
    return ET.fromstring(data)


def _docx_paragraphs(root: ET.Element) -> Iterator[tuple[str, list[ET.Element]]]:
    """Paragraphs of the body and of its tables with their text runs."""
    body = root.find(f"{W}body")
    direct = set(body) if body is not None else set()
    for p in body.iter(f"{W}p") if body is not None else ():
        yield "paragraph" if p in direct else "table", list(p.iter(f"{W}t"))


def _odt_nodes(root: ET.Element) -> Iterator[tuple[str, ET.Element, str]]:
    """Text nodes of paragraphs and headings: (kind, element, 'text' or 'tail')."""

    def walk(node: ET.Element, top: ET.Element) -> Iterator[tuple[str, ET.Element, str]]:
        kind = "heading" if top.tag == f"{ODT}h" else "paragraph"
        if node.text and node.text.strip():
            yield kind, node, "text"
        for child in node:
            if child.tag not in (f"{ODT}p", f"{ODT}h"):
                yield from walk(child, top)
            if child.tail and child.tail.strip():
                yield kind, child, "tail"

    for node in root.iter():
        if node.tag in (f"{ODT}p", f"{ODT}h"):
            yield from walk(node, node)


def segments_of(path: str, data: bytes) -> list[tuple[int, str, str]]:
    """(number, kind, text) of every non-empty segment of a DOCX or ODT file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if path.lower().endswith(".docx"):
            found = [(k, "".join(t.text or "" for t in ts)) for k, ts in _docx_paragraphs(_parse(z.read("word/document.xml")))]
        elif path.lower().endswith(".odt"):
            found = [(k, getattr(n, where)) for k, n, where in _odt_nodes(_parse(z.read("content.xml")))]
        else:
            raise ValueError(f"not a document of a known format: {path}")
    return [(i, k, t) for i, (k, t) in enumerate(found) if t and t.strip()]


def _rezip(data: bytes, change: Callable[[str, bytes], bytes | None]) -> bytes:
    """The archive with every part passed through `change`; None leaves a part out."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in z.infolist():
            part = change(info.filename, z.read(info.filename))
            if part is not None:
                new.writestr(info.filename, part, zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rewrite(path: str, data: bytes, texts: dict[int, str]) -> bytes:
    """The document with segments replaced: a paragraph's text goes to its first run, the others are emptied."""

    def change(name: str, part: bytes) -> bytes:
        if name == "word/document.xml" and path.lower().endswith(".docx"):
            root = _parse(part)
            for i, (_, runs) in enumerate(_docx_paragraphs(root)):
                if i in texts and runs:
                    runs[0].text = texts[i]
                    runs[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                    for r in runs[1:]:
                        r.text = ""
            return ET.tostring(root, encoding="utf-8", xml_declaration=True)
        if name == "content.xml" and path.lower().endswith(".odt"):
            root = _parse(part)
            for i, (_, node, where) in enumerate(list(_odt_nodes(root))):
                if i in texts:
                    setattr(node, where, texts[i])
            return ET.tostring(root, encoding="utf-8", xml_declaration=True)
        return part

    return _rezip(data, change)


# Parts that carry hidden content, and the elements counted in the report.
_DROPPED = re.compile(r"docProps/|word/comments|word/people\.xml|customXml/|meta\.xml|Thumbnails/|Configurations2/")
_COUNTED = {"revisions": rb"<w:(?:ins|del|moveFrom|moveTo)[ >]|<text:changed-region[ >]", "comments": rb"<w:comment [^>]*>|<office:annotation[ >]"}


def sanitize(path: str, data: bytes) -> tuple[bytes, dict[str, int]]:
    """The document without properties, comments and tracked changes, and how many of each there were.

    Insertions are accepted, deletions removed.
    """
    report = {"parts": 0, "revisions": 0, "comments": 0}

    def change(name: str, part: bytes) -> bytes | None:
        for kind, rx in _COUNTED.items():
            report[kind] += len(re.findall(rx, part))
        if _DROPPED.match(name):
            report["parts"] += 1
            return None
        if name == "word/document.xml":
            part = re.sub(rb"<w:(del|moveFrom)[ >].*?</w:\1>", b"", part, flags=re.S)
            part = re.sub(rb"</?w:(?:ins|moveTo)(?: [^>]*)?>", b"", part)
            part = re.sub(rb"<w:comment(?:RangeStart|RangeEnd|Reference)[^>]*/>", b"", part)
        elif name == "content.xml":
            part = re.sub(rb"<text:tracked-changes.*?</text:tracked-changes>|<office:annotation[ >].*?</office:annotation>|<text:change(?:-start|-end)?[^>]*/>", b"", part, flags=re.S)
        elif name in ("[Content_Types].xml", "META-INF/manifest.xml") or name.endswith(".rels"):
            part = re.sub(rb'<(?:Override|Relationship|manifest:file-entry)[^>]*(?:docProps/|comments|people\.xml|customXml/|meta\.xml|Thumbnails/|Configurations2/)[^>]*/>', b"", part)
        return part

    return _rezip(data, change), report


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, seg_no, kind, text) of office files; a file is read by one task, files in parallel. Unreadable files give one
    row of kind 'error'."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, b in zip(batch["path"], batch["content"]):
                try:
                    rows += [(p, *s) for s in segments_of(p, bytes(b))]
                except (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError) as e:
                    rows.append((p, -1, "error", type(e).__name__))
            yield pd.DataFrame(rows, columns=SEGMENTS.names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(split, SEGMENTS)


def write_documents(originals: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, content): documents with the texts of `segments` (path, seg_no, text) written back, hidden content removed."""
    new = segments.groupBy("path").agg(F.collect_list(F.struct("seg_no", "text")).alias("segs"))

    @F.pandas_udf(T.BinaryType())
    def put(path: pd.Series, content: pd.Series, segs: pd.Series) -> pd.Series:
        return pd.Series([sanitize(p, rewrite(p, bytes(b), {s["seg_no"]: s["text"] for s in (ss if ss is not None else [])}))[0] for p, b, ss in zip(path, content, segs)])

    return originals.join(new, "path", "left").select("path", put("path", "content", "segs").alias("content"))
