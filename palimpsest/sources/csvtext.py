"""CSV and TSV documents: separator and header sniffing, cells as segments, byte-faithful rewriting, streaming."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SEPARATORS = ("\t", ",", ";")
SNIFF_LINES = 8
BOM = "﻿"

SEGMENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("row_no", T.LongType()), T.StructField("col_no", T.IntegerType()), T.StructField("is_header", T.BooleanType()), T.StructField("text", T.StringType())])


def sniff_separator(text: str) -> str:
    """The separator counted most often in the first lines, the earlier of equal ones; by column counts if none occurs."""
    lines = text.lstrip(BOM).splitlines()[:SNIFF_LINES]
    counts = {s: sum(line.count(s) for line in lines) for s in SEPARATORS}
    best = max(SEPARATORS, key=lambda s: counts[s])
    if counts[best]:
        return best
    widths = {s: max((len(r) for r in csv.reader(lines, delimiter=s)), default=0) for s in SEPARATORS}
    return max(SEPARATORS, key=lambda s: widths[s])


def looks_like_header(first: list[str], second: list[str] | None) -> bool:
    """At least two distinct, filled, short cells, none starting with a digit or plus, over a row that has a digit or an at
    sign in a column where the first row has none."""
    if second is None or len(first) < 2:
        return False
    cells = [c.strip() for c in first]
    if any(not c or len(c) > 40 or c[0].isdigit() or c[0] == "+" for c in cells) or len({*cells}) < len(cells):
        return False
    data = lambda c: any(x.isdigit() or x == "@" for x in c)
    return any(data(b) and not data(a) for a, b in zip(cells, second))


def read_rows(text: str, separator: str | None = None) -> list[list[str]]:
    """Rows of a document; quotes are taken loosely, rows may be ragged."""
    return list(csv.reader(io.StringIO(text.lstrip(BOM), newline=""), delimiter=separator or sniff_separator(text), strict=False))


def cells(text: str, header: str = "auto") -> Iterator[tuple[int, int, bool, str]]:
    """(row, column, is_header, cell) of every filled cell. `header`: 'auto', 'none' or 'present'."""
    rows = read_rows(text)
    head = header == "present" or (header == "auto" and bool(rows) and looks_like_header(rows[0], rows[1] if len(rows) > 1 else None))
    for i, row in enumerate(rows):
        for j, cell in enumerate(row):
            if cell.strip():
                yield i, j, head and i == 0, cell


def rewrite(text: str, replaced: dict[tuple[int, int], str]) -> str:
    """The document with cells replaced, its separator, byte order mark and line ends kept."""
    sep = sniff_separator(text)
    rows = read_rows(text, sep)
    for (i, j), value in replaced.items():
        rows[i][j] = value
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\r\n" if "\r\n" in text else "\n").writerows(rows)
    return (BOM if text.startswith(BOM) else "") + out.getvalue()


def read_segments(spark: SparkSession, paths: str | list[str], header: str = "auto") -> DataFrame:
    """(path, row_no, col_no, is_header, text): one row a filled cell. A file is read by one task, files in parallel."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, j, h, c) for p, b in zip(batch["path"], batch["content"]) for i, j, h, c in cells(bytes(b).decode("utf-8", "replace"), header)]
            yield pd.DataFrame(rows, columns=SEGMENTS.names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(split, SEGMENTS)


def write_documents(originals: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, content): documents (path, content) with the cells of `segments` (path, row_no, col_no, text) written back."""
    from pyspark.sql import functions as F

    new = segments.groupBy("path").agg(F.collect_list(F.struct("row_no", "col_no", "text")).alias("cells"))

    @F.pandas_udf(T.BinaryType())
    def put(content: pd.Series, changed: pd.Series) -> pd.Series:
        return pd.Series([rewrite(bytes(b).decode("utf-8", "replace"), {(c["row_no"], c["col_no"]): c["text"] for c in (cs if cs is not None else [])}).encode() for b, cs in zip(content, changed)])

    return originals.join(new, "path", "left").select("path", put("content", "cells").alias("content"))


def stream_rows(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of lines (path, value) of text files, for batches of cells through `foreachBatch`."""
    from pyspark.sql import functions as F

    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder).select(F.col("_metadata.file_path").alias("path"), "value")
