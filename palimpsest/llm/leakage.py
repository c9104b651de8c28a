"""Evaluation texts leaking into training text (problem 8).

Prefix-filtered set join. Every passage is cut into windows of 20 successive words; a document leaks a passage if it holds
a window with at most two words replaced, dropped or added. Shingles of five words of all passages are ordered by rarity,
which is their document frequency over the whole corpus. The prefix of a window is the rarest set of three shingles that
share no word: two changes break two of them at most, so a document with the window holds the third. A document's shingle
that stands in a prefix makes a candidate at one offset between document and passage. Bounds on position (only windows over
that shingle, at that offset give or take the changes) and on length (as many of the window's words must stand there at
all) leave few stretches, which are verified exactly by edit distance.

Each document is cut into words once. The passages are a stated query set: they are held in blocks of bounded size, which
every task reads, so that documents are never moved.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import layout
from palimpsest.llm.canon import plain
from palimpsest.llm.overlap import disjoint
from palimpsest.session import checkpoint, spread, table

#: Successive words of a passage that make a leak, how many of them may be changed, and the words of a shingle.
WINDOW, CHANGED, SHINGLE = 20, 2, 5
#: Words of passages that are held against the corpus at a time; more items are taken in further passes over it.
BLOCK_WORDS = 1_000_000
_QUOTE = re.compile(r"^(?:[ \t]*>)+[ \t]?", re.M)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def text_words(text: str | None) -> list[str]:
    """Comparable words of a whole text: without markup, quote prefixes, case, accents, punctuation and look-alikes."""
    if not text:
        return []
    return _WORD.findall(plain(layout.unmarked(_QUOTE.sub("", text) if ">" in text else text)))


def passages(items: list[tuple[int, str]]) -> list[tuple[list[int], list[str]]]:
    """(item ids, words) of every distinct passage.

    The instruction and the question are common stock: a leading or closing sentence that other items have with another
    neighbour, or a closing one with a question mark. What remains between them is the passage.
    """
    cut = [(i, [s for s in _SENTENCE.split(" ".join((t or "").split())) if s]) for i, t in items]
    norm = lambda s: re.sub(r"\d+", "0", " ".join(_WORD.findall(plain(s))))
    heads: dict[str, set[str]] = {}
    tails: dict[str, set[str]] = {}
    for _, ss in cut:
        if len(ss) > 1:
            heads.setdefault(norm(ss[0]), set()).add(norm(ss[1]))
            tails.setdefault(norm(ss[-1]), set()).add(norm(ss[-2]))
    by: dict[tuple[str, ...], list[int]] = {}
    for i, ss in cut:
        while len(ss) > 1 and (len(tails.get(norm(ss[-1]), ())) > 1 or ss[-1].rstrip().endswith("?") or len(_WORD.findall(ss[-1])) < 3):
            ss = ss[:-1]
        if len(ss) > 1 and len(heads.get(norm(ss[0]), ())) > 1:
            ss = ss[1:]
        by.setdefault(tuple(_WORD.findall(plain(" ".join(ss)))), []).append(i)
    return [(ids, list(w)) for w, ids in by.items() if w]



class Passages:
    """One block of passages as numbers of words, with the shingles by which documents meet them."""

    def __init__(self, rows: list[tuple[list[int], list[str]]]):
        self.number: dict[str, int] = {}  # words from 1; 0 is any word outside the passages
        self.items = [ids for ids, _ in rows]
        self.words = [[self.number.setdefault(w, len(self.number) + 1) for w in ws] for _, ws in rows]
        self.shingles: dict[tuple[int, ...], int] = {}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of each shingle: passage, position
        for k, ws in enumerate(self.words):
            size = min(SHINGLE, len(ws))
            for p in range(len(ws) - size + 1):
                self.places[self.shingles.setdefault(tuple(ws[p : p + size]), len(self.shingles))].append((k, p))
        self.sizes = sorted({len(x) for x in self.shingles})

    def hits(self, words: list[str]) -> tuple[list[int], list[int], list[int]]:
        """(numbers of a document's words, shingles of passages that it holds, where)."""
        get = self.number.get
        ids = [get(w, 0) for w in words]
        found, at = [], []
        for size in self.sizes:
            if len(ids) < size:
                continue
            # stretches of words that all stand in some passage
            known = np.concatenate(([0], np.cumsum(np.array(ids) > 0)))
            for p in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                x = self.shingles.get(tuple(ids[p : p + size]))
                if x is not None:
                    found.append(x)
                    at.append(p)
        return ids, found, at

    def prefixes(self, frequency: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """(passage, position) by shingle, of the shingles that stand in the prefix of some window."""
        out: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k, ws in enumerate(self.words):
            size, need = min(SHINGLE, len(ws)), allowed(len(ws)) + 1
            window = min(WINDOW, len(ws))
            own = [self.shingles[tuple(ws[p : p + size])] for p in range(len(ws) - size + 1)]
            for s in range(len(ws) - window + 1):
                ranges = [(frequency.get(own[p], 0), p - s, p - s + size - 1, own[p], p) for p in range(s, s + window - size + 1)]
                for g, p in disjoint(ranges, window, need):
                    out[g].add((k, p))
        return {g: sorted(v) for g, v in out.items()}


def allowed(n: int) -> int:
    """Changes allowed in a window of a passage of `n` words; a passage shorter than a window must stand as a whole."""
    return CHANGED if n >= WINDOW else n // 10


def holds(doc: list[int], passage: list[int], offsets: list[tuple[int, int]]) -> bool:
    """True if the document holds a window of the passage, lightly changed, over one of the shingles at (position in the
    document, position in the passage)."""
    n = len(passage)
    window, most = min(WINDOW, n), allowed(n)
    done = set()
    for pos, p in offsets:
        for s in range(max(0, p + min(SHINGLE, n) - window), min(p, n - window) + 1):
            start = pos - (p - s)
            if (s, start) in done:
                continue
            done.add((s, start))
            win = passage[s : s + window]
            stretch = doc[max(0, start - most) : start + window + most]
            if sum((Counter(win) & Counter(stretch)).values()) >= window - most and within(win, stretch, most):
                return True
    return False


def within(win: list[int], stretch: list[int], most: int) -> bool:
    """True if some part of the stretch is `win` with at most `most` words replaced, dropped or added."""
    row = [0] * (len(stretch) + 1)
    for i, w in enumerate(win, 1):
        diag, row[0] = row[0], i
        for j, x in enumerate(stretch, 1):
            up = row[j]
            row[j] = min(diag + (w != x), up + 1, row[j - 1] + 1)
            diag = up
        if min(row) > most:
            return False
    return min(row) <= most


def item_rows(items: DataFrame) -> list[tuple[int, str]]:
    """The evaluation set, which is a stated query set."""
    return [(r.item_id, r.text) for r in items.select("item_id", "text").distinct().where("item_id is not null and text is not null").orderBy("item_id", "text").collect()]


def passage_blocks(rows: list[tuple[int, str]]) -> Iterator[Passages]:
    block, size = [], 0
    for ids, words in passages(rows):
        block.append((ids, words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield Passages(block)
            block, size = [], 0
    if block:
        yield Passages(block)


def _leaks_of(documents: DataFrame, block: Passages) -> DataFrame:
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(block)  # at most BLOCK_WORDS words

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ids, found, at = known.hits(text_words(text))
                if found:
                    out.append((doc_id, ids, found, at))
            yield pd.DataFrame(out, columns=["doc_id", "ids", "found", "at"])

    kind = dict(documents.dtypes)["doc_id"]
    # documents that hold any shingle of a passage: few, and written once, as they are read twice
    found = checkpoint(spread(documents.where("text <> ''")).mapInPandas(read, f"doc_id {kind}, ids array<int>, found array<int>, at array<int>"))
    counts = found.select(F.explode(F.array_distinct("found")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    prefixes = sc.broadcast(block.prefixes({r.g: r.n for r in counts.collect()}))  # a row a shingle of the block at most

    def verify(ids: pd.Series, found: pd.Series, at: pd.Series) -> pd.Series:
        places, known = prefixes.value, shared.value

        def one(doc, gs, ps):
            near: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for g, pos in zip(gs.tolist(), ps.tolist()):
                for k, p in places.get(g, ()):
                    near[k].append((pos, p))
            doc = doc.tolist()
            return [i for k, offsets in near.items() if holds(doc, known.words[k], offsets) for i in known.items[k]]

        return pd.Series([one(*x) for x in zip(ids, found, at)])

    items = F.pandas_udf(verify, T.ArrayType(T.LongType())).asNondeterministic()("ids", "found", "at")
    return found.select("doc_id", F.explode(items).alias("item_id"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold at least 20 successive words of an item's passage, lightly changed.

    A passage shorter than that must stand as a whole, with one word in ten changed. Null and empty texts leak nothing; items
    without text have no passage; items that share a passage are all listed. Documents of any length are searched as a
    whole. Repeated rows come out once; columns beside doc_id and text play no part.
    """
    docs = documents.select("doc_id", "text")
    out = None
    for block in passage_blocks(item_rows(items)):
        part = _leaks_of(docs, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.where("false").select("doc_id", F.lit(0).cast("bigint").alias("item_id"))
    return out.distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents by item."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
