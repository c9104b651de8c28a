"""Brown clustering: counts are distributed, the agglomeration of a bounded vocabulary runs on the driver."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.tokens import ngrams, vocabulary

Bigrams = tuple[np.ndarray, np.ndarray, np.ndarray]


def counts(tokens: DataFrame, by: list[str], order: str, word: str = "word", min_count: int = 5, limit: int = 20_000) -> tuple[list[tuple[str, int]], Bigrams]:
    """Unigrams of the `limit` most frequent words, and bigrams among them as (first, second, n), words by their place among
    the unigrams; both bounded by `limit`."""
    uni = sorted(((r["word"], r["n"]) for r in vocabulary(tokens, word, min_count, limit).collect()), key=lambda x: (-x[1], x[0]))
    places = tokens.sparkSession.createDataFrame([(w, k) for k, (w, _) in enumerate(uni)], "word string, place int")
    low = tokens.withColumn(word, F.lower(word))
    pairs = ngrams(low, by, order, word)
    for side in ("first", "second"):
        pairs = pairs.join(F.broadcast(places.select(F.col("word").alias(side), F.col("place").alias(f"{side}_place"))), side)
    bi = pairs.groupBy("first_place", "second_place").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return uni, (bi["first_place"].to_numpy(np.int64), bi["second_place"].to_numpy(np.int64), bi["n"].to_numpy(np.float64))


def _f(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1.0))


def _gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _f(a + b) - _f(a) - _f(b)


def _by(key: np.ndarray, other: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries grouped by `key`: where each group starts, then the other words and counts."""
    order = np.lexsort((other, key))
    return np.searchsorted(key[order], np.arange(size + 1)), other[order], n[order]


class _Active:
    """Bigram counts of the active clusters and what a merge of any two of them loses.

    Merging a and b changes the sum of f(n) = n log n over the cells of the count matrix and over its two margins, and the
    mutual information is the former less the latter. `shared` holds the change over cells for all pairs, as if a and b
    were no neighbours of themselves, `own` what that leaves out, `margin` the change over margins. Only rows that share a
    neighbour with a word or cluster change with it, so a step costs its neighbours times the active clusters.
    """

    def __init__(self, size: int) -> None:
        self.p, self.shared, self.own, self.margin = (np.zeros((size, size)) for _ in range(4))
        self.loss = np.full((size, size), np.inf)
        self.live = np.zeros(size, bool)
        self.out, self.into = np.zeros(size), np.zeros(size)

    def refresh(self, rows: np.ndarray) -> None:
        x = self.margin[rows] - self.shared[rows] - self.own[rows]
        x = np.round(x, 6) + 0.0  # alike pairs tie, whatever order their counts came in
        x[:, ~self.live] = np.inf
        x[np.arange(len(rows)), rows] = np.inf
        self.loss[rows] = x
        self.loss[:, rows] = x.T

    def set_margin(self, rows: np.ndarray) -> None:
        x = _gain(self.out[rows][:, None], self.out[None]) + _gain(self.into[rows][:, None], self.into[None])
        self.margin[rows] = x
        self.margin[:, rows] = x.T

    def set_own(self, s: int) -> None:
        p, d = self.p, self.p.diagonal()
        ss, sb, bs = d[s], p[s], p[:, s]
        x = _f(ss) + _f(sb) + _f(bs) + _f(d) + _f(ss + sb + bs + d) - _f(ss + bs) - _f(sb + d) - _f(ss + sb) - _f(bs + d)
        self.own[s] = x
        self.own[:, s] = x

    def enter(self, s: int, out: np.ndarray, into: np.ndarray) -> None:
        """A word into the free slot `s`, with its counts before and behind each slot; into[s] is not used."""
        p = self.p
        into[s] = 0.0
        p[s], self.live[s] = out, True
        p[:, s] += into
        x = np.flatnonzero(p[s])
        row = _gain(p[s, x], p[:, x]).sum(axis=1)
        y = np.flatnonzero(p[:, s])
        row += _gain(p[y, s][:, None], p[y]).sum(axis=0)
        # the word as a new column of the others' rows, and a new row of their columns
        for z, v in ((y[y != s], p[:, s]), (x[x != s], p[s])):
            self.shared[np.ix_(z, z)] += _gain(v[z][:, None], v[z][None])
        self.shared[s] = row
        self.shared[:, s] = row
        self.set_own(s)
        self.out += into
        self.into += out
        self.out[s], self.into[s] = p[s].sum(), p[:, s].sum()
        rows = np.union1d(np.union1d(x, y), [s])
        rows = rows[self.live[rows]]
        self.set_margin(rows)
        self.refresh(rows)

    def _join(self, p: np.ndarray, keep: int, gone: int) -> np.ndarray:
        """Row `gone` of `p` goes into row `keep`; gives the slots whose `shared` changed among themselves."""
        a, b = p[keep].copy(), p[gone].copy()
        x = np.flatnonzero(b)
        # the row itself against all others
        row = (_gain((a + b)[x], p[:, x]) - _gain(a[x], p[:, x])).sum(axis=1)
        # the columns that see one row in place of two
        y = np.flatnonzero(a + b)
        delta = _gain((a + b)[x][:, None], (a + b)[y][None]) - _gain(a[x][:, None], a[y][None]) - _gain(b[x][:, None], b[y][None])
        self.shared[np.ix_(x, y)] += delta
        rest = b[y] == 0
        self.shared[np.ix_(y[rest], x)] += delta[:, rest].T
        self.shared[keep] += row
        self.shared[:, keep] += row
        p[keep] += b
        p[gone] = 0.0
        return x

    def merge(self, keep: int, gone: int) -> None:
        self.live[gone] = False
        rows = [self._join(self.p, keep, gone), self._join(self.p.T, keep, gone), [keep]]
        for m in (self.shared, self.own, self.margin):
            m[gone] = 0.0
            m[:, gone] = 0.0
        self.out[keep] += self.out[gone]
        self.into[keep] += self.into[gone]
        self.out[gone] = self.into[gone] = 0.0
        self.set_own(keep)
        self.set_margin(np.array([keep]))
        self.loss[gone] = np.inf
        self.loss[:, gone] = np.inf
        rows = np.unique(np.concatenate(rows).astype(np.int64))
        self.refresh(rows[self.live[rows]])


def cluster(uni: list[tuple[str, int]], bi: dict[tuple[str, str], int] | Bigrams, active: int = 1_000) -> dict[str, str]:
    """Bit path of each word: words enter by frequency into `active` clusters; the merge that loses least mutual information
    follows each entry, and at the end the clusters are merged to one tree."""
    size = len(uni)
    if isinstance(bi, dict):
        index = {w: k for k, (w, _) in enumerate(uni)}
        bi = tuple(np.array(x) for x in zip(*((index[a], index[b], float(n)) for (a, b), n in bi.items()))) if bi else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    first, second, n = bi
    out_at, out_word, out_n = _by(first, second, n, size)
    in_at, in_word, in_n = _by(second, first, n, size)
    slots = min(active, size) + 1
    state = _Active(slots)
    slot_of = np.full(size, -1)  # of each word that has entered
    node_of, born = [0] * slots, [0] * slots
    free = list(range(slots))[::-1]
    children: dict[int, tuple[int, int]] = {}
    clock = itertools.count()

    def merge() -> None:
        a, b = divmod(int(state.loss.argmin()), slots)
        if born[a] > born[b]:
            a, b = b, a
        node = size + len(children)
        children[node] = (node_of[a], node_of[b])
        # the cluster with fewer neighbours goes into the other's slot
        keep, gone = (a, b) if np.count_nonzero(state.p[a]) + np.count_nonzero(state.p[:, a]) >= np.count_nonzero(state.p[b]) + np.count_nonzero(state.p[:, b]) else (b, a)
        state.merge(keep, gone)
        slot_of[slot_of == gone] = keep
        node_of[keep], born[keep] = node, next(clock)
        free.append(gone)

    def weights(words: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = slot_of[words]
        return np.bincount(at[at >= 0], n[at >= 0], slots).astype(np.float64)

    for k in range(size):
        s = free.pop()
        slot_of[k], node_of[s], born[s] = s, k, next(clock)
        state.enter(s, weights(out_word[out_at[k] : out_at[k + 1]], out_n[out_at[k] : out_at[k + 1]]), weights(in_word[in_at[k] : in_at[k + 1]], in_n[in_at[k] : in_at[k + 1]]))
        if not free:
            merge()
    while len(free) < slots - 1:
        merge()
    paths: dict[str, str] = {}
    stack = [(size + len(children) - 1 if children else 0, "")] if size else []
    while stack:
        node, path = stack.pop()
        if node in children:
            a, b = children[node]
            stack += [(a, path + "0"), (b, path + "1")]
        else:
            paths[uni[node][0]] = path or "0"
    return paths
