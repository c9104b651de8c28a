"""Same or near-same records across splits (problem 6).

Exact prefix-filter bipartite join on rare shingles. A sentence is reduced to its letters and digits (case, accents,
punctuation, blanks and look-alikes removed), so word segmentation plays no part, and cut into character shingles. A pair
may differ in one word in eight of its longer sentence, which may have some more words than the other: words joined or cut.

The prefix of an evaluation sentence holds, for each number k of changes that some partner allows (`levels`), k + 1
shingles of which no two touch one word: a changed or dropped word, or one put between two others, breaks one of them at
most, so a partner within k changes holds one of the others unbroken. Of all such sets the rarest is taken, by counts of
shingles over the whole training split. Rarity only keeps the join small; any set gives the same result. Prefixes are
indexed and training sentences probe them with their shingles, under filters on length, number of words and position;
a bitmap of fixed size of all prefixes keeps the other shingles of training sentences from being moved at all. Every
candidate is verified by an alignment of words that lets words be joined or cut.

Exact copies are taken together before the join and expanded after it, so a text that stands a million times in training
is compared once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.canon import plain
from palimpsest.session import checkpoint, table

#: One word in WORDS_PER_CHANGE may differ; words that one side may have more besides, at most half of the shorter side.
WORDS_PER_CHANGE, JOINED = 8, 4
#: Characters of a shingle, and the sets of them tried in turn: where words are too short for enough long ones, shorter ones help.
SIZES = (10, 6, 4, 2)
SIZE_SETS = (SIZES[:2], SIZES)
#: Least and most binary digits of the number of buckets of the frequency sketch, and of bits of the bitmap of prefixes.
SKETCH_BITS, BITMAP_BITS = (17, 22), (22, 26)
#: Binary digits of the number of buckets, and of words of the bitmap, that come to the driver as one row of bytes.
PART_BITS, PART_WORDS = 12, 15
#: Steps of a doubling by which the sketch tells frequencies apart, in one byte a bucket, and the frequency of each byte.
STEPS = 6
FREQUENCIES = np.exp2(np.arange(256) / STEPS) - 1
#: Work (words times changes) up to which the rarest set is found exactly; longer sentences take the rarest of equal parts.
EXACT_WORK = 60_000
_NOT_WORD = re.compile(r"[\W_]+")


@F.pandas_udf(T.ArrayType(T.StringType()))
def bare_words(words: pd.Series) -> pd.Series:
    """The letters and digits of each word, in comparable form; words without any are left out."""
    return words.map(lambda ws: None if ws is None else [w for w in (_NOT_WORD.sub("", plain(x or "")) for x in ws) if w])


def sentences(tokens: DataFrame) -> DataFrame:
    """(sent_id, split, source, words): each sentence's comparable words in order.

    Repeated rows count once, of several words at a place the first; null words, and rows without sent_id or pos, are left
    out. Tags play no part.
    """
    rows = tokens.where("sent_id is not null and pos is not null and word is not null")
    grouped = rows.groupBy("sent_id", "split").agg(F.array_sort(F.collect_set(F.struct("pos", "word"))).alias("w"), F.min("source").alias("source"))
    once = F.filter("w", lambda x, i: (i == 0) | (F.get(F.col("w"), i - 1)["pos"] != x["pos"]))
    return grouped.select("sent_id", "split", "source", bare_words(F.transform(once, lambda x: x["word"])).alias("words"))


def joined(n: int) -> int:
    """Words that the other side may have more than `n` besides the changes."""
    return min(JOINED, n // 2)


def levels(n: int) -> range:
    """The numbers of changes that a pair with a sentence of `n` words can be allowed.

    At least one in WORDS_PER_CHANGE of its own words. A longer partner of m words allows k = m // WORDS_PER_CHANGE, and
    m <= n + k + joined(n), or `changes` refuses the pair; so k * (WORDS_PER_CHANGE - 1) <= n + joined(n).
    """
    own = n // WORDS_PER_CHANGE
    return range(own, max(own, (n + joined(n)) // (WORDS_PER_CHANGE - 1)) + 1)


def shingle_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that starts at each character."""
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[j : j + n]
    h += np.uint64(size) << np.uint64(57)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _chars(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)


def whole_hash(words) -> int:
    """Hash of a whole sentence: by it the sentences that allow no change are found."""
    import xxhash

    return xxhash.xxh64_intdigest("".join(words))


class Batch:
    """The shingles of many sentences at once: flat arrays over all their characters."""

    def __init__(self, rows: list[list[str]]):
        self.lengths = np.array([sum(map(len, ws)) for ws in rows], np.int64)
        self.counts = np.array([len(ws) for ws in rows], np.int64)
        self.chars = _chars([w for ws in rows for w in ws])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(rows)), self.lengths)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, sentence, position) of every shingle within one sentence."""
        h = shingle_hashes(self.chars, size)
        if not len(h):
            return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = self.owner[: len(h)]
        inside = owner == self.owner[size - 1 :]
        at = np.flatnonzero(inside)
        return h[at], owner[at], at - self.starts[owner[at]]


def portions(batches: Iterator[pd.DataFrame], most: int = 4_000_000) -> Iterator[tuple[np.ndarray, list[list[str]]]]:
    """(keys, words) of rows, in portions of about `most` characters, so that long texts don't add up in memory."""
    for rows in batches:
        keys = rows["key"].to_numpy() if "key" in rows else np.arange(len(rows))
        words, at, size = [], 0, 0
        for ws in rows["words"]:
            words.append(list(ws))
            size += sum(map(len, ws))
            if size >= most:
                yield keys[at : at + len(words)], words
                words, at, size = [], at + len(words), 0
        if words:
            yield keys[at:], words


def bits_for(n: int, limits: tuple[int, int]) -> int:
    return min(limits[1], max(limits[0], int(n).bit_length()))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Frequencies as bytes: the number in FREQUENCIES that is nearest by the logarithm."""
    return np.minimum(255, np.rint(STEPS * np.log2(1.0 + counts))).astype(np.uint8)


def frequency_sketch(words: DataFrame, bits: int) -> np.ndarray:
    """How many shingles of all rows of `words` fall into each of 2**bits buckets, as `levels_of`.

    Counted over everything. Executors add the counts up, and only bytes come to the driver. Tasks are joined to twice the
    cores, so that no more than so many whole sketches are moved, however many partitions there are.
    """
    part = min(bits, PART_BITS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.int64)
        for _, words_ in portions(batches):
            batch = Batch(words_)
            for size in SIZES:
                total += np.bincount((batch.shingles(size)[0] & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        for k, piece in enumerate(total.reshape(-1, 1 << part)):
            if piece.any():
                yield pd.DataFrame({"k": [k], "n": [piece.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << part, np.int64)
        for x in rows["n"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"k": rows["k"][:1], "x": [levels_of(total).tobytes()]})

    tasks = 2 * words.sparkSession.sparkContext.defaultParallelism
    out = np.zeros(1 << bits, np.uint8)
    for r in words.select("words").coalesce(tasks).mapInPandas(count, "k int, n binary").groupBy("k").applyInPandas(add, "k int, x binary").collect():
        out[r.k << part : (r.k + 1) << part] = np.frombuffer(r.x, np.uint8)
    return out


def prefix(words: list[str], rank) -> list[tuple[int, int, int]]:
    """(shingle, position, words // WORDS_PER_CHANGE of the partner): the shingles by which an evaluation sentence is found.

    `rank` gives the frequencies of an array of shingles.
    """
    n = len(words)
    ks = levels(n)
    out: list[tuple[int, int, int]] = []
    ranges: dict[tuple[int, ...], list] = {}
    for k in ks:
        # partners for which k changes are allowed, by their number of words in eights
        most = n + k + joined(n)
        partners = range(max(0, n - k - JOINED) // WORDS_PER_CHANGE, k + 1) if k == ks[0] else [k] if k * WORDS_PER_CHANGE <= most else []
        if not partners:
            continue
        if k == 0:
            out.append((whole_hash(words), -1, 0))
            continue
        for sizes in SIZE_SETS:
            if sizes not in ranges:
                ranges[sizes] = _rarest_by_range(words, rank, sizes)
            if found := disjoint(ranges[sizes], n, k + 1):
                break
        out += [(g, p, b) for g, p in found for b in partners]
    return out


def _rarest_by_range(words: list[str], rank, sizes: tuple[int, ...]) -> list[tuple[float, int, int, int, int]]:
    """(frequency, first word, last word, shingle, position): the rarest shingle over each stretch of words, by last word."""
    chars = _chars(words)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    parts = []
    for size in sizes:
        h = shingle_hashes(chars, size)
        parts.append((rank(h), of[: len(h)], of[size - 1 :] if len(h) else of[:0], h, np.arange(len(h))))
    f, first, last, h, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, f, first, last))
    f, first, last, h, at = f[order], first[order], last[order], h[order], at[order]
    new = np.ones(len(f), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    return list(zip(f[new].tolist(), first[new].tolist(), last[new].tolist(), h[new].tolist(), at[new].tolist()))


def disjoint(ranges: list[tuple[float, int, int, int, int]], n: int, need: int) -> list[tuple[int, int]]:
    """`need` (shingle, position) of which no two touch one word, of least total frequency; none if there are not as many."""
    if n * need > EXACT_WORK:
        # the rarest within each of `need` equal parts
        parts: dict[int, tuple[float, int, int, int, int]] = {}
        for x in ranges:
            k = x[1] * need // n
            if x[2] * need // n == k and (k not in parts or x < parts[k]):
                parts[k] = x
        return [(x[3], x[4]) for x in parts.values()] if len(parts) == need else []
    inf = float("inf")
    best = [[0.0] + [inf] * need]  # by number of words read, by number taken
    take: list[list[tuple | None]] = [[None] * (need + 1)]
    k = 0
    for w in range(n):
        row, back = best[-1][:], [None] * (need + 1)
        while k < len(ranges) and ranges[k][2] == w:
            x = ranges[k]
            before = best[x[1]]
            for c in range(need):
                if before[c] + x[0] < row[c + 1]:
                    row[c + 1], back[c + 1] = before[c] + x[0], x
            k += 1
        best.append(row)
        take.append(back)
    if best[n][need] == inf:
        return []
    out = []
    w, c = n, need
    while c:
        while take[w][c] is None:
            w -= 1
        x = take[w][c]
        out.append((x[3], x[4]))
        w, c = x[1], c - 1
    return out


def changes(a: list[str], b: list[str], most: int) -> int:
    """Words added, dropped or replaced between two sentences, joined and cut words being equal; `most + 1` if more.

    Banded dynamic programming over words; up to three words of one side may stand for up to three of the other.
    """
    n, m = len(a), len(b)
    band = most + joined(min(n, m))
    big = most + 1
    if abs(n - m) > band:
        return big
    wide = 2 * band + 1  # column j of row i stands at j - i + band
    rows: list[list[int]] = []
    for i in range(n + 1):
        row = [big] * wide
        for j in range(max(0, i - band), min(m, i + band) + 1):
            at = j - i + band
            best = 0 if not i and not j else big
            if i and at + 1 < wide and rows[-1][at + 1] + 1 < best:
                best = rows[-1][at + 1] + 1
            if j and at and row[at - 1] + 1 < best:
                best = row[at - 1] + 1
            if i and j:
                x = rows[-1][at] + (a[i - 1] != b[j - 1])
                if x < best:
                    best = x
                if a[i - 1][-1] == b[j - 1][-1]:
                    for p, q in ((1, 2), (2, 1), (1, 3), (3, 1), (2, 2), (2, 3), (3, 2)):
                        if i >= p and j >= q and 0 <= at + p - q < wide and rows[-p][at + p - q] < best and "".join(a[i - p : i]) == "".join(b[j - q : j]):
                            best = rows[-p][at + p - q]
            row[at] = best
        rows = [*rows[-2:], row]
        if min(map(min, rows)) >= big:
            return big
    return min(big, rows[-1][m - n + band])


def alike(a: list[str], b: list[str]) -> bool:
    """True if at most one word in WORDS_PER_CHANGE of the longer sentence differs."""
    most = max(len(a), len(b)) // WORDS_PER_CHANGE
    return a == b or changes(a, b, most) <= most


@F.pandas_udf(T.BooleanType())
def near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(list(x), list(y)) for x, y in zip(a, b)])


def _spare(words, k: int) -> int:
    """The most characters by which `k` changed words can move what stands behind them."""
    return sum(sorted(map(len, words), reverse=True)[:k])


_ROW = "key binary, gram bigint, pos int, eights int, chars int, spare int"


def index_rows(texts: DataFrame, sketch) -> DataFrame:
    """The prefixes of evaluation texts."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sketch.value
        rank = lambda h: FREQUENCIES[counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)]]
        for rows in batches:
            out = []
            for key, words in zip(rows["key"], rows["words"]):
                words = list(words)
                chars, spare = sum(map(len, words)), _spare(words, levels(len(words))[-1])
                out += [(key, np.uint64(g).astype(np.int64), p, b, chars, spare) for g, p, b in dict.fromkeys(prefix(words, rank))]
            yield pd.DataFrame(out, columns=["key", "gram", "pos", "eights", "chars", "spare"])

    return texts.select("key", "words").mapInPandas(make, _ROW)


def prefix_bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """One bit for each residue of an indexed shingle: 2**bits of them, whatever the data. Only bytes come to the driver."""
    part = min(bits - 5, PART_WORDS)

    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << part, np.uint32)
        out[rows["w"].to_numpy(dtype=np.int64) & ((1 << part) - 1)] = rows["x"].to_numpy(dtype=np.int64).astype(np.uint32)
        return pd.DataFrame({"k": [int(rows["w"].iloc[0]) >> part], "x": [out.tobytes()]})

    slot = F.col("gram").bitwiseAND((1 << bits) - 1)
    words = index.groupBy(F.shiftright(slot, 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 31 as int))")).alias("x"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in words.groupBy(F.shiftright("w", part).alias("k")).applyInPandas(lay, "k int, x binary").collect():
        out[r.k << part : (r.k + 1) << part] = np.frombuffer(r.x, np.uint32)
    return out


def probe_rows(texts: DataFrame, bitmap, bits: int) -> DataFrame:
    """The shingles of training texts that the bitmap does not rule out, and the whole of those that allow no change."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = bitmap.value
        mask = np.uint64((1 << bits) - 1)

        def hit(h: np.ndarray) -> np.ndarray:
            slot = (h & mask).astype(np.int64)
            return (table_[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1

        for keys, words in portions(batches):
            batch = Batch(words)
            eights = batch.counts // WORDS_PER_CHANGE
            spare = np.array([_spare(ws, levels(len(ws))[-1]) for ws in words], np.int64)
            short = np.flatnonzero(eights == 0)
            found = [(np.array([whole_hash(words[i]) for i in short], np.uint64), short, np.full(len(short), -1))]
            for size in SIZES:
                h, owner, pos = batch.shingles(size)
                at = np.flatnonzero(hit(h)) if len(h) else np.zeros(0, np.int64)
                found.append((h[at], owner[at], pos[at]))
            h, owner, pos = (np.concatenate(x) for x in zip(*found))
            yield pd.DataFrame({"key": keys[owner], "gram": h.astype(np.int64), "pos": pos.astype(np.int32), "eights": eights[owner].astype(np.int32), "chars": batch.lengths[owner].astype(np.int32), "spare": spare[owner].astype(np.int32)})

    return texts.select("key", "words").mapInPandas(make, _ROW)


def matches(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentences, pairs): every sentence with the key of its text and side, and the pairs of texts that overlap.

    `sentences` has sent_id, split, source, side ('t' for train, 'e' for dev and test) and key; `pairs` has key_e and key_t.
    """
    side = F.when(F.col("split") == "train", "t").when(F.col("split").isin("dev", "test"), "e")
    # read again and again below, so both are written once to the shared folder
    sents = checkpoint(
        sentences(tokens).where("size(words) > 0").withColumn("side", side).where("side is not null")
        .select("sent_id", "split", "source", "side", "words", F.unhex(F.md5(F.array_join("words", " "))).alias("key"))
    )
    # one row per distinct text of a side
    texts = checkpoint(sents.groupBy("side", "key").agg(F.first("words").alias("words")))
    e, t = texts.where("side = 'e'"), texts.where("side = 't'")
    sizes = {r.side: r.n for r in texts.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    sc = texts.sparkSession.sparkContext
    sketch = sc.broadcast(frequency_sketch(t, bits_for(sizes.get("t", 0), SKETCH_BITS)))
    index = checkpoint(index_rows(e, sketch))  # read twice: for the bitmap and the join
    bits = bits_for(32 * sizes.get("e", 0), BITMAP_BITS)
    probes = probe_rows(t, sc.broadcast(prefix_bitmap(index, bits)), bits)
    a = index.select("gram", "eights", *[F.col(c).alias(f"{c}_e") for c in ("key", "chars", "spare", "pos")])
    b = probes.select("gram", "eights", *[F.col(c).alias(f"{c}_t") for c in ("key", "chars", "spare", "pos")])
    slack = F.greatest("spare_e", "spare_t")
    candidates = (
        b.join(a, ["gram", "eights"])
        .where((F.abs(F.col("chars_e") - F.col("chars_t")) <= slack) & (F.abs(F.col("pos_e") - F.col("pos_t")) <= slack))
        .select("key_e", "key_t")
        .distinct()
    )
    of_e, of_t = e.select(F.col("key").alias("key_e"), F.col("words").alias("words_e")), t.select(F.col("key").alias("key_t"), F.col("words").alias("words_t"))
    return sents, candidates.join(of_e, "key_e").join(of_t, "key_t").where(near("words_e", "words_t")).select("key_e", "key_t")


def overlaps(tokens: DataFrame) -> DataFrame:
    """(sent_id_a, sent_id_b): every training sentence with every dev or test sentence that equals it or nearly so.

    Sentences without a letter or digit, or without split, match nothing. Two sentences of fewer than eight words match
    only when equal up to word segmentation. Empty tables give an empty result. Columns beside the five that are read play
    no part.
    """
    sents, pairs = matches(tokens)
    e = sents.where("side = 'e'").select(F.col("key").alias("key_e"), F.col("sent_id").alias("id_e"))
    t = sents.where("side = 't'").select(F.col("key").alias("key_t"), F.col("sent_id").alias("id_t"))
    return pairs.join(e, "key_e").join(t, "key_t").where("id_e <> id_t").select(F.least("id_e", "id_t").alias("sent_id_a"), F.greatest("id_e", "id_t").alias("sent_id_b")).distinct()


def report(tokens: DataFrame) -> DataFrame:
    """(eval_split, eval_source, train_source, pairs, eval_sentences): overlaps counted from classes of equal texts.

    Copies are counted, not expanded into pairs: n and m copies of two texts are n times m pairs. A sentence that stands
    in training under its own sent_id as well is no partner of itself.
    """
    sents, pairs = matches(tokens)
    e = sents.where("side = 'e'").select(F.col("key").alias("key_e"), F.col("sent_id").alias("id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    t = sents.where("side = 't'").select(F.col("key").alias("key_t"), F.col("sent_id").alias("id"), F.col("source").alias("train_source"))
    # partners of each evaluation text by training source
    by_source = t.groupBy("key_t", "train_source").agg(F.count(F.lit(1)).alias("m"))
    partners = pairs.join(by_source, "key_t").groupBy("key_e", "train_source").agg(F.sum("m").alias("m"))
    # an id in both splits whose two texts overlap: one pair less
    own = e.join(t, "id").join(pairs, ["key_e", "key_t"]).groupBy("id", "key_e", "eval_split", F.coalesce("train_source", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("less"))
    rows = e.join(partners, "key_e").withColumn("s", F.coalesce("train_source", F.lit(""))).join(own, ["id", "key_e", "eval_split", "s"], "left").withColumn("m", F.col("m") - F.coalesce("less", F.lit(0))).where("m > 0")
    return rows.groupBy("eval_split", "eval_source", "train_source").agg(F.sum("m").alias("pairs"), F.count_distinct("id").alias("eval_sentences"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "annotated_tokens"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation sentences and pairs by evaluation split, evaluation source and training source."""
    return report(table(spark, sf_dir, "annotated_tokens"))
