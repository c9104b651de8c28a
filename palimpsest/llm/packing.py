"""Filling fixed-capacity containers with items (problem 7).

Items of one size are interchangeable, so an instance is its histogram of sizes: at most `capacity` rows, whatever the
number of items. On it, the Martello-Toth reduction fixes every container that provably dominates all alternatives for the
largest item, many equal ones at a time, until nothing more can be fixed; best-fit decreasing fills the remainder. The plan
is a list of (pattern, multiplicity), again bounded by the capacity. Items then find their container by their rank among
the items of their size, which is counted in salted groups, as many as the histogram asks for, so that a size held by a
third of all items is no hot group.

An item above the capacity is cut into full pieces, each a container of its own, and a rest that is packed like others.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.session import checkpoint, table

#: Items of one size that are ranked together; rows of a plan up to which it is broadcast.
GROUP, BROADCAST_ROWS = 200_000, 100_000
#: Words and runs of other signs, as the public WordPunct rule has them, with Unicode letters and digits.
WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85   -     　]+"

Pattern = tuple[tuple[int, int], ...]  # (size, how many), largest first


class _Bag:
    """A multiset of sizes with its distinct sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.remove(size)

    def give(self, size: int, n: int) -> None:
        if size not in self.count:
            insort(self.sizes, size)
        self.count[size] = self.count.get(size, 0) + n

    def largest(self, most: int) -> int | None:
        i = bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else None

    def smallest_sum(self, n: int) -> int:
        """Sum of the n smallest items; beyond any capacity if there are fewer."""
        total = 0
        for s in self.sizes:
            k = min(n, self.count[s])
            total += k * s
            n -= k
            if not n:
                return total
        return 1 << 60


def _dominating(bag: _Bag, w: int, capacity: int) -> tuple[int, ...] | None:
    """The companions of an item of size w in a container that dominates every other one holding it, or None.

    A set dominates another if the other's items can be grouped so that each group fits in place of one of its items.
    Called with w taken out of the bag.
    """
    room = capacity - w
    k = bag.largest(room)
    if k is None:
        return ()
    if k == room or bag.smallest_sum(2) > room:
        return (k,)
    if bag.smallest_sum(3) > room:
        # at most two companions: (k, b) must dominate every pair (x, y)
        bag.take(k, 1)
        b = bag.largest(room - k)
        bag.give(k, 1)
        for x in reversed(bag.sizes):
            if x > room:
                continue
            y = bag.largest(min(x, room - x))
            if y == x and bag.count[x] < 2:
                y = _below(bag, x)
            if y is None:
                continue
            if x + y <= k or (b is not None and x <= k and y <= b):
                continue
            return None
        return (k,) if b is None else (k, b)
    return None


def _below(bag: _Bag, size: int) -> int | None:
    i = bisect_left(bag.sizes, size)
    return bag.sizes[i - 1] if i else None


def solve(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, multiplicity) of containers holding a multiset of sizes, none above the capacity.

    Every dominance is shown against all items not yet packed, those included for which nothing could be fixed so far; after
    a pass that fixed something those are tried again. Never takes more containers than best-fit decreasing alone: where the
    remainder happens to fit worse than the whole, the whole is taken.
    """
    bag = _Bag(counts)
    plan: list[tuple[Pattern, int]] = []
    fixed = True
    while fixed:
        fixed = False
        w = bag.sizes[-1] if bag.sizes else None
        while w is not None:
            bag.take(w, 1)
            mates = _dominating(bag, w, capacity)
            bag.give(w, 1)
            if mates is not None:
                need: dict[int, int] = {}
                for s in (w, *mates):
                    need[s] = need.get(s, 0) + 1
                # the same step again and again, until one of its sizes runs short
                times = min(bag.count[s] // q for s, q in need.items())
                for s, q in need.items():
                    bag.take(s, q * times)
                plan.append((tuple(sorted(need.items(), reverse=True)), times))
                fixed = True
                if w in bag.count:
                    continue
            w = _below(bag, w)
    plan += best_fit(bag.count, capacity)
    plain = best_fit({s: n for s, n in counts.items() if s > 0 and n > 0}, capacity)
    return plan if containers_in(plan) <= containers_in(plain) else plain


def containers_in(plan: list[tuple[Pattern, int]]) -> int:
    return sum(n for _, n in plan)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a multiset, equal containers kept together."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {}
    order: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(order, s)
            if i < len(order):
                room = order[i]
                pattern, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(i)
                q = min(room // s, left)  # the fitted container stays the best one for the next item of this size
                m = min(n, left // q)
                put(room, pattern, n - m)
                put(room - q * s, (*pattern, (s, q)), m)
                left -= q * m
            else:
                q = min(capacity // s, left)
                m = left // q
                put(capacity - q * s, ((s, q),), m)
                left -= q * m
    return [x for room in order for x in rooms[room]]


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, n): tokens of each document, counted where n_tokens is null or negative; a null text has none."""
    counted = F.coalesce(F.regexp_count("text", F.lit(WORD_PUNCT)), F.lit(0))
    return documents.select("doc_id", F.when(F.col("n_tokens") >= 0, F.col("n_tokens")).otherwise(counted).cast("int").alias("n")).where("doc_id is not null")


def pieces(items: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(container_kind, capacity, doc_id, piece_no, n): what is to be packed, once for each kind of container.

    Only documents above the capacity come in several pieces.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in kinds]))
    items = items.select("doc_id", "n", each.alias("k")).select("k.container_kind", "k.capacity", "doc_id", "n")
    number = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity"))).cast("int")
    cut = items.select("container_kind", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece_no"))
    return cut.select("container_kind", "capacity", "doc_id", "piece_no", F.least(F.col("capacity"), F.col("n") - F.col("piece_no") * F.col("capacity")).alias("n"))


def pack(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_no, doc_id, piece_no, n_tokens): where every piece of every document goes.

    Containers are numbered from 1 in each kind. Documents without tokens take no room and go to container 1. Kinds without
    a positive capacity are left out; no document is lost for any other, but rows without doc_id are left out. Repeated
    document rows are packed once, with the largest of their sizes.
    """
    spark = documents.sparkSession
    kinds = [(r.container_kind, r.capacity) for r in containers.where("capacity > 0 and container_kind is not null").groupBy("container_kind").agg(F.max("capacity").alias("capacity")).orderBy("container_kind").collect()]
    if not kinds:
        return spark.createDataFrame([], "container_kind string, container_no bigint, doc_id bigint, piece_no int, n_tokens int")
    # texts are read once and left behind; identifiers and sizes are read thrice below
    items = pieces(checkpoint(sizes(documents).groupBy("doc_id").agg(F.max("n").alias("n"))), kinds)
    histogram: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    for r in items.groupBy("container_kind", "n").agg(F.count(F.lit(1)).alias("m")).collect():  # at most `capacity` rows a kind
        histogram[r.container_kind][r.n] = r.m
    rows = []
    for kind, capacity in kinds:
        used: dict[int, int] = {}
        no = 1
        by_size: dict[int, list[tuple[int, int, int, int]]] = {0: [(0, 1 << 62, 1, 1 << 62)]}
        for pattern, times in solve(histogram[kind], capacity):
            for s, q in pattern:
                lo = used.get(s, 0)
                used[s] = lo + q * times
                by_size.setdefault(s, []).append((lo, lo + q * times, no, q))
            no += times
        rows += [(kind, s, 1 + histogram[kind].get(s, 0) // GROUP, v) for s, v in by_size.items()]
    plan = spark.createDataFrame(rows, "container_kind string, n int, salts int, parts array<struct<lo:bigint,hi:bigint,first:bigint,each:bigint>>")
    if len(rows) <= BROADCAST_ROWS:  # one row for each size of each kind; else Spark joins as it sees fit
        plan = F.broadcast(plan)
    # items of one size are ranked in groups of about GROUP
    salted = items.join(plan.select("container_kind", "n", "salts"), ["container_kind", "n"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("salts").cast("bigint")).cast("int"))
    groups = salted.groupBy("container_kind", "n", "salt").agg(F.count(F.lit(1)).alias("m"))
    offsets = groups.withColumn("before", F.sum("m").over(Window.partitionBy("container_kind", "n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("container_kind", "n", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("container_kind", "n", "salt").orderBy("doc_id", "piece_no")) - 1
    placed = salted.withColumn("rank", rank).join(offsets, ["container_kind", "n", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).join(plan.select("container_kind", "n", "parts"), ["container_kind", "n"])
    part = F.element_at(F.filter("parts", lambda p: (F.col("rank") >= p["lo"]) & (F.col("rank") < p["hi"])), 1)
    return placed.withColumn("part", part).select(
        "container_kind", (F.col("part.first") + F.expr("(rank - part.lo) div part.each")).alias("container_no"), "doc_id", "piece_no", F.col("n").alias("n_tokens")
    )


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens packed and the share of room used, by kind."""
    kinds = table(spark, sf_dir, "containers")
    by = p7_pack(spark, sf_dir).groupBy("container_kind").agg(F.count_distinct("container_no").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return by.join(kinds.where("capacity > 0").groupBy("container_kind").agg(F.max("capacity").alias("capacity")), "container_kind").select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))
