"""Problem 8: texts into contexts of fixed capacity by dominance reduction and best fit."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one size that are numbered in one task, on average.
CHUNK = 50_000


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counts(texts: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every text, null and empty ones with 0.

    ``tokenizer`` is the path of a rank file on the driver. The file, under a megabyte, is broadcast, so the
    executors need no file of their own.
    """
    shared = texts.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encoder.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(count, "doc_id long, n_tokens long")


class _Sizes:
    """A multiset of sizes in order."""

    def __init__(self, counts: Mapping[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int = 1) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect_right(self.order, size) - 1)

    def put(self, size: int, n: int = 1) -> None:
        if size not in self.count:
            self.count[size] = 0
            self.order.insert(bisect_right(self.order, size), size)
        self.count[size] += n

    def largest_upto(self, room: int) -> int | None:
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else None

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The ``k`` smallest items larger than ``above``, repeated as often as they are there."""
        out: list[int] = []
        for s in self.order[bisect_right(self.order, above) :]:
            out += [s] * min(k - len(out), self.count[s])
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """The two items of largest sum that fit together, the larger first."""
        best, low = None, 0
        high = bisect_right(self.order, room) - 1
        while high >= low >= 0 and high >= 0:
            a, b = self.order[high], self.order[low]
            if a + b > room:
                high -= 1
                continue
            if (a != b or self.count[a] > 1) and (best is None or a + b > sum(best)):
                best = (a, b)
            low += 1
        return best


def dominating_set(j: int, others: _Sizes, capacity: int) -> tuple[int, ...] | None:
    """The items beside ``j`` in a set that dominates every other feasible set of ``j``, or None if none is proven.

    ``others`` are all items not yet fixed but one of size ``j``, larger and smaller ones. A set dominates another
    one of j if the items of the other can be grouped so that each group is no larger than an item of the set of
    its own: exchanging them never needs a further bin. Sets of at most three items are looked at:

    * j alone, if nothing fits beside it;
    * j with i, the largest that fits, if i fills the bin, if no two items fit beside j, or if no three fit and no
      two that fit together are larger than i;
    * j with a and b, the two of largest sum that fit, if no three fit, a is as large as i, and no two items
      that fit are both larger than b (but for a itself).
    """
    room = capacity - j
    i = others.largest_upto(room)
    if i is None:
        return ()
    least = others.smallest(3)
    if i == room or sum(least[:2]) > room or len(least) < 2:
        return (i,)
    if len(least) == 3 and sum(least) <= room:
        return None
    pair = others.best_pair(room)
    if pair is None or i >= sum(pair):
        return (i,)
    a, b = pair
    if a != i:
        return None
    others.take(a)
    two = others.smallest(2, above=b)
    others.put(a)
    return (a, b) if len(two) < 2 or sum(two) > room else None


def reduce_bins(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[Counter[tuple[int, ...]], dict[int, int]]:
    """Bins fixed by dominance, and how many items of each size are left undecided.

    Sizes are looked at from the largest to the smallest, again and again until a pass fixes nothing. Undecided
    items stay in view of all others, so a fixed set dominates over all items that are left, and the fixed
    bins with the best packing of the rest are a best packing of all. A set that was fixed stays dominating while
    its sizes last (what is left only shrinks), so it is fixed as often as they do: the work depends on the number of different
    sizes, at most ``capacity``, not on the number of items.
    """
    left = _Sizes({s: n for s, n in counts.items() if 0 < s <= capacity})
    fixed: Counter[tuple[int, ...]] = Counter()
    moved = True
    while moved:
        moved = False
        for j in reversed(list(left.order)):
            while j in left.count:
                left.take(j)
                beside = dominating_set(j, left, capacity)
                left.put(j)
                if beside is None:
                    break
                need = Counter((j, *beside))
                bins = min(left.count[s] // n for s, n in need.items())
                fixed[(j, *beside)] += bins
                for s, n in need.items():
                    left.take(s, n * bins)
                moved = True
    return fixed, dict(left.count)


def plan_bins(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes in one bin, number of such bins) that hold ``counts`` items of each size.

    Dominance reduction first, then best fit in decreasing order for the undecided rest. The reduction never
    raises the least possible number of bins, but best fit is a rule of thumb and may do worse on the smaller
    instance; where it does, the plan of best fit for all items is taken, so a plan has never more bins than that.
    """
    fixed, rest = reduce_bins(counts, capacity)
    plan = [*fixed.items(), *_best_fit(Counter(rest), capacity)]
    plain = _best_fit(Counter({s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}), capacity)
    return plan if sum(n for _, n in plan) <= sum(n for _, n in plain) else plain


def _best_fit(counts: Counter[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order; equal bins are one entry with a multiplicity."""
    open_bins: dict[int, Counter[tuple[int, ...]]] = {}  # room left -> patterns
    rooms: list[int] = []
    closed: Counter[tuple[int, ...]] = Counter()

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not room:
            closed[pattern] += n
            return
        if room not in open_bins:
            open_bins[room] = Counter()
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room][pattern] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                # new bins, each filled with as many of this size as it takes
                each = capacity // size
                if n >= each:
                    put((size,) * each, n // each)
                    n %= each
                if n:
                    put((size,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            pattern, have = next(iter(open_bins[room].items()))
            used = min(n, have)
            open_bins[room][pattern] -= used
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            put((*pattern, size), used)
            n -= used
    for patterns in open_bins.values():
        closed.update(patterns)
    return list(closed.items())


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, part, start, n_tokens, context_id): every text, or piece of a text, in one context.

    ``sizes`` has doc_id and n_tokens. A text longer than the capacity is split: full contexts first, the
    rest is an item like others (part counts from 0, start is the first token of the piece). Only the number
    of items of each size goes to the driver, at most ``capacity`` rows whatever the data; the plan made
    there says how many bins of each pattern there are. Items are then numbered within their size, in
    chunks, so that a size with a third of all items is numbered by many tasks, and the number picks the bin.

    Defined cases: texts of no tokens, null sizes and null ids get no context; a repeated row (same id and
    size) counts once; equal sizes are taken in the order of a hash of doc_id, then of doc_id; empty input,
    empty result; other columns are ignored.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    whole = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens")).filter("doc_id IS NOT NULL AND n_tokens > 0").distinct()
    parts = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {capacity}"))))
    items = parts.select("doc_id", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("size"))
    items = scratch.write(items, "items")

    # chunks by a hash, so ids may be dense or sparse; their number grows with the items
    chunks = max(1, -(-items.count() // CHUNK))
    items = items.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "part"), F.lit(chunks)))
    by_chunk = scratch.write(items.groupBy("size", "chunk").count(), "chunks")
    histogram = {r["size"]: r["n"] for r in by_chunk.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    # one row for each run of items of one size that go to bins of one pattern and place
    runs, first, at = [], 0, Counter()
    for pattern, bins in plan:
        for size, many in Counter(pattern).items():
            runs.append((size, at[size], many, first))
            at[size] += many * bins
        first += bins
    slots = spark.createDataFrame(runs or [(0, 0, 1, 0)], "size int, from long, many int, bin long")
    slots = slots.withColumn("upto", F.lead("from").over(Window.partitionBy("size").orderBy("from")))

    offsets = by_chunk.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("size", "chunk").orderBy("doc_id", "part")) - 1
    numbered = items.withColumn("k", rank).join(offsets.drop("count"), ["size", "chunk"]).withColumn("k", F.col("k") + F.col("before"))
    near = numbered.alias("i").join(F.broadcast(slots).alias("s"), (F.col("i.size") == F.col("s.size")) & (F.col("k") >= F.col("from")) & (F.col("upto").isNull() | (F.col("k") < F.col("upto"))))
    return near.select("doc_id", F.col("part").cast("int").alias("part"), "start", F.col("i.size").alias("n_tokens"), (F.col("bin") + F.expr("(k - from) div many")).alias("context_id"))


def pack_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_items, n_contexts, n_tokens, least_contexts): how full the contexts are."""
    per = packed.agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("context_id").alias("n_contexts"), F.sum("n_tokens").alias("n_tokens"))
    return per.withColumn("least_contexts", F.ceil(F.col("n_tokens") / capacity))


