"""Problem 3: near-duplicate records by a signature-coordinate inverted join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .words import chunks, mix, word_keys, words

#: Buckets of the document-frequency sketch: its size is fixed, whatever the vocabulary.
SKETCH = 1 << 18
#: Share of the records from which a word counts as common.
COMMON = 1 / 2500
#: How much less often than a rare word a common one is picked, at most: a single odd word must not decide.
HANDICAP = 8.0
#: Base coordinates of a signature, and those two records must share to be a candidate.
BASE, SHARED = 32, 8
#: Posted coordinates, each made of three base coordinates.
POSTED = 32
#: A posting carries two bits of every base coordinate, a class four; two unlike coordinates agree in them by
#: chance once in 4 or 16 times. So many fields of a pair must agree to be a candidate.
AGREE2, AGREE4 = 15, 10
#: A posting list up to this length is merged, a longer one is skipped and split.
LIST = 2_048
#: Postings of a task, and those from which a list is split before the exchange.
ROWS, HOT = 1_000_000, 100_000
#: None gives all pairs of a group of same-word records. On request only, groups above a size are given in short
#: as representative and member: that leaves out pairs, also pairs of different texts.
EXPANDED: int | None = None
#: Members of a group that are expanded together: a large group is written by many tasks, a block pair each.
BLOCK = 1_024


def _design() -> list[tuple[int, int, int]]:
    """The base coordinates of each posted one: distinct triples that use all bases about equally."""
    rng, out = np.random.default_rng(7), []
    while len(out) < POSTED:
        order = rng.permutation(BASE)
        out += [t for t in (tuple(sorted(map(int, order[i : i + 3]))) for i in range(0, BASE - 2, 3)) if t not in out]
    return out[:POSTED]


TRIPLES = _design()


def _sketch(records: DataFrame) -> tuple[np.ndarray, float]:
    """In how many records each bucket of words occurs, and in how many a common word does (8 at least), over all records."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            seen += len(batch)
            for _, lengths, k in chunks(batch["text"]):
                row = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
                # each word of a text counts once: texts and buckets in one number, sorted
                met = np.sort((row << np.uint64(18)) | (k % np.uint64(SKETCH)))
                met = met[np.append(True, met[1:] != met[:-1])] if len(met) else met
                total += np.bincount((met % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": [*at, -1], "n": [*total[at], seen]})

    rows = records.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sketch = np.zeros(SKETCH + 1, np.int64)
    sketch[rows["bucket"].to_numpy()] = rows["n"].to_numpy()  # -1, the last place, has the records
    return sketch[:-1], max(8.0, sketch[-1] * COMMON)


def _elements(lengths: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a chunk, in any order within it: its words, and keys of a word with which of its
    occurrences it is, so that the common words of two texts, counted with repetition, are their common elements."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((k, row))
    k, row = k[order], row[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    nth = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
    return row, k, mix(k + mix(nth.astype(np.uint64), 1), 2)


def _signatures(lengths: np.ndarray, k: np.ndarray, sketch: np.ndarray, common: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a chunk: two keys of its bag of words, and its signature."""
    row, k, element = _elements(lengths, k)
    share = sketch[(k % np.uint64(SKETCH)).astype(np.int64)]
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    with np.errstate(over="ignore"):
        bag1, bag2 = np.add.reduceat(mix(element, 3), begin), np.add.reduceat(mix(element, 4), begin)
    # coordinates look at the rarer half: words that most records have would fill long posting lists
    order = np.lexsort((element, share, row))
    keep = np.arange(len(k)) - np.repeat(begin, lengths) < np.repeat((lengths + 1) // 2, lengths)
    half, at = element[order][keep], np.concatenate(([0], np.cumsum((lengths + 1) // 2)[:-1]))
    # and within it the more a word is common the less it is picked, so words of set phrases rarely are
    handicap = np.clip(share[order][keep] / common, 1.0, HANDICAP)
    signature = np.empty((len(lengths), BASE), np.int32)
    for c in range(BASE):
        u = ((mix(half, 10 + c) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        least = np.minimum.reduceat(-np.log(u) * handicap, at)
        signature[:, c] = (mix(least.view(np.uint64), 5) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return bag1.view(np.int64), bag2.view(np.int64), signature


def _fields(signature: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each of 64/width coordinates in one number, a row each."""
    low = (signature.view(np.uint32) & np.uint32((1 << width) - 1)).astype(np.uint64)
    return (low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(width))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 32 two-bit fields are equal."""
    d = (x ^ y).view(np.uint64)
    return 32 - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).astype(np.int64)


def _signed(records: DataFrame, sketch: tuple[np.ndarray, float], least_words: int) -> DataFrame:
    shared = records.sparkSession.sparkContext.broadcast(sketch)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, lengths, k in chunks(batch["text"]):
                long = lengths >= least_words
                if not long.any():
                    continue
                k = k[np.repeat(long, lengths)]
                bag1, bag2, signature = _signatures(lengths[long], k, *shared.value)
                part = batch.iloc[rows[long]]
                yield pd.DataFrame({"kind": part["kind"].to_numpy(), "id": part["id"].to_numpy(), "bag": bag1, "bag2": bag2, "two": _fields(signature, 2), "four1": _fields(signature[:, :16], 4), "four2": _fields(signature[:, 16:], 4), "sig": list(signature)})

    return records.mapInPandas(sign, "kind string, id long, bag long, bag2 long, two long, four1 long, four2 long, sig array<int>")


def _alike(ids: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one posting list whose two-bit fields agree enough, row by row of the list's triangle."""
    a, b = [], []
    step = max(1, (1 << 21) // max(1, len(ids)))
    for at in range(0, len(ids), step):
        i, j = np.nonzero(_agreeing(two[at : at + step, None], two[None, :]) >= AGREE2)
        later = j > i + at
        a.append(ids[i[later] + at]), b.append(ids[j[later]])
    return np.concatenate(a), np.concatenate(b)


def _hot_lists(postings: DataFrame, rows: int) -> list[int]:
    """Keys of lists with more than about HOT postings, told from a bounded sample; HOT grows with the rows beyond
    some 10^9, so there are never more than a few thousand. A list that is missed is merged by one task, without loss."""
    least = max(HOT, rows // 4_000)
    share = min(1.0, 4_000_000 / max(1, rows))
    if rows < least:
        return []
    sample = postings.select("key", "id").filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < max(1, round(share * (1 << 20))))
    return [r["key"] for r in sample.groupBy("key").count().filter(F.col("count") > least * share).select("key").collect()]


def _pairs_of_runs(postings: DataFrame, rows: int) -> DataFrame:
    """Postings (key, id, two, step), ``rows`` of them: pairs (a, b) of lists up to LIST with step -1, and rows
    (a, two as b, key, step) of longer lists.

    Lists are merged from rows sorted by key, in as many tasks as the rows need. A hot list is known before and stays out of the exchange.
    """
    hot = _hot_lists(postings, rows)
    long = None
    if hot:
        at = F.broadcast(postings.sparkSession.createDataFrame([(k,) for k in hot], "key long"))
        long = postings.join(at, "key", "left_semi").select(F.col("id").alias("a"), F.col("two").alias("b"), "key", "step")
        postings = postings.join(at, "key", "left_anti")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "key": np.int64(0), "step": np.int32(-1)})

        last, skipping, ids, two = None, False, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key, rid, bits, step = (batch[c].to_numpy() for c in ("key", "id", "two", "step"))
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(cut, len(key)))
            a, b, longs = [], [], []
            if last is not None:
                on = key[0] == last[0]  # the list goes on from the batch before
                if on:
                    ids, two = np.concatenate((ids, rid[: size[0]])), np.concatenate((two, bits[: size[0]]))
                    cut, size = cut[1:], size[1:]
                if skipping or len(ids) > LIST:
                    skipping = True
                    longs.append((last, ids, two))
                    ids, two = ids[:0], two[:0]
                elif len(cut) or not on:
                    for out, x in zip((a, b), _alike(ids, two), strict=True):
                        out.append(x)
            if len(cut):  # the last list of the batch may go on
                last, skipping = (key[cut[-1]], step[cut[-1]]), False
                ids, two = rid[cut[-1] :], bits[cut[-1] :]
                cut, size = cut[:-1], size[:-1]
                for n in np.unique(size[(size > 1) & (size <= 32)]):  # lists of one length at once
                    at = cut[size == n][:, None] + np.arange(n)
                    i, j = np.triu_indices(n, 1)
                    same = _agreeing(bits[at[:, i]], bits[at[:, j]]) >= AGREE2
                    a.append(rid[at[:, i]][same]), b.append(rid[at[:, j]][same])
                for k, n in zip(cut[size > 32], size[size > 32], strict=True):
                    if n > LIST:
                        longs.append(((key[k], step[k]), rid[k : k + n], bits[k : k + n]))
                    else:
                        for out, x in zip((a, b), _alike(rid[k : k + n], bits[k : k + n]), strict=True):
                            out.append(x)
            if a:
                yield pairs(a, b)
            for (k, s), members, t in longs:
                if len(members):
                    yield pd.DataFrame({"a": members, "b": t, "key": k, "step": s})
        if last is not None and len(ids):
            if skipping or len(ids) > LIST:
                yield pd.DataFrame({"a": ids, "b": two, "key": last[0], "step": last[1]})
            else:
                yield pairs(*([x] for x in _alike(ids, two)))

    parts = max(1, -(-rows // ROWS))
    merged = postings.repartition(parts, "key").sortWithinPartitions("key", "id").mapInPandas(merge, "a long, b long, key long, step int")
    return merged if long is None else merged.unionByName(long)


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of class ids whose signatures share enough coordinates."""
    # a row for each triple first, then one short hash a row: one expression with all hashes is too long to be compiled
    design = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(c).alias(f"c{i}") for i, c in enumerate(t)]) for n, t in enumerate(TRIPLES)])
    lists = classes.select("id", "two", "kind", "sig", F.inline(design)).select(F.xxhash64("n", "kind", *[F.get("sig", F.col(f"c{i}")) for i in range(3)]).alias("key"), "id", "two", F.lit(0).alias("step"))
    merged = scratch.write(_pairs_of_runs(lists, classes.count() * POSTED), "merged")
    scratch.release()
    found = [merged.filter("step < 0").select("a", "b")]
    # A list too long to merge is split by a further coordinate. Two records that share SHARED of the BASE
    # coordinates share, in their order, one of the first BASE-SHARED+1, then one of the first
    # BASE-SHARED+2 behind it and so on, so no candidate is lost; after SHARED steps all of a list qualify.
    level = 0
    while level < SHARED:
        longs = merged.filter("step >= 0").select(F.col("a").alias("id"), F.col("b").alias("two"), "key", "step")
        open_rows = longs.count()
        if not open_rows:
            break
        level += 1
        after = longs.join(classes.select("id", "sig"), "id")
        parts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(BASE - SHARED + level)), lambda c: F.struct(F.xxhash64("key", c, F.element_at("sig", c)).alias("key"), c.cast("int").alias("step"), (c > F.col("step")).alias("ok"))), lambda x: x["ok"])
        split = after.select("id", "two", F.explode(parts).alias("p")).select(F.col("p.key").alias("key"), "id", "two", F.col("p.step").alias("step"))
        merged = scratch.write(_pairs_of_runs(split, open_rows * (BASE - SHARED + level)), "merged")
        found.append(merged.filter("step < 0").select("a", "b"))
    else:
        rest = merged.filter("step >= 0").select("key", F.col("a").alias("id"))
        found.append(rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    return reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _agreeing4(x: str, y: str):
    """How many of the 16 four-bit fields of two numbers are equal."""
    d = F.col(x).bitwiseXOR(F.col(y))
    half = d.bitwiseOR(F.shiftright(d, 1))
    some = half.bitwiseOR(F.shiftright(half, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.lit(16) - F.bit_count(some)


def common_share(a: str, b: str) -> tuple[int, int]:
    """Common words counted with repetition, and words of the longer text."""
    x, y = Counter(words(a)), Counter(words(b))
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    return sum(min(n, large[w]) for w, n in small.items() if w in large), max(x.total(), y.total())


def _shares(a: pd.Series, b: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs of texts, in pieces of a batch: their rows, common words and words of the longer, as ``common_share``."""
    size = 400_000
    weight = (a.str.len() + b.str.len()).to_numpy()
    for rows in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(weight) // size)) + 1) if len(a) else []:
        (na, ka), (nb, kb) = word_keys(a.iloc[rows].tolist()), word_keys(b.iloc[rows].tolist())
        ra, _, ea = _elements(na, ka)
        rb, _, eb = _elements(nb, kb)
        row, element = np.concatenate((ra, rb)), np.concatenate((ea, eb))
        order = np.lexsort((element, row))
        row, element = row[order], element[order]
        both = (element[1:] == element[:-1]) & (row[1:] == row[:-1])
        yield rows, np.bincount(row[1:][both], minlength=len(rows)), np.maximum(na, nb)


def near_duplicates(records: DataFrame, threshold: tuple[int, int] = (4, 5), least_words: int = 12) -> DataFrame:
    """Pairs (record_kind, id_lo, id_hi) of records of one kind whose common words reach the threshold.

    ``records`` has kind STRING, id BIGINT, text STRING. Similarity is the number of common words, with
    repetition and in any order, over the words of the longer text, at least ``threshold`` (a fraction).

    Records with the same bag of words form a class and are compared once. Every class has a signature of
    32 min-wise coordinates over the rarer half of its (word, occurrence) elements; rarity comes from a
    fixed-size sketch of word frequencies over all records. Triples of coordinates are posted to an
    inverted index under (coordinate, value). When a posting list is merged, the collisions of every pair
    are counted on a few bits of all 32 coordinates, and pairs above the match threshold are candidates.
    Lists too long to merge are skipped and split by further coordinates in prefix order; the split by itself
    loses no pair that shares 8 of the 32, but the match thresholds drop some that share few, so the operator
    is not exact. Candidates are checked on all words of the whole texts, each met as a 64-bit key. Lists with more than about
    HOT postings are told from a sample and split before they are shuffled, so none is sent to one task.

    Defined cases: null texts and texts under ``least_words`` words are in no pair; repeated rows of one id
    are one record; classes of any size give all their pairs, inside and with other classes, so the result
    grows with the square of the copies; empty input, empty result; other columns are ignored.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "neardup")
    records = records.select(F.col("kind").cast("string").alias("kind"), F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    # ids of different kinds may be equal; classes are known by a key of their kind and bag
    signed = scratch.write(_signed(records, _sketch(records), least_words), "signed")
    for seed in range(100):  # two bags with one key would be one class: a seed is taken only where there are none
        keyed = signed.withColumn("cid", F.xxhash64(F.lit(seed), "kind", "bag", "bag2"))
        several = lambda c: F.min(c) != F.max(c)
        first = keyed.groupBy("cid").agg(F.min(F.struct("id", "kind", "two", "four1", "four2", "sig")).alias("m"), (several("bag") | several("bag2") | several("kind")).alias("clash"))
        classes = scratch.write(first.select(F.col("cid").alias("id"), F.col("m.id").alias("rep"), "m.kind", "m.two", "m.four1", "m.four2", "m.sig", "clash"), "classes")
        if not classes.filter("clash").limit(1).count():
            break
        scratch.drop(classes)
    classes = classes.drop("clash")
    members = scratch.write(keyed.select("kind", "id", "cid").distinct(), "members")
    scratch.drop(signed)
    scratch.release()
    near = _candidates(classes, scratch)

    end = lambda e: classes.select(F.col("id").alias(e), F.col("kind").alias(f"kind_{e}"), F.col("rep").alias(f"r{e}"), F.col("four1").alias(f"x{e}"), F.col("four2").alias(f"y{e}"))
    pairs = near.join(end("a"), "a").join(end("b"), "b").filter((F.col("kind_a") == F.col("kind_b")) & (_agreeing4("xa", "xb") + _agreeing4("ya", "yb") >= AGREE4))
    pairs = scratch.write(pairs.select(F.col("kind_a").alias("kind"), "a", "b", "ra", "rb"), "pairs")
    scratch.release()
    ends = pairs.select("kind", F.explode(F.array("ra", "rb")).alias("id")).distinct()
    texts = scratch.write(records.join(ends, ["kind", "id"], "left_semi").groupBy("kind", "id").agg(F.min("text").alias("text")), "texts")
    up, down = threshold

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for at, common, longest in _shares(a, b):
            out[at] = common * down >= longest * up
        return pd.Series(out)

    text = lambda e: texts.select("kind", F.col("id").alias(f"r{e}"), F.col("text").alias(f"t{e}"))
    with_texts = pairs.join(text("a"), ["kind", "ra"]).join(text("b"), ["kind", "rb"])
    true = scratch.write(with_texts.filter(alike("ta", "tb")).select("kind", "a", "b"), "true")
    scratch.release()

    sizes = members.groupBy("kind", "cid").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"))
    # a class that is alone and like no other gives no pair
    paired = true.select("kind", F.explode(F.array("a", "b")).alias("cid")).distinct().withColumn("met", F.lit(True))
    sizes = scratch.write(sizes.join(paired, ["kind", "cid"], "left").filter("size > 1 OR met").select("kind", "cid", "size", "rep"), "sizes")
    listed = members.join(sizes, ["kind", "cid"])
    star = None
    if EXPANDED is not None:
        star = listed.filter((F.col("size") > EXPANDED) & (F.col("id") != F.col("rep"))).select("kind", F.col("rep").alias("p"), F.col("id").alias("q"))
        listed = listed.filter((F.col("size") <= EXPANDED) | (F.col("id") == F.col("rep")))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))
    blocks = scratch.write(listed.withColumn("block", block).groupBy("kind", "cid", "block").agg(F.collect_list("id").alias("ids")), "blocks")
    x, y = (blocks.select("kind", F.col("cid").alias(c), F.col("block").alias(f"block_{c}"), F.col("ids").alias(f"ids_{c}")) for c in "ab")
    inside = x.join(y.withColumnRenamed("b", "a"), ["kind", "a"]).filter("block_a <= block_b AND (block_a < block_b OR size(ids_a) > 1)").withColumn("b", F.col("a"))
    across = true.join(x, ["kind", "a"]).join(y, ["kind", "b"])
    met = inside.unionByName(across).repartition("kind", "a", "block_a", "b", "block_b")
    out = met.select("kind", "a", "b", "block_a", "block_b", "ids_b", F.explode("ids_a").alias("p")).select("kind", "a", "b", "block_a", "block_b", "p", F.explode("ids_b").alias("q"))
    out = out.filter("p < q OR (p > q AND NOT (a = b AND block_a = block_b))").select("kind", "p", "q")
    if star is not None:
        out = out.unionByName(star)
    return out.select(F.col("kind").alias("record_kind"), F.least("p", "q").alias("id_lo"), F.greatest("p", "q").alias("id_hi")).distinct()
