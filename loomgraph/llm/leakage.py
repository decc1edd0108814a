"""Problem 9: evaluation texts inside training texts, by SimHash windows and multi-index Hamming blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .words import chunks, mix, word_keys, words

#: Words of a window, the unit an item is cut into.
WINDOW = 12
#: Fingerprints within this Hamming distance are found for certain: they agree in one of RADIUS + 1 blocks.
RADIUS = 2
#: Item windows that are broadcast as an index (about 180 bytes each); more are met by a join.
WINDOWS = 500_000
#: Bits of a block that a bitmap tells apart.
MASK = 22


def cuts(radius: int) -> list[int]:
    """Where the 64 bits are cut into ``radius`` + 1 blocks of about one width."""
    return [round(64 * b / (radius + 1)) for b in range(radius + 2)]


def fingerprints(k: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of every window of consecutive word keys: bit i is the majority of bit i of its words."""
    n = len(k) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = 1 << 16  # bits are unpacked piecewise, so a long text needs no more memory than a short one
    mixed = mix(k, 99)
    for at in range(0, n, step):
        part = mixed[at : min(n, at + step) + window - 1]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1)
        run = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=run[1:])
        major = (run[window:] - run[:-window]) * 2 > window
        out[at : at + step] = np.packbits(major, axis=1).view(np.uint64).ravel()
    return out


def _block(f: np.ndarray, b: int, radius: int = RADIUS) -> np.ndarray:
    at = cuts(radius)
    width = at[b + 1] - at[b]
    return ((f >> np.uint64(at[b])) & np.uint64((1 << width) - 1 if width < 64 else 2**64 - 1)).view(np.int64)


def _windows(k: np.ndarray, window: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(k, window) if len(k) >= window else np.empty((0, window), np.uint64)


class ItemIndex:
    """Windows of a bounded number of items: word keys, fingerprints, and per block the windows by value."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, radius: int = RADIUS) -> None:
        self.window, self.radius = window, radius
        lengths, keys = word_keys([t for _, t in items])
        seqs = [(q, k) for (q, _), k in zip(items, np.split(keys, np.cumsum(lengths)[:-1]), strict=True) if len(k) >= window] if items else []
        rows = [_windows(k, window) for _, k in seqs]
        owner = [np.full(len(r), q, np.int64) for (q, _), r in zip(seqs, rows, strict=True)]
        self.words = np.concatenate(rows) if rows else np.empty((0, window), np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        self.prints = np.concatenate([fingerprints(k, window) for _, k in seqs]) if seqs else np.empty(0, np.uint64)
        self.blocks = []
        for b in range(radius + 1):
            v = _block(self.prints, b, radius)
            order = np.argsort(v, kind="stable")
            self.blocks.append((v[order], order))

    def masks(self) -> list[np.ndarray]:
        """Per block, which values (their low MASK bits) occur at all."""
        out = []
        for v, _ in self.blocks:
            m = np.zeros(1 << MASK, bool)
            m[v & ((1 << MASK) - 1)] = True
            out.append(m)
        return out

    def near(self, prints: np.ndarray, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All (position, item window) with fingerprints within the radius."""
        at, win = [], []
        for b, (v, order) in enumerate(self.blocks):
            value = _block(prints, b, self.radius)
            hit = np.flatnonzero(masks[b][value & ((1 << MASK) - 1)])
            lo, hi = np.searchsorted(v, value[hit], "left"), np.searchsorted(v, value[hit], "right")
            n = hi - lo
            pos = np.repeat(hit, n)
            w = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            close = np.bitwise_count(prints[pos] ^ self.prints[w]) <= self.radius
            at.append(pos[close]), win.append(w[close])
        return np.concatenate(at), np.concatenate(win)


def weighted_shingle_similarity(a: np.ndarray, b: np.ndarray, width: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Of each row pair of word windows: weight of the shingles both have at one place over all of a place.

    A shingle is ``width`` words in order; ``weight`` gives the weight of each place, one by default. With
    the width of the window there is one shingle, and similarity 1 means the same words in the same order.
    """
    same = np.lib.stride_tricks.sliding_window_view(a == b, width, axis=1).all(axis=2)
    w = np.ones(same.shape[1]) if weight is None else weight
    return (same * w).sum(axis=1) / w.sum()


def _whole_windows(rows: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of every word of a chunk, and where windows within one text begin."""
    row = np.repeat(np.arange(len(rows)), lengths)
    return row, np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :]) if len(row) >= window else np.empty(0, np.int64)


def _block_rows(texts: DataFrame, owner: str, window: int, radius: int, bitmaps: Broadcast | None = None) -> DataFrame:
    """(block, value, print, words, owner): a row for every block of every window of the texts, of which the
    block's value occurs in the bitmaps where these are given."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = None
        if bitmaps is not None:
            masks = [np.zeros(1 << MASK, bool) for _ in range(radius + 1)]
            for b, bucket, bits in bitmaps.value:
                part = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
                masks[b][bucket * len(part) : (bucket + 1) * len(part)] = part
        for batch in batches:
            ids = batch[owner].to_numpy()
            for rows, lengths, k in chunks(batch["text"]):
                row, start = _whole_windows(rows, lengths, window)
                if not len(start):
                    continue
                prints, view = fingerprints(k, window)[start], _windows(k, window)
                for b in range(radius + 1):
                    v = _block(prints, b, radius)
                    hit = np.arange(len(v)) if masks is None else np.flatnonzero(masks[b][v & ((1 << MASK) - 1)])
                    for at in range(0, len(hit), 50_000):
                        h = hit[at : at + 50_000]
                        yield pd.DataFrame({"block": np.int32(b), "value": v[h], "print": prints[h].view(np.int64), "words": [view[i].tobytes() for i in start[h]], owner: ids[rows[row[start[h]]]]})

    return texts.select(owner, "text").mapInPandas(rows_of, f"block int, value long, print long, words binary, {owner} long")


def _by_join(docs: DataFrame, queries: DataFrame, least: float, width: int, window: int, radius: int) -> DataFrame:
    """Any number of items: windows of both sides meet by (block, value). Documents are read once; only windows with
    a block value that some item has, told by bitmaps of fixed size, are shuffled."""
    scratch = Scratch(docs.sparkSession, "leakage")
    theirs = scratch.write(_block_rows(queries, "question_id", window, radius).distinct(), "items")
    low = F.col("value").bitwiseAND(F.lit((1 << MASK) - 1))
    # Spark numbers the buckets of a bitmap from 1
    set_bits = theirs.groupBy("block", (F.bitmap_bucket_number(low + 1) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low + 1)).alias("bits"))
    bitmaps = docs.sparkSession.sparkContext.broadcast([(r["block"], r["bucket"], bytes(r["bits"])) for r in set_bits.collect()])
    mine = _block_rows(docs, "doc_id", window, radius, bitmaps)
    met = mine.alias("d").join(theirs.alias("q"), ["block", "value"]).filter(F.bit_count(F.col("d.print").bitwiseXOR(F.col("q.print"))) <= radius)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(c), np.uint64).reshape(-1, window) for c in (a, b))
        return pd.Series(weighted_shingle_similarity(x, y, width) >= least)

    return met.filter(alike("d.words", "q.words")).select("doc_id", "question_id")


def leaked_items(documents: DataFrame, items: DataFrame, least: float = 1.0, width: int = WINDOW, window: int = WINDOW, radius: int = RADIUS, windows: int = WINDOWS) -> DataFrame:
    """Rows (doc_id, question_id): documents that hold a ``window`` of an item's texts.

    ``documents`` has doc_id and text, ``items`` question_id and texts (ARRAY of STRING). Items are cut into
    windows of 12 words, every window of every document gets a SimHash fingerprint, and ``radius`` + 1 blocks of
    bits find all pairs of fingerprints within ``radius`` bits: such a pair agrees in one block at least. Pairs are
    then checked by the exact weighted-shingle similarity of the words themselves. With the default width of a
    whole window and similarity 1 the result is exactly the documents that share 12 consecutive words; a
    smaller ``width`` and ``least`` with a larger ``radius`` also finds edited passages.

    Up to ``windows`` item windows are broadcast as an index and documents are only scanned, with no shuffle but
    the removal of repeated result rows. More item windows, however many, are joined by their blocks in one pass
    over the documents.

    Defined cases: null texts, and texts of fewer words than a window, match nothing; repeated documents or items
    count once; null ids are skipped; either side empty, empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    queries = items.select(F.col("question_id").cast("long").alias("question_id"), F.explode("texts").alias("text")).filter("question_id IS NOT NULL AND text IS NOT NULL").distinct()
    # a word has one character at least and one that divides it from the next
    bound = queries.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first()["n"] or 0
    if bound > windows:
        count = F.pandas_udf(lambda s: s.map(lambda t: max(0, len(words(t)) - window + 1)), "long")
        bound = queries.select(count("text").alias("n")).agg(F.sum("n").alias("n")).first()["n"]
    if bound > windows:
        return _by_join(docs, queries, least, width, window, radius).distinct()
    shared = spark.sparkContext.broadcast(ItemIndex([(r["question_id"], r["text"]) for r in queries.collect()], window, radius))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        masks = ix.masks()
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for rows, lengths, k in chunks(batch["text"]):
                row, start = _whole_windows(rows, lengths, window)
                if not len(start) or not len(ix.owner):
                    continue
                at, win = ix.near(fingerprints(k, window)[start], masks)
                at = start[at]
                true = weighted_shingle_similarity(_windows(k, window)[at], ix.words[win], width) >= least
                pairs = np.unique(np.stack([ids[rows[row[at[true]]]], ix.owner[win[true]]], axis=1), axis=0) if true.any() else np.empty((0, 2), np.int64)
                yield pd.DataFrame({"doc_id": pairs[:, 0], "question_id": pairs[:, 1]})

    return docs.mapInPandas(scan, "doc_id long, question_id long").distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (question_id, n_docs) for every item that leaked into at least one document."""
    return found.groupBy("question_id").agg(F.count_distinct("doc_id").alias("n_docs"))
