"""Problem 6: the most similar vectors of every vector by a hash-prefix forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Trees that share one division of the vectors into shards, and bits of a hash string inside a shard.
TREES, BITS = 8, 24
#: Candidates a vector must meet in the trees of one shard together before the ascent ends there.
ENOUGH = 200
#: Vectors of a shard on average.
SHARD = 16_384
#: Divisions into shards: so many at least, and so many that a pair of the cosine NEAR is together in one of
#: them with the probability CAUGHT.
DIVISIONS, NEAR, CAUGHT = 8, 0.9, 0.99
#: Vectors the medians of the divisions are fitted on, at most, and the fewest a median is taken of.
SAMPLE, FEWEST = 20_000, 32
#: Most similar classes kept of each shard and over all shards, and smallest ids a class of equal vectors offers.
KEEP, OFFER = 8, 6


def valid_vectors(responses: DataFrame, dim: int) -> DataFrame:
    """Distinct (node_id, vec) of usable vectors, with the numbers as they are stored."""
    pairs = responses.select(F.explode(F.arrays_zip(F.col("node_ids").alias("node_id"), F.col("embeddings").alias("vec"))).alias("p")).select("p.node_id", "p.vec")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    return pairs.filter(F.col("node_id").isNotNull() & (F.size("vec") == dim) & ~bad & some).distinct()


def _classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column]:
    """(cid, vec, low), one row for each distinct vector with the smallest ids that have it, and the key of a vector.

    Two vectors with one key would be one class, so a seed is taken only when the keys are unique.
    """
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(1024)))
    part = salted.groupBy("vec", "salt").agg(F.slice(F.array_sort(F.collect_set("node_id")), 1, OFFER).alias("low"))
    whole = scratch.write(part.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("low"))), 1, OFFER).alias("low")), "distinct")
    for seed in range(100):
        key = F.xxhash64(F.lit(seed), "vec")
        if not whole.select(key.alias("cid")).groupBy("cid").count().filter("count > 1").limit(1).count():
            return whole.select(key.alias("cid"), "vec", "low"), key
    raise RuntimeError("no collision-free key seed found")


def _number(classes: DataFrame) -> str:
    """The numpy name of the stored number: single-precision vectors travel as such, without loss."""
    return "float32" if classes.schema["vec"].dataType.elementType.simpleString() == "float" else "float64"


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, however large or small the numbers are."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1)[:, None]
    return m / np.linalg.norm(m, axis=1)[:, None]


def _planes(seed: int, dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits))


def division_count(bits: int) -> int:
    """How many divisions of so many bits keep a pair of the cosine NEAR together in one with probability CAUGHT."""
    together = (1 - math.acos(NEAR) / math.pi) ** bits
    return DIVISIONS if together > 0.999 else max(DIVISIONS, math.ceil(math.log(1 - CAUGHT) / math.log(1 - together)))


class Divisions:
    """Hash strings whose bit at each level says on which side of a hyperplane a vector lies.

    A hyperplane has a direction for all nodes of the level and a threshold for each node, the median of a
    bounded sample there, so the shards stay near one size however uneven the vectors are. Nodes with few
    sampled vectors take the median of the closest ancestor that has enough.
    """

    def __init__(self, sample: np.ndarray, count: int, bits: int, dim: int) -> None:
        self.bits = bits
        self.directions = [_planes(5_000 + d, dim, bits) for d in range(count)]
        self.thresholds: list[list[np.ndarray]] = []
        for planes in self.directions:
            at = sample @ planes
            node, levels = np.zeros(len(sample), np.int64), []
            members = [np.arange(len(sample))]  # of each node, the sampled rows its median is taken of
            for level in range(bits):
                limit = np.array([np.median(at[rows, level]) if len(rows) else 0.0 for rows in members])
                node = node * 2 + (at[:, level] > limit[node])
                order = np.argsort(node, kind="stable")
                ends = np.searchsorted(node[order], np.arange((2 << level) + 1), "left")
                members = [order[lo:hi] if hi - lo >= FEWEST else members[k // 2] for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
                levels.append(limit)
            self.thresholds.append(levels)

    def of(self, unit: np.ndarray, division: int) -> np.ndarray:
        at = unit @ self.directions[division]
        node = np.zeros(len(unit), np.int64)
        for level, limit in enumerate(self.thresholds[division]):
            node = node * 2 + (at[:, level] > limit[node])
        return node


def _fit(classes: DataFrame, n: int, dim: int) -> Divisions:
    bits = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    sample = np.empty((0, dim))
    if bits:
        share = min(1.0, SAMPLE / n)
        chosen = classes.filter(F.pmod(F.xxhash64(F.lit("sample"), "cid"), F.lit(1_000_000)) < round(share * 1_000_000)).select("vec").limit(2 * SAMPLE).toPandas()
        sample = _unit(np.stack(chosen["vec"].to_numpy())) if len(chosen) else sample
    return Divisions(sample, division_count(bits), bits, dim)


def _top(sims: np.ndarray) -> np.ndarray:
    k = min(KEEP, sims.shape[-1])
    return np.argpartition(-sims, k - 1, axis=-1)[..., :k]


def forest_neighbours(m: np.ndarray, seed: int, enough: int = ENOUGH, trees: int = TREES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, candidates met by each row): up to KEEP of the most similar other rows of every row.

    Each tree is a sorted array of hash strings, bits of sides of hyperplanes through the mean of the rows. Every
    row descends to its longest prefix; then all trees leave the deepest level together, level by level, until the
    row has met ``enough`` candidates (or all there are), which are compared in single precision.
    """
    k, dim = m.shape
    centred = (m - m.mean(axis=0)).astype(np.float32)
    near = m.astype(np.float32)
    power = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))[None, :]
    orders, labels = [], []
    met = np.zeros((BITS + 1, k), np.int64)
    for t in range(trees):
        label = ((centred @ _planes(seed * 64 + t, dim, BITS).astype(np.float32) > 0) * power).sum(axis=1)
        order = np.argsort(label, kind="stable")
        label = label[order]
        orders.append(order), labels.append(label)
        for depth in range(BITS + 1):
            cut = np.flatnonzero(np.append(True, np.diff(label >> np.int64(BITS - depth)) != 0))
            size = np.diff(np.append(cut, k))
            met[depth, order] += np.repeat(size - 1, size)
    depth_of = np.zeros(k, np.int64)
    for depth in range(BITS + 1):
        depth_of[met[depth] >= min(enough, trees * (k - 1))] = depth
    out = []
    for order, label in zip(orders, labels, strict=True):
        mine = depth_of[order]
        for depth in np.unique(mine):
            cut = np.flatnonzero(np.append(True, np.diff(label >> np.int64(BITS - depth)) != 0))
            size = np.diff(np.append(cut, k))
            asked = np.add.reduceat(mine == depth, cut) > 0
            cut, size = cut[asked & (size > 1)], size[asked & (size > 1)]
            # nodes of about one size are compared at once, padded to the next power of two
            width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
            for w in np.unique(width):
                some = np.flatnonzero(width == w)
                step = max(1, (1 << 22) // int(w * w)) if w <= 2048 else 1
                for at in range(0, len(some), step):
                    c, s = cut[some[at : at + step]], size[some[at : at + step]]
                    if w > 2048:
                        rows = order[c[0] : c[0] + s[0]]
                        for q in range(0, len(rows), 1024):
                            ask = np.flatnonzero(mine[c[0] + q : c[0] + min(len(rows), q + 1024)] == depth) + q
                            if len(ask):
                                sims = near[rows[ask]] @ near[rows].T
                                sims[np.arange(len(ask)), ask] = -2
                                top = _top(sims)
                                out.append((np.repeat(rows[ask], top.shape[1]), rows[top].ravel(), np.take_along_axis(sims, top, axis=1).ravel()))
                        continue
                    inside = np.arange(w) < s[:, None]
                    place = np.where(inside, c[:, None] + np.arange(w), c[:, None])
                    rows = order[place]
                    x = near[rows]
                    sims = np.matmul(x, x.transpose(0, 2, 1))
                    sims = np.where(inside[:, None, :], sims, np.float32(-2))
                    sims[:, np.arange(w), np.arange(w)] = -2
                    top = _top(sims)
                    value = np.take_along_axis(sims, top, axis=2)
                    good = (inside & (mine[place] == depth))[:, :, None] & (value > -2)
                    other = np.take_along_axis(np.broadcast_to(rows[:, None, :], sims.shape), top, axis=2)
                    out.append((np.broadcast_to(rows[:, :, None], top.shape)[good], other[good], value[good]))
    count = met[depth_of, np.arange(k)]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), count
    a, b, sim = (np.concatenate(c) for c in zip(*out, strict=True))
    # one number holds row, other row and distance, so plain sorts drop repeated pairs and rank the rest
    wide = max(1, int(k - 1).bit_length())
    fine = min(30, 62 - 2 * wide)
    far = np.clip((1.0 - sim.astype(np.float64)) / 2, 0, 1) * ((1 << fine) - 1)
    pairs = np.sort((a << (wide + fine)) | (b << fine) | far.astype(np.int64))
    pairs = pairs[np.append(True, (pairs[1:] >> fine) != (pairs[:-1] >> fine))]
    a, b, far = pairs >> (wide + fine), (pairs >> fine) & ((1 << wide) - 1), pairs & ((1 << fine) - 1)
    ranked = np.sort((a << (wide + fine)) | (far << wide) | b)
    a, b = ranked >> (wide + fine), ranked & ((1 << wide) - 1)
    best = np.arange(len(a)) - np.searchsorted(a, a, "left") < KEEP
    return a[best], b[best], count


def similar_classes(classes: DataFrame, dim: int, least: float = -1.0, enough: int = ENOUGH) -> DataFrame:
    """(cid, other, sim): for every vector up to KEEP of its most similar others of every shard it is in."""
    number = _number(classes)
    n = classes.count()
    shared = classes.sparkSession.sparkContext.broadcast(_fit(classes, n, dim))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        divisions = shared.value
        for batch in batches:
            m = np.stack(batch["vec"].to_numpy()).astype(number)
            unit, raw, cid = _unit(m), [row.tobytes() for row in m], batch["cid"].to_numpy()
            for d in range(len(divisions.directions)):
                yield pd.DataFrame({"division": np.int32(d), "shard": divisions.of(unit, d), "cid": cid, "vec": raw})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        cid = pdf["cid"].to_numpy()
        m = _unit(np.frombuffer(b"".join(pdf["vec"]), number).reshape(-1, dim))
        a, b, _ = forest_neighbours(m, int(pdf["division"].iloc[0]) * 1_000_003 + int(pdf["shard"].iloc[0]) % 1_000_003, enough)
        sim = np.einsum("ij,ij->i", m[a], m[b])
        kept = np.round(sim, 6) >= least
        return pd.DataFrame({"cid": cid[a[kept]], "other": cid[b[kept]], "sim": sim[kept]})

    rows = classes.select("cid", "vec").mapInPandas(place, "division int, shard long, cid long, vec binary")
    return rows.groupBy("division", "shard").applyInPandas(search, "cid long, other long, sim double")


def similar_pairs(responses: DataFrame, k: int = 5, least: float = 0.8, dim: int = 64, enough: int = ENOUGH) -> DataFrame:
    """Pairs (node_lo, node_hi): either node is among the ``k`` most similar of the other, cosine >= ``least``.

    ``responses`` has the parallel arrays node_ids and embeddings. Equal vectors form a class that is
    searched once and offers its six smallest ids. A forest of hash strings is kept in parts: the leading bits
    divide the vectors into shards of about SHARD, in several divisions of their own hyperplanes, and each shard
    holds the sorted arrays of TREES trees. In every shard it is in, a vector descends to its longest prefix in all
    trees; then the trees ascend level by level together until it has met ENOUGH candidates, which are scored
    inside the shard, so a vector is shuffled once for a division and no candidate pair is, only the best
    eight of a shard. The number of divisions follows from the number of bits (see ``division_count``), so near
    pairs stay together in one of them at every size. Only the thresholds of the divisions are fitted on
    a sample of about SAMPLE vectors; every vector is indexed and every vector is a query.

    Defined cases: vectors that are null, of another length, all zero, or hold null, NaN or infinity do not
    count, nor null ids; a node embedded twice with the same vector counts once; ties by the smaller node
    id; similarity is rounded to 6 places; fewer than two vectors, empty result; other columns are ignored.
    """
    spark = responses.sparkSession
    scratch = Scratch(spark, "knn")
    vectors = scratch.write(valid_vectors(responses, dim), "vectors")
    classes, key = _classes(vectors, scratch)
    # one exchange by cid serves both steps: a pair found in several shards is one, then the best of each class
    near = similar_classes(classes, dim, least, enough).repartition("cid").groupBy("cid", "other").agg(F.max("sim").alias("sim"))
    best = scratch.write(near, "near")
    scratch.release()

    low = classes.select(F.col("cid").alias("other"), F.explode("low").alias("node"))
    offers = best.join(low, "other").select("cid", F.struct((-F.round("sim", 6)).alias("far"), "node").alias("o"))
    own = classes.select("cid", F.explode("low").alias("node")).select("cid", F.struct(F.lit(-1.0).alias("far"), "node").alias("o"))
    # at most KEEP classes of OFFER ids for each division
    tops = offers.unionByName(own).groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("o")), 1, k + 1).alias("top"))
    asked = vectors.select("node_id", key.alias("cid")).join(tops, "cid")
    mine = asked.select("node_id", F.explode(F.slice(F.filter("top", lambda o: o["node"] != F.col("node_id")), 1, k)).alias("o")).filter(F.col("o.far") <= -least)
    return mine.select(F.least("node_id", "o.node").alias("node_lo"), F.greatest("node_id", "o.node").alias("node_hi")).distinct()
