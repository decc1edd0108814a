"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Bounds of the number of parts a key's share is measured against.
LEAST_PARTS, MOST_PARTS = 64, 4_096


def hot_keys(counts: DataFrame, key: str, count: str = "cnt", parts: int | None = None) -> list:
    """Keys with more rows than a shuffle partition has on average, from a table of counts by key.

    ``parts`` is the number of shuffle partitions between LEAST_PARTS and MOST_PARTS. There are fewer
    such keys than parts whatever the data, so the list is bounded.
    """
    if parts is None:
        parts = min(MOST_PARTS, max(LEAST_PARTS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    total = counts.agg(F.sum(count).alias("n")).first()["n"]
    if not total:
        return []
    # rows too few to hurt any task are not worth a second branch
    least = max(total / parts, 20_000)
    return [r[0] for r in counts.filter((F.col(count) > least) & F.col(key).isNotNull()).select(key).limit(parts).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per ``key``.

    Rows of the ``hot`` keys meet their right rows by broadcast (at most ``len(hot)`` rows, see
    ``hot_keys``) and are never shuffled; all others take an ordinary join. ``how`` is inner or left.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right.filter(~is_hot), key, how)
    warm = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return cold.unionByName(warm)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with their row number within the keys, counted from 1 in the order, which must be total.

    Rows are range-partitioned by keys and order together, so a key with a third of all rows is spread over many
    tasks; each numbers its own rows, and the counts of the parts before a part are added.
    """
    parts = scratch.write(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return parts.withColumn("_within", within).join(counts, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")
