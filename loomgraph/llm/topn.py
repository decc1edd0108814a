"""Problem 2: the N best items of every group by simultaneous per-group bisection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, join_unique
from ..session import Scratch

#: Bytes of the identifier in one word of the code; with their number they fit a double exactly.
WORD = 6
#: Midpoints a round tests at once.
CUTS = 256
_BIG = 1.7976931348623157e308


def _id_word(item: str, word: Column) -> Column:
    """The ``word``-th run of six bytes of a string, as a number in the order of the bytes.

    The number of bytes present is the last digit, so that a prefix comes before what extends it.
    """
    part = F.substring(F.encode(F.col(item), "UTF-8"), (word - 1) * WORD + 1, F.lit(WORD))
    value = F.conv(F.hex(F.rpad(part, WORD, F.lit(b"\x00"))), 16, 10).cast("long")
    return (value * 8 + F.length(part)).cast("double")


def _bucket(code: str, lo: str, hi: str) -> Column:
    """Number of the midpoints of (lo, hi) below the code: monotone, 0 at lo and CUTS-1 at hi."""
    c, a, b = F.col(code), F.col(lo), F.col(hi)
    plain = (c - a) / (b - a)
    halved = (c / 2 - a / 2) / (b / 2 - a / 2)
    share = F.when(b <= a, F.lit(0.0)).when((F.abs(a) < 1e300) & (F.abs(b) < 1e300), plain).otherwise(halved)
    return F.greatest(F.lit(0), F.least(F.lit(CUTS - 1), F.floor(share * CUTS))).cast("int")


def top_n(items: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """Rows (group, item_rank, item): the ``n`` items of highest score of every group, ties by item.

    Every row has a code: first the negated score, then the bytes of the identifier in words, so smaller
    codes are better and no two items of a group share one. For all groups at once each round counts the
    rows between the midpoints of the group's open interval. Rows before the interval that holds the
    n-th row are taken, rows after it are dropped, and only that interval stays open, shrunk to its
    smallest and largest code; where one value is left, the next word of the code decides. A group is done
    when the rows taken are exactly ``n`` or all it has. A round moves counts, at most 256 for a group;
    the open rows shrink fast and no group is ever gathered or sorted beyond its ``n`` taken rows.

    Groups with more than 1/64 of the rows get their cutoffs by broadcast (one row a group).

    Defined cases: rows with null group, item or score, a NaN score, or item = group do not count; an item
    that occurs several times in a group counts once with its highest score; infinite scores rank as the
    largest finite ones; empty input, empty result; other columns are ignored.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "topn")
    s = F.col(score).cast("double")
    base = items.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), s.alias("s"))
    base = base.filter("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s) AND g <> i")
    base = base.withColumn("s", F.greatest(F.lit(-_BIG), F.least(F.lit(_BIG), F.col("s"))) + F.lit(0.0))
    rows = scratch.write(base.groupBy("g", "i").agg(F.max("s").alias("s")), "rows")

    edge = rows.agg(F.min(-F.col("s")).alias("lo"), F.max(-F.col("s")).alias("hi")).first()
    taken: list[DataFrame] = []
    if edge["lo"] is not None:
        opened = rows.select("g", "i", "s", F.lit(0).alias("w"), F.lit(edge["lo"]).alias("lo"), F.lit(edge["hi"]).alias("hi"), F.lit(n).cast("long").alias("need"))
        while True:
            code = F.when(F.col("w") == 0, -F.col("s")).otherwise(_id_word("i", F.col("w")))
            coded = opened.withColumn("code", code).withColumn("b", _bucket("code", "lo", "hi"))
            counts = coded.groupBy("g", "b").agg(F.count(F.lit(1)).alias("cnt"), F.min("code").alias("lo2"), F.max("code").alias("hi2"), F.first("w").alias("w"), F.first("need").alias("need"))
            run = counts.withColumn("upto", F.sum("cnt").over(Window.partitionBy("g").orderBy("b")))
            # the last interval that is looked at: the first that reaches the need, or else the last there is
            cut = run.groupBy("g").agg(
                F.min(F.when(F.col("upto") >= F.col("need"), F.struct("b", "upto", "cnt", "lo2", "hi2", "w", "need"))).alias("c"),
                F.sum("cnt").alias("cnt"),
            )
            single = F.col("c.lo2") == F.col("c.hi2")
            whole = F.col("c").isNull() | (F.col("c.upto") == F.col("c.need"))
            cut = scratch.write(
                cut.select(
                    "g", "cnt", F.coalesce(F.col("c.b"), F.lit(CUTS)).alias("at"), whole.alias("whole"),
                    F.when(single, F.col("c.w") + 1).otherwise(F.col("c.w")).alias("w2"),
                    # a new word starts with the full range of a word
                    F.when(single, F.lit(0.0)).otherwise(F.col("c.lo2")).alias("lo2"),
                    F.when(single, F.lit(float(2 ** (8 * WORD + 3)))).otherwise(F.col("c.hi2")).alias("hi2"),
                    (F.col("c.need") - (F.col("c.upto") - F.col("c.cnt"))).alias("need2"),
                ),
                "cut",
            )
            met = join_unique(coded.select("g", "i", "s", "b"), cut.drop("cnt"), "g", hot_keys(cut, "g")).filter(F.col("b") <= F.col("at"))
            done = (F.col("b") < F.col("at")) | F.col("whole")
            step = scratch.write(met.select("g", "i", "s", done.alias("done"), F.col("w2").alias("w"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("need2").alias("need")), "step")
            taken.append(step.filter("done").select("g", "i", "s"))
            opened = step.filter("NOT done").drop("done")
            scratch.drop(cut)
            if len(taken) == 1:
                scratch.drop(rows)
            scratch.release()
            if not opened.limit(1).count():
                break
    kept = reduce(DataFrame.unionByName, taken) if taken else rows
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i")))
    return kept.select(F.col("g").alias(group), rank.cast("int").alias("item_rank"), F.col("i").alias(item))
