"""Problem 10: texts cut off by field limits, by length hazards and the way texts end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .endings import cut_at_end

#: Lengths on either side whose hazards a length is tested against.
NEIGHBOURS = 40
#: False-discovery rate of the lengths, and texts a limit must have stopped at least.
FDR, LEAST = 0.01, 3
#: Sizes of p that are told apart, in quarters of its natural logarithm; smaller ones are one size.
SIZES = 2_800


def length_hazards(lengths: DataFrame) -> DataFrame:
    """(source, measure, length, n, at_risk, expected, p): hazard of ending at each length, and its test.

    The hazard at a length is the share of the source's texts at least that long that end there. It is
    tested against the pooled hazard of the NEIGHBOURS lengths on both sides: p bounds (Chernoff) the
    Poisson probability of so many ends or more. ``lengths`` has source, measure and length, one row a text.
    """
    counted = lengths.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "measure").orderBy("length")
    longer = by.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    risk = counted.withColumn("at_risk", F.sum("n").over(longer))
    risk = risk.withColumn("ends_near", F.sum("n").over(near) - F.col("n")).withColumn("risk_far", F.min("at_risk").over(near))
    # lengths without any text are at risk as well, so the neighbours count with their full number
    rate = (F.col("ends_near") + 1.0) / (2 * NEIGHBOURS * F.greatest(F.col("risk_far") + F.col("ends_near") / 2, F.lit(1.0)))
    tested = risk.withColumn("expected", F.least(F.lit(1.0), rate) * F.col("at_risk"))
    bound = F.exp(-(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected")))
    return tested.select("source", "measure", "length", "n", "at_risk", "expected", F.when(F.col("n") <= F.col("expected"), F.lit(1.0)).otherwise(bound).alias("p"))


def significant_lengths(hazards: DataFrame) -> DataFrame:
    """The lengths that stay significant under Benjamini-Hochberg control over all tests."""
    # ranks are counted by the size of p: a cumulative count over a bounded number of sizes, then ranks within one size,
    # so no task sorts all tests; the sizes are ordered, so both together are the rank among all
    low = hazards.filter(F.col("p") <= FDR).withColumn("size", F.greatest(F.lit(-SIZES), F.round(F.log(F.greatest(F.col("p"), F.lit(1e-300))) * 4)).cast("int"))
    sizes = low.groupBy("size").agg(F.count(F.lit(1)).alias("many")).withColumn("before", F.sum("many").over(Window.orderBy("size")) - F.col("many"))
    within = F.row_number().over(Window.partitionBy("size").orderBy("p", "source", "measure", "length"))
    tests = hazards.agg(F.count(F.lit(1)).alias("tests"))
    ranked = low.withColumn("within", within).join(F.broadcast(sizes.drop("many")), "size").withColumn("rank", F.col("before") + F.col("within")).crossJoin(F.broadcast(tests))
    passed = ranked.filter(F.col("p") <= F.col("rank") * FDR / F.col("tests")).agg(F.max("p").alias("cut"))
    return low.crossJoin(F.broadcast(passed)).filter((F.col("p") <= F.col("cut")) & (F.col("n") >= LEAST)).select("source", "measure", "length", "n")


def truncated(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, source, at_limit): texts cut inside a word or sentence.

    Every text is measured in characters and in UTF-8 bytes. Lengths at which a source ends significantly
    more texts than at neighbouring lengths are its field limits; there every ending but a full stop counts
    as cut. Elsewhere (broken transfers end anywhere) the ending itself must show the cut: no full stop, and
    no heading, list, table row, note, signature or quotation as the last line. Marks put behind a cut
    (dots, "read more", broken markup) are looked through.

    Defined cases: null and blank texts are no case and are not measured; a null source is a source of its
    own; repeated rows count once in the result; empty input, empty result; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "truncation")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND trim(text) <> ''")
    measured = docs.select("source", F.inline(F.array(F.struct(F.lit("chars").alias("measure"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.octet_length("text").alias("length")))))
    # the hazards are read by several steps: the texts are measured once
    limits = scratch.write(significant_lengths(scratch.write(length_hazards(measured), "hazards")), "limits")
    limit = lambda m: limits.filter(F.col("measure") == m).select("source", F.col("length").alias(m), F.lit(True).alias(f"at_{m}"))

    @F.pandas_udf("int")
    def ending(texts: pd.Series) -> pd.Series:
        # 2: cut in any case, 1: cut if at a limit, 0: whole
        return texts.map(lambda t: 2 if cut_at_end(t) else int(cut_at_end(t, True))).astype("int32")

    ended = docs.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), ending("text").alias("ending")).filter("ending > 0")
    met = ended.join(limit("chars"), ["source", "chars"], "left").join(limit("bytes"), ["source", "bytes"], "left")
    at = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    return met.withColumn("at_limit", at).filter((F.col("ending") == 2) | F.col("at_limit")).select("doc_id", "source", "at_limit").distinct()


def truncation_report(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, share): how often each source truncates, among its non-blank texts."""
    total = documents.filter("text IS NOT NULL AND trim(text) <> ''").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count_distinct("doc_id").alias("n_docs"))
    hit = cut.groupBy("source").agg(F.count_distinct("doc_id").alias("n_cut"))
    return total.join(hit, "source", "left").select("source", "n_docs", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_docs"), 6).alias("share"))
