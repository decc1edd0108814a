"""Answer evaluation and data-set filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_match, token_f1


def scored_answers(results: DataFrame, field: str = "short_answer") -> DataFrame:
    """(.., em, f1) of each prediction against its gold answers (column golds, an array); the best gold counts."""
    each = results.withColumn("gold", F.explode_outer("golds"))
    keys = [c for c in results.columns if c != "golds"]
    em, f1 = exact_match("gold", field), F.round(token_f1("gold", field), 6)
    return each.groupBy(*keys).agg(F.max(em).alias("em"), F.max(f1).alias("f1"))


def summary(scored: DataFrame, by: str, places: int = 4) -> DataFrame:
    """Means by group and over all rows (null group), by one rollup."""
    return scored.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("em") * 100, places).alias("em"), F.round(F.avg("f1") * 100, places).alias("f1"))


def doc_number(c: str) -> Column:
    """The number in an id such as ``hotpot_7``; null where the id has another form."""
    return F.nullif(F.regexp_extract(c, r"^[A-Za-z0-9]+_(\d+)$", 1), F.lit("")).cast("long")


def surviving(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    return documents.join(nodes.select(F.col("doc_id").alias("doc_key")).distinct(), "doc_key", "left_semi")


def skipped(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    return documents.join(nodes.select(F.col("doc_id").alias("doc_key")).distinct(), "doc_key", "left_anti")


def all_facts_valid(samples: DataFrame, valid: DataFrame, key: str, facts: str, fact: str) -> DataFrame:
    """Samples all of whose facts are valid; a sample without facts passes, a null fact is ignored."""
    bad = samples.select(key, F.explode(facts).alias(fact)).filter(F.col(fact).isNotNull()).join(valid.select(fact).distinct(), fact, "left_anti")
    return samples.join(bad.select(key).distinct(), key, "left_anti")


def judge_summary(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, n, n_right, share) of verdicts (is_correct 0 or 1) by group and over all rows (null group)."""
    return verdicts.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("n_right"), F.round(F.avg("is_correct") * 100, 4).alias("share"))


def mean_scores(scores: DataFrame, key: str, score: str) -> DataFrame:
    """(key, n, mean) of scores that are numbers."""
    return scores.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"))
