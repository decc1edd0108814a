"""Problem 5: the best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that name nothing, compared in lower case after trimming.
PLACEHOLDERS = ["", "-", "--", "?", "??", "...", "…", "n/a", "na", "nan", "nil", "none", "null", "tbd", "tba", "todo", "unknown", "not given", "not available", "not specified", "unspecified", "undefined", "missing", "empty", "placeholder", "xxx"]
# The types an entity may have.
ENTITY_TYPES = ["PERSON", "ORGANIZATION", "LOCATION", "WORK_OF_ART", "EVENT", "DATE", "CUSTOM"]

_BLANK = r"(?U)[\s\p{Z}\x{200B}\x{2060}\x{FEFF}]"


def trimmed(c: str | Column) -> Column:
    """A text without outer white space, Unicode blanks included."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def names_something(c: Column) -> Column:
    """False for null, blank, placeholder words and bracketed template slots such as ``<fused_text>``."""
    t = F.lower(trimmed(c))
    slot = t.rlike(r"^(<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|\([^()]*\))$")
    return F.coalesce(~t.isin(PLACEHOLDERS) & ~slot & t.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def survivorship(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (group_id, text_from, type_from): the record that supplies each surviving field, 0 if none.

    One aggregation takes, for each field, the maximum of a composite struct (usable, source priority,
    timestamp, value): for the name (usable, confidence, exact occurrences in the group's texts, fused_at,
    smaller fused_id), for the type (usable, confidence, fused_at, smaller fused_id). The maximum is
    partially aggregated, so a group with a third of all rows costs no more than others. The occurrences
    are counted per (group, text) before they meet the records.

    Defined cases: confidence that is null, NaN or outside 0 to 1 ranks lowest, a null time last; repeated
    records change nothing; a null fused_id supplies nothing; records without a group id form no group; a
    group without texts has no occurrences, lists of one group stored twice count once, differing ones both; empty input, empty result; other columns are ignored.
    """
    usable_conf = F.when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), F.lit(-1.0)).otherwise(F.coalesce(F.col("confidence"), F.lit(-1.0)))
    recs = records.filter("group_id IS NOT NULL").select("group_id", "fused_id", "fused_text", "fused_type", "fused_at", usable_conf.cast("double").alias("conf"), trimmed("fused_text").alias("name"))
    # a list stored twice counts once; differing lists of one group count both
    texts = groups.filter("group_id IS NOT NULL").select("group_id", "entity_texts").distinct()
    seen = texts.select("group_id", F.explode("entity_texts").alias("t")).select("group_id", trimmed("t").alias("name")).filter("name IS NOT NULL").groupBy("group_id", "name").agg(F.count(F.lit(1)).alias("occ"))
    recs = recs.join(seen, ["group_id", "name"], "left")

    has_id = F.col("fused_id").isNotNull()
    name_ok = has_id & names_something(F.col("fused_text"))
    type_ok = has_id & F.coalesce(F.upper(trimmed("fused_type")).isin(ENTITY_TYPES), F.lit(False))
    rank = -F.col("fused_id")
    at = F.coalesce(F.col("fused_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    best = recs.groupBy("group_id").agg(
        F.max(F.when(name_ok, F.struct("conf", F.coalesce("occ", F.lit(0)).alias("occ"), F.col("fused_at").isNotNull().alias("dated"), at.alias("at"), rank.alias("rank")))).alias("name"),
        F.max(F.when(type_ok, F.struct("conf", F.col("fused_at").isNotNull().alias("dated"), at.alias("at"), rank.alias("rank")))).alias("type"),
    )
    return best.select("group_id", F.coalesce(-F.col("name.rank"), F.lit(0)).cast("long").alias("text_from"), F.coalesce(-F.col("type.rank"), F.lit(0)).cast("long").alias("type_from"))
