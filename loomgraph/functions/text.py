"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relation names and the coarse edge type each belongs to; any other is SIMILARITY.
EDGE_TYPES = {
    "SEQUENCE": "SKELETON",
    "CONTRAST": "SKELETON",
    "CONCESSION": "SKELETON",
    "SKELETON": "SKELETON",
    "CAUSED_BY": "DETAIL",
    "MOTIVATION": "DETAIL",
    "ELABORATION": "DETAIL",
    "BACKGROUND": "DETAIL",
    "DETAIL": "DETAIL",
    "SIMILARITY": "SIMILARITY",
}
# Directions as extractors name them.
DIRECTIONS = {"forward": "1->2", "backward": "2->1", "bidirectional": "1<->2"}


#: White space inside a character class.
BLANK = r"\s\p{Z}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def edge_type(c: str | Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(EDGE_TYPES), _col(c)), F.lit("SIMILARITY"))


def direction(c: str | Column) -> Column:
    """Arrow form of a direction; arrows stay, anything unknown is ``1->2``."""
    c = _col(c)
    return F.when(c.isin(list(DIRECTIONS.values())), c).otherwise(F.coalesce(F.try_element_at(_lookup(DIRECTIONS), c), F.lit("1->2")))


def entity_id(doc_id: str | Column, text: str | Column) -> Column:
    return F.concat(_col(doc_id), F.lit("_ent_"), F.translate(F.replace(_col(text), F.lit(" "), F.lit("_")), "\"'", ""))


def proposition_id(doc_id: str | Column, prop_idx: str | Column) -> Column:
    return F.concat(_col(doc_id), F.lit("_prop_"), _col(prop_idx).cast("string"))


def normalize_answer(c: str | Column) -> Column:
    """Lower case, no punctuation but dots and hyphens, articles replaced as substrings, single blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}_\p{Z}\s.\-]", "")
    for article in ("a ", "an ", "the "):
        t = F.replace(t, F.lit(article), F.lit(" "))
    return F.trim(F.regexp_replace(t, r"[\s\p{Z}]+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def token_f1(gold: str | Column, predicted: str | Column) -> Column:
    """F1 over token multisets of the normalised answers; both empty 1, one empty 0."""
    g, p = tokens(normalize_answer(gold)), tokens(normalize_answer(predicted))
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    same = F.aggregate(F.array_intersect(g, p), F.lit(0), lambda acc, t: acc + F.least(count(g, t), count(p, t)))
    return F.when((F.size(g) == 0) & (F.size(p) == 0), 1.0).when((F.size(g) == 0) | (F.size(p) == 0) | (same == 0), 0.0).otherwise(F.lit(2.0) * same / (F.size(g) + F.size(p)))


def exact_match(gold: str | Column, predicted: str | Column) -> Column:
    return (normalize_answer(gold) == normalize_answer(predicted)).cast("double")


def clean_short_answer(c: str | Column) -> Column:
    """Without outer quotes, doubled blanks and closing punctuation."""
    strip = lambda t, chars: F.regexp_replace(t, f"^[{chars}]+|[{chars}]+$", "")
    t = strip(F.coalesce(_col(c), F.lit("")), BLANK)
    for quote in ('"', "'", BLANK):
        t = strip(t, quote)
    t = F.regexp_replace(F.regexp_replace(t, f"[{BLANK}]+", " "), r"[。．.!！?？;；,:，]+$", "")
    return F.trim(t)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays read as sets; 0 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(both / either)


def jaccard_pairs(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """Ordered pairs (id1, id2, similarity) of rows whose sets of items have at least the similarity, both ways.

    ``items`` is an array without repetitions. Two sets of similarity t share one of the first n - ceil(t n) + 1 of their n
    items in one common order, so rows meet by these alone, the rarest first: frequent items lead to no pairs.
    """
    each = sets.select(key, F.size(items).alias("n"), F.explode(items).alias("item"))
    rare = each.groupBy("item").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(rare, "item").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("f", "item")))
    # a hair below the product, as 0.3 * 10 may come out above 3
    heads = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(key, "item")
    met = heads.withColumnRenamed(key, "id1").join(heads.withColumnRenamed(key, "id2"), "item").filter("id1 <> id2").select("id1", "id2").distinct()
    side = lambda i: sets.select(F.col(key).alias(f"id{i}"), F.col(items).alias(f"w{i}"))
    scored = met.join(side(1), "id1").join(side(2), "id2").withColumn("similarity", jaccard(F.col("w1"), F.col("w2")))
    return scored.filter(F.col("similarity") >= least).select("id1", "id2", "similarity")


def words_lower(c: str | Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"\s+"), lambda x: x != "")


def numbered_lines(items: str | Column) -> Column:
    """Lines ``1. x`` of an array of texts."""
    return F.array_join(F.transform(_col(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
