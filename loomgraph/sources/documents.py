"""Corpus and question files as DataFrames with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.ArrayType(T.StringType()))])
QUESTION = "question string, answer string, id string, supporting_facts array<array<string>>"
# Data-set names looked for in a path, and the prefix of their document ids.
PREFIXES = {"hotpot": "hotpot", "2wiki": "2wiki", "musique": "musique"}


def dataset_prefix(path: str, default: str = "hotpot") -> str:
    """The document-id prefix of the data set a path names; ``default`` where it names none."""
    low = path.lower()
    return next((p for name, p in PREFIXES.items() if name in low), default)


def _existing(path: str) -> str:
    """The path, or the same file in a ``raw_dataset`` folder beside it where only that exists."""
    if os.path.exists(path) or "://" in path:
        return path
    other = os.path.join(os.path.dirname(path), "raw_dataset", os.path.basename(path))
    return other if os.path.exists(other) else path


def load_documents(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """(doc_id, title, content) of a JSON array of articles; the id is the prefix and the place in the array.

    One file is one array, so its place numbers need the file as a whole; larger corpora come as JSON lines.
    """
    prefix = prefix or dataset_prefix(path)
    raw = spark.read.text(_existing(path), wholetext=True)
    rows = raw.select(F.posexplode(F.from_json("value", T.ArrayType(DOCUMENT))).alias("pos", "d"))
    return rows.select(F.concat(F.lit(f"{prefix}_"), F.col("pos").cast("string")).alias("doc_id"), F.coalesce("d.title", F.lit("")).alias("title"), F.coalesce("d.content", F.array().cast("array<string>")).alias("content"))


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, content) of JSON lines; blank lines are skipped, rows without an id get a hash of theirs."""
    raw = spark.read.schema(DOCUMENT).json(path)
    made = F.concat(F.lit("doc_"), F.hex(F.xxhash64("title", "content")))
    return raw.filter("title IS NOT NULL OR content IS NOT NULL").select(F.coalesce("doc_id", made).alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.array().cast("array<string>")).alias("content"))


def load_titles(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title) of documents with a title; unknown data sets have the prefix ``doc`` here."""
    return load_documents(spark, path, dataset_prefix(path, "doc")).filter("title <> ''").select("doc_id", "title")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, golds, facts) of a JSON array of questions; blank questions are skipped.

    An answer is a text or a list of texts; facts are the titles of well-formed supporting facts.
    """
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("pos", "j"))
    field = lambda f: F.get_json_object("j", f"$.{f}")
    answer = field("answer")
    golds = F.when(answer.startswith("["), F.from_json(answer, "array<string>")).when(answer.isNotNull(), F.array(answer)).otherwise(F.array().cast("array<string>"))
    facts = F.transform(F.filter(F.from_json(field("supporting_facts"), "array<array<string>>"), lambda x: F.size(x) >= 1), lambda x: x[0])
    out = rows.select(F.coalesce(field("id"), F.col("pos").cast("string")).alias("question_id"), field("question").alias("question"), golds.alias("golds"), F.coalesce(facts, F.array().cast("array<string>")).alias("facts"))
    return out.filter("trim(coalesce(question, '')) <> ''")


def find_dataset_file(folder: str, names: tuple[str, ...] = ("filtered_docs.json", "docs.json")) -> str:
    """The first of the files that exists, the filtered one before the full one."""
    for name in names:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def load_index(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A stored vector table; vectors of another length raise when the table is read."""
    df = spark.read.parquet(path)
    return df.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit(f"vector length is not {dim}: "), F.size("vec").cast("string")))))


def index_dim(spark: SparkSession, path: str) -> int:
    """The length of the vectors of a stored index, as written beside it."""
    return spark.read.json(f"{path}.meta").first()["dim"]


def load_checked_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index with the length that its own record names."""
    return load_index(spark, path, index_dim(spark, path))


def load_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All vector tables of a store by name; the name is a partition, so one table's files are read for one name."""
    store = spark.read.parquet(path)
    names = [r["index_name"] for r in store.select("index_name").distinct().collect()]
    return {str(n): store.filter(F.col("index_name") == n).drop("index_name") for n in sorted(map(str, names))}


class Artefacts(dict):
    """Stored artefacts by name, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> None:
        super().__init__()
        self.spark, self.path = spark, path
        for name in required:  # hard requirements fail at once
            self[name]

    def __missing__(self, name: str) -> DataFrame:
        table = self[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return table


def load_artefacts(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> Artefacts:
    """The tables of ``sinks.persist_artefacts``: adjacency, mappings, metadata, lookups, statistics and indexes."""
    return Artefacts(spark, path, required)


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A stored table; where there is none, or only the beginning of one, it is computed, stored and read back."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
