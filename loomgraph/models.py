"""Model calls behind small interfaces, with deterministic implementations for tests and offline runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


class TextModel(Protocol):
    """Turns prompts into replies; a failed prompt gives None."""

    def generate(self, prompts: list[str]) -> list[str | None]: ...


class EmbeddingModel(Protocol):
    """Turns texts into vectors of one length."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


EXTRACTED = (
    "propositions array<struct<id:int,text:string,sentence_index:int,entities:array<struct<text:string,type:string,custom_type:string,reason:string>>>>,"
    " relations array<struct<source:int,target:int,relation:string,direction:string,reason:string>>"
)


def complete(rows: DataFrame, prompt: str, model: Callable[[], TextModel], retries: int = 1, valid: Callable[[str], bool] | None = None) -> DataFrame:
    """``rows`` with reply and ok: one batched call per Arrow batch and one per retry of what failed.

    ``model`` builds the client on the worker, once per task.
    """
    schema = StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("ok", BooleanType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        good = valid or (lambda reply: bool(reply))
        for batch in batches:
            replies: list[str | None] = [None] * len(batch)
            open_rows = list(range(len(batch)))
            for _ in range(retries + 1):
                if not open_rows:
                    break
                for i, reply in zip(open_rows, client.generate([batch[prompt].iloc[i] for i in open_rows]), strict=True):
                    if reply is not None and good(reply):
                        replies[i] = reply
                open_rows = [i for i in open_rows if replies[i] is None]
            yield batch.assign(reply=replies, ok=[r is not None for r in replies])

    return rows.mapInPandas(call, schema)


def embed_distinct(texts: DataFrame, column: str, model: Callable[[], EmbeddingModel]) -> DataFrame:
    """(text, vec): every distinct text embedded once."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            yield batch.assign(vec=client.embed(batch[column].tolist()))

    distinct = texts.select(column).filter(F.col(column).isNotNull() & (F.trim(column) != "")).distinct()
    return distinct.mapInPandas(call, f"{column} string, vec array<double>")


def flatten_extraction(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Propositions, entities and relations of (doc_id, reply) rows; replies that do not parse give none."""
    from .functions.replies import json_text
    from .functions.text import direction

    parsed = replies.select("doc_id", F.from_json(json_text("reply", "propositions"), "struct<" + EXTRACTED.replace("propositions array", "propositions:array").replace(" relations array", "relations:array") + ">").alias("j"))
    props = parsed.select("doc_id", F.explode("j.propositions").alias("p"))
    relations = parsed.select("doc_id", F.inline("j.relations")).withColumn("direction", direction("direction"))
    entities = props.select("doc_id", F.col("p.id").alias("prop_idx"), F.inline("p.entities"))
    return props.select("doc_id", F.col("p.id").alias("prop_idx"), F.col("p.sentence_index").alias("sent_idx"), F.col("p.text").alias("text")), entities, relations


def rule_verdict(similarity: Column, link: float = 0.95, detail: float = 0.9) -> Column:
    """The deterministic judge: a link type by similarity alone."""
    return F.when(similarity >= link, "SIMILARITY").when(similarity >= detail, "DETAIL").otherwise("NONE")


class SentenceExtractor:
    """A deterministic extractor: one proposition a line of the prompt, capitalised runs as entities."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        import re

        out: list[str | None] = []
        for prompt in prompts:
            props = []
            for i, line in enumerate(x for x in prompt.split("\n") if x.strip()):
                text = re.sub(r"^\[\d+\]\s*", "", line).strip()
                names = dict.fromkeys(re.findall(r"[A-Z]\w+(?: [A-Z]\w+)+", text))
                props.append({"id": i, "text": text, "sentence_index": i, "entities": [{"text": n, "type": "MISC"} for n in names]})
            relations = [{"source": i, "target": i + 1, "relation": "SEQUENCE", "direction": "forward"} for i in range(len(props) - 1)]
            out.append(json.dumps({"propositions": props, "relations": relations}))
        return out


class LineExtractor:
    """A deterministic extractor: one proposition a line with text, no reply for a prompt without any."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        lines = [[x for x in prompt.split("\n") if x.strip(" ")] for prompt in prompts]
        return [json.dumps({"propositions": [{"id": i, "text": x, "sentence_index": i, "entities": []} for i, x in enumerate(xs)]}) if xs else None for xs in lines]


class NameFuser:
    """A deterministic judge of groups: members of a prompt's lines ``1. id | text | type`` with one lower-case text fuse."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for prompt in prompts:
            sets: dict[str, list[str]] = {}
            for line in prompt.split("\n"):
                place, _, rest = line.partition(". ")
                if place.isdigit() and rest.count(" | ") >= 2:
                    node, text = rest.split(" | ")[0], " | ".join(rest.split(" | ")[1:-1])
                    sets.setdefault(text.strip(" ").lower(), []).append(node)
            out.append("The sets are: " + json.dumps({"fused_entities": [{"original_ids": ids} for ids in sets.values() if len(ids) > 1]}))
        return out


def extract_documents(documents: DataFrame, model: Callable[[], TextModel], retries: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Propositions, entities and relations of documents (doc_id, content), and (doc_id, ok): one call a document, in batches.

    A document whose reply has no propositions is asked again, and is not ok if that gives none either.
    """
    prompts = documents.select("doc_id", F.col("content").alias("prompt"))
    replies = complete(prompts, "prompt", model, retries, lambda reply: '"propositions"' in reply)
    return *flatten_extraction(replies.filter("ok").select("doc_id", "reply")), replies.select("doc_id", "ok")
