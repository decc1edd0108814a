"""What models reply, made into values: JSON inside prose, short answers, verdicts; and the texts they are asked with."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, clean_short_answer, direction

_FENCES = (re.compile(r"```json\s*(.*?)\s*```", re.DOTALL), re.compile(r"```\s*(.*?)\s*```", re.DOTALL))


def balanced_objects(text: str) -> Iterator[str]:
    """The outermost runs from a brace to the one that closes it; a closing brace without partner is passed over."""
    opened: list[int] = []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            start = opened.pop()
            if not opened:
                yield text[start : m.end()]


def _has(body: str, field: str) -> bool:
    try:
        value = json.loads(body)
    except ValueError:
        return False
    return isinstance(value, dict) and field in value


def json_of(reply: str | None, field: str | None = None) -> str | None:
    """The JSON text of a reply: what a fence holds, else the first balanced object that has the field, else the
    first balanced object, else all from the first to the last brace, else the reply itself."""
    if reply is None:
        return None
    for fence in _FENCES:
        if m := fence.search(reply):
            return m.group(1).strip()
    found = list(balanced_objects(reply))
    wanted = [b for b in found if field is not None and _has(b, field)] or found
    if wanted:
        return wanted[0]
    first, last = reply.find("{"), reply.rfind("}")
    return reply[first : last + 1] if 0 <= first < last else reply


def json_text(c: str | Column, field: str | None = None) -> Column:
    """``json_of`` over a column. Braces need counting, which no built-in expression does; batches go through Arrow."""
    find = F.pandas_udf(lambda s: pd.Series([json_of(x, field) for x in s], dtype=object), "string")
    return find(c)


def reply_field(c: str | Column, field: str) -> Column:
    """A field of the JSON of a reply as text, null where there is none."""
    return F.get_json_object(json_text(c, field), f"$.{field}")


def reply_answer(reply: Column, natural: Column | None = None) -> Column:
    """The short answer of a reply: what follows ``Answer:``, else its last line with text, else the natural answer."""
    named = F.nullif(F.regexp_extract(F.trim(reply), r"(?is)\bAnswer\s*:\s*(.+?)\s*$", 1), F.lit(""))
    lines = F.filter(F.split(reply, r"[\r\n]+"), lambda x: F.trim(x) != "")
    short = F.nullif(clean_short_answer(F.coalesce(named, F.try_element_at(lines, F.lit(-1)))), F.lit(""))
    return F.coalesce(short, clean_short_answer(natural) if natural is not None else F.lit(""))


def fallback_answer(reply: Column) -> Column:
    """(answer, confidence) of a reply that is no JSON: the line behind the word answer, else the whole reply."""
    line = F.nullif(F.regexp_extract(reply, r"(?i)answer[\"\s:]+([^\n]+)", 1), F.lit(""))
    bare = lambda t: F.regexp_replace(t, f"^[{BLANK}]+|[{BLANK}]+$", "")
    return F.struct(F.coalesce(bare(line), bare(reply)).alias("answer"), F.when(line.isNotNull(), 0.5).otherwise(0.3).alias("confidence"))


def link_decision(reply: Column) -> Column:
    """(should_link, relation_type, direction, confidence, reason) of a verdict; what does not parse links nothing.

    The verdict is fenced JSON, or the beginning of an object whose first key is the relation.
    """
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    begun = F.nullif(F.regexp_extract(reply, r"(\{\s*\"relation\"\s*:\s*\"[^\"]+\")", 1), F.lit(""))
    v = F.from_json(F.coalesce(fenced, F.concat(begun, F.lit("}"))), "relation string, direction string, confidence double, reason string", {"mode": "PERMISSIVE"})
    parsed = F.get_json_object(F.coalesce(fenced, F.concat(begun, F.lit("}"))), "$").isNotNull()
    yes = parsed & (F.coalesce(v["relation"], F.lit("NO_RELATION")) != "NO_RELATION")
    return F.struct(
        F.coalesce(yes, F.lit(False)).alias("should_link"),
        F.when(yes, v["relation"]).alias("relation_type"),
        direction(F.coalesce(v["direction"], F.lit("1->2"))).alias("direction"),
        F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(parsed, F.coalesce(v["reason"], F.lit(""))).otherwise("Parse failed").alias("reason"),
    )


def judge_prompt(question: Column, gold: Column, predicted: Column) -> Column:
    """What a judge of answers is asked."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.format_string("Question: %s\n\nGold answer: %s\n\nPredicted answer: %s\n\nIs the predicted answer right? Reply with right or wrong only.", text(question), text(gold), text(predicted))


def judged_right(reply: Column) -> Column:
    """1 for a reply that says right, else 0; a failed call counts as wrong."""
    return F.when(F.lower(F.coalesce(reply, F.lit(""))).rlike(r"\bright\b"), 1).otherwise(0)


def gap_context(gap: Column, status: Column, attempts: Column, documents: Column, hints: Column | None = None) -> Column:
    """A gap's state as lines for a prompt."""
    lines = [F.concat(F.lit("- gap: "), gap), F.concat(F.lit("  status: "), status), F.concat(F.lit("  attempts: "), attempts.cast("string")), F.when(documents > 0, F.concat(F.lit("  documents: "), documents.cast("string")))]
    if hints is not None:
        lines.append(F.when(F.size(hints) > 0, F.concat(F.lit("  hints: "), F.array_join(hints, "; "))))
    return F.concat_ws("\n", *lines)


def entity_line(place: Column, node: Column, text: Column, kind: Column) -> Column:
    """One member of a group in a fusion prompt."""
    return F.concat(place.cast("string"), F.lit(". "), node, F.lit(" | "), F.coalesce(text, F.lit("")), F.lit(" | "), F.coalesce(kind, F.lit("")))
