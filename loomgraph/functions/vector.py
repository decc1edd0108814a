"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where a vector is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def hashed_words(text: str | Column) -> Column:
    """A deterministic embedding for tests and offline runs: how many words of the text fall on each of the
    16 first hexadecimal digits of their MD5."""
    c = F.col(text) if isinstance(text, str) else text
    digits = F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.substring(F.md5(w), 1, 1))
    return F.transform(F.array(*[F.lit(h) for h in "0123456789abcdef"]), lambda h: F.size(F.filter(digits, lambda d: d == h)).cast("double"))


class HashedWords:
    """``hashed_words`` as an embedding model."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import re

        out = []
        for text in texts:
            first = [hashlib.md5(w.encode()).hexdigest()[0] for w in re.split(r"[\W_]+", text.lower()) if w]
            out.append([float(first.count(h)) for h in "0123456789abcdef"])
        return out
