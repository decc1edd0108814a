"""Words of a text and their 64-bit keys, as numpy arrays over whole batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: A word is a maximal run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


#: Base of the polynomial that makes a word a number, and its inverse modulo 2^64.
_BASE = 0x9E6C63D0876A9A4B
_INVERSE = pow(_BASE, -1, 2**64)
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter or digit."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of the base modulo 2^64."""
    have = _tables.get(name, np.ones(1, np.uint64))
    while len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate((have, have * np.uint64(pow(base, len(have), 2**64))))
        _tables[name] = have
    return have


def word_keys(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and a 64-bit key of every word, text by text.

    Whole batches are done at once: a word is the polynomial of its code points modulo 2^64, read off running
    sums by one difference. Equal words have equal keys; different words have different ones but for
    chances of the order of 2^-64.
    """
    low = [t.lower() if t else "" for t in texts]
    code = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(len(low), np.int64), np.empty(0, np.uint64)
    edge = np.diff(_letters()[code].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _powers("base", _BASE, len(code))[: len(code)], out=run[1:])
        keys = mix((run[end] - run[start]) * _powers("inverse", _INVERSE, len(code))[start], 42)
    begin = np.cumsum([0, *(len(t) + 1 for t in low)])
    return np.diff(np.searchsorted(start, begin, "left")), keys


def chunks(texts: Iterable[str | None], size: int = 1_500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive texts in chunks of about ``size`` characters: (row numbers, words a row, word keys).

    A text longer than that is a chunk by itself, so texts are always whole.
    """
    rows: list[int] = []
    part: list[str | None] = []
    total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total and total + n > size:
            yield np.array(rows), *word_keys(part)
            rows, part, total = [], [], 0
        rows.append(i)
        part.append(text)
        total += n + 1
    if rows:
        yield np.array(rows), *word_keys(part)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of the key over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
