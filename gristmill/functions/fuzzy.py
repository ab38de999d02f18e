"""Fuzzy contains: every word of the needle is near to some word of the text."""

from __future__ import annotations

from functools import reduce
from typing import Any

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"[^a-z0-9\p{L}]+"


def max_distance(length: int, config: Any = True) -> int:
    """Edits allowed for a word: by length, or by the tighter of maxDistance and maxRatio."""
    own = config if isinstance(config, dict) else {}
    caps = [int(own["maxDistance"])] if own.get("maxDistance") is not None else []
    if own.get("maxRatio") is not None:
        caps.append(int(own["maxRatio"] * length))
    if caps:
        return min(caps)
    return 0 if length <= 3 else 1 if length <= 6 else 2


def words(text: str) -> list[str]:
    return [w for w in regex.split(_SPLIT, text.lower()) if w]


def fuzzy_contains(column: Column, needle: str, config: Any = True) -> Column:
    """A blank needle is in any text; a needle that stands in the text as it is needs no words."""
    if not needle.strip():
        return column.isNotNull()
    low, wanted = F.lower(column), words(needle)
    exact = F.contains(low, F.lit(needle.strip().lower()))
    if not wanted:
        return exact
    own = F.filter(F.split(low, _SPLIT), lambda w: w != "")

    def near(word: str) -> Column:
        most = 0 if regex.fullmatch("[0-9]+", word) else max_distance(len(word), config)
        if most == 0:
            return F.array_contains(own, word)
        return F.exists(own, lambda w: (F.abs(F.length(w) - len(word)) <= most) & (F.levenshtein(w, F.lit(word), most) >= 0) | (w == word))

    return F.when(exact, F.lit(True)).otherwise(reduce(Column.__and__, map(near, wanted)))
