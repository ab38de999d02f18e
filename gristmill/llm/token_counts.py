"""Token counts by the whole-token shortcut.

A byte-level BPE vocabulary is proved once, on the driver: a vocabulary string is *whole* if merging its bytes by rank
ends in that one token. A text is cut into pre-tokens by the tokenizer's pattern. A pre-token that is a whole string counts
one without any merge; only the other pre-tokens are merged, each distinct one once per Python worker while it stays in a
bounded memo. Nothing is shuffled.

Defined cases: a null or empty text has 0 bytes and 0 tokens. A special string inside a text is one token, as the tokenizer
library does by default, and cuts the text. Repeated rows and any other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import small_batches, text_or_empty

#: The pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: `\s` of the pattern means Unicode White_Space.
_SPACE = r"\p{White_Space}"
#: Distinct pre-tokens that a worker remembers before it starts afresh.
MEMO = 400_000


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Merger:
    """Merges by rank. `ranks` maps a pair of parts to the order in which it was learnt."""

    def __init__(self, ranks: dict[tuple[str, str], int], vocabulary: set[str], whole: frozenset[str] | None = None):
        self.ranks, self.vocabulary = ranks, vocabulary
        self.whole = whole

    def parts(self, word: str) -> list[str]:
        return self._short(word) if len(word) <= 48 else self._long(word)

    def _short(self, word: str) -> list[str]:
        parts, get, none = list(word), self.ranks.get, 1 << 60
        order = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while order and (best := min(order)) < none:
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(order):
                order[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def _long(self, word: str) -> list[str]:
        """The same by a heap over a linked list, for pre-tokens of any length."""
        part: list[str | None] = list(word)
        n, ranks = len(part), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if part[i] != a or (j := after[i]) >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p is not None]

    def proved(self) -> frozenset[str]:
        """The vocabulary strings that encode alone as one token."""
        return frozenset(w for w in self.vocabulary if len(w) == 1 or len(self.parts(w)) == 1)


def read_vocabulary(path: str) -> dict:
    """What a worker needs: merges, vocabulary, special strings and the proved whole strings (as plain texts where they are UTF-8)."""
    with open(path, "rb") as f:
        content = f.read()
    spec = json.loads(content)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merger = Merger({m: r for r, m in enumerate(merges)}, set(spec["model"]["vocab"]))
    back = {c: b for b, c in enumerate(byte_letters())}
    whole = set()
    for w in merger.proved():
        try:
            whole.add(bytes(back[c] for c in w).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    return {"name": hashlib.sha256(content).hexdigest(), "merges": merges, "whole": frozenset(whole), "special": [t["content"] for t in spec.get("added_tokens", [])]}


class Counting:
    """Counts the tokens of texts in one Python worker."""

    def __init__(self, vocabulary: dict):
        self.whole = vocabulary["whole"]
        self.merger = Merger({tuple(m): r for r, m in enumerate(vocabulary["merges"])}, set())
        self.pattern = regex.compile(PATTERN.replace(r"\s+", _SPACE + "+").replace(r"(?!\S)", f"(?!{_SPACE.replace('p{', 'P{')})").replace(r"[^\s", f"[^{_SPACE}"))
        self.special = sorted(vocabulary["special"], key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.letters, self.memo = dict(enumerate(byte_letters())), {}

    def rest(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.merger.parts(piece.encode("utf-8").decode("latin-1").translate(self.letters)))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(piece) <= 64:
                self.memo[piece] = n
        return n

    def of(self, text: str) -> int:
        n, pieces = 0, [text]
        if self.split is not None and any(s in text for s in self.special):
            pieces = self.split.split(text)
            n = len(pieces) - 1
        whole = self.whole
        for piece in pieces:
            for pre, times in Counter(self.pattern.findall(piece)).items():
                n += times if pre in whole else times * self.rest(pre)
        return n


#: By the hash of its file, the vocabulary that a reused worker has ready.
_here: dict[str, Counting] = {}


def count_tokens(df: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """`df` (with `text`) with n_bytes, n_tokens and over_limit; the other columns stay.

    The vocabulary is read on the driver and broadcast; its size is that of the file, whatever the data.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    key, shared = vocabulary["name"], df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counting = _here.get(key)
        if counting is None:
            _here.clear()
            counting = _here[key] = Counting(shared.value)
        for texts in batches:
            yield pd.Series([counting.of(t) if t else 0 for t in texts], dtype="int64")

    text = text_or_empty()
    out = small_batches(df).withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", tokens(text))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
