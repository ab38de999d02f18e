"""Benchmark decontamination by winnowing.

Words are hashed; a text's k-gram hashes are cut into windows of w and the least hash of each window is its fingerprint.
With k + w - 1 = the window length, two texts that share a whole window share its fingerprint. Fingerprints of test
items and of documents are joined on the hash; each hit is extended to the windows around it that hold the fingerprint, which are
compared as wholes, by 128 bits of their words' hashes. So runs of shared words of any length come out window by window, in time
linear in the text, however it repeats itself. An item with fewer words than a window is one window; it is looked up by its own length.

Where the items' windows come to TEST_BYTES at most (counted first) they are broadcast as arrays and the join is a search in them. Beyond,
a filter of fixed size picks the document windows whose fingerprint may be an item's, and these are joined with the items' windows by a
shuffle, in one pass over the documents whatever the size of the items. Windows that very many documents hold are salted.

Defined cases: a null or wordless document has 0 words and no hits; a null or wordless item hits nothing; a null
item_id is not listed; items with the same id count once; repeated documents are rated each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm import common
from gristmill.llm.common import FILTER_BITS, SALTS, bit_filter, cut, has_bit, join_left, small_batches

WINDOW, KGRAM = 10, 6
#: Bytes of the windows that are broadcast, and of one of them.
TEST_BYTES, ROW_BYTES = 16 << 20, 40
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: The same for the JVM, on a text with A to Z lowered.
WORD, _UPPER, _LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Hashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, and all bytes of a letter outside ASCII belong to words."""
    return _WORD.findall(text.encode("utf-8").lower()) if text else []


def hashed(words: list[bytes], memo: Hashes) -> np.ndarray:
    return np.fromiter((memo[w] for w in words), dtype=np.uint64, count=len(words))


def _multipliers(k: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(bytes([seed, i % 256, i // 256])) | 1 for i in range(k)], np.uint64)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k words in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = _multipliers(k, seed)
    with np.errstate(over="ignore"):
        g = h[:n] * odd[0]
        for i in range(1, k):
            g = g + h[i : i + n] * odd[i]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    return g


def winnow(h: np.ndarray, window: int = WINDOW, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: the least k-gram of each window (the first of equal ones)."""
    g = grams(h, k)
    w = window - k + 1
    if len(g) < w:
        return np.empty(0, np.int64), g[:0]
    at = np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1)
    at = np.unique(at)
    return at, g[at]


def around(h: np.ndarray, at: np.ndarray, fingerprints: np.ndarray, known: np.ndarray, window: int = WINDOW, k: int = KGRAM) -> np.ndarray:
    """First words of the windows that known fingerprints extend to: those that hold one and have no lesser k-gram."""
    w = window - k + 1
    j = np.unique((at[known][:, None] - np.arange(w)).ravel())
    j = j[(j >= 0) & (j <= len(h) - window)]
    if not len(j):
        return j
    g = grams(h, k)
    least = g[j]
    for i in range(1, w):
        least = np.minimum(least, g[j + i])
    return j[np.isin(least, fingerprints[known])]


def whole_hashes(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of `size` words that begins at one of the places (sorted, each once)."""
    if len(at) > len(h) // (2 * size):  # dense: all windows cost less than a copy of those asked for
        return grams(h, size, 1)[at], grams(h, size, 2)[at]
    own = h[at[:, None] + np.arange(size)].reshape(-1)
    return tuple(grams(own, size, seed)[::size] if len(own) else own for seed in (1, 2))


def _known(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are among sorted keys."""
    if not len(keys) or not len(hashes):
        return np.zeros(len(hashes), bool)
    i = np.searchsorted(keys, hashes)
    i[i == len(keys)] = 0
    return keys[i] == hashes


def _windows(window: int, k: int):
    """The distinct windows of items: size, 128 bits, fingerprint, item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = hashed(words_of(text), memo)
                if not len(h):
                    continue
                size = min(window, len(h))
                a, b = whole_hashes(h, np.arange(len(h) - size + 1), size)
                f = np.lib.stride_tricks.sliding_window_view(grams(h, k), window - k + 1).min(axis=1) if size == window else a
                rows = np.unique(np.stack([a, b, f], axis=1), axis=0).view(np.int64)
                n = len(rows)
                yield pa.record_batch({"size": np.full(n, size, np.int32), "a": rows[:, 0].copy(), "b": rows[:, 1].copy(), "f": rows[:, 2].copy(), "item": pa.array([item] * n, pa.string())})

    return run


class Tests:
    """The items' distinct windows as sorted arrays, each with its items."""

    def __init__(self, table: pa.Table, window: int = WINDOW, k: int = KGRAM):
        self.window, self.k = window, k
        size, (a, b, f) = table.column("size").to_numpy(), (table.column(c).to_numpy().view(np.uint64) for c in ("a", "b", "f"))
        self.ids, item = np.unique(np.array(["" if x is None else f"={x}" for x in table.column("item").to_pylist()], object), return_inverse=True)
        order = np.lexsort((item, b, a, size))
        size, a, b, item = size[order], a[order], b[order], item[order]
        new = np.ones(len(a), bool)
        new[1:] = (size[1:] != size[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b, self.item, self.begin = a[new], b[new], item, np.append(np.flatnonzero(new), len(a))
        self.prints, size = np.unique(f[table.column("size").to_numpy() == window]), size[new]
        self.parts = {int(s): (int(np.searchsorted(size, s)), int(np.searchsorted(size, s, side="right"))) for s in np.unique(size)}

    def match(self, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which window each is, or -1."""
        low, high = self.parts[size]
        at, out = low + np.searchsorted(self.a[low:high], a), np.full(len(a), -1)
        while len(left := np.flatnonzero((out < 0) & (at < high))) and (same := self.a[at[left]] == a[left]).any():
            left = left[same]
            hit = left[self.b[at[left]] == b[left]]
            out[hit] = at[hit]
            at[left] += 1  # windows of one `a` lie together, by `b`
        return out

    def hits(self, h: np.ndarray) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Of a document's word hashes: how many are hit, their ranges, and the items."""
        change, found = np.zeros(len(h) + 1, np.int64), [np.empty(0, np.int64)]
        for size, j in candidates(h, self.prints, self.parts, self.window, self.k):
            which = self.match(size, *whole_hashes(h, j, size))
            np.add.at(change, j[which >= 0], 1)
            np.add.at(change, j[which >= 0] + size, -1)
            found += [self.item[self.begin[i] : self.begin[i + 1]] for i in np.unique(which[which >= 0])]
        n, ranges = marked(np.cumsum(change[:-1]) > 0)
        return n, ranges, sorted(x[1:] for x in self.ids[np.unique(np.concatenate(found))] if x)


def candidates(h: np.ndarray, prints: np.ndarray, sizes: Iterable[int], window: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """By size, the first words of the windows that may be an item's."""
    for size in sizes:
        if size == window:
            at, fingerprints = winnow(h, window, k)
            known = _known(prints, fingerprints)
            if known.any():
                yield size, around(h, at, fingerprints, known, window, k)
        elif len(h) >= size:
            yield size, np.arange(len(h) - size + 1)


def marked(hit: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """How many are true, and the ranges of them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return int(hit.sum()), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
_RATED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_ranges", _SPANS)])


def _by_arrays(docs: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Tests(windows.toArrow(), window, k))

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tests, memo = shared.value, Hashes()
        for texts in batches:
            rows = []
            for text in texts:
                h = hashed(words_of(text), memo)
                n, ranges, items = tests.hits(h) if len(h) else (0, [], [])
                rows.append((len(h), n, items, ranges))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "hit_ranges"])

    return docs.withColumn("_0", F.pandas_udf(rate, _RATED)(F.col("text").cast("string")))


def _places(shared, sizes: list[int], window: int, k: int):
    """size, 128 bits and first word of the windows of a text that the filter takes for an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, memo = shared.value, Hashes()
        for batch in batches:
            for t1, t2, text in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text")), strict=True):
                h = hashed(words_of(text), memo)
                for size in sizes:
                    if size == window:
                        at, fingerprints = winnow(h, window, k)
                        known = has_bit(bits, _slots(fingerprints))
                        j = around(h, at, fingerprints, known, window, k)
                        a, b = whole_hashes(h, j, size)
                    else:
                        j = np.arange(max(0, len(h) - size + 1))
                        a, b = whole_hashes(h, j, size)
                        known = has_bit(bits, _slots(a))
                        j, a, b = j[known], a[known], b[known]
                    if n := len(j):
                        yield pa.record_batch({"t1": np.full(n, t1, np.int64), "t2": np.full(n, t2, np.int64), "size": np.full(n, size, np.int32), "a": a.view(np.int64), "b": b.view(np.int64), "p": j.astype(np.int64)})

    return run


def _slots(f: np.ndarray) -> np.ndarray:
    return (f % np.uint64(FILTER_BITS)).astype(np.int64)


def _by_joins(docs: DataFrame, windows: DataFrame, sizes: list[int], window: int, k: int) -> DataFrame:
    """The same for items of any size. Equal texts, named by 128 bits, are rated together."""
    text = F.col("text").cast("string")
    names = [F.xxhash64(F.lit(i), text).alias(f"t{i}") for i in (1, 2)]
    slot = F.pmod(F.col("f"), F.lit(FILTER_BITS)).cast("int")  # FILTER_BITS is a power of two, so signs don't matter
    shared = bit_filter(windows.select(slot.alias("slot")))
    texts = docs.select(*names, text.alias("text")).where("text IS NOT NULL")
    places = cut(texts.mapInArrow(_places(shared, sizes, window, k), "t1 long, t2 long, size int, a long, b long, p long").distinct())
    key = ["size", "a", "b"]
    hot = F.broadcast(cut(places.groupBy(*key).count().where(F.col("count") > common.HOT_ROWS).select(*key)))
    salted = windows.select(*key, "item").join(hot, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    more = places.join(hot, key).withColumn("salt", F.pmod(F.xxhash64("t1", "t2"), F.lit(SALTS)).cast("int"))
    hits = places.join(windows.select(*key, "item").join(hot, key, "left_anti"), key).select("t1", "t2", "size", "p", "item")
    hits = cut(hits.union(more.join(salted, [*key, "salt"]).select("t1", "t2", "size", "p", "item")))
    ends = hits.select("t1", "t2", F.col("p").alias("begin"), (F.col("p") + F.col("size")).alias("end")).distinct()
    items = hits.where("item IS NOT NULL").select("t1", "t2", "item").distinct().groupBy("t1", "t2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    merged = """aggregate(spans, cast(array() as array<struct<begin: bigint, end: bigint>>), (a, x) -> if(size(a) > 0 and x.begin <= element_at(a, -1).end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"""
    ranges = ends.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans")).select("t1", "t2", F.expr(merged).alias("hit_ranges"))
    rated = ranges.join(items, ["t1", "t2"], "left")
    n_words = F.coalesce(F.regexp_count(F.translate(text, _UPPER, _LOWER), F.lit(WORD)), F.lit(0)).cast("long")
    n_hit = F.coalesce(F.expr("aggregate(hit_ranges, 0L, (a, x) -> a + x.end - x.begin)"), F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    found = F.struct(F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("hit_ranges", F.array().cast(_SPANS)).alias("hit_ranges"))
    rows = docs.select(F.struct("*").alias("_row"), *names, n_words.alias("_n"))
    return join_left(rows, rated, ["t1", "t2"]).select("_row.*", found.alias("_0"))


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW, k: int = KGRAM, test_bytes: int = TEST_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, items (sorted ids, as strings), hit_ranges (word offsets) and contaminated. tests: item_id, text."""
    items = small_batches(tests).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    windows = cut(items.mapInArrow(_windows(window, k), "size int, a long, b long, f long, item string").distinct())
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plain = [c for c in docs.columns if c not in {"n_words", "n_hit", "items", "hit_ranges", "contaminated"}]
    docs = docs.select(*[F.col(f"`{c}`") for c in plain])
    small = ROW_BYTES * sum(sizes.values()) <= test_bytes
    out = _by_arrays(docs, windows, window, k) if small else _by_joins(docs, windows, sorted(sizes), window, k)
    out = out.select(*[F.col(f"`{c}`") for c in plain], "_0.n_words", "_0.n_hit", "_0.items", "_0.hit_ranges")
    return out.withColumn("contaminated", F.col("n_hit") > 0)
