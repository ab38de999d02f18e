"""Toxicity by a linear-chain conditional random field.

Learning, on a bounded sample (at most `per_class` toxic and OTHERS times as many other labelled documents and `letters` letters, by id
hash, never a held-out one; a text that doesn't fit is passed over, whole): words and word beginnings that toxic documents hold far oftener become cues; in toxic documents tokens with a cue are labelled 1, all
other tokens 0; from these labelled tokens the field's weights (cues, cues of the neighbours, transitions) are fitted by gradient
ascent on the conditional likelihood. A logistic curve from the marginals to the document's label is fitted last. One task of an executor
fits; the driver sees ids and sizes of the sample, and the model.

Scoring: forward-backward marginals of every token of every whole text; their sum and maximum give the score, runs of tokens over
one half give the offending offsets (code points). Labels, language, source and id are no input of a score. The model is small
(at most MAX_CUES cues) and broadcast.

Defined cases: null or wordless texts score as texts without any cue; null labels and labels without a document teach nothing; of
labels for one id the greatest counts, of texts for one id that of the greatest hash; without labels of both kinds every score is the share of
toxic labels (0 without labels).
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, small_batches

PER_CLASS, OTHERS, MAX_CUES = 1000, 3, 5000
#: Letters of the sample's texts at most, a third of them toxic; of those that the field itself is fitted on, as it has few weights beside the cues.
SAMPLE_LETTERS, FIELD_LETTERS = 24_000_000, 3_000_000
_TOKEN = re.compile(r"\w+")
_BEGINNINGS = (3, 4, 5, 6, 7, 8)
_MEMO = 200_000


def features_of(word: str) -> list[str]:
    w = word.lower()
    return [w, *(f"{w[:n]}*" for n in _BEGINNINGS if len(w) > n)]


@dataclass
class Field:
    """Two tags; potentials of tag 1 against tag 0 from the token's cues, and a transition matrix."""

    cues: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    around: np.ndarray = field(default_factory=lambda: np.zeros(2))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float | None = None


def scan(e: np.ndarray, starts: np.ndarray, t: np.ndarray, width: int = 256) -> np.ndarray:
    """Odds of tag 1 after each token of a pass over concatenated chains, exactly, in blocks side by side.

    e: exponentials of the token potentials; starts: where a chain begins; t: exponentials of the transitions.
    """
    n = len(e)
    blocks = -(-n // width)
    pad = blocks * width - n
    grid = lambda x, fill: np.concatenate([x, np.full(pad, fill)]).reshape(blocks, width).T.copy()
    e_, s_ = grid(e, 1.0), grid(starts.astype(float), 1.0)
    t00, t01, t10, t11 = (np.where(s_ > 0, 1.0, t[i, j]) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))
    a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for i in range(width):  # what a block does to the odds before it
        na, nb = t00[i] * a + t10[i] * c, t00[i] * b + t10[i] * d
        nc, nd = e_[i] * (t01[i] * a + t11[i] * c), e_[i] * (t01[i] * b + t11[i] * d)
        if i % 4 == 3:
            m = np.maximum(np.maximum(na, nb), np.maximum(nc, nd))
            na, nb, nc, nd = na / m, nb / m, nc / m, nd / m
        a, b, c, d = na, nb, nc, nd
    before, r = np.empty(blocks), 1.0
    for k in range(blocks):
        before[k] = r
        r = (c[k] + d[k] * r) / (a[k] + b[k] * r)
    out, r = np.empty((width, blocks)), before
    for i in range(width):
        r = e_[i] * (t01[i] + t11[i] * r) / (t00[i] + t10[i] * r)
        out[i] = r
    return out.T.reshape(-1)[:n]


def marginals(potential: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(tag 1) of each token, and the forward and backward odds."""
    starts, ends = np.zeros(len(potential), bool), np.zeros(len(potential), bool)
    end = np.cumsum(lengths[lengths > 0])
    ends[end - 1] = True
    starts[end - lengths[lengths > 0]] = True
    e, t = np.exp(potential), np.exp(transition)
    forward = scan(e, starts, t)
    backward = scan(e[::-1], ends[::-1], t.T)[::-1]
    odds = forward * backward / e
    return odds / (1 + odds), forward, backward


class Tagger:
    def __init__(self, model: Field):
        self.model, self.memo = model, {}
        self.patterns: dict[tuple[int, ...], int] = {(): 0}
        self.sums = [0.0]

    def pattern(self, word: str) -> int:
        p = self.memo.get(word)
        if p is None:
            own = tuple(sorted(self.model.cues[f] for f in features_of(word) if f in self.model.cues))
            p = self.patterns.setdefault(own, len(self.sums))
            if p == len(self.sums):
                self.sums.append(float(self.model.weights[list(own)].sum()))
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = p
        return p

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cue patterns of all tokens in a row, and the number of tokens of each text."""
        flat, lengths, get = [], [], self.memo.get
        for text in texts:
            words = _TOKEN.findall(text) if text else []
            lengths.append(len(words))
            flat += [p if (p := get(w)) is not None else self.pattern(w) for w in words]
        return np.array(flat, np.int64), np.array(lengths, np.int64)

    def potential(self, patterns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = self.model
        left, right = neighbours(patterns, lengths)
        return np.clip(m.bias + np.array(self.sums)[patterns] + m.around[0] * left + m.around[1] * right, -30, 30)

    def rate(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the spans of tokens over one half."""
        m, spans = self.model, [[] for _ in texts]
        if m.prior is None or not len(m.cues):
            return np.full(len(texts), m.prior or 0.0), spans
        patterns, lengths = self.encode(texts)
        total, top = np.zeros(len(texts)), np.zeros(len(texts))
        if len(patterns):
            p, _, _ = marginals(self.potential(patterns, lengths), lengths, m.transition)
            doc = np.repeat(np.arange(len(texts)), lengths)
            total = np.bincount(doc, weights=p, minlength=len(texts))
            np.maximum.at(top, doc, p)
            begin = np.cumsum(lengths) - lengths
            for i in np.nonzero(top >= 0.5)[0]:
                hot = p[begin[i] : begin[i] + lengths[i]] >= 0.5
                at = [w.span() for w in _TOKEN.finditer(texts[i])]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hot, [0]])))
                spans[i] = [(at[a][0], at[b - 1][1]) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return 1 / (1 + np.exp(-np.clip(signals(total, top) @ m.curve, -30, 30))), spans


def neighbours(patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the token before, and after, in the same text has a cue."""
    cue = (patterns > 0).astype(float)
    left, right = np.concatenate([[0.0], cue[:-1]]), np.concatenate([cue[1:], [0.0]])
    end = np.cumsum(lengths[lengths > 0])
    right[end - 1] = 0
    left[end - lengths[lengths > 0]] = 0
    return left, right


def signals(total: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(total), np.log1p(total), top], axis=1)


def find_cues(texts: list[str | None], toxic: np.ndarray) -> dict[str, int]:
    """Features whose share among toxic documents is above chance, by the likelihood ratio, for as many features as were tried."""
    in_toxic, elsewhere = Counter(), Counter()
    held = lambda text: {f for w in set(_TOKEN.findall(text or "")) for f in features_of(w)}
    for i in np.nonzero(toxic == 1)[0]:
        in_toxic.update(held(texts[i]))
    # Too few for any verdict: dropped before the other documents are counted, which keeps the tables small.
    share = float(np.mean(toxic == 1))
    least = max(2, int(3 / -np.log(share)))
    tried = {f: k for f, k in in_toxic.items() if k >= least}
    del in_toxic
    for i in np.nonzero(toxic == 0)[0]:
        elsewhere.update(held(texts[i]) & tried.keys())
    k, c = np.array(list(tried.values()), float), np.array([elsewhere[f] for f in tried], float)
    own = k / (k + c)
    ratio = k * np.log(own / share) + c * np.log(np.maximum(1 - own, 1e-12) / (1 - share))
    keep = (ratio >= np.log(max(1, len(tried))) + 4) & (own >= max(0.7, share + 0.85 * (1 - share)))
    found = sorted(((-r, f) for r, f, ok in zip(ratio, tried, keep, strict=True) if ok))[:MAX_CUES]
    return {f: i for i, (_, f) in enumerate(found)}


def within(sizes: list[int], toxic: np.ndarray, letters: int) -> np.ndarray:
    """Which texts, in order, come to no more than so many letters, a third of them toxic. One that doesn't fit is passed over; the shortest of each class stays."""
    keep = np.zeros(len(sizes), bool)
    for x, room in ((1, letters // 3), (0, letters - letters // 3)):
        own = np.nonzero(toxic == x)[0]
        for i in own:
            if sizes[i] <= room:
                keep[i], room = True, room - sizes[i]
        if len(own):
            keep[min(own, key=lambda i: sizes[i])] = True
    return np.nonzero(keep)[0]


def fit(texts: list[str | None], toxic: np.ndarray, prior: float | None, steps: int = 30) -> Field:
    """The field of labelled texts, which come in the order of preference."""
    model = Field(prior=prior)
    if prior is None or toxic.min(initial=1) == toxic.max(initial=0):
        return model
    model.cues = find_cues(texts, toxic)
    if not model.cues:
        return model
    model.weights = np.zeros(len(model.cues))
    keep = within([len(t or "") for t in texts], toxic, FIELD_LETTERS)
    texts, toxic = [texts[i] for i in keep], toxic[keep]
    tagger = Tagger(model)
    patterns, lengths = tagger.encode(texts)
    tagger.memo.clear()
    own = [list(k) for k in tagger.patterns]
    doc = np.repeat(np.arange(len(texts)), lengths)
    y = ((patterns > 0) & (toxic[doc] == 1)).astype(float)
    left, right = neighbours(patterns, lengths)
    inner = np.ones(len(patterns), bool)  # tokens with one before them in their text
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.nonzero(inner)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    k = len(model.weights)
    x = np.concatenate([model.weights, [model.bias], model.around, model.transition.ravel()])
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    scale = 1.0 / max(1.0, y.sum())
    for step in range(1, steps + 1):
        model.weights, model.bias, model.around, model.transition = x[:k], x[k], x[k + 1 : k + 3], x[k + 3 :].reshape(2, 2)
        tagger.sums = [float(model.weights[o].sum()) for o in own]
        potential = tagger.potential(patterns, lengths)
        p, forward, backward = marginals(potential, lengths, model.transition)
        rest = y - p
        by_pattern = np.bincount(patterns, weights=rest, minlength=len(own))
        g = np.zeros_like(x)
        for o, v in zip(own, by_pattern, strict=True):
            g[o] += v
        g[k], g[k + 1], g[k + 2] = rest.sum(), rest @ left, rest @ right
        t = np.exp(model.transition)
        r, b = forward[at - 1], backward[at]
        pair = np.stack([np.full(len(at), t[0, 0]), t[0, 1] * b, t[1, 0] * r, t[1, 1] * r * b])
        g[k + 3 :] = seen.ravel() - (pair / pair.sum(axis=0)).sum(axis=1)
        g = g * scale - 1e-3 * np.concatenate([x[:k], np.zeros(len(x) - k)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        x = x + 0.4 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model.weights, model.bias, model.around, model.transition = x[:k], float(x[k]), x[k + 1 : k + 3], x[k + 3 :].reshape(2, 2)
    tagger.sums = [float(model.weights[o].sum()) for o in own]
    p, _, _ = marginals(tagger.potential(patterns, lengths), lengths, model.transition)
    total, top = np.bincount(doc, weights=p, minlength=len(texts)), np.zeros(len(texts))
    np.maximum.at(top, doc, p)
    model.curve = _logistic(signals(total, top), toxic, prior)
    return model


def _logistic(z: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Weighted so that the sample's classes have their share among all labels."""
    share = y.mean()
    w = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    c = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(c))
        c = c + np.linalg.solve(h, z.T @ (w * (y - p)) - 1e-2 * c)
    return c


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fitted(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("order", "doc_id", "text", "toxic")), strict=True)), key=lambda r: r[:2])
        model = fit([r[2] for r in rows], np.array([r[3] for r in rows], np.int64), prior)
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, letters: int = SAMPLE_LETTERS) -> Field:
    """The sample's ids come from the labels alone; at most (1 + OTHERS) `per_class` of them are broadcast, and their texts written once."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Field()
    pick = lambda x: known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class if x else OTHERS * per_class)
    texts = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(pick(0).union(pick(1))), "doc_id").withColumns({"order": F.xxhash64("doc_id"), "row": F.monotonically_increasing_id()})
    sample = cut(sample)
    one = F.max(F.struct(F.xxhash64("text").alias("h"), "row", F.coalesce(F.length("text"), F.lit(0)).alias("n"))).alias("one")
    rows = sample.groupBy("order", "doc_id", "toxic").agg(one).orderBy("order", "doc_id").collect()
    keep = within([r["one"]["n"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), letters)
    sample = sample.where(F.col("row").isin([rows[i]["one"]["row"] for i in keep]))
    prior = shares.get(1, 0) / sum(shares.values())
    return pickle.loads(sample.repartition(1).mapInArrow(_fitted(prior), "model binary").first()["model"])


def score(docs: DataFrame, model: Field) -> DataFrame:
    """`docs` with score, predicted and toxic_spans (start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for texts in batches:
            scores, spans = tagger.rate(list(texts))
            yield pd.DataFrame({"score": scores, "spans": spans})

    plain = [c for c in docs.columns if c not in {"score", "predicted", "toxic_spans"}]
    rated = small_batches(docs).select(*plain).withColumn("_r", F.pandas_udf(run, "score double, spans array<struct<start: long, end: long>>")(F.col("text").cast("string")))
    return rated.select(*plain, F.col("_r.score").alias("score"), (F.col("_r.score") >= 0.5).cast("int").alias("predicted"), F.col("_r.spans").alias("toxic_spans"))
