"""Exact top-k inner-product search by norm buckets.

Vectors fall into buckets by length (powers of STEP); a bucket is cut by hash into blocks of bounded size, packed as one row each.
Queries are packed the same way. The longest block of all gives every query a first threshold: its k-th best score there. A query block
then meets a candidate block only if some query's length times the bucket's greatest length can reach that query's threshold.
In such a pair each query has the local cosine threshold theta / (|q| * longest): above COORDINATE_AT the candidates are pruned by
the feasible range of the query's strongest coordinates, else by length; what is left is verified by exact integer products.
Each pair reports at most k candidates a query; a window keeps the k best. A task gets a candidate block's bytes once for a bounded
number of query blocks.

Defined cases: a vector that is null or has null or non-finite components, or a null id, takes no part; rows that share an id are queries
and candidates each, and of each other; only vectors of equal dimension are compared; zero vectors score 0; fewer than k candidates give all. Scores that
may not fit a double's integers are computed with unbounded integers and held to the range of long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, small_batches

K, SCALE = 5, 256
STEP = 1.1
CANDIDATES, QUERIES = 4096, 512
COORDINATE_AT, COORDINATES = 0.6, 3
SPREAD = 16
#: Query blocks that a task holds beside one candidate block, about.
TOGETHER = 16
_LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v (array of integral doubles), dim, norm and band, of the vectors that take part. To be written before use: it numbers the rows."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("dim", F.size("v")).withColumn("norm", norm)
    return rows.withColumn("band", F.when(F.col("norm") > 0, F.floor(F.log("norm") / np.log(STEP))).otherwise(F.lit(-10000)).cast("int"))


def _pack(table: pa.Table) -> pa.Table:
    """Rows of one block, longest first, as bytes."""
    ids, row, v = table.column("vec_id").to_numpy(), table.column("row").to_numpy(), table.column("v").combine_chunks()
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    norms = np.sqrt((m * m).sum(axis=1))
    order = np.lexsort((row, ids, -norms))
    first = {c: table.column(c)[0].as_py() for c in ("dim", "band", "salt")}
    return pa.table({"dim": pa.array([first["dim"]], pa.int32()), "band": pa.array([first["band"]], pa.int32()), "salt": pa.array([first["salt"]], pa.int64()), "ids": pa.array([ids[order].astype(np.int64).tobytes()]), "rows": pa.array([row[order].astype(np.int64).tobytes()]), "m": pa.array([np.ascontiguousarray(m[order]).tobytes()]), "longest": pa.array([float(norms.max())])})


def packed(rows: DataFrame, most: int, by_band: bool) -> DataFrame:
    """One row per block of at most about `most` vectors. Counts by dimension and band set the number of blocks."""
    rows = rows if by_band else rows.withColumn("band", F.lit(0))
    counts = rows.groupBy("dim", "band").agg(F.ceil(F.count("*") * 1.1 / most).alias("blocks"))
    rows = rows.join(counts, ["dim", "band"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("blocks")))
    return rows.groupBy("dim", "band", "salt").applyInArrow(_pack, "dim int, band int, salt long, ids binary, rows binary, m binary, longest double")


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    if len(q) and len(m) and np.abs(q).max() * np.abs(m).max() * q.shape[1] < 2.0**53:
        return (q @ m.T).astype(np.int64)
    if not len(q) or not len(m):
        return np.zeros((len(q), len(m)), np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in m], object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id, then to the smaller row."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= edge)[0]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rows[at], ids[at], -scores[at]))][:k]


def search_block(q_ids: np.ndarray, q_rows: np.ndarray, q: np.ndarray, theta: np.ndarray, ids: np.ndarray, rows: np.ndarray, m: np.ndarray, k: int) -> list[tuple[int, int, int, int, int]]:
    """(query's row, query, candidate's row, candidate, score): what can be among the k best of each query, of a block sorted by length."""
    lengths, q_lengths, out = np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1)), []
    slack = 1 - 1e-9
    directions = m / np.where(lengths > 0, lengths, 1)[:, None]
    whole, pruned = [], []
    for i in range(len(q)):
        reach = q_lengths[i] * lengths[0]
        if theta[i] > 0 and reach * (1 + 1e-9) < theta[i]:
            continue
        local = theta[i] / reach * slack if reach > 0 and theta[i] > 0 else 0.0
        (pruned if local >= COORDINATE_AT else whole).append((i, local))

    def report(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= theta[i]) & (rows[at] != q_rows[i])
        at, scores = at[keep], scores[keep]
        out.extend((int(q_rows[i]), int(q_ids[i]), int(rows[at[j]]), int(ids[at[j]]), int(scores[j])) for j in best_of(scores, ids[at], rows[at], k))

    if whole:  # by length: together, up to the least length that the easiest of them needs
        index = np.array([i for i, _ in whole])
        need = np.where(q_lengths[index] > 0, theta[index] / np.where(q_lengths[index] > 0, q_lengths[index], 1) * slack, -np.inf)
        upto = int(np.searchsorted(-lengths, -need.min(), side="right")) if need.min() > 0 else len(m)
        scores = _products(q[index], m[:upto])
        for row, i in enumerate(index):
            report(int(i), np.arange(upto), scores[row])
    for i, local in pruned:
        unit, keep = q[i] / q_lengths[i], np.ones(len(m), bool)
        room = np.sqrt(max(0.0, 1 - local * local))
        for f in np.argsort(-np.abs(unit))[:COORDINATES]:
            side = room * np.sqrt(max(0.0, 1 - unit[f] ** 2)) + 1e-9
            low = unit[f] * local - side if unit[f] > 0 else -1.0
            high = unit[f] * local + side if unit[f] < 0 else 1.0
            keep &= (directions[:, f] >= low) & (directions[:, f] <= high)
        at = np.nonzero(keep)[0]
        report(i, at, _products(q[i : i + 1], m[at])[0])
    return out


def _matrix(block: bytes, ids: np.ndarray) -> np.ndarray:
    return np.frombuffer(block, np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))


_FOUND = ("query_row", "query_id", "row", "vec_id", "score")


def _search(k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        """The query blocks that meet one candidate block; of equal blocks on either side the first counts."""
        found: list[tuple] = []
        if block.num_rows:
            ids, rows = (np.frombuffer(block.column(c)[0].as_py(), np.int64) for c in ("ids", "rows"))
            m = _matrix(block.column("m")[0].as_py(), ids)
            for i in range(queries.num_rows):
                r = {c: queries.column(c)[i].as_py() for c in ("q_ids", "q_rows", "q_m", "theta")}
                q_ids, q_rows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64)
                found += search_block(q_ids, q_rows, _matrix(r["q_m"], q_ids), np.frombuffer(r["theta"], np.float64), ids, rows, m, k)
        return pa.table({n: np.array([x[j] for x in found], np.int64) for j, n in enumerate(_FOUND)})

    return run


def _seeded(seeds: dict[int, tuple[bytes, bytes]], k: int):
    """Each query's first threshold, and the block's least length quotient, by which buckets are ruled out."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                q_rows = np.frombuffer(r["rows"], np.int64)
                q, theta = _matrix(r["m"], q_rows), np.full(len(q_rows), -np.inf)
                if r["dim"] in seeds:
                    rows_ = np.frombuffer(seeds[r["dim"]][0], np.int64)
                    scores = _products(q, _matrix(seeds[r["dim"]][1], rows_))
                    for i in range(len(q)):
                        own = scores[i][rows_ != q_rows[i]]
                        if len(own) >= k:
                            theta[i] = float(np.partition(own, len(own) - k)[len(own) - k])
                lengths = np.sqrt((q * q).sum(axis=1))
                needs = np.where(theta <= 0, 0.0, theta / np.where(lengths > 0, lengths, 1e-300))
                rows.append({"dim": r["dim"], "q_ids": r["ids"], "q_rows": r["rows"], "q_m": r["m"], "theta": theta.tobytes(), "needs": float(needs.min()) * (1 - 1e-9)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dim", pa.int32()), ("q_ids", pa.binary()), ("q_rows", pa.binary()), ("q_m", pa.binary()), ("theta", pa.binary()), ("needs", pa.float64())]))

    return run


def top_k(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows that `queries` (SQL on vec_id) selects, against all rows."""
    rows = cut(scaled(small_batches(vectors), scale))
    blocks = cut(packed(rows, CANDIDATES, True))
    asked = packed(rows.where(queries), QUERIES, False)
    # One block for each dimension, each of at most about CANDIDATES vectors.
    longest = blocks.groupBy("dim").agg(F.max_by(F.struct("band", "salt"), F.struct("longest", "salt")).alias("at")).select("dim", "at.band", "at.salt")
    seeds = {r["dim"]: (bytes(r["rows"]), bytes(r["m"])) for r in blocks.join(longest, ["dim", "band", "salt"]).orderBy("dim").limit(16).toLocalIterator()}
    asked = asked.mapInArrow(_seeded(seeds, k), "dim int, q_ids binary, q_rows binary, q_m binary, theta binary, needs double")
    asked = cut(asked.withColumn("q_block", F.xxhash64("q_rows")))
    # Which blocks meet is settled on rows of a few numbers, dealt over SPREAD keys; then each side's bytes are fetched by block.
    some = asked.select("dim", "q_block", "needs", F.pmod("q_block", F.lit(SPREAD)).alias("r"))
    each = blocks.select("dim", "band", "salt", "longest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("r"))
    chunks = -(-asked.count() // TOGETHER) or 1
    meets = some.join(each, ["dim", "r"]).where(F.col("longest") >= F.col("needs")).select("dim", "q_block", "band", "salt", F.pmod(F.xxhash64("q_block"), F.lit(chunks)).alias("chunk"))
    key, meets = ["dim", "band", "salt", "chunk"], cut(meets)
    left = meets.join(asked.select("dim", "q_block", "q_ids", "q_rows", "q_m", "theta"), ["dim", "q_block"]).drop("q_block")
    right = blocks.drop("longest").join(meets.select(*key).distinct(), ["dim", "band", "salt"])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, since both sides stem from `meets`
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k), ", ".join(f"{c} long" for c in _FOUND))
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
