"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

1. Words are counted per document; the small (doc_id, source, size) table is written once.
2. Sources get weights by code point order; targets are filled like vessels: a target stops at `most` times its source.
3. A source's documents fall into blocks by hash. A source gives `whole` complete passes over its blocks and a part of one more,
   in permuted order; each block of each pass is a ticket. Their number is bounded, so the tree works on a small table.
4. The tree halves the tickets: at a node each source's share of the left half is a multivariate-hypergeometric draw
   (selection sampling over the node's tickets), so every shard gets equally many tickets and every quota is exact.
5. Shards draw the consecutive tickets that their leaves name, which are disjoint blocks of the permuted passes; what a document gives
   is the sum of its blocks' draws. Inside a shard documents get a shuffled place (`shards_of`).
The document that crosses a source's target is taken in part, so what is taken equals the rounded target.

Skew: no step groups documents by source alone other than partial sums; windows run inside blocks.
Defined cases: a null text has size 0 and is never drawn; a null source is a source of its own, ordered last; a table with no words
has targets 0; repeated rows are rows of their own; columns besides doc_id, source and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SHARDS = 16
BLOCK_DOCS, BLOCKS = 1000, 32768
_SPLIT = """
aggregate(quota,
  named_struct('need', (total + 1) div 2, 'left', total, 'got', cast(array() as array<struct<rank: int, q: bigint>>)),
  (acc, s) -> transform(array(aggregate(
      if(s.q > 0, sequence(1L, s.q), cast(array() as array<bigint>)),
      named_struct('need', acc.need, 'left', acc.left, 'n', 0L),
      (b, t) -> if(shiftrightunsigned(xxhash64({seed}L, node, s.rank, t), 11) * {unit} * b.left < b.need,
        named_struct('need', b.need - 1, 'left', b.left - 1, 'n', b.n + 1),
        named_struct('need', b.need, 'left', b.left - 1, 'n', b.n)))),
    r -> named_struct('need', r.need, 'left', r.left, 'got', concat(acc.got, array(named_struct('rank', s.rank, 'q', r.n)))))[0],
  acc -> acc.got)
"""


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words; written once, since four steps read it."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n_docs, source_size, rank (from 0), weight and target. One row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("rank", F.row_number().over(ordered) - 1).withColumn("weight", weight)
    by_fill = Window.orderBy(F.col("full_at"), F.col("rank"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("level", rest / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    open_ = F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "rank", "level"))
    rows = rows.withColumn("level", F.min(open_).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "n_docs", "source_size", "rank", "weight", target.alias("target"))


def split_tickets(quotas: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """rank, shard, begin, end: each shard's tickets of each source, from (rank, q). The quotas' array has one entry per source."""
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("q").cast("long").alias("q")))).alias("quota")).withColumn("node", F.lit(1).cast("long"))
    levels = max(0, math.ceil(math.log2(shards)))
    for _ in range(levels):
        nodes = nodes.withColumn("total", F.expr("aggregate(quota, 0L, (a, s) -> a + s.q)"))
        nodes = nodes.withColumn("got", F.expr(_SPLIT.format(seed=seed, unit="1.1102230246251565E-16D")))
        nodes = nodes.selectExpr("inline(array(named_struct('node', node * 2, 'quota', got), named_struct('node', node * 2 + 1, 'quota', zip_with(quota, got, (a, b) -> named_struct('rank', a.rank, 'q', a.q - b.q)))))")
    leaves = nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.inline("quota"))
    w = Window.partitionBy("rank").orderBy("shard")
    end = F.sum("q").over(w)
    return leaves.select("rank", "shard", (end - F.col("q")).alias("begin"), end.alias("end"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = 7, block_docs: int = BLOCK_DOCS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and draws (an array of epoch, shard, place, words) for each row of `docs`."""
    sizes = sized(docs)
    of = targets(sizes, weights, most)
    share = F.ceil(F.lit(float(blocks)) * F.col("n_docs") / F.sum("n_docs").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    of = of.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.ceil(F.col("n_docs") / block_docs), share)).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    of = cut(of.withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))

    one = of.select(F.col("source").alias("_source"), "rank", "n_blocks", "source_size", "target", "whole")
    placed = sizes.join(one, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_blocks")))

    # Blocks: one row each, in permuted order within their source.
    sums = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    sums = sums.join(of.select("rank", "n_blocks", "whole", "rest"), "rank")
    w = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block"), "block")
    before = F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("turn", F.row_number().over(w) - 1).withColumn("seen", F.count("*").over(Window.partitionBy("rank")))
    sums = sums.withColumn("part", F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("words")))
    sums = sums.withColumn("last_turn", F.sum((F.col("part") > 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    sums = cut(sums)
    quotas = sums.groupBy("rank").agg((F.max("whole") * F.max("seen") + F.sum((F.col("part") > 0).cast("long"))).alias("q"))
    # The tree's leaves name the tickets that a shard draws; a ticket is a turn in one pass over the source's permuted blocks.
    drawn = split_tickets(quotas, shards, seed + 2).where("end > begin").select("rank", "shard", F.explode(F.sequence("begin", F.col("end") - 1)).alias("ticket"))
    passes = sums.groupBy("rank").agg(F.max("seen").alias("_seen"), F.max("whole").alias("_whole"))
    drawn = drawn.join(F.broadcast(passes) if passes.count() <= BLOCKS else passes, "rank").withColumn("epoch", F.least(F.expr("ticket div _seen"), F.col("_whole")))
    drawn = drawn.select("rank", "shard", "epoch", (F.col("epoch") == F.col("_whole")).alias("last"), (F.col("ticket") - F.col("epoch") * F.col("_seen")).alias("turn"))
    turns = sums.where("whole > 0").select("rank", "block", F.lit(False).alias("last"), "turn", F.lit(None).cast("long").alias("most"))
    turns = turns.union(sums.where("part > 0").select("rank", "block", F.lit(True), "last_turn", "part"))
    tickets = drawn.join(turns, ["rank", "last", "turn"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "most"))).alias("tickets"))

    inside = Window.partitionBy("rank", "block").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id", "size"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(tickets, ["rank", "block"], "left")
    words = "if(t.most is null, size, least(greatest(t.most - before, 0L), size))"
    draws = f"filter(transform(tickets, t -> named_struct('epoch', t.epoch, 'shard', t.shard, 'place', xxhash64({seed + 4}L, t.epoch, t.shard, doc_id), 'words', {words})), d -> d.words > 0)"
    none = "cast(array() as array<struct<epoch: bigint, shard: bigint, place: bigint, words: bigint>>)"
    out = out.withColumn("draws", F.expr(f"coalesce({draws}, {none})")).withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "draws")


def shards_of(mixed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per draw, each shard in sorted runs of `place`: what a writer of training shards stores."""
    rows = mixed.select("doc_id", "source", F.inline("draws"))
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id")
