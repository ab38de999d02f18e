"""Exact n-gram Jaccard self-join by a token-group matrix.

A document is the set of 64-bit hashes of its distinct word shingles; equal sets form one class. Steps:
1. One pass over the texts gives each document's class and size. It also counts shingles inside large batches: those that are
   frequent there, at most HEAVY of them, are the heavy shingles. They set an order only, so what the counts miss costs no link.
2. Shingles are ordered light before heavy, then by hash. Two sets with Jaccard >= t share a shingle among the first
   n - ceil(t n) + 1 of each. A second pass emits these (shingle, class) entries; light ones that only one class holds are dropped
   while the sorted entries stream by. Classes left without entries have no partner.
3. Similar classes form groups of near sizes: a class that is mostly heavy belongs to its most frequent heavy shingle, any other to
   its least hash. The distinct (shingle, group) entries are the token-group matrix. Joining a class's entries to it counts how many
   of them a group holds, and the sizes of their holders. Of two linked sets, the one whose entries end first shares at least `must_share` of them with the other,
   since those it doesn't share are in the other nowhere; a group that holds fewer is not opened.
4. Sets of the remaining classes are built from their texts. A group's members and those that ask it are cut into blocks of bounded
   token count, each with its token union. A query opens a block only if it shares enough with the union for the threshold; inside,
   overlaps are counted exactly by postings. A block reports a spanning star of the links found, not the pairs.
   A group of many blocks has pivots, well connected members that all of its blocks hold. Pivots that one set links to are of one
   component; sets that link to the greatest such bundle needn't be compared with each other any more. Only what is left of the group
   meets the blocks of the rest, so a large group of near copies is read a fixed number of times, not once for each of its blocks.
5. Connected components give each class, and so each document, the smallest doc_id that it reaches.

Defined cases: a null or wordless text has 0 shingles and is alone; fewer words than the shingle length are one shingle; a null
doc_id takes the component of its class (null if alone); repeated rows are of one class; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import bit_filter, cut, free_shuffles, has_bit, join_by, partitions, slot_of, small_batches
from gristmill.llm.components import components
from gristmill.llm.winnowing import Hashes, grams

WORDS, PERCENT = 5, 80
#: Bound on the heavy shingles, which are broadcast; on those that one batch reports; tokens of a batch; of a block; least count.
HEAVY, HEAVY_BATCH, BATCH_TOKENS, BLOCK_TOKENS, HEAVY_COUNT = 1 << 17, 20_000, 2_000_000, 50_000, 2
#: Pivots of a group of many blocks, at most. Their numbers are bits of a mask.
PIVOTS = 16
#: Groups of many blocks up to this number are broadcast, with a few numbers each.
FEW_GROUPS = 100_000
_MEMO = 200_000


class Shingles:
    def __init__(self, words: int = WORDS):
        self.k, self.memo = words, Hashes()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes. bytes.lower() and bytes.split() know A-Z and the six ASCII blanks only, as asked."""
        words = text.encode("utf-8").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > _MEMO:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))
        return np.unique(grams(h, min(self.k, len(h))))


def class_of(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def needed(n: np.ndarray | int, percent: int):
    """ceil(percent / 100 * n)"""
    return (n * percent + 99) // 100


def group_of(key: np.uint64, n: int) -> int:
    """A group's name, from its key shingle and the size in steps of a tenth."""
    return int(np.int64((int(key) * 0x9E3779B97F4A7C15 + int(np.log(n) / np.log(1.1)) * 0xD6E8FEB86659FD93) % (1 << 64) - (1 << 63)))


def must_share(n: str, least: str, most: str, percent: int) -> str:
    """SQL for the entries that a set of n shingles shares with a linked one of `least` to `most`.

    Linked sets overlap in t / (1 + t) of both sizes. The set whose entries end first has ceil(t n) - 1 shingles beside them, so the rest
    of the overlap is among the entries. Which of the two ends first isn't known here: the weaker demand holds. If the other one does, of
    size m, the demand is overlap(m) - ceil(t m) + 1. It doesn't fall with every m, but does (or stays) over `step` of them, the least
    number with a whole t * step: ceil(t m) rises by just that, the overlap by no more. So its least value is among the last `step` sizes.
    """
    low = f"greatest({least}, ceil({n} * {percent} / 100))"
    high = f"least({most}, floor({n} * 100 / {percent}))"
    overlap = lambda m: f"ceil({percent} * ({n} + {m}) / {100 + percent} - 1e-9)"
    last = [f"greatest({low}, {high} - {i})" for i in range(100 // math.gcd(percent, 100))]
    others = ", ".join(f"{overlap(m)} - ceil({m} * {percent} / 100) + 1" for m in last)
    return f"if({low} > {high}, null, greatest(1, least({overlap(low)} - ceil({n} * {percent} / 100) + 1, {others})))"


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, n_held = Shingles(words), [], 0

        def frequent() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = np.nonzero(c >= HEAVY_COUNT)[0]
            if len(keep) > HEAVY_BATCH:  # of equal counts the lesser hashes, so that batches report the same ones
                keep = keep[np.lexsort((u[keep], -c[keep]))[:HEAVY_BATCH]]
            n = len(keep)
            return pa.record_batch({"doc_id": pa.nulls(n, pa.int64()), "n": c[keep].astype(np.int64), "class": pa.nulls(n, pa.int64()), "shingle": u[keep].view(np.int64)})

        for batch in batches:
            sets = [shingles.of(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "n": np.array([len(s) for s in sets], np.int64), "class": np.array([class_of(s) for s in sets], np.int64), "shingle": pa.nulls(len(sets), pa.int64())})
            held += sets
            n_held += sum(map(len, sets))
            if n_held >= BATCH_TOKENS:
                yield frequent()
                held, n_held = [], 0
        if n_held:
            yield frequent()

    return run


def _entries(shared, words: int, percent: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, score = shared.value
        shingles = Shingles(words)
        for batch in batches:
            out, seen = [], set()
            for text in batch.column(1).to_pylist():
                s = shingles.of(text)
                name = class_of(s)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                is_heavy, group = np.zeros(len(s), bool), s[0]
                if len(heavy):
                    at = np.searchsorted(heavy, s)
                    at[at == len(heavy)] = 0
                    is_heavy = heavy[at] == s
                    if 2 * is_heavy.sum() >= len(s):
                        best = np.where(is_heavy, score[at], -1)
                        group = s[int(best.argmax())]
                m = len(s) - needed(len(s), percent) + 1
                light = s[~is_heavy][:m]
                more = s[is_heavy][: m - len(light)]
                out.append((light, more, name, len(s), group_of(group, len(s))))
            if out:
                light, more = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                names, sizes, groups = (np.array([x[i] for x in out], np.int64) for i in (2, 3, 4))
                of_light, of_more = (np.repeat(names, [len(x[i]) for x in out]) for i in (0, 1))
                t = np.concatenate([light.view(np.int64), more.view(np.int64)])
                c = np.concatenate([of_light, of_more])
                # Light entries meet by shingle. Heavy ones need not meet here; they and the classes' groups are dealt by class.
                to = np.concatenate([light.view(np.int64), of_more])
                n = len(t)
                yield pa.record_batch({"to": np.concatenate([to, names]) % parts, "shingle": np.concatenate([t, sizes]), "class": np.concatenate([c, names]), "group": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(groups)]), "kind": np.concatenate([np.zeros(len(light), np.int8), np.ones(len(more), np.int8), np.full(len(names), 2, np.int8)])})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted entries, each once, what isn't light or is held by two classes at least. Needs the last entry only, however long a run."""
    last: pa.RecordBatch | None = None
    last_out = True
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        t, c, kind = (whole.column(x).to_numpy(zero_copy_only=False) for x in ("shingle", "class", "kind"))
        same_t = (t[1:] == t[:-1]) & (kind[1:] == kind[:-1])
        twin = same_t & (c[1:] == c[:-1])
        other = same_t & ~twin
        # a run is kept once a second class turns up: the entry before, and all that follow in the run
        run = np.concatenate([[0], np.cumsum(~same_t)])
        first_other = np.full(run[-1] + 1, len(t))
        at = np.nonzero(other)[0] + 1
        np.minimum.at(first_other, run[at], at)
        index = np.arange(len(t))
        start = np.concatenate([[0], np.nonzero(~same_t)[0] + 1])
        if last is not None and last_out and kind[0] == 0:
            first_other[0] = 0  # the run was found shared in an earlier batch
        new = np.concatenate([[True], ~twin])
        keep = new & ((kind != 0) | (index >= first_other[run]))
        ends = first_other[first_other < len(t)]
        lead = start[run[ends]] if len(ends) else ends
        keep[lead] = True  # of equal entries before the second class, the first
        if last is not None:
            keep[0] = keep[0] and not last_out
        last_out_now = bool((kind[-1] != 0) or first_other[run[-1]] < len(t))
        if keep.any():
            yield whole.filter(pa.array(keep)).select(["shingle", "class", "group", "kind"])
        last, last_out = whole.slice(len(t) - 1, 1), last_out_now


def _sets(shared, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shingles = shared.value, Shingles(words)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array(has_bit(bits, slot)))
            sets = [shingles.of(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"class": np.array([class_of(s) for s in sets], np.int64), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _open(percent: int):
    def run(block: pa.Table) -> pa.Table:
        """Links between the queries and the members of one block, as stars (a, b), and by set the pivots that it links to (a, to_group, mask)."""
        at_class: dict[int, int] = {}
        names, sets, member, query, pivot = [], [], [], [], []
        for c, tokens, m, q, k in zip(*(block.column(x).to_pylist() for x in ("class", "tokens", "member", "query", "pivot")), strict=True):
            i = at_class.setdefault(c, len(names))
            if i == len(names):
                names.append(c)
                sets.append(np.frombuffer(tokens, np.uint64))
                member.append(m)
                query.append(q)
                pivot.append(k)
            else:
                member[i], query[i], pivot[i] = member[i] or m, query[i] or q, max(pivot[i], k)
        sizes, root = np.array([len(s) for s in sets]), list(range(len(names)))
        mask, bit = [0] * len(names), np.array([1 << k if k >= 0 else 0 for k in pivot], np.int64)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        members = np.nonzero(member)[0]
        if len(members):
            flat = np.concatenate([sets[i] for i in members])
            owner = np.repeat(np.arange(len(members)), sizes[members])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            union, begin = np.unique(flat, return_index=True)
            held = np.diff(np.append(begin, len(flat)))
            for q in np.nonzero(query)[0]:
                mask[q] |= int(bit[q])
                at = np.searchsorted(union, sets[q])
                at[at == len(union)] = 0
                at = at[union[at] == sets[q]]
                if len(at) < needed(sizes[q], percent):
                    continue  # no member can reach the threshold
                if member[q]:
                    at = at[held[at] > 1]
                if not len(at):
                    continue
                counts = held[at]
                spots = np.arange(counts.sum()) + np.repeat(begin[at] - np.cumsum(counts) + counts, counts)
                common = np.bincount(owner[spots], minlength=len(members))
                linked = members[(common > 0) & (100 * common >= percent * (sizes[q] + sizes[members] - common))]
                mask[q] |= int(np.bitwise_or.reduce(bit[linked], initial=0))
                for m in linked:
                    a, b = find(int(q)), find(int(m))
                    if a != b:
                        root[max(a, b)] = min(a, b)
        moved = [i for i in range(len(names)) if find(i) != i]
        known = [i for i in range(len(names)) if mask[i]]
        group = block.column("to_group")[0].as_py()
        return pa.table({
            "a": pa.array([names[i] for i in moved + known], pa.int64()), "b": pa.array([names[find(i)] for i in moved] + [None] * len(known), pa.int64()),
            "to_group": pa.array([None] * len(moved) + [group] * len(known), pa.int64()), "mask": pa.array([None] * len(moved) + [mask[i] for i in known], pa.int64()),
        })

    return run


_FOUND = "a long, b long, to_group long, mask long"


def _asking(opened: DataFrame) -> DataFrame:
    """class, to_group, n, own, popular: a group's members, and the classes that ask it. Of a pair of groups the class of the greater one asks."""
    rows = opened.where("group > to_group").select("class", "to_group", "n", F.lit(False).alias("own"), F.lit(0).cast("long").alias("popular"))
    mine = opened.groupBy("class", "group", "n").agg(F.max(F.when(F.col("group") == F.col("to_group"), F.col("popular")).otherwise(0)).alias("popular"))
    return mine.select("class", F.col("group").alias("to_group"), "n", F.lit(True).alias("own"), "popular").union(rows)


def _few(large: DataFrame) -> DataFrame:
    """Rows about groups of many blocks, which are few: broadcast, so that no group's classes meet in one task, while they are."""
    return F.broadcast(large) if large.count() <= FEW_GROUPS else large


def _placed(asking: DataFrame, blocks: DataFrame) -> DataFrame:
    """to_group, qb, mb, class, query, member, pivot: each class once for each group, and the pivots in all blocks of theirs.

    blocks: to_group and nb, of groups of many blocks.
    """
    rows = asking.join(_few(blocks), "to_group", "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("long")))
    block = F.pmod(F.xxhash64("class"), F.col("nb"))
    home = rows.select("class", "to_group", block.alias("qb"), block.alias("mb"), F.lit(True).alias("query"), F.col("own").alias("member"), F.lit(-1).alias("pivot"))
    return home.union(_pivots(rows).select("class", "to_group", "qb", F.col("qb").alias("mb"), F.lit(True), F.lit(True), "pivot"))


def _pivots(rows: DataFrame) -> DataFrame:
    """class, to_group, pivot and qb, once for each block: of the members in each of PIVOTS parts, the one whose entries are shared most."""
    part = F.pmod(F.xxhash64(F.lit(1), "class"), F.lit(PIVOTS)).cast("int")
    best = rows.where("own AND nb > 1").groupBy("to_group", "nb", part.alias("pivot")).agg(F.max_by("class", F.struct("popular", "class")).alias("class"))
    return best.select("class", "to_group", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("qb"))


def _greatest_bundle(masks: pa.Table) -> pa.Table:
    """Of one group's distinct masks with their numbers, the pivots of the component that most sets link to."""
    bundles: list[tuple[int, int]] = []  # pivots, sets
    for mask, n in zip(masks.column("mask").to_pylist(), masks.column("n").to_pylist(), strict=True):
        apart = [b for b in bundles if not b[0] & mask]
        for b in bundles:
            if b[0] & mask:
                mask, n = mask | b[0], n + b[1]
        bundles = [*apart, (mask, n)]
    return pa.table({"to_group": masks.column("to_group")[:1], "major": pa.array([max(bundles, key=lambda b: (b[1], b[0]))[0]], pa.int64())})


def _placed_rest(asking: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The same for what the blocks of large groups have left open: pairs of a member and a member or asking class, not both linked to the bundle.

    c, r: members linked to the bundle and others; s, t: asking classes likewise. A group whose r and t are empty is done.
    """
    masks = found.where("mask IS NOT NULL").groupBy("a", "to_group").agg(F.bit_or("mask").alias("mask"))
    major = cut(masks.groupBy("to_group", "mask").agg(F.count("*").alias("n")).groupBy("to_group").applyInArrow(_greatest_bundle, "to_group long, major long"))
    linked = masks.join(_few(major), "to_group").where(F.col("mask").bitwiseAND(F.col("major")) != 0).select(F.col("a").alias("class"), "to_group", F.lit(True).alias("linked"))
    rows = asking.join(_few(blocks).select("to_group"), "to_group").join(linked, ["class", "to_group"], "left")
    rows = rows.withColumn("kind", F.expr("if(own, if(linked, 'c', 'r'), if(linked, 's', 't'))"))
    number = lambda kind: F.ceil(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)) / BLOCK_TOKENS).alias(kind)
    rows = cut(rows)
    rows = rows.join(_few(rows.groupBy("to_group").agg(*map(number, "crst")).where("r > 0 OR t > 0")), "to_group")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("class"), F.expr("case kind when 'c' then c when 'r' then r when 's' then s else t end")))
    # Blocks of members: c, then r. Blocks of queries: r, then t, then s, which meets r alone; of two blocks of r the lesser asks.
    each = lambda low, high, body: f"if({high} >= {low}, transform(sequence({low}, {high}), x -> named_struct({body})), array())"
    pair = lambda q, m, query, member: f"'qb', {q}, 'mb', {m}, 'query', {query}, 'member', {member}"
    where = f"""case kind
        when 'c' then {each("0L", "r + t - 1", pair("x", "h", "false", "true"))}
        when 'r' then concat({each("0L", "h", pair("x", "c + h", "x = h", "true"))}, {each("r", "r + t + s - 1", pair("x", "c + h", "false", "true"))},
            {each("0L", "c - 1", pair("h", "x", "true", "false"))}, {each("c + h + 1", "c + r - 1", pair("h", "x", "true", "false"))})
        when 't' then {each("0L", "c + r - 1", pair("r + h", "x", "true", "false"))}
        else {each("c", "c + r - 1", pair("r + t + h", "x", "true", "false"))} end"""
    return rows.select("class", "to_group", F.inline(F.expr(where))).withColumn("pivot", F.lit(-1))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text)."""
    return jaccard_classes(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The same with each row's class and root, the least class that it reaches: they tell rows apart that share a doc_id."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = cut(texts.mapInArrow(_profile(words), "doc_id long, n long, class long, shingle long"))
    heavy = profile.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(HEAVY).toArrow()
    tokens, score = heavy.column("shingle").to_numpy().view(np.uint64), heavy.column("n").to_numpy()
    order = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[order], score[order]))
    sized = profile.where("shingle IS NULL").select("doc_id", "n", "class")

    entries = texts.mapInArrow(_entries(shared, words, percent, 1 << 20), "to long, shingle long, class long, group long, kind byte")
    entries = entries.repartition(2 * partitions(spark), "to").drop("to").sortWithinPartitions("kind", "shingle", "class")
    entries = cut(entries.mapInArrow(_shared, "shingle long, class long, group long, kind byte"))
    free_shuffles(spark)
    groups = entries.where("kind = 2").select("class", "group", F.col("shingle").alias("n"))
    active = cut(entries.where("kind < 2").select("class", "shingle").join(groups, "class"))

    holders = [F.count("*").alias("holders"), F.min("n").alias("least"), F.max("n").alias("most")]
    matrix = active.groupBy("shingle", "group").agg(*holders).withColumnRenamed("group", "to_group")
    # A linked member holds all that is shared, so its size is within those of the holders.
    shared_by = [F.count("*").alias("common"), F.sum("holders").alias("popular"), F.min("least").alias("least"), F.max("most").alias("most")]
    meets = active.join(matrix, "shingle").where("group <> to_group OR holders > 1").groupBy("class", "group", "n", "to_group").agg(*shared_by)
    opened = cut(meets.where(f"common >= {must_share('n', 'least', 'most', percent)}").select("class", "group", "to_group", "n", "popular"))
    free_shuffles(spark)

    firsts = sized.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    name = F.coalesce("doc_id", F.lit(-1))

    def links(placed: DataFrame) -> DataFrame:
        """What the placed classes' blocks report. Only texts that the filter takes for theirs are read for sets."""
        bitmap = bit_filter(firsts.join(placed.select("class").distinct(), "class", "left_semi").select(name.alias("doc_id")).select(slot_of("doc_id").alias("slot")))
        sets = texts.withColumn("doc_id", name).withColumn("slot", slot_of("doc_id")).mapInArrow(_sets(bitmap, words), "class long, tokens binary")
        return cut(placed.join(sets, "class").groupBy("to_group", "qb", "mb").applyInArrow(_open(percent), _FOUND))

    asking = _asking(opened)
    blocks = cut(asking.groupBy("to_group").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("nb")).where("nb > 1"))
    found = links(_placed(asking, blocks))
    edges = found.where("b IS NOT NULL").select("a", "b")
    if blocks.limit(1).count():
        rest = cut(_placed_rest(asking, blocks, found))
        if rest.limit(1).count():
            edges = edges.union(links(rest).where("b IS NOT NULL").select("a", "b"))
    roots = components(edges)

    classes = firsts.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    labels = join_by(classes, least, "root").select("class", "root", "component_id")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return sized.join(labels, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "class", "root")


def class_column(text: Column, words: int = WORDS) -> Column:
    """The class of a text, as `jaccard_classes` names it."""

    @F.pandas_udf("long")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingles = Shingles(words)
        for texts in batches:
            yield pd.Series([class_of(shingles.of(t)) for t in texts], dtype="int64")

    return name(text.cast("string"))
