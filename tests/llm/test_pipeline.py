"""The pipeline's stages against plain code, and their edge cases."""

from __future__ import annotations

import random
import re

import corpus_pipeline as c
import pytest
from test_edges import plain_components, plain_hits, sentence

STAGES = dict(c.STAGES)
#: Nulls in every column, no words, a very long text, repeated rows, ids with several texts.
ODD = [
    (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "w " * 60_000, None, "s", 120_000), (None, "one two three four five six seven", "en", "s", 32), (None, "one two three four five six seven", "en", "s", 32),
    (4, "only few", "en", "t", 8), (4, "only few", "en", "t", 8), (5, "first text here says one two three four", "en", "s", 38), (5, "another text of six other words", "en", "s", 31), (6, "a third one without any kin at all", "en", "s", 34),
    (7, "another text of six other words", "en", "s", 31),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels=(), benchmark=()):
    for name, rows, kind in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(list(rows), kind).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def key(row):
    return tuple((x is not None, x) for x in row)


def same(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


def test_jaccard_tells_rows_of_one_id_apart(spark, tmp_path):
    docs = [(5, "a b c d e f", "en", "s", 11), (5, "g h i j k l", "en", "s", 11), (6, "m n o p q r", "en", "s", 11)]
    same(c.jaccard(spark, tables(spark, tmp_path, docs), str(tmp_path)).collect(), docs)
    copies = [*docs, (5, "a b c d e f", "en", "s", 11), (7, "g h i j k l", "en", "s", 11), (6, "a b c d e f", "en", "s", 11)]
    same(c.jaccard(spark, tables(spark, tmp_path, copies), str(tmp_path)).collect(), docs)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_keeps_one_of_each_group(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(8, 60)).split() for _ in range(15)]
    docs = []
    for i in range(120):
        words = list(rng.choice(base))
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words), "en", "s", 1))
    docs += [d for d in ODD if d[0] is not None and d[0] not in (4, 5, 7)]
    docs = [d if d[0] is None or i < 120 else (d[0] + 1000, *d[1:]) for i, d in enumerate(docs)]
    least = {i: k for i, _, k in plain_components([d[:2] for d in docs])}
    same(c.jaccard(spark, tables(spark, tmp_path, docs), str(tmp_path)).collect(), [d for d in docs if least[d[0]] == d[0]])


def test_decontamination_against_windows(spark, tmp_path):
    rng = random.Random(7)
    items = [(i, sentence(rng, rng.randrange(1, 30))) for i in range(6)] + [(9, None), (None, sentence(rng, 15))]
    docs = [(i, sentence(rng, 20) + " " + (items[i % 8][1] or "")[: rng.randrange(5, 120)], "en", "s", 1) for i in range(60)] + ODD
    out = c.decontamination(spark, tables(spark, tmp_path, docs, benchmark=items), str(tmp_path))
    same(out.collect(), [d for d in docs if not plain_hits(d[1], items)[1]])


def test_secrets_replace_base_spans(spark, tmp_path):
    docs = [(i, f"say {'0123456789abcdef' * (i % 3)} and password=abcdefghijkl{i} end", "en", "s", 1) for i in range(20)] + ODD
    out = c.secrets(spark, tables(spark, tmp_path, docs), str(tmp_path)).collect()
    plain = lambda t: t if t is None else re.sub(r"(?i:password|token)=[A-Za-z0-9+/_.=-]{12,}|[0-9a-f]{16,}", "[secret]", t)
    same(out, [(i, plain(t), lang, s, None if t is None and n is None else len(plain(t))) for i, t, lang, s, n in docs])


def test_toxicity_drops_what_is_rejected(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, sentence(rng, 40) + (" grubling meany" if i % 4 == 0 else ""), "en", "s", 1) for i in range(300)] + [(d[0] and d[0] + 1000, *d[1:]) for d in ODD]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)]
    out = c.toxicity(spark, tables(spark, tmp_path, docs, labels), str(tmp_path)).collect()
    same(out, [d for d in docs if "meany" not in (d[1] or "")])


def test_mixing_stage(spark, tmp_path):
    docs = [(i, "w " * (i % 9), f"l{i}", f"s{i % 4}", 1) for i in range(200)] + ODD
    out = c.mixing(spark, tables(spark, tmp_path, docs), str(tmp_path)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    same([(r["doc_id"], r["source"], r["size"]) for r in out], [(d[0], d[3], size(d[1])) for d in docs])
    total: dict = {}
    for r in out:
        own = total.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        own[0], own[3] = own[0] + r["taken"], own[3] + r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken - target) <= 1 and words == told for taken, target, told, words in total.values())


@pytest.mark.parametrize("name", list(STAGES))
@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_stages_take_any_table(spark, tmp_path, name, rows):
    """Columns that clash with an operator's own ones pass untouched, save in the last stage, which returns the mix."""
    docs = tables(spark, tmp_path, rows, [(6, 1, 0), (7, 0, 1)] if rows else [], [(1, "without any")] if rows else [])
    clash = "score predicted class root n tokens base secrets items n_words _row _class _gone _id _again size".split()
    more = docs.selectExpr("*", *[f"'{x}' AS `{x}`" for x in clash]) if name != "mixing" else docs.selectExpr("*", *[f"'{x}' AS `{x}`" for x in ("target", "rank", "block", "taken")])
    out = STAGES[name](spark, more, str(tmp_path))
    found = out.collect()
    if name == "mixing":
        assert len(found) == len(rows)
    else:
        assert out.columns == more.columns and all(r[x] == x for r in found for x in clash)


def test_run_is_the_stages_in_a_row(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in c.STAGES:
        docs = stage(spark, docs, data)
    same(c.run(spark, data).collect(), docs.collect())
