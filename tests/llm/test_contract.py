"""The contract queries: against SQL where there is some, against plain code where not."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gristmill.llm.queries import ORACLES, QUERIES


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, name):
    found, wanted = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_token_counts(spark, data, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in documents}
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in QUERIES["op2_token_counts"](spark, data).collect()}
    assert found == wanted


def test_secrets(spark, data, documents):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = {r["doc_id"]: r for r in QUERIES["op10_secrets"](spark, data).collect()}
    assert len(found) == len(documents)
    for i, t, _ in documents:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert found[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(found[i]["spans"].split(","))


def test_mixing(spark, data, documents):
    found = QUERIES["op8_mixing"](spark, data).collect()
    again = QUERIES["op8_mixing"](spark, data).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in documents}
    source = {i: s for i, _, s in documents}
    names = sorted(set(source.values()))
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}
    total = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    fixed: dict = {}
    while True:
        rest, open_ = sum(total.values()) - sum(fixed.values()), [s for s in names if s not in fixed]
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 3 * total[s]]
        if not over:
            break
        fixed |= {s: 3 * total[s] for s in over}
    target |= fixed
    taken: dict = {}
    for r in found:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == total[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_extraction(spark, data, duck):
    import html as entities

    found = {r["page_id"]: r for r in QUERIES["op9_extraction"](spark, data).collect()}
    for i, source in duck.sql("SELECT page_id, html FROM pages").fetchall():
        article = source.split("<article>")[1].split("</article>")[0]
        blocks = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", b)))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert found[i]["text"] == " ".join(filter(None, blocks)) and found[i]["n_chars"] == len(found[i]["text"])


def test_toxicity(spark, data, duck):
    """Held-out accuracy, on a table large enough to learn from."""
    larger = data.replace("sf0.001", "sf0.01")
    labels = dict(duck.sql(f"SELECT doc_id, toxic FROM '{larger}/labels.parquet'").fetchall())
    found = QUERIES["op1_toxicity"](spark, larger).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    own = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in own) / len(own) > 0.9
