from __future__ import annotations

import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with a column that clashes with what operators add."""

    def build(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return build


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def documents(duck):
    return duck.sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
