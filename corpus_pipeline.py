"""A corpus pipeline of training-data operators. Each stage's rows are written and read again as the next one's documents.

Defined cases, in every stage but the last: columns pass untouched whatever their names (secrets changes text and n_chars); an empty table gives
an empty one; rows with a null text, or without words, are never rejected; repeated rows and rows that share a doc_id are judged each by
its own text, and of equal texts with words Jaccard keeps one. A null doc_id matters to Jaccard alone, which keeps such rows; a null source is one of
its own in the mix, which lists every row that reaches it. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, new_folder, small_batches, table
from gristmill.llm.jaccard_join import class_column, jaccard_classes
from gristmill.llm.mixing import mix
from gristmill.llm.secrets import find_secrets, redact
from gristmill.llm.toxicity import learn, score
from gristmill.llm.winnowing import decontaminate

#: A list of ids up to this many bytes is broadcast; a longer one is joined by id.
IDS_BYTES = 4 << 20


def _whole(docs: DataFrame) -> DataFrame:
    """The columns that an operator needs beside the untouched row, so that no other column of `docs` can clash with its own."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field rejects (score of one half or more) go."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(_whole(docs), model).where("predicted = 0").select("_row.*")


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity, one with the least doc_id stays; rows without a doc_id or without words stay.

    Ids that several rows have don't name a row: such rows are told apart by the class of their text, and one row of a component stays.
    """
    found = cut(jaccard_classes(docs).where("doc_id IS NOT NULL AND n_shingles > 0"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = F.broadcast(gone) if 8 * gone.count() <= IDS_BYTES else gone
    rows, id_ = small_batches(_whole(docs)), F.col("doc_id").cast("long")
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if not again.limit(1).count():
        return rows.join(gone, id_ == F.col("_gone"), "left_anti").select("_row.*")
    again = cut(again)
    plain = rows.join(again, id_ == F.col("_again"), "left_anti").join(gone, id_ == F.col("_gone"), "left_anti")
    rows = rows.join(again, id_ == F.col("_again"), "left_semi").withColumn("_class", class_column(F.col("text")))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("class").alias("_found"), F.col("root").alias("_root")).distinct()
    one = rows.join(kept, (id_ == F.col("_id")) & (F.col("_class") == F.col("_found"))).dropDuplicates(["_root"])
    return plain.select("_row").union(rows.where("_class = 0").select("_row")).union(one.select("_row")).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontaminate(_whole(docs), table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars follows the new text; no document goes. The scanned rows are written once, as both of its steps read them."""
    found = find_secrets(_whole(docs), written=True).withColumn("text", F.col("_row.text").cast("string"))
    clean = redact(found)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("_row.n_chars").cast("long"))}
    return clean.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("jaccard", jaccard),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]
#: No SQL for a fitted field or the tree's draws; the tests hold the pipeline against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
