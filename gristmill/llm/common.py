"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be long, so a batch is kept small.
ARROW_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """Called by operators that pass texts to Python: bounds the rows of one Arrow batch for the session, unless it bounds them lower itself."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a temporary one does in local mode only."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = os.path.join(tempfile.gettempdir(), "gristmill-checkpoints")
        spark.conf.set("spark.checkpoint.dir", own)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder; a lost executor then costs no more than a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key that more rows hold is joined by broadcast; there can't be many such keys.
HOT_ROWS = 100_000


def join_by(rows: DataFrame, one: DataFrame, key: str, n: str = "n") -> DataFrame:
    """`rows` with the columns of `one`, which has a row for each key and in `n` how many of the rows hold it.

    No task gets a hot key's rows: written first, `one` leaves the join open to being split at run time, and keys of very many rows don't meet at all.
    """
    one = cut(one)
    hot = one.where(F.col(n) > HOT_ROWS)
    if not hot.limit(1).count():
        return rows.join(one.drop(n), key)
    hot = F.broadcast(hot.drop(n))
    return rows.join(hot, key).union(rows.join(hot.select(key), key, "left_anti").join(one.where(F.col(n) <= HOT_ROWS).drop(n), key))


#: Parts that a hot key's rows are dealt to.
SALTS = 32


def join_left(rows: DataFrame, one: DataFrame, key: list[str]) -> DataFrame:
    """`rows` with the columns of `one`, which has one row for a key at most and is too large to broadcast. Keys that very many rows hold are salted."""
    hot = F.broadcast(cut(rows.groupBy(*key).count().where(F.col("count") > HOT_ROWS).select(*key, F.lit(True).alias("_hot"))))
    salts = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    salted = one.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot").join(salted, [*key, "_salt"], "left").drop("_salt")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that a written table has replaced; else they stay until the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh place below the shared folder for files that an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Bits of a filter on hashes, whatever the data.
FILTER_BITS = 1 << 26


def slot_of(*columns: str) -> Column:
    """Where columns fall in a filter."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).cast("int")


def _packed_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << 16, np.uint8)
    bits[pdf["low"].to_numpy()] = 1
    return pd.DataFrame({"high": [int(pdf["high"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})


def bit_filter(slots: DataFrame, column: str = "slot"):
    """A broadcast bitmap of the slots. It is FILTER_BITS large whatever the data; what it lets pass wrongly has to be joined away."""
    spark, slot = slots.sparkSession, F.col(column)
    rows = slots.select(F.shiftright(slot, 16).cast("int").alias("high"), slot.bitwiseAND(65535).cast("int").alias("low")).distinct().groupBy("high").applyInPandas(_packed_bits, "high int, bits binary").collect()
    whole = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in rows:
        whole[r["high"] << 13 : (r["high"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(whole)


def has_bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
