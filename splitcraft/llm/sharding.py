"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: no ring, no
table of shards.  With one shard more, a row stays or goes to the new shard.
The key is the first 60 bits of the MD5 of the key column as text, so that any
engine can find a row's shard.

Slots number the rows of a shard without gaps.  No shard is ever gathered in
one task: rows are counted per shard and run (a slice of the key space), the
counts are summed up to offsets, and rows are numbered within their run.

A null key has the key text ``''``.  Rows with equal keys share a shard; their
slots follow size and checksum.  Null texts have size 1 and checksum 0, as
empty ones.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from splitcraft.llm.common import ship, table

#: The step of the generator (a fixed value of the method).
STEP = 2862933555777941757
#: Runs of a shard at least, and rows of a run on average at most.
RUNS, RUN_ROWS = 64, 65536


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: follow the key's jumps from
    shard to shard while they stay below the number of shards."""
    if shards < 1:
        raise ValueError("there has to be a shard")
    keys = keys.astype(np.uint64)
    out = np.zeros(len(keys), np.int64)
    at = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(at):
            keys = keys * np.uint64(STEP) + np.uint64(1)
            to = ((out[at] + 1) * (float(1 << 31) / ((keys >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            on = to < shards
            at, keys = at[on], keys[on]
            out[at] = to[on]
    return out


def key_of(col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf(T.IntegerType())
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(jump(s.to_numpy(), shards).astype("int32"))

    return shard(key)


def assign_shards(df: DataFrame, shards: int, key_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """``df`` with its shard; a column of that name is replaced."""
    ship(df.sparkSession)
    return df.withColumn(shard_col, shard_of(key_of(F.col(key_col)), shards))


def write_shards(df: DataFrame, path: str, shards: int, key_col: str = "doc_id") -> None:
    """One folder of Parquet files for each shard, ``shard=0`` and so on.  Rows
    are dealt by shard and slice of the key, so that large shards have many
    writers and no shard has a file from every task."""
    out = assign_shards(df, shards, key_col)
    slices = F.pmod(key_of(F.col(key_col)), F.lit(RUNS))
    out.repartition("shard", slices).write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_layout(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    ship(docs.sparkSession)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    runs = max(RUNS, -(-docs.count() // (shards * RUN_ROWS)))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"), key_of(F.col(id_col).cast("long")).alias("key"))
            .withColumn("shard", shard_of(F.col("key"), shards))
            .withColumn("grown_shard", shard_of(F.col("key"), shards + 1))
            .withColumn("run", F.pmod("key", F.lit(runs))))
    # counting reads only the keys
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    return (rows.join(offsets, ["shard", "run"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("offset") + F.row_number().over(within) - 1).alias("slot"), "grown_shard"))


#: Shards of the registered query.
SHARDS = 8


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document, by the law ``key``."""
    return shard_layout(table(spark, sf_dir, "documents"), SHARDS)

