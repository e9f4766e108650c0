"""Sharding by jump consistent hashing: stable keys to shards without a ring table (law `key`).

Cases: a null key hashes as a key of its own; rows that repeat a key share its shard and take slots of their own;
a null text has no bytes, very long ones are only measured; shards and slots follow hashes, rows that tie in the slot's
hash take neighbouring slots in any order; of the columns only the key and the text are read, and what is added has names
that the query chooses, so others can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import materialize, spread_rank, table


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. With one more shard a key either stays or goes to the new one.

    A key jumps ahead by pseudo-random steps of a linear congruence; its shard is the last place below `shards`.
    """
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Column of the shard of a stable key; the key is mixed to 64 bits first, so any type will do."""

    @F.pandas_udf("int")
    def jump(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(jump_hash(part.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign(docs: DataFrame, *, shards: int = 24, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) per row; slots run from 0 without gaps in each shard.

    Slots follow the hash of the key. Shards may hold any number of rows: each is ranked in many buckets.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(key_col).alias("key"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = materialize(rows.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1)), "shards")
    return spread_rank(rows, ["shard"], F.xxhash64(F.lit("slot"), "key", "text_crc32"), "slot", rows.count())


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
