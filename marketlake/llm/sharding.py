"""Shards by jump consistent hashing: a key and the shard count decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import number_within, pick

STEP = np.uint64(2862933555777941757)  # multiplier of the method's generator, a fixed value


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jump ahead until the next jump would leave the range."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while moving.size:
        key[moving] = key[moving] * STEP + np.uint64(1)
        draw = ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target = np.floor((shard[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
        stays = target < shards
        moving, target = moving[stays], target[stays]
        shard[moving] = target
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key column (any type) as an int; a null key counts as one more key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def of(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return of(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps, also in shards that hold a large
    share of all rows. ``grown_shard`` is the shard with one more shard: the same, or the new one.
    Null ids all go to one shard; a null text has 16 bytes and checksum 0, as an empty one has;
    rows repeated keep a slot each. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = number_within(rows, F.col("shard"), order, "slot", docs.count())
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
