"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the text contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns asked for, under the given names; other columns can't clash with ours."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def flat(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def number_within(
    df: DataFrame, group: Column, order: list[Column], out: str, rows: int, bucket_rows: int = 16384
) -> DataFrame:
    """Adds ``out``: the row's gapless number from 0 within its group, in an order by hash.

    A group is never gathered in one task. Its rows are cut by the leading bits of a hash of
    ``order`` into buckets of about ``bucket_rows``; only buckets are sorted, and the counts of
    the buckets before are added. ``rows`` is the number of rows or an estimate of it: it
    sets the number of buckets, not the result. Null groups are groups of their own. Rows that
    agree in all of ``order`` get neighbouring numbers.
    """
    bits = max(1, math.ceil(math.log2(max(rows, 1) / bucket_rows)) if rows > bucket_rows else 1)
    df = df.withColumns({"__group": group, "__hash": F.xxhash64(*order)})
    df = df.withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - bits))
    before = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("__group", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(
        F.struct(F.col("__group").alias("g"), F.col("__bucket").alias("b")).alias("__key"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy("__key").orderBy("__hash", *order)
    df = df.withColumn("__key", F.struct(F.col("__group").alias("g"), F.col("__bucket").alias("b")))
    df = df.withColumn("__in", F.row_number().over(inside))
    joined = df.join(counts.withColumnRenamed("__key", "__k"), F.col("__key").eqNullSafe(F.col("__k")))
    return joined.withColumn(out, F.col("__before") + F.col("__in") - 1).drop(
        "__group", "__hash", "__bucket", "__key", "__k", "__in", "__before"
    )


def kept_in_worker(name: str, key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, kept by the Python worker that runs this task for the tasks that it runs later. One
    object is kept under each name: another ``key`` replaces it. Results must not depend on what it remembers."""
    kept = sys.modules.setdefault("marketlake_kept", types.ModuleType("marketlake_kept")).__dict__
    if kept.get(name, ("", None))[0] != key:
        kept.pop(name, None)  # never two of them at once
        kept[name] = key, make()
    return kept[name][1]
