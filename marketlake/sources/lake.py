"""Staged, bronze and silver tables as partitioned Parquet.

Only bronze is shuffled when it is written. It is rebalanced on its date: AQE cuts a large day
into several files near the advisory size and puts small days together, so neither one huge
file nor thousands of tiny ones come out. Rows are sorted by ticker inside a file, which lets
Parquet min/max statistics skip row groups for a ticker filter.

Staged files come from day files that hold one date each, and silver is bronze with two more
columns: in both cases the input is already split by date, and tasks write what they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.functions.sessions import with_session, with_timestamp
from marketlake.schemas import BRONZE, SILVER
from marketlake.sources.raw_files import align

STAGED = T.StructType(
    BRONZE.fields
    + [
        T.StructField("row_ok", T.BooleanType()),
        T.StructField("raw", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("year", T.StringType()),
    ]
)


def write_staged(parsed: DataFrame, path: str) -> None:
    """Parsed day files, laid out by year and date; rerunning a day replaces it."""
    rows = parsed.withColumn("year", F.substring("date", 1, 4))
    _overwrite_partitions(rows, path, ["year", "date"], [])


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGED).parquet(path)


def write_bronze(bars: DataFrame, path: str) -> None:
    """Loads bars into bronze, partitioned by date only. A date in ``bars`` replaces that date
    in the table, so loading a day twice does not duplicate it."""
    rows = align(bars, F.col("date")).hint("rebalance", "date")
    _overwrite_partitions(rows, path, ["date"], ["ticker", "window_start"])


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Unparsable rows (date, raw JSON); a date is replaced when it is loaded again."""
    _overwrite_partitions(rows, path, ["date"], [])


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("raw string, date string").parquet(path)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BRONZE).parquet(path)


def to_silver(bronze: DataFrame) -> DataFrame:
    """Bronze bars with New York time and session."""
    return with_session(with_timestamp(bronze)).select(*SILVER.fieldNames())


def write_silver(bronze: DataFrame, path: str, by_ticker: bool = False) -> None:
    """Refreshes the silver partitions of the dates in ``bronze``.

    Partitioned by date; ``by_ticker`` adds ticker as a second partition column, which makes
    one file per ticker and day and pays off only for few tickers.
    """
    silver = to_silver(bronze)
    if by_ticker:
        keys = ["date", "ticker"]
        _overwrite_partitions(silver.hint("rebalance", *keys), path, keys, ["window_start"])
    else:
        _overwrite_partitions(silver, path, ["date"], ["ticker", "window_start"])


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SILVER).parquet(path)


def _overwrite_partitions(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    (
        rows.sortWithinPartitions(*keys, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*keys)
        .parquet(path)
    )
