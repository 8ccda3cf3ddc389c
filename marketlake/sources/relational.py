"""Users, watchlists and positions: from a database over JDBC, or from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.schemas import POSITIONS, USER_TICKERS, USERS

TABLES = {"users": USERS, "user_tickers": USER_TICKERS, "positions": POSITIONS}
SPLIT_COLUMN = {"users": "id", "user_tickers": "user_id", "positions": "id"}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the three tables from ``{path}/{name}``; only the columns analytics need."""
    return spark.read.schema(TABLES[name]).parquet(f"{path.rstrip('/')}/{name}")


def read_table_jdbc(
    spark: SparkSession, name: str, url: str, properties: dict[str, str], partitions: int = 16
) -> DataFrame:
    """The same over JDBC, read in ``partitions`` parallel key ranges. Password hashes, API keys
    and preferences stay in the database."""
    schema = TABLES[name]
    split = SPLIT_COLUMN[name]
    lo, hi = (
        spark.read.jdbc(url, f"(select min({split}) lo, max({split}) hi from {name}) b", properties=properties)
        .select("lo", "hi")
        .first()
    )
    table = spark.read.jdbc(
        url,
        name,
        column=split,
        lowerBound=lo or 0,
        upperBound=(hi or 0) + 1,
        numPartitions=partitions,
        properties=properties,
    )
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
