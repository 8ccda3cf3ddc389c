"""Watchlist changes as a stream: a table of watchlists that each micro-batch brings up to date.

Only the keys that a batch touches are read from the table, changed and written again; the rest stays. Batches
come in the order of ``seq``. A batch that is repeated starts from the table as of the batch before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from marketlake.operators.changes import KEY, apply_watchlist_changes, expand_watchlist_changes
from marketlake.schemas import USER_TICKERS
from marketlake.sources.changes import ChangeTable
from marketlake.streaming.live import start_batches

WATCHLIST_CHANGE = "seq bigint, user_id bigint, op string, tickers array<string>"
GONE = "gone"


def watchlist_table(spark: SparkSession, path: str, compact_every: int = 16) -> ChangeTable:
    """The watchlists: (user_id, ticker, sort_order)."""
    schema = StructType([*USER_TICKERS.fields, StructField(GONE, BooleanType())])
    return ChangeTable(spark, path, schema, KEY, by_field=False, gone=GONE, compact_every=compact_every)


def load_watchlists(table: ChangeTable, user_tickers: DataFrame) -> None:
    """The lists before the first change: write 0 of the table. Batch n of the stream is write n + 1."""
    table.write(user_tickers.withColumn(GONE, F.lit(False)), 0)


def watchlist_batch(changes: DataFrame, batch_id: int, table: ChangeTable) -> None:
    """Applies the changes of one micro-batch to the keys that they touch."""
    keys = expand_watchlist_changes(changes).select(*KEY).distinct()
    before = table.read(batch_id).drop(GONE).join(keys, KEY, "left_semi").persist()  # used twice
    try:
        after = apply_watchlist_changes(before, changes)
        gone = before.join(after.select(*KEY), KEY, "left_anti")
        rows = after.withColumn(GONE, F.lit(False)).unionByName(gone.withColumn(GONE, F.lit(True)))
        table.write(rows, batch_id + 1)
    finally:
        before.unpersist()


def start_watchlists(changes: DataFrame, table: ChangeTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the changes stream (``WATCHLIST_CHANGE`` rows). One table belongs to one checkpoint."""
    return start_batches(changes, lambda batch, batch_id: watchlist_batch(batch, batch_id, table), checkpoint, every)
