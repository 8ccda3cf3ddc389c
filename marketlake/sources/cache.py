"""The ticker cache: what several producers know of each ticker, merged when it is read.

Each producer writes a table of its own (``ChangeTable``), so none can undo what another writes at the same
time. The nightly job owns the closes, the seeding of new tickers the seeds, and every live stream a table under
its name. Which of two values counts is decided by the time of the data, not of the write:

- of closes and seeds those of the later day, seeds on the same day;
- of live ticks the latest one; it counts against a close if it is later than the end of the close's
  day, or, where a row has no day, no older than the row itself;
- a field that the newer side lacks comes from the older one.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.functions.sessions import POST_CLOSE
from marketlake.functions.times import ny_epoch_seconds
from marketlake.schemas import CACHE, PERF_COLUMNS
from marketlake.sources.changes import ChangeTable
from marketlake.sources.files import folders

CLOSES = T.StructType([*CACHE.fields, T.StructField("as_of", T.DateType()), T.StructField("until", T.LongType())])
LIVE_FIELDS = ["price", "change", "changePct", "volume", "timestamp", *PERF_COLUMNS]
LIVE = T.StructType([CACHE["ticker"], *[CACHE[c] for c in LIVE_FIELDS]])


class CacheTable:
    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        # a night's rows are nearly the whole table: it is written out each time, and read as it is
        self.closes = ChangeTable(spark, f"{self.path}/closes", CLOSES, ["ticker"], compact_every=1)
        self.seeds = ChangeTable(spark, f"{self.path}/seeds", CLOSES, ["ticker"], ["as_of"], compact_every=compact_every)

    def live(self, producer: str = "live") -> ChangeTable:
        """The table of one live stream."""
        return ChangeTable(
            self.spark, f"{self.path}/live/{producer}", LIVE, ["ticker"], ["timestamp"], compact_every=self.compact_every
        )

    def merge(self, updates: DataFrame, as_of: dt.date | None = None) -> int:
        """Writes closes, one row per ticker, of the end of the day ``as_of``; returns the version written."""
        return self.closes.write(_dated(updates, as_of, final=True))

    def merge_seeds(self, updates: DataFrame, as_of: dt.date | None = None) -> int:
        """Writes rows of new tickers. The day may go on, so live ticks later than a row count."""
        return self.seeds.write(_dated(updates, as_of, final=False))

    def merge_live(self, updates: DataFrame, batch_id: int, producer: str = "live") -> None:
        """Writes the latest ticks of a micro-batch. A batch that is repeated replaces itself."""
        self.live(producer).write(updates, batch_id)

    def version(self) -> int | None:
        """The number of the newest write of closes."""
        return self.closes.newest()

    def batch(self, producer: str = "live") -> int | None:
        """The newest batch of a live stream that the cache holds."""
        return self.live(producer).newest()

    def reference(self) -> DataFrame:
        """Closes and seeds: one row per ticker. A plain stored table while there are no seeds."""
        closes = self.closes.read()
        if self.seeds.newest() is None:
            return closes
        return _overlay(closes, self.seeds.read(), F.expr("as_of is null or _as_of >= as_of"))

    def ticks(self, upto: dict[str, int | None] | None = None) -> DataFrame | None:
        """The latest live tick per ticker over all streams, None before the first. ``upto`` gives
        a batch per stream; a stream that it gives None, or does not name, had none."""
        names = folders(self.spark, f"{self.path}/live")
        if upto is not None:
            names = [n for n in names if upto.get(n) is not None]
        tables = [self.live(n).read(None if upto is None else upto[n]) for n in names]
        return reduce(lambda a, b: _overlay(a, b, F.expr("timestamp is null or _timestamp >= timestamp")), tables) if tables else None

    def read(self, upto: dict[str, int | None] | None = None) -> DataFrame:
        """The merged cache; no rows before the first write."""
        closes, ticks = self.reference(), self.ticks(upto)
        if ticks is not None:
            later = F.expr("case when until is not null then _timestamp > until else timestamp is null or _timestamp >= timestamp end")
            closes = _overlay(closes, ticks, later)
        return closes.select(*CACHE.fieldNames())

    def streams(self) -> dict[str, int | None]:
        """The newest batch of every live stream: a cut through the cache, to be given to ``read``."""
        return {n: self.batch(n) for n in folders(self.spark, f"{self.path}/live")}


def _dated(rows: DataFrame, as_of: dt.date | None, final: bool) -> DataFrame:
    day = F.lit(as_of).cast("date")
    until = ny_epoch_seconds(day, F.lit(POST_CLOSE)) * 1000 if final else F.lit(None).cast("long")
    return rows.withColumns({"as_of": day, "until": until})


def _overlay(old: DataFrame, new: DataFrame, newer: Column) -> DataFrame:
    """Field by field, the value of the side that counts, else that of the other. ``newer`` may use
    the columns of both, those of ``new`` with an underscore before their names; null means no."""
    fields = [c for c in old.columns if c != "ticker"]
    joined = old.join(new.withColumnsRenamed({c: f"_{c}" for c in new.columns if c != "ticker"}), "ticker", "full_outer")
    first = lambda c: F.when(F.coalesce(newer, F.lit(False)), F.coalesce(f"_{c}", c)).otherwise(F.coalesce(c, f"_{c}"))
    return joined.select("ticker", *[first(c).alias(c) if c in new.columns else F.col(c) for c in fields])
