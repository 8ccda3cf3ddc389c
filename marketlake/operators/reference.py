"""Reference closes, performance fields and the ticker cache rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.performance import change, change_pct
from marketlake.operators.calendar import reference_dates
from marketlake.operators.universe import restrict
from marketlake.schemas import CACHE, HORIZONS, REF_COLUMNS

RECENT = "recent"


def reference_closes(bars: DataFrame, as_of: DataFrame, dense: DataFrame) -> DataFrame:
    """Closes on the eight reference dates, one row per (as_of, ticker).

    Daily bars meet the reference dates in one broadcast join and are pivoted by a conditional
    aggregate: one scan and one shuffle instead of one join per horizon. A ticker without a
    bar on a date gets null; there is no fallback to an earlier bar.
    """
    dates = reference_dates(as_of, dense)
    hits = _on_dates(bars, dates)
    return hits.groupBy("as_of", "ticker").agg(*_closes())


def close_of_day(
    bars: DataFrame,
    as_of: DataFrame,
    dense: DataFrame,
    lookback_days: int = 5,
    universe: DataFrame | None = None,
) -> DataFrame:
    """Cache rows per (as_of, ticker): latest price, reference closes, change, performance.

    The look-back days are added to the reference dates as one more label, so latest bar and
    reference closes come out of the same join and the same aggregate. ``universe`` limits the
    work to tracked tickers, after the bars have been cut to the wanted dates.
    """
    hits = _on_dates(bars, wanted_dates(as_of, dense, lookback_days))
    if universe is not None:
        hits = restrict(hits, universe)
    rows = hits.groupBy("as_of", "ticker").agg(*_newest(), *_closes())
    out = _ordered(performance(rows), "as_of")
    return out.where(F.coalesce("price", "prevClose", *REF_COLUMNS).isNotNull())


def seed_rows(
    bars: DataFrame,
    as_of: DataFrame,
    dense: DataFrame,
    lookback_days: int = 10,
    universe: DataFrame | None = None,
) -> DataFrame:
    """Cache rows for newly added tickers: as ``close_of_day``, but the previous close is the
    second-latest bar of the look-back window, whatever its date; zero counts as missing.
    Tickers without a bar in the window give no row.

    The collected list holds the bars of the look-back window only, so at most eleven.
    """
    hits = _on_dates(bars, wanted_dates(as_of, dense, lookback_days))
    if universe is not None:
        hits = restrict(hits, universe)
    recent = f"collect_list(case when label = '{RECENT}' then struct(ref_date, close) end)"
    second = F.expr(f"nullif(try_element_at(sort_array({recent}), -2).close, 0D) as _second")
    rows = hits.groupBy("as_of", "ticker").agg(*_newest(), *_closes(), second)
    rows = rows.where("price is not null").withColumn("prevClose", F.col("_second"))
    return _ordered(performance(rows), "as_of")


def performance(rows: DataFrame) -> DataFrame:
    """Adds change, changePct and the seven performance columns from price, prevClose, ref*."""
    return rows.withColumns(
        {
            "change": change("price", "prevClose"),
            "changePct": change_pct("price", "prevClose"),
            **{perf: change_pct("price", ref) for ref, perf in HORIZONS.values()},
        }
    )


def wanted_dates(as_of: DataFrame, dense: DataFrame, lookback_days: int) -> DataFrame:
    """(as_of, label, ref_date): the reference dates and, as label ``recent``, the look-back."""
    dates = as_of.select("as_of").distinct()
    recent = dates.select(
        "as_of",
        F.lit(RECENT).alias("label"),
        F.explode(F.sequence(F.date_sub("as_of", lookback_days), "as_of")).alias("ref_date"),
    )
    return reference_dates(dates, dense).unionByName(recent)


def _on_dates(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Bars on the wanted dates.

    The dates side is bounded by the calendar (at most about two dozen rows per as_of day), so
    broadcasting it is safe at any data size. The semi join comes first because Catalyst moves
    it below the aggregate that made the bars, down to the scan: minute bars of other days are
    dropped before they are grouped. The key keeps the type of the date column, so that it can
    be a partition column.
    """
    day_type = bars.schema["date"].dataType
    dates = dates.withColumn("date", F.col("ref_date").cast(day_type))
    wanted = bars.join(F.broadcast(dates.select("date")), "date", "left_semi")
    return wanted.selectExpr(
        "ticker",
        "date",
        "close",
        "coalesce(cast(volume as bigint), 0) as bar_volume",
        "coalesce(timestamp_ms, 0) as timestamp_ms",
    ).join(F.broadcast(dates), "date")


def _newest() -> list[Column]:
    day = f"case when label = '{RECENT}' then ref_date end"
    fields = {"price": "close", "volume": "bar_volume", "timestamp": "timestamp_ms"}
    return [F.expr(f"max_by({source}, {day}) as {name}") for name, source in fields.items()]


def _closes() -> list[Column]:
    names = {"prev": "prevClose", **{label: ref for label, (ref, _) in HORIZONS.items()}}
    return [F.expr(f"max(case when label = '{k}' then close end) as {v}") for k, v in names.items()]


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *CACHE.fieldNames())

