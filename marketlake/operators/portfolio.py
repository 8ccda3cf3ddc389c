"""Watchlist and position reports over all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.symbols import cleaned_ticker, is_valid_ticker
from marketlake.schemas import PERF_COLUMNS

WATCH_COLUMNS = ["price", "change", "changePct", "volume", "prevClose", *PERF_COLUMNS]


def watchlist(user_tickers: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's tickers; order with ``watchlist_order``."""
    return user_tickers.join(
        users.select(F.col("id").alias("user_id"), "username"), "user_id"
    ).select("username", "ticker", "sort_order")


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``rank``, the place in the list of their user, from 1; rows that agree in ``order`` share one.

    Users are dealt over the tasks, and each one's rows come in order; users are in no order. A sort of the
    whole table would run the joins below it twice, to sample them first. A user's list is what one person
    keeps (a ticker once in a watchlist), and its sort spills.
    """
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("username").orderBy(*order)))


def watchlist_order(rows: DataFrame) -> DataFrame:
    """By list position, then ticker."""
    return ranked(rows, "sort_order", "ticker")


def positions_order(rows: DataFrame) -> DataFrame:
    """By opening time, then id."""
    return ranked(rows, "opened_at", "id")


def watchlist_report(user_tickers: DataFrame, users: DataFrame, ticks: DataFrame) -> DataFrame:
    """(username, ticker) with the metrics of the latest tick; null where there is none.

    ``ticks`` is a stored table with one row per ticker: Spark sees its size and picks the
    join; watchlists are never shuffled while it is below the broadcast threshold.
    """
    metrics = [c for c in WATCH_COLUMNS if c in ticks.columns]
    return watchlist(user_tickers, users).join(ticks.select("ticker", *metrics), "ticker", "left")


def sort_by_metric(rows: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """Sorted per user by any metric; a missing value ranks below every number."""
    key = F.col(metric)
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return ranked(rows, order) if metric == "ticker" else ranked(rows, order, "ticker")


def positions_report(positions: DataFrame, users: DataFrame, ticks: DataFrame) -> DataFrame:
    """Positions with market value and profit; nulls run through where there is no tick."""
    held = positions.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    quotes = ticks.select("ticker", "price", "change", F.col("changePct").alias("dayPlPct"))
    shares = F.col("shares").cast("double")
    basis = F.col("cost_basis").cast("double")
    return (
        held.join(quotes, "ticker", "left")
        .withColumns({"shares": shares, "cost_basis": basis})
        .withColumns(
            {
                "totalCost": F.col("shares") * F.col("cost_basis"),
                "marketValue": F.col("shares") * F.col("price"),
                "dayPl": F.col("shares") * F.col("change"),
            }
        )
        .withColumn("pl", F.col("marketValue") - F.col("totalCost"))
        .withColumn("plPct", F.try_divide("pl", "totalCost") * 100)
        .select(
            "username", "id", "ticker", "shares", "cost_basis", "opened_at", "price",
            "totalCost", "marketValue", "pl", "plPct", "dayPl", "dayPlPct",
        )
    )


def portfolio_totals(report: DataFrame) -> DataFrame:
    """Value, profit and cost per user, exact to a millionth: a double sum would depend on the
    order in which tasks finish."""
    sums = report.groupBy("username").agg(
        _money_sum("coalesce(marketValue, totalCost)").alias("totalValue"),
        _money_sum("coalesce(pl, 0D)").alias("totalPl"),
        _money_sum("totalCost").alias("grandCost"),
    )
    pct = "case when grandCost > 0 then try_divide(totalPl, grandCost) * 100 else 0D end"
    return sums.selectExpr("*", f"{pct} as totalPlPct")


def position_inputs(entries: DataFrame) -> DataFrame:
    """Checks typed positions (ticker, shares, total_cost): adds ``cost_basis`` or ``error``.

    Nothing is dropped; split on ``error is null``.
    """
    error = (
        F.when(~is_valid_ticker(F.col("ticker")), "invalid ticker")
        .when(~_positive("shares"), "shares must be > 0")
        .when(~_positive("total_cost"), "total cost must be > 0")
    )
    basis = F.try_divide("total_cost", "shares")
    return (
        entries.withColumn("error", error)
        .withColumn("cost_basis", F.when(F.col("error").isNull(), basis))
        .withColumn("ticker", cleaned_ticker(F.col("ticker")))
    )


def ticker_inputs(entries: DataFrame) -> DataFrame:
    """Checks typed tickers: adds the cleaned ``ticker`` and whether it is ``valid``."""
    return entries.withColumns(
        {"valid": is_valid_ticker(F.col("text")), "ticker": cleaned_ticker(F.col("text"))}
    )


def _money_sum(value: str) -> Column:
    """Sums whole units and millionths apart, as two bigints: exact, free of overflow for any
    real amount, and much cheaper per row than decimals."""
    units = f"sum(floor({value}))"
    micros = f"sum(cast(rint(({value} - floor({value})) * 1000000) as bigint))"
    return F.expr(f"cast(cast({units} as decimal(25,0)) * 1000000 + {micros} as double) / 1000000")


def _positive(name: str) -> Column:
    return F.coalesce(F.col(name) > 0, F.lit(False)) & ~F.isnan(F.col(name).cast("double"))
