import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlake.operators import bars as B
from marketlake.operators import portfolio as P
from marketlake.plans import market
from marketlake.schemas import POSITIONS, USER_TICKERS, USERS
from marketlake.sources import lake, relational
from marketlake.sources import raw_files as raw
from marketlake.sources.cache import CacheTable
from marketlake.sources.calendar import rule_calendar


def minute(ticker, date, clock, close, volume=10.0):
    import zoneinfo

    at = dt.datetime.fromisoformat(f"{date}T{clock}").replace(tzinfo=zoneinfo.ZoneInfo("America/New_York"))
    return (ticker, close, close, close, close, volume, int(at.timestamp()) * 1_000_000_000, 1, date)


COLUMNS = "ticker string, open double, high double, low double, close double, volume double, " \
    "window_start bigint, transactions bigint, date string"


@pytest.fixture
def silver(spark, tmp_path):
    rows = [
        minute("A", "2023-01-12", "10:00", 50.0),
        minute("A", "2023-12-29", "10:00", 80.0),
        minute("A", "2024-01-05", "15:59", 90.0),
        minute("A", "2024-01-10", "10:00", 95.0),
        minute("A", "2024-01-12", "09:30", 98.0),
        minute("A", "2024-01-12", "15:59", 100.0),
        minute("A", "2024-01-12", "19:00", 500.0),  # not in the market session
        minute("B", "2024-01-11", "10:00", 20.0),
        minute("C", "2024-01-12", "10:00", 7.0),  # nobody follows it
    ]
    bars = raw.align(spark.createDataFrame(rows, COLUMNS), F.col("date"))
    path = f"{tmp_path}/silver"
    lake.write_silver(bars, path)
    return path


@pytest.fixture
def book(spark):
    now = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    from decimal import Decimal as Dec

    return {
        "users": spark.createDataFrame([(1, "ann"), (2, "bob")], USERS),
        "user_tickers": spark.createDataFrame([(1, "A", 1), (1, "Q", 0), (2, "B", 0)], USER_TICKERS),
        "positions": spark.createDataFrame(
            [
                (1, 1, "A", Dec(10), Dec("60"), now),
                (2, 1, "N", Dec(50), Dec("178.25"), now),
                (3, 2, "B", Dec(0), Dec("1"), now),
            ],
            POSITIONS,
        ),
    }


def test_nightly_job_and_reports(spark, tmp_path, silver, book):
    cache = CacheTable(spark, f"{tmp_path}/cache")
    calendar = rule_calendar(spark, 2020, 2024)
    market.run_close_of_day(
        spark, silver, calendar, book["user_tickers"], book["positions"], cache, dt.date(2024, 1, 12)
    )
    rows = {r.ticker: r for r in cache.read().collect()}
    assert set(rows) == {"A", "B"}
    a, b = rows["A"], rows["B"]
    assert (a.price, a.volume, a.prevClose, a.change) == (100.0, 20, None, None)  # no bar on 01-11
    assert (a.ref5d, a.ref1y, a.refYtd, a.perf5d, a.perf1y, a.perfYtd) == (90.0, 50.0, 80.0, 11.1111, 100.0, 25.0)
    assert (b.price, b.prevClose, b.change, b.ref5d) == (20.0, 20.0, 0.0, None)

    market.seed_tickers(
        spark, silver, calendar, spark.createDataFrame([("A",)], "ticker string"), cache, dt.date(2024, 1, 12)
    )
    a = {r.ticker: r for r in cache.read().collect()}["A"]
    assert (a.prevClose, a.change, a.changePct) == (95.0, 5.0, 5.2632)  # by bar order

    report = {(r.username, r.id): r for r in market.positions_report(cache, book["positions"], book["users"]).collect()}
    first = report["ann", 1]
    assert (first.marketValue, first.totalCost, first.pl, first.dayPl) == (1000.0, 600.0, 400.0, 50.0)
    unpriced = report["ann", 2]
    assert (unpriced.marketValue, unpriced.pl, unpriced.plPct) == (None, None, None)
    assert report["bob", 3].plPct is None  # nothing paid
    totals = {r.username: r for r in market.portfolio_totals(cache, book["positions"], book["users"]).collect()}
    assert (totals["ann"].totalValue, totals["ann"].totalPl, totals["ann"].grandCost) == (9912.5, 400.0, 9512.5)
    assert totals["bob"].totalPlPct == 0.0

    watch = market.watchlist_report(cache, book["user_tickers"], book["users"]).collect()
    assert [(r.username, r.ticker, r.price) for r in watch] == [("ann", "Q", None), ("ann", "A", 100.0), ("bob", "B", 20.0)]


def test_sort_by_metric_puts_missing_last(spark):
    rows = spark.createDataFrame(
        [("u", "A", 1.0), ("u", "B", None), ("u", "C", 3.0)], "username string, ticker string, perf1m double"
    )
    assert [r.ticker for r in P.sort_by_metric(rows, "perf1m").collect()] == ["C", "A", "B"]
    assert [r.ticker for r in P.sort_by_metric(rows, "perf1m", descending=False).collect()] == ["B", "A", "C"]


def test_ranks_are_per_user_and_shared_by_equals(spark):
    now, later = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)
    rows = [("u", 2, now), ("v", 9, now), ("u", 1, later), ("u", 1, now), ("u", 2, now), ("v", 8, None)]
    got = P.positions_order(spark.createDataFrame(rows, "username string, id long, opened_at timestamp")).collect()
    assert [(r.id, r.rank) for r in got if r.username == "u"] == [(1, 1), (2, 2), (2, 2), (1, 4)]
    assert [(r.id, r.rank) for r in got if r.username == "v"] == [(8, 1), (9, 2)]
    lists = spark.createDataFrame([("v", "B", 0), ("u", "B", 0), ("u", "A", 0), ("u", "C", -1)], "username string, ticker string, sort_order int")
    assert [r.ticker for r in P.watchlist_order(lists).collect() if r.username == "u"] == ["C", "A", "B"]


def test_position_inputs(spark):
    rows = [(" aapl", 10.0, 50.0), ("A1", 1.0, 1.0), ("B", 0.0, 5.0), ("B", None, 5.0), ("B", float("nan"), 5.0), ("B", 5.0, -1.0)]
    got = P.position_inputs(spark.createDataFrame(rows, "ticker string, shares double, total_cost double")).collect()
    assert [(r.ticker, r.cost_basis, r.error) for r in got] == [
        ("AAPL", 5.0, None),
        ("A1", None, "invalid ticker"),
        ("B", None, "shares must be > 0"),
        ("B", None, "shares must be > 0"),
        ("B", None, "shares must be > 0"),
        ("B", None, "total cost must be > 0"),
    ]


@pytest.mark.parametrize(
    "multiplier, span, expected",
    [
        (5, "minute", "2024-01-12 09:30:00"),
        (1, "hour", "2024-01-12 09:00:00"),
        (1, "day", "2024-01-12 00:00:00"),
        (1, "week", "2024-01-08 00:00:00"),
        (1, "month", "2024-01-01 00:00:00"),
        (1, "quarter", "2024-01-01 00:00:00"),
        (1, "year", "2024-01-01 00:00:00"),
        (3, "month", "2024-01-01 00:00:00"),
    ],
)
def test_rolled_bars(spark, multiplier, span, expected):
    rows = spark.createDataFrame([minute("A", "2024-01-12", "09:33", 5.0)], COLUMNS)
    out = B.rolled_bars(lake.to_silver(raw.align(rows, F.col("date"))), multiplier, span)
    assert str(out.first().bucket) == expected


def test_tables_from_parquet(spark, tmp_path, book):
    for name, df in book.items():
        df.write.parquet(f"{tmp_path}/{name}")
    for name, df in book.items():
        got = relational.read_table(spark, name, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
