import datetime as dt
import zoneinfo

import pytest

from marketlake.operators import calendar as C
from marketlake.sources.calendar import read_calendar, rule_calendar

NY = zoneinfo.ZoneInfo("America/New_York")
D = dt.date.fromisoformat


@pytest.fixture(scope="module")
def calendar(spark):
    return rule_calendar(spark, 2020, 2024).persist()


@pytest.fixture(scope="module")
def dense(calendar):
    return C.dense_calendar(calendar).persist()


def test_known_closings(calendar):
    rows = {r.date: r for r in calendar.collect()}
    closed = {d for d, r in rows.items() if r.close_minute is None and d.year == 2024}
    assert closed == {
        D(d)
        for d in (
            "2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 "
            "2024-09-02 2024-11-28 2024-12-25"
        ).split()
    }
    early = {d for d, r in rows.items() if r.close_minute == 780 and d.year == 2024}
    assert early == {D("2024-07-03"), D("2024-11-29"), D("2024-12-24")}
    assert D("2021-12-24") in rows and rows[D("2021-12-24")].close_minute is None
    assert D("2022-01-01") not in rows  # a Saturday
    assert rows[D("2021-12-31")].close_minute == 960  # not made up for
    per_year = {y: sum(r.close_minute is not None for d, r in rows.items() if d.year == y) for y in range(2020, 2025)}
    assert per_year == {2020: 253, 2021: 252, 2022: 251, 2023: 250, 2024: 252}


def test_dense_against_loop(calendar, dense):
    sessions = {r.date: r.close_minute for r in calendar.collect() if r.close_minute}
    days = sorted(sessions)
    for r in dense.collect():
        before = [d for d in days if d <= r.day]
        after = [d for d in days if d > r.day]
        assert r.is_trading_day == (r.day in sessions)
        assert r.last_trading_day == before[-1]
        assert r.prev_trading_day == (before[-2] if len(before) > 1 else None)
        if after:
            assert r.following_trading_day == after[0]
            assert r.following_close_minute == sessions[after[0]]
            assert r.next_trading_day == (r.day if r.day in sessions else after[0])


def test_forward_look_up_reaches_ten_days(spark):
    rows = [(D("2024-01-02"), 960, None), (D("2024-01-14"), 960, None)]
    dense = C.dense_calendar(spark.createDataFrame(rows, "date date, close_minute int, holiday_name string"))
    got = {r.day.day: (r.next_trading_day.day, r.following_trading_day.day) for r in dense.collect()}
    assert got[2] == (2, 3)  # following: from the 3rd, the 14th is out of reach
    assert got[3] == (3, 14)
    assert got[4] == (14, 14)


@pytest.mark.parametrize(
    "as_of, expected",
    [
        ("2024-01-12", dict(prev="2024-01-11", **{"5d": "2024-01-05", "1m": "2023-12-12", "3m": "2023-10-12",
         "6m": "2023-07-12", "1y": "2023-01-12", "3y": "2021-01-12", "ytd": "2023-12-29"})),
        ("2024-01-15", dict(prev="2024-01-11", **{"5d": "2024-01-05", "ytd": "2023-12-29"})),
        ("2024-01-01", dict(prev="2023-12-28", ytd="2023-12-29")),
        ("2024-03-31", {"1m": "2024-02-28", "prev": "2024-03-27"}),
    ],
)
def test_reference_dates(spark, dense, as_of, expected):
    days = spark.createDataFrame([(D(as_of),)], "as_of date")
    got = {r.label: str(r.ref_date) for r in C.reference_dates(days, dense).collect()}
    assert {k: got[k] for k in expected} == expected


def test_reference_dates_need_two_sessions(spark, dense):
    days = spark.createDataFrame([(D("2020-01-02"),), (D("2020-01-03"),)], "as_of date")
    got = {(r.as_of, r.label) for r in C.reference_dates(days, dense).collect()}
    assert got == {(D("2020-01-03"), "prev")}


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=NY).astimezone(dt.UTC).replace(tzinfo=None)


def unix(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=NY).timestamp())


STATUS = [
    ("2024-01-15 10:00", "closed", True, "2024-01-16 04:00", "2024-01-16 20:00"),
    ("2024-11-29 13:30", "post-market", False, "2024-12-02 04:00", "2024-11-29 16:00"),
    ("2024-11-29 16:30", "closed", False, "2024-12-02 04:00", "2024-12-02 20:00"),
    ("2024-11-29 03:00", "closed", False, "2024-11-29 04:00", "2024-11-29 16:00"),
    ("2024-11-29 12:59", "open", False, "2024-12-02 04:00", "2024-11-29 16:00"),
    ("2024-01-16 09:29", "pre-market", False, "2024-01-17 04:00", "2024-01-16 20:00"),
    ("2024-01-16 16:00", "post-market", False, "2024-01-17 04:00", "2024-01-16 20:00"),
    ("2024-01-16 20:00", "closed", False, "2024-01-17 04:00", "2024-01-17 20:00"),
    ("2024-01-13 12:00", "closed", False, "2024-01-16 04:00", "2024-01-16 20:00"),
    ("2024-03-08 21:00", "closed", False, "2024-03-11 04:00", "2024-03-11 20:00"),
    ("2024-11-27 21:00", "closed", False, "2024-11-29 04:00", "2024-11-29 16:00"),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_market_status(spark, dense, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(c[0], at(c[0])) for c in STATUS], "k string, ts timestamp_ntz")
        got = {r.k: r for r in C.market_status(df, dense, "ts").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for k, session, holiday, next_open, next_close in STATUS:
        r = got[k]
        assert (r.session, r.is_holiday, r.next_open, r.next_close) == (
            session, holiday, unix(next_open), unix(next_close)
        ), k
        assert r.holiday_name == ("Market Holiday" if holiday else None)


def test_calendar_table_is_checked(spark, tmp_path):
    rows = [(D("1800-01-02"), 960, None), (D("2024-01-02"), 960, None)]
    spark.createDataFrame(rows, "date date, close_minute int, holiday_name string").write.parquet(f"{tmp_path}/c")
    with pytest.raises(ValueError):
        read_calendar(spark, f"{tmp_path}/c")
    with pytest.raises(ValueError):
        rule_calendar(spark, 1800, 2024)


def test_nothing_is_said_outside_the_calendar(spark, dense):
    """Noon in New York on the last trading day, the Wednesday after the calendar and one before it."""
    rows = [(d, dt.datetime.combine(D(d), dt.time(17))) for d in ("2024-12-31", "2025-01-08", "2019-12-18")]
    at = spark.createDataFrame(rows, "day string, ts timestamp_ntz")
    found = {r.day: r for r in C.market_status(at, dense, "ts").collect()}
    last = found["2024-12-31"]
    assert (last.session, last.is_holiday, last.holiday_name, last.next_open) == ("open", False, None, None)
    assert last.next_close == int(dt.datetime(2024, 12, 31, 20, tzinfo=NY).timestamp())
    for day in ("2025-01-08", "2019-12-18"):
        r = found[day]
        assert (r.session, r.is_holiday, r.holiday_name, r.next_open, r.next_close) == (None,) * 5
    flags = {r.day: r.is_trading_day for r in C.trading_day_flag(at, dense, "ts").collect()}
    assert flags == {"2024-12-31": True, "2025-01-08": None, "2019-12-18": None}
