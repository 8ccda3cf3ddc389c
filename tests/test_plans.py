"""The plans that must hold at scale."""

import contextlib
import datetime as dt
import io

import pytest

from marketlake.operators import bars as B
from marketlake.operators import reference as R
from marketlake.operators import ticks as K
from marketlake.operators.calendar import dense_calendar
from marketlake.plans.market import silver_on
from marketlake.queries import REGISTRY
from marketlake.session import one_day
from marketlake.sources import feeds, lake
from marketlake.sources.calendar import rule_calendar

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(REGISTRY[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert bad not in text, text


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake") / "silver")
    lake.write_silver(feeds.event_bars(feeds.table(spark, SF, "events"), "wide"), path)
    return lake.read_silver(spark, path)


def test_daily_bars_keep_the_hash_aggregate_and_prune_columns(silver):
    text = plan(B.daily_bars(silver).select("ticker", "date", "close"))
    assert "SortAggregate" not in text
    scan = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "high" not in scan and "transactions" not in scan
    assert "PushedFilters: [IsNotNull(session), EqualTo(session,market)" in text


def test_nightly_job_reads_only_its_dates(spark, silver):
    """A dozen literal dates prune the partitions of silver, and the semi join on the dates
    sits below the aggregate."""
    dense = dense_calendar(rule_calendar(spark, 2020, 2024))
    day = one_day(spark, dt.date(2024, 1, 12))
    bars = B.daily_bars(silver_on(silver, day, dense, 5))
    text = plan(R.close_of_day(bars, day, dense))
    filters = next(line for line in text.splitlines() if line.startswith("PartitionFilters"))
    assert filters.count("2024-01-") + filters.count("202") >= 8 and "date#" in filters
    tree = text.splitlines()
    semi = next(i for i, line in enumerate(tree) if "LeftSemi" in line)
    group = max(i for i, line in enumerate(tree[:semi]) if "HashAggregate" in line)
    assert group < semi


def test_look_back_is_a_partition_filter(spark, silver):
    from pyspark.sql import functions as F

    text = plan(B.latest_bar(B.daily_bars(silver), F.to_date(F.lit("2024-01-12")), 5))
    filters = next(line for line in text.splitlines() if line.startswith("PartitionFilters"))
    assert "date#" in filters and ">=" in filters


def test_silver_refresh_does_not_shuffle(spark, tmp_path):
    bars = feeds.event_bars(feeds.table(spark, SF, "events"), "wide")
    lake.write_bronze(bars, f"{tmp_path}/bronze")
    bronze = lake.read_bronze(spark, f"{tmp_path}/bronze").where("date in ('2024-01-16')")
    text = plan(lake.to_silver(bronze))
    assert "Exchange" not in text
    filters = next(line for line in text.splitlines() if line.startswith("PartitionFilters"))
    assert "2024-01-16" in filters


def test_status_does_not_shuffle_the_events(spark):
    dense = dense_calendar(rule_calendar(spark, 2020, 2024))
    from marketlake.operators.calendar import market_status

    text = plan(market_status(feeds.table(spark, SF, "events"), dense, "ts"))
    assert "BroadcastExchange" in text and "hashpartitioning" not in text


def test_enrich_broadcasts_a_small_stored_cache_only(spark, tmp_path):
    ticks = K.normalize_ticks(feeds.messages(feeds.table(spark, SF, "events"), "wide"))
    rows = REGISTRY["seed_cache"](spark, SF).drop("as_of").dropDuplicates(["ticker"])
    rows.write.parquet(f"{tmp_path}/cache")
    cache = spark.read.parquet(f"{tmp_path}/cache")
    assert "hashpartitioning" not in plan(K.enrich(ticks, cache))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(K.enrich(ticks, cache))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text


def test_direction_windows_are_keyed_by_time_bucket(spark):
    ticks = K.normalize_ticks(feeds.messages(feeds.table(spark, SF, "events"), "narrow"))
    text = plan(K.tick_direction(ticks))
    windows = [line for line in text.splitlines() if "windowspecdefinition" in line and "lag(price" in line]
    assert windows and all("_bucket" in w for w in windows)
