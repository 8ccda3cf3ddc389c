"""The registered queries: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.sessions import bar_session
from marketlake.functions.symbols import feed_symbol
from marketlake.functions.times import ny_from_utc
from marketlake.operators import bars as B
from marketlake.operators import calendar as C
from marketlake.operators import changes as CH
from marketlake.operators import portfolio as P
from marketlake.operators import quality as Q
from marketlake.operators import reference as R
from marketlake.operators import ticks as K
from marketlake.operators import universe as U
from marketlake.plans.lakehouse import Lake, commit_staged, committed, ingest_day, ingest_new_files, load_files, refresh_silver
from marketlake.schemas import RAW_COLUMNS
from marketlake.session import one_day, scratch_path, staged
from marketlake.sources import feeds, lake
from marketlake.sources import raw_files as raw
from marketlake.sources.cache import CacheTable
from marketlake.sources.calendar import rule_calendar
from marketlake.sources.files import rename
from marketlake.sources.lake import to_silver
from marketlake.streaming import live
from marketlake.streaming import watchlists as WL

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "events")


def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(feeds.table(spark, sf, t) for t in ("lineitem", "orders", "part"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.history_bars(feeds.table(spark, sf, "lineitem"), feeds.table(spark, sf, "part"))


def _calendar(spark: SparkSession, which: str) -> DataFrame:
    return rule_calendar(spark, *feeds.CALENDAR_YEARS[which])


_DENSE: dict[tuple[int, str], tuple[SparkSession, DataFrame]] = {}


def _dense(spark: SparkSession, which: str) -> DataFrame:
    """The dense calendar, made once per session and kept in memory: a few thousand rows that
    most queries look up."""
    key = (id(spark), which)
    if key not in _DENSE:
        _DENSE[key] = (spark, C.dense_calendar(_calendar(spark, which)).persist())
    return _DENSE[key][1]


def _silver(spark: SparkSession, sf: str, kind: str = "narrow") -> DataFrame:
    return to_silver(feeds.event_bars(_events(spark, sf), kind))


def _last_date(spark: SparkSession, sf: str) -> DataFrame:
    """The newest date of the history as a one-row table, as a nightly job gets its date."""
    lineitem = feeds.table(spark, sf, "lineitem")
    newest = lineitem.agg(F.to_date(F.max("l_shipdate"))).first()[0]
    return one_day(spark, newest)


def _all_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every date of the history: bounded by the calendar."""
    lineitem = feeds.table(spark, sf, "lineitem")
    return lineitem.select(F.to_date("l_shipdate").alias("as_of")).distinct()


# --- bars -------------------------------------------------------------------------------------


@query
def session_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Events -> minute bars -> New York time -> session -> volume per session."""
    return (
        _silver(spark, sf)
        .groupBy("session")
        .agg(
            F.count(F.lit(1)).alias("bars"),
            F.sum("volume").alias("volume"),
            F.sum("transactions").alias("transactions"),
        )
    )


@query
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session of every single event by its New York clock."""
    wall = ny_from_utc(F.col("ts"))
    return (
        _events(spark, sf)
        .select("event_type", bar_session(wall).alias("session"))
        .groupBy("event_type", "session")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def minute_bars(spark: SparkSession, sf: str) -> DataFrame:
    bars = feeds.event_bars(_events(spark, sf))
    return bars.select(*[c for c in bars.columns if c != "otc"])


@query
def silver_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _silver(spark, sf, "wide").select(
        "ticker", "date", "window_start", "timestamp", "session", "close"
    )


@query
def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.daily_bars(_silver(spark, sf, "wide"))


@query
def history_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)


@query
def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.rolled_bars(_silver(spark, sf), 2, "hour")


@query
def monthly_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Months of daily bars, by the same roll-up."""
    daily = _history(spark, sf).withColumns(
        {
            "timestamp": F.col("date").cast("timestamp_ntz"),
            "window_start": F.col("timestamp_ms") * 1_000_000,
        }
    )
    return B.rolled_bars(daily, 1, "month")


@query
def latest_bar(spark: SparkSession, sf: str) -> DataFrame:
    bars = B.daily_bars(_silver(spark, sf, "wide"), session=None)
    newest = bars.agg(F.to_date(F.max("date"))).first()[0]
    return B.latest_bar(bars, F.lit(newest), 5)


@query
def prev_close_by_bar(spark: SparkSession, sf: str) -> DataFrame:
    return B.previous_bar_close(_history(spark, sf)).select("ticker", "date", "close", "prev_close")


@query
def last_bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.last_bars(_history(spark, sf), 3).select("ticker", "date", "close", "rank")


# --- calendar ---------------------------------------------------------------------------------


@query
def trading_dates(spark: SparkSession, sf: str) -> DataFrame:
    return C.trading_dates(_all_dates(spark, sf), _dense(spark, "history"))


@query
def next_trading_day(spark: SparkSession, sf: str) -> DataFrame:
    days = _all_dates(spark, sf).withColumnRenamed("as_of", "day")
    dense = _dense(spark, "history")
    return C.next_trading_day(days, dense, "day")


@query
def last_trading_day(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines per trading day their ship date settles on (as-of backward on the fact)."""
    lineitem = feeds.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    per_day = lineitem.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    dense = _dense(spark, "history")
    settled = C.last_trading_day(per_day, dense, "day")
    return settled.groupBy("last_trading_day").agg(F.sum("n").alias("lines"))


@query
def trading_day_flag(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, "live")
    events = _events(spark, sf).select("event_id", "ts")
    return C.trading_day_flag(events, dense, "ts").select("event_id", "is_trading_day")


@query
def market_status(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, "live")
    return C.market_status(_events(spark, sf).select("event_id", "ts"), dense, "ts").drop("ts")


@query
def market_status_history(spark: SparkSession, sf: str) -> DataFrame:
    """Status at the quarter hour that each order's price points to, over seven years: covers
    early closes, holidays and daylight-saving changes."""
    dense = _dense(spark, "history")
    minute = F.pmod(F.col("o_totalprice").cast("bigint"), F.lit(96)) * 15
    at = feeds.table(spark, sf, "orders").select(
        "o_orderkey", F.timestamp_add("MINUTE", minute, F.col("o_orderdate")).alias("ts")
    )
    return C.market_status(at, dense, "ts").drop("ts")


# --- performance ------------------------------------------------------------------------------


@query
def reference_closes(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, "history")
    return R.reference_closes(_history(spark, sf), _all_dates(spark, sf), dense)


@query
def performance(spark: SparkSession, sf: str) -> DataFrame:
    """Close-of-day rows for every date of the history."""
    dense = _dense(spark, "history")
    return R.close_of_day(_history(spark, sf), _all_dates(spark, sf), dense)


@query
def close_of_day_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The nightly job: tracked tickers only, as of the newest date."""
    dense = _dense(spark, "history")
    lineitem, orders, part = _facts(spark, sf)
    watch = feeds.user_tickers(lineitem, orders, part)
    universe = U.tracked_universe(watch, feeds.positions(lineitem, orders, part))
    rows = R.close_of_day(_history(spark, sf), _last_date(spark, sf), dense, universe=universe)
    return rows.drop("as_of")


@query
def seed_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for new tickers, as of every date: previous close by bar order."""
    dense = _dense(spark, "history")
    return R.seed_rows(_history(spark, sf), _all_dates(spark, sf), dense)


# --- universe and portfolio -------------------------------------------------------------------


@query
def tracked_universe(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, orders, part = _facts(spark, sf)
    followed = feeds.messages(_events(spark, sf), "brand").select(
        F.regexp_replace("symbol", r"^A\.", "").alias("ticker")
    )
    return U.tracked_universe(followed, feeds.positions(lineitem, orders, part))


@query
def universe_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Tickers of customers and parts against those of the event feeds."""
    buyers = feeds.table(spark, sf, "orders").select(
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("ticker")
    )
    brands = feeds.table(spark, sf, "part").select(F.col("p_brand").alias("ticker"))
    events = _events(spark, sf)
    new = feeds.trades(events, "wide").select("ticker").union(
        feeds.trades(events, "brand").select("ticker")
    )
    return U.universe_diff(buyers.union(brands), new)


@query
def watchlist_report(spark: SparkSession, sf: str) -> DataFrame:
    watch, users, quotes = _watch_inputs(spark, sf)
    return P.watchlist_report(watch, users, quotes)


@query
def watchlist_order(spark: SparkSession, sf: str) -> DataFrame:
    watch, users, _ = _watch_inputs(spark, sf, quotes=False)
    return P.watchlist_order(P.watchlist(watch, users))


@query
def watchlist_sorted(spark: SparkSession, sf: str) -> DataFrame:
    watch, users, quotes = _watch_inputs(spark, sf)
    report = P.watchlist_report(watch, users, quotes)
    return P.sort_by_metric(report, "perf1m").select("username", "ticker", "perf1m", "rank")


@query
def positions_report(spark: SparkSession, sf: str) -> DataFrame:
    return P.positions_order(_positions_report(spark, sf))


@query
def portfolio_totals(spark: SparkSession, sf: str) -> DataFrame:
    return P.portfolio_totals(_positions_report(spark, sf))


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The cache after the close of the newest date. Written out, so that joins see its true size."""
    dense = _dense(spark, "history")
    rows = R.close_of_day(_history(spark, sf), _last_date(spark, sf), dense, 10).drop("as_of")
    return staged(rows, "quotes")


def _watch_inputs(spark: SparkSession, sf: str, quotes: bool = True) -> tuple:
    lineitem, orders, part = _facts(spark, sf)
    watch = feeds.user_tickers(lineitem, orders, part)
    users = feeds.users(feeds.table(spark, sf, "customer"))
    return watch, users, _quotes(spark, sf) if quotes else None


def _positions_report(spark: SparkSession, sf: str) -> DataFrame:
    users = feeds.users(feeds.table(spark, sf, "customer"))
    return P.positions_report(feeds.positions(*_facts(spark, sf)), users, _quotes(spark, sf))


# --- ticks ------------------------------------------------------------------------------------


def _ticks(spark: SparkSession, sf: str, kind: str = "wide") -> DataFrame:
    return K.normalize_ticks(feeds.messages(_events(spark, sf), kind))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return K.enrich(_ticks(spark, sf, "brand"), _quotes(spark, sf))


@query
def normalize_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return _ticks(spark, sf)


@query
def feed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct feed spellings of the tickers people typed."""
    typed = _events(spark, sf).select(F.concat(F.lit(" "), "event_type").alias("text"))
    names = feeds.table(spark, sf, "part").select(F.col("p_brand").alias("text"))
    prefixed = names.select(F.concat(F.lit("a."), "text").alias("text"))
    both = typed.unionByName(names).unionByName(prefixed)
    return both.groupBy(feed_symbol(F.col("text")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query
def ticker_validation(spark: SparkSession, sf: str) -> DataFrame:
    entries = _events(spark, sf).select("event_id", F.concat("event_type", F.lit(" ")).alias("text"))
    return P.ticker_inputs(entries).select("event_id", "ticker", "valid")


@query
def position_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return P.position_inputs(feeds.position_entries(_events(spark, sf)))


@query
def enriched_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf)


@query
def latest_tick(spark: SparkSession, sf: str) -> DataFrame:
    return K.latest_tick(_ticks(spark, sf))


@query
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Close-of-day cache, then the latest live tick of each ticker merged over it."""
    quotes = _quotes(spark, sf)
    live = K.enrich(_ticks(spark, sf, "brand"), quotes)
    return K.merge_cache(quotes, K.cache_fields(K.latest_tick(live)))


@query
def cached_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return K.cached_ticks(_quotes(spark, sf), positive_only=True)


@query
def tick_direction(spark: SparkSession, sf: str) -> DataFrame:
    return K.tick_direction(_ticks(spark, sf, "narrow")).select("seq", "ticker", "price", "direction")


@query
def demo_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of the tickers on an allow-list table (brands of the smallest parts)."""
    return K.allowed_feed(_ticks(spark, sf, "brand"), _allowed(spark, sf)).select("seq", "ticker", "price")


def _allowed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "part").where("p_size = 1").select(F.col("p_brand").alias("ticker"))


# --- change feeds -----------------------------------------------------------------------------


@query
def apply_watchlist_changes(spark: SparkSession, sf: str) -> DataFrame:
    watch = feeds.user_tickers(*_facts(spark, sf))
    return CH.apply_watchlist_changes(watch, feeds.watchlist_changes(_events(spark, sf)))


@query
def reorder_watchlist(spark: SparkSession, sf: str) -> DataFrame:
    watch = feeds.user_tickers(*_facts(spark, sf))
    orders = feeds.watchlist_changes(_events(spark, sf)).where("op = 'reorder'")
    return CH.reorder_watchlist(watch, orders)


@query
def apply_position_changes(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, orders, part = _facts(spark, sf)
    changes = feeds.position_changes(_events(spark, sf), orders)
    out = CH.apply_position_changes(feeds.order_lots(lineitem, orders, part), changes)
    return out.withColumns(
        {"shares": F.col("shares").cast("double"), "cost_basis": F.col("cost_basis").cast("double")}
    )


# --- completeness -----------------------------------------------------------------------------


@query
def counts_per_date(spark: SparkSession, sf: str) -> DataFrame:
    return Q.counts_per_date(feeds.event_bars(_events(spark, sf)))


@query
def missing_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days without a line, between the first and the last of the history."""
    lineitem = feeds.table(spark, sf, "lineitem")
    bars = lineitem.select(F.to_date("l_shipdate").alias("date"))
    first, last = bars.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return Q.missing_sessions(bars, _calendar(spark, "history"))
    return Q.missing_sessions(bars, rule_calendar(spark, first.year, last.year))


@query
def ticker_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of trading days on which a ticker of the history has no bar."""
    return Q.ticker_gaps(_history(spark, sf), _calendar(spark, "history"))


# --- lakehouse files --------------------------------------------------------------------------


def _export(spark: SparkSession, bars: DataFrame) -> list[str]:
    """Bars written out as gzip CSV day files: their paths."""
    root = scratch_path(spark, "day-files")
    raw.write_day_files(bars, root)
    return raw.list_files(spark, raw.exported_globs(root))


def _day(column: str = "date") -> Column:
    return F.substring(column, 9, 2).cast("int")


def _lines(bars: DataFrame, root: str, compression: str = "gzip") -> list[str]:
    """Bars written line by line as one day file a date, its header first, columns ``line`` and ``date``: their paths."""
    head = bars.select("date").distinct().select(F.lit(HEADER).alias("line"), "date", F.lit(0).alias("at"))
    rows = bars.select("line", "date", F.lit(1).alias("at")).unionByName(head)
    rows.repartition("date").sortWithinPartitions("date", "at").select("line", "date").write.partitionBy("date").option(
        "compression", compression
    ).text(root)
    out = []
    for row in spark_files(bars.sparkSession, root):
        name = re.sub(r"/part-(\d+)[^/]*$", r"/part-\1" + raw.SUFFIX, row)
        rename(bars.sparkSession, row, name)
        out.append(name)
    return out


def spark_files(spark: SparkSession, root: str) -> list[str]:
    """The files that Spark has written under ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(root)
    return [r.path for r in found.select("path").collect()]


#: The header of a day file without its last column.
HEADER = ",".join(c for c in RAW_COLUMNS if c != "otc")


def _bar_line(bars: DataFrame, *more: Column) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in RAW_COLUMNS if c != "otc"], *more)


@query
def csv_to_bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Day files under three headers (two orders of columns, one column missing) -> staged -> bronze, loaded twice:
    the second load must change nothing."""
    bars = feeds.event_bars(_events(spark, sf))
    turned = bars.select("date", *reversed(list(RAW_COLUMNS)))
    paths = _export(spark, bars.where(_day() % 3 == 0)) + _export(spark, turned.where(_day() % 3 == 1))
    paths += _export(spark, bars.where(_day() % 3 == 2).drop("otc"))
    tables = Lake(scratch_path(spark, "lake"))
    load_files(spark, paths, tables)
    load_files(spark, paths, tables)
    return lake.read_bronze(spark, tables.path("bronze"))


@query
def daily_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger after two runs of the daily ingest over good, broken, ragged, empty and undated files, some of them
    late, and what bronze and silver hold of each date."""
    root, tables = scratch_path(spark, "raw"), Lake(scratch_path(spark, "lake"))
    bars = feeds.event_bars(_events(spark, sf), "wide")
    bars = bars.withColumn("line", _bar_line(bars))
    kind = _day() % 7
    more = F.when((F.col("window_start") / 60_000_000_000) % 5 == 0, F.concat("line", F.lit(",1"))).otherwise(F.col("line"))
    _lines(bars.where(kind == 0), f"{root}/broken", "none")  # plain text under the name of a gzip file
    _lines(bars.where(kind == 1).withColumn("line", more), f"{root}/ragged")
    _lines(bars.where(kind == 2).select("date").distinct().withColumn("line", F.lit("")), f"{root}/empty")
    _lines(bars.where(kind > 3), f"{root}/good")
    for path in _lines(bars.where(kind == 3).withColumn("date", F.lit("none")), f"{root}/undated"):
        rename(spark, path, path.replace("date=none", "notes"))
    ingest_new_files(spark, root, tables, f"{root}-checkpoint", files_per_run=1000)
    _lines(bars.where(kind == 3), f"{root}/late")
    ingest_new_files(spark, root, tables, f"{root}-checkpoint", files_per_run=3)
    bronze = Q.counts_per_date(lake.read_bronze(spark, tables.path("bronze"))).withColumnRenamed("rows", "bronze_rows")
    silver = Q.counts_per_date(lake.read_silver(spark, tables.path("silver"))).withColumnRenamed("rows", "silver_rows")
    ledger = committed(spark, tables).groupBy("date", "status").agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"))
    return ledger.join(bronze, "date", "left").join(silver, "date", "left")


@query
def commit_retry(spark: SparkSession, sf: str) -> DataFrame:
    """The retry after a correction: some dates are staged again with other closes, one was staged and never committed.
    Bronze after it, and how often each date was loaded."""
    bars = feeds.event_bars(_events(spark, sf))
    tables = Lake(scratch_path(spark, "lake"))
    never = _day() % 10 == 1
    load_files(spark, _export(spark, bars.where(~never)), tables)
    corrected = bars.withColumn("close", F.col("close") + 1000)
    again = raw.read_day_files(spark, _export(spark, corrected.where((_day() % 10 == 2) | never)))
    lake.write_staged(again, tables.path("staged"))  # and here the job was lost
    commit_staged(spark, tables)
    commit_staged(spark, tables)  # nothing is left to do
    loads = committed(spark, tables).select("date", "generation").distinct().groupBy("date").agg(F.count(F.lit(1)).alias("loads"))
    return lake.read_bronze(spark, tables.path("bronze")).select("ticker", "date", "window_start", "close").join(loads, "date")


@query
def single_file(spark: SparkSession, sf: str) -> DataFrame:
    """One day file into a lake that holds the days before it, found by its date; bronze and silver of every date."""
    bars = feeds.event_bars(_events(spark, sf), "wide")
    last = bars.agg(F.max("date")).first()[0]
    tables = Lake(scratch_path(spark, "lake"))
    lake.write_bronze(bars.where(F.col("date") < F.lit(last)), tables.path("bronze"))
    refresh_silver(spark, tables)
    root = scratch_path(spark, "day-files")
    raw.write_day_files(bars.where(F.col("date") >= _days_before(last)), root)
    report = ingest_day(spark, raw.exported_globs(root), tables, last)
    loads = report.where("status = 'ok'").select("date", F.lit(1).cast("long").alias("loads")).distinct()
    counts = [Q.counts_per_date(f(spark, tables.path(n))).withColumnRenamed("rows", n) for f, n in
              ((lake.read_bronze, "bronze"), (lake.read_silver, "silver"))]
    return counts[0].join(counts[1], "date", "full_outer").join(loads, "date", "left")


def _days_before(last: str | None, days: int = 5) -> Column:
    return F.date_format(F.date_sub(F.lit(last).cast("date"), days), "yyyy-MM-dd")


@query
def silver_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze -> silver, then a refresh of one date: other partitions must stay."""
    tables = Lake(scratch_path(spark, "lake"))
    lake.write_bronze(feeds.event_bars(_events(spark, sf), "wide"), tables.path("bronze"))
    refresh_silver(spark, tables)
    refresh_silver(spark, tables, ["2024-01-16"])
    silver = lake.read_silver(spark, tables.path("silver"))
    return silver.select("ticker", "date", "window_start", "timestamp", "session", "close")


@query
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of a load of day files, some with unparsable closes and some without rows."""
    bars = feeds.event_bars(_events(spark, sf), "wide")
    broken = F.when((F.col("volume") == 99) & (F.col("close") > 150), "n.a.")
    bars = bars.withColumn("close", F.coalesce(broken, F.col("close").cast("string")))
    paths = _export(spark, bars.where(_day() % 10 > 0))
    paths += _lines(bars.where(_day() % 10 == 0).select("date").distinct().withColumn("line", F.lit(" ")), scratch_path(spark, "day-files"))
    report = load_files(spark, paths, Lake(scratch_path(spark, "lake")))
    named = F.bool_and(F.col("file").contains(F.col("date"))).alias("named")
    timed = F.bool_and(F.col("seconds") > 0).alias("timed")
    return report.groupBy("date", "status").agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"), named, timed)


# --- streams ----------------------------------------------------------------------------------


def _relay(spark: SparkSession, sf: str, allowed: DataFrame | None = None) -> tuple[CacheTable, str]:
    """Runs all messages, as files, through the stream into a cache and a delta folder."""
    root = scratch_path(spark, "live")
    messages = feeds.messages(_events(spark, sf), "brand")
    messages.repartitionByRange(4, "seq").write.json(f"{root}/messages")
    cache = CacheTable(spark, f"{root}/cache")
    cache.merge(_quotes(spark, sf))
    ticks = K.normalize_ticks(live.json_source(spark, f"{root}/messages", files_per_batch=2))
    emit = live.folder_emitter(f"{root}/out")
    live.start_relay(ticks, cache, emit, f"{root}/checkpoint", allowed).awaitTermination()
    return cache, f"{root}/out"


@query
def stream_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The cache after the stream: equal to the batch merge."""
    return _relay(spark, sf)[0].read()


def _slices(rows: DataFrame, column: str, n: int) -> list[DataFrame]:
    """The rows in ``n`` parts that follow each other in ``column``."""
    edges = rows.approxQuantile(column, [i / n for i in range(1, n)], 0.01)
    low, out = None, []
    for high in [*edges, None]:
        part = rows if low is None else rows.where(F.col(column) >= low)
        out.append(part if high is None else part.where(F.col(column) < high))
        low = high
    return out


@query
def stream_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Price directions on a stream that is stopped and started again twice: equal to the batch lag."""
    root = scratch_path(spark, "directions")
    emit, state = live.folder_emitter(f"{root}/out"), live.direction_state(spark, f"{root}/state", compact_every=2)
    for part in _slices(feeds.messages(_events(spark, sf), "narrow"), "end_timestamp", 3):
        part.write.mode("append").json(f"{root}/messages")
        ticks = K.normalize_ticks(live.json_source(spark, f"{root}/messages", files_per_batch=1000))
        live.start_directions(ticks, state, emit, f"{root}/checkpoint").awaitTermination()
    found = spark.read.schema("seq bigint, ticker string, price double, direction string").json(f"{root}/out/directions")
    return found.drop("batch")


@query
def stream_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """What clients know that connect between two runs of the relay and then get its deltas: the cache."""
    root = scratch_path(spark, "snapshot")
    users = feeds.users(feeds.table(spark, sf, "customer"))
    followed = staged(P.watchlist(feeds.user_tickers(*_facts(spark, sf)), users), "followed")
    cache = CacheTable(spark, f"{root}/cache")
    cache.merge(_quotes(spark, sf))
    messages = None
    for part in _slices(feeds.messages(_events(spark, sf), "brand"), "end_timestamp", 2):
        part.write.mode("append").json(f"{root}/messages")
        ticks = K.normalize_ticks(live.json_source(spark, f"{root}/messages", files_per_batch=1000))
        live.start_relay(ticks, cache, live.folder_emitter(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
        if messages is None:
            first, cut = live.connect(cache, followed)
            messages = staged(first, "messages")
    deltas = K.delta_messages(followed, live.delta_log(spark, f"{root}/out"), cut)
    state = K.client_state(messages.unionByName(deltas, allowMissingColumns=True))
    return state.select("username", "ticker", *[f"tick.{c}" for c in ("price", "change", "changePct", "volume", "timestamp", "perf5d", "perf3y")])


@query
def cache_producers(spark: SparkSession, sf: str) -> DataFrame:
    """Two live streams, a nightly run and seeds in turns, in batches out of order: nothing is lost."""
    cache = CacheTable(spark, f"{scratch_path(spark, 'producers')}/cache", compact_every=2)
    quotes = _quotes(spark, sf)
    day = _last_date(spark, sf).first()[0]
    parts = _slices(_ticks(spark, sf, "brand"), "timestamp", 4)
    late = quotes.where("ticker >= 'Brand#3'")
    cache.merge(quotes.where("ticker < 'Brand#2'"), day)
    for batch_id, (n, producer) in enumerate([(3, "east"), (0, "west"), (1, "east"), (2, "west")]):
        rows = K.cache_fields(K.latest_tick(K.enrich(parts[n], quotes)))
        cache.merge_live(rows, batch_id, producer)
        if batch_id == 1:
            cache.merge_seeds(late, day)
        if batch_id == 2:
            cache.merge(quotes.where("ticker >= 'Brand#2' and ticker < 'Brand#3'"), day)
        cache.merge_live(rows, batch_id, producer)  # a batch that is repeated
    return cache.read()


@query
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are no ticks, by fault, as kept by the receiver, and the numbers it observed."""
    root = scratch_path(spark, "records")
    ticks = _ticks(spark, sf)
    whole = F.to_json(F.struct(*K.TICK_COLUMNS))
    no_ticker = F.to_json(F.struct(*[c for c in K.TICK_COLUMNS if c != "ticker"]))
    no_price = F.to_json(F.struct(*[c for c in K.TICK_COLUMNS if c != "price"]))
    kind = F.pmod("volume", F.lit(9))
    value = F.when(kind == 0, F.substring(whole, 1, 30)).when(kind == 1, no_ticker).when(kind == 2, no_price).otherwise(whole)
    ticks.select(value.alias("value")).repartition(4).write.text(f"{root}/records")
    records = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{root}/records")
    emit = live.folder_emitter(f"{root}/out")
    live.start_receiver(records, emit, f"{root}/checkpoint", lambda t, n: emit(t, "good", n)).awaitTermination()
    kept = spark.read.schema("value string, fault string").json(f"{root}/out/dead_letters").groupBy("fault")
    seen = spark.read.schema("records bigint, dead bigint").json(f"{root}/out/record_counts").agg(F.sum("records").alias("r"), F.sum("dead").alias("d"))
    good = spark.read.schema("ticker string").json(f"{root}/out/good").agg(F.count("ticker").alias("n"))
    totals = seen.select(F.explode(F.create_map(F.lit("(records)"), "r", F.lit("(dead)"), "d")).alias("fault", "n"))
    return kept.agg(F.count("value").alias("n")).union(totals).union(good.select(F.lit("(ticks)"), "n"))


@query
def stream_watchlists(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed as a stream in three runs: equal to the feed applied at once."""
    root = scratch_path(spark, "watchlists")
    table = WL.watchlist_table(spark, f"{root}/table", compact_every=2)
    WL.load_watchlists(table, feeds.user_tickers(*_facts(spark, sf)))
    for part in _slices(feeds.watchlist_changes(_events(spark, sf)), "seq", 3):
        part.write.mode("append").json(f"{root}/changes")
        changes = spark.readStream.schema(WL.WATCHLIST_CHANGE).option("maxFilesPerTrigger", 1000).json(f"{root}/changes")
        WL.start_watchlists(changes, table, f"{root}/checkpoint").awaitTermination()
    return table.read().select("user_id", "ticker", "sort_order")


@query
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest tick of every ticker, kept by a streaming aggregate over two runs: equal to the batch result."""
    root = scratch_path(spark, "latest")
    table = live.latest_table(spark, f"{root}/table", compact_every=2)
    for part in _slices(feeds.messages(_events(spark, sf), "wide"), "seq", 2):
        part.repartition(2).write.mode("append").json(f"{root}/messages")
        ticks = K.normalize_ticks(live.json_source(spark, f"{root}/messages", files_per_batch=1))
        live.start_latest(ticks, table, f"{root}/checkpoint").awaitTermination()
    return table.read()


@query
def stream_demo(spark: SparkSession, sf: str) -> DataFrame:
    """The sub-stream of an allow-list, as the relay sends it: equal to the filtered ticks."""
    _, out = _relay(spark, sf, _allowed(spark, sf))
    body = F.from_json("value", "type string, tick struct<price double>").alias("m")
    return live.delta_log(spark, out, "demo").select("seq", F.col("key").alias("ticker"), body).select("seq", "ticker", "m.tick.price")


@query
def stream_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The delta messages of the stream, parsed back."""
    _, out = _relay(spark, sf)
    records = spark.read.schema("key string, value string").json(f"{out}/ticks")
    body = F.from_json("value", "type string, tick struct<price double, change double, perf5d double>")
    return records.select(F.col("key").alias("ticker"), body.alias("b")).select(
        "ticker", "b.type", "b.tick.price", "b.tick.change", "b.tick.perf5d"
    )
