"""Market data views over the sample tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.times import epoch_micros, ny_from_epoch_ns
from marketlake.operators.bars import minute_bars

CALENDAR_YEARS = {"history": (1991, 2002), "live": (2020, 2024)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _event_ticker(kind: str) -> Column:
    return {
        "narrow": F.upper("event_type"),
        "wide": F.concat(F.lit("U"), F.col("user_id").cast("string")),
        "brand": F.concat(F.lit("Brand#"), (F.pmod(_k(), F.lit(30)) + 1).cast("string")),
    }[kind]


def trades(events: DataFrame, kind: str = "narrow") -> DataFrame:
    """Events as trades: ticker, ts (UTC), event_id, price, volume."""
    return events.select(
        _event_ticker(kind).alias("ticker"),
        "ts",
        "event_id",
        F.col("value").alias("price"),
        _k().alias("volume"),
    )


def event_bars(events: DataFrame, kind: str = "narrow") -> DataFrame:
    """Bronze minute bars of events; ``date`` is the New York date, as in a vendor's day file."""
    bars = minute_bars(trades(events, kind), ["ts", "event_id"])
    day = F.to_date(ny_from_epoch_ns(F.col("window_start"))).cast("string")
    return bars.withColumn("date", day)


def messages(events: DataFrame, kind: str = "wide") -> DataFrame:
    """Events as raw aggregate messages, with missing and zero opens among them."""
    kind_of = F.col("event_type")
    official = F.when(kind_of == "view", 0.0).when(kind_of.isin("click", "purchase"), _k().cast("double"))
    open_ = F.when(kind_of != "error", F.col("value") / 2)
    return events.select(
        F.concat(F.lit("A."), _event_ticker(kind)).alias("symbol"),
        F.col("value").alias("close"),
        open_.alias("open"),
        official.alias("official_open_price"),
        F.call_function("div", epoch_micros(F.col("ts")), F.lit(1000)).alias("end_timestamp"),
        _k().alias("accumulated_volume"),
        F.col("event_id").alias("seq"),
    )


def order_lines(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Line items as trades of a brand. ``part`` grows with the data, so the join is unhinted."""
    lines = lineitem.join(part.select("p_partkey", "p_brand"), lineitem["l_partkey"] == part["p_partkey"])
    return lines.select(
        F.col("p_brand").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("bigint").alias("shares"),
        "l_extendedprice",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def history_bars(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Daily bars of brands: the close is the last line of the day, ties broken by value.

    Line keys are not unique, hence the full ordering struct ending in the price.
    """
    rank = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    midnight = F.unix_date("date").cast("bigint") * 86_400_000
    return (
        order_lines(lineitem, part)
        .groupBy("ticker", "date")
        .agg(
            F.min(rank).getField("price").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max(rank).getField("price").alias("close"),
            F.sum("shares").alias("volume"),
            F.count(F.lit(1)).alias("transactions"),
        )
        .withColumn("timestamp_ms", midnight)
    )


def users(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def positions(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Every order line as a position; ``id`` is the order key (not unique per line)."""
    lines = order_lines(lineitem, part)
    return lines.join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"),
        lines["l_orderkey"] == F.col("o_orderkey"),
    ).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        "ticker",
        F.col("shares").cast("decimal(18,6)").alias("shares"),
        F.col("price").cast("decimal(18,6)").alias("cost_basis"),
        F.col("o_orderdate").alias("opened_at"),
    )


def order_lots(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """One position per order, so that ``id`` is unique: total shares at the average price."""
    lots = (
        order_lines(lineitem, part)
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.min("ticker").alias("ticker"),
            F.sum("shares").alias("n"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("cost"),
        )
    )
    owners = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    average = F.col("cost").cast("double") / F.col("n")
    return lots.join(owners, "id").select(
        "id",
        "user_id",
        "ticker",
        F.col("n").cast("decimal(18,6)").alias("shares"),
        average.cast("decimal(18,6)").alias("cost_basis"),
    )


def user_tickers(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Watchlists: the brands each customer ordered; list position = lowest line number."""
    lines = order_lines(lineitem, part)
    return (
        lines.join(
            orders.select("o_orderkey", "o_custkey"), lines["l_orderkey"] == F.col("o_orderkey")
        )
        .groupBy(F.col("o_custkey").alias("user_id"), "ticker")
        .agg(F.min("l_linenumber").alias("sort_order"))
    )


def watchlist_changes(events: DataFrame) -> DataFrame:
    """Events as watchlist changes of one to four brands each."""
    first = F.pmod(_k(), F.lit(25))
    numbers = F.sequence(first, first + F.pmod(F.col("event_id"), F.lit(4)))
    op = (
        F.when(F.col("event_type").isin("view", "click"), "add")
        .when(F.col("event_type") == "signup", "reorder")
        .otherwise("remove")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        "user_id",
        op.alias("op"),
        F.transform(
            numbers, lambda n: F.concat(F.lit("Brand#"), (F.pmod(n * 7, F.lit(25)) + 1).cast("string"))
        ).alias("tickers"),
    )


def position_changes(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Events as changes of order lots, two per lot; ``view`` changes come from a user who
    usually does not own the lot and must then have no effect; purchases open new lots."""
    target = F.call_function("div", "event_id", F.lit(2))
    kind = F.col("event_type")
    owned = events.withColumn("_order", target).join(
        orders.select(F.col("o_orderkey").alias("_order"), "o_custkey"), "_order"
    )
    is_new = kind == "purchase"
    return owned.select(
        F.col("event_id").alias("seq"),
        F.when(kind == "view", F.col("user_id")).otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(is_new, "add").when(kind == "error", "delete").otherwise("update").alias("op"),
        F.when(is_new, F.col("event_id") + 1_000_000_000_000)
        .otherwise(F.col("_order"))
        .alias("position_id"),
        F.upper("event_type").alias("ticker"),
        (_k() + 1).cast("decimal(18,6)").alias("shares"),
        F.col("value").cast("decimal(18,6)").alias("cost_basis"),
    )


def position_entries(events: DataFrame) -> DataFrame:
    """Events as typed position forms; some tickers are too long, some shares are zero."""
    return events.select(
        "event_id",
        F.concat(F.lit(" "), "event_type").alias("ticker"),
        _k().cast("double").alias("shares"),
        F.col("value").alias("total_cost"),
    )
