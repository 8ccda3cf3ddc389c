"""Table and stream schemas.

Column names, types and label lists below are fixed values: stored tables and messages must
carry exactly these names.
"""

from __future__ import annotations

from pyspark.sql import types as T

RAW_COLUMNS = {
    "ticker": T.StringType(),
    "volume": T.DoubleType(),
    "open": T.DoubleType(),
    "close": T.DoubleType(),
    "high": T.DoubleType(),
    "low": T.DoubleType(),
    "window_start": T.LongType(),
    "transactions": T.LongType(),
    "otc": T.StringType(),
}

BRONZE = T.StructType(
    [T.StructField(n, t) for n, t in RAW_COLUMNS.items()] + [T.StructField("date", T.StringType())]
)

SILVER = T.StructType(
    BRONZE.fields
    + [T.StructField("timestamp", T.TimestampNTZType()), T.StructField("session", T.StringType())]
)

# Raw per-second/per-minute aggregate messages, before normalising.
MESSAGE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("official_open_price", T.DoubleType()),
        T.StructField("end_timestamp", T.LongType()),
        T.StructField("accumulated_volume", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

TICK = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("change", T.DoubleType()),
        T.StructField("changePct", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("volume", T.LongType()),
        T.StructField("node", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

# Performance horizons: label -> (reference close column, performance column).
HORIZONS = {
    "5d": ("ref5d", "perf5d"),
    "1m": ("ref1m", "perf1m"),
    "3m": ("ref3m", "perf3m"),
    "6m": ("ref6m", "perf6m"),
    "1y": ("ref1y", "perf1y"),
    "ytd": ("refYtd", "perfYtd"),
    "3y": ("ref3y", "perf3y"),
}
REF_COLUMNS = [ref for ref, _ in HORIZONS.values()]
PERF_COLUMNS = [perf for _, perf in HORIZONS.values()]

# One row per ticker: latest tick fields, previous close, horizons.
CACHE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("change", T.DoubleType()),
        T.StructField("changePct", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("prevClose", T.DoubleType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in PERF_COLUMNS + REF_COLUMNS]
)

CALENDAR = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("close_minute", T.IntegerType()),
        T.StructField("holiday_name", T.StringType()),
    ]
)

USERS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("username", T.StringType())]
)

USER_TICKERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("sort_order", T.IntegerType()),
    ]
)

POSITIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("shares", T.DecimalType(18, 6)),
        T.StructField("cost_basis", T.DecimalType(18, 6)),
        T.StructField("opened_at", T.TimestampType()),
    ]
)
# Tickers shown to demo subscribers.
DEMO_TICKERS = ["AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "TSLA", "META", "JPM", "V", "UNH"]
