"""Live ticks: normalise, enrich, keep the latest, direction of the price.

The same functions serve batch tables and Structured Streaming. ``tick_direction`` looks back over the whole
history of a ticker; on a stream, ``directions_after`` continues it from batch to batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.performance import change, change_pct, first_nonzero
from marketlake.functions.symbols import display_ticker
from marketlake.schemas import DEMO_TICKERS, HORIZONS, PERF_COLUMNS, REF_COLUMNS

ZERO_DEFAULTS = [
    "coalesce(change, 0D) as change",
    "coalesce(changePct, 0D) as changePct",
    "coalesce(volume, 0) as volume",
    "coalesce(timestamp, 0) as timestamp",
]
#: Fields of a tick in messages to clients.
SENT_COLUMNS = {
    "ticker": "string", "price": "double", "open": "double", "change": "double", "changePct": "double", "timestamp": "bigint",
    "volume": "bigint", "prevClose": "double", **dict.fromkeys(PERF_COLUMNS, "double"),
}
TICK_COLUMNS = ["ticker", "price", "open", "change", "changePct", "timestamp", "volume", "node"]


def normalize_ticks(messages: DataFrame, node: str = "spark") -> DataFrame:
    """Raw aggregate messages -> ticks. Messages without symbol or close are dropped; an open
    of zero counts as missing; change is against the open until a previous close is known."""
    usable = messages.where("symbol is not null and close is not null")
    ticks = usable.withColumn("_open", first_nonzero("official_open_price", "open", "close"))
    return ticks.select(
        display_ticker(F.col("symbol")).alias("ticker"),
        F.col("close").alias("price"),
        F.col("_open").alias("open"),
        F.expr("close - _open as change"),
        F.expr("coalesce(try_divide(close - _open, _open) * 100, 0D) as changePct"),
        F.expr("coalesce(end_timestamp, 0) as timestamp"),
        F.expr("coalesce(accumulated_volume, 0) as volume"),
        F.lit(node).alias("node"),
        "seq",
    )


def enrich(ticks: DataFrame, cache: DataFrame) -> DataFrame:
    """Ticks with the change against the previous close and the horizon performance.

    Unknown tickers pass through with their open-based change. The join carries no hint: the
    cache is a stored table (one row per ticker), so Spark knows its size and broadcasts it
    below its threshold; above, it sort-merges and AQE splits a hot ticker's rows.
    """
    side = cache.select("ticker", "prevClose", *REF_COLUMNS)
    known = F.col("prevClose").isNotNull()
    pct = change_pct("price", "prevClose")
    out = ticks.join(side, "ticker", "left").withColumns(
        {
            "change": F.when(known, change("price", "prevClose")).otherwise(F.col("change")),
            "changePct": F.when(known, pct).otherwise(F.col("changePct")),
            **{perf: change_pct("price", ref) for ref, perf in HORIZONS.values()},
        }
    )
    return out.select(*ticks.columns, "prevClose", *PERF_COLUMNS)


def latest_tick(ticks: DataFrame) -> DataFrame:
    """The newest tick of each ticker by (timestamp, seq), one partial-aggregated pass."""
    fields = [c for c in ticks.columns if c != "ticker"]
    newest = F.max_by(F.struct(*fields), F.struct("timestamp", "seq")).alias("t")
    return ticks.groupBy("ticker").agg(newest).select("ticker", "t.*")


def cache_fields(ticks: DataFrame) -> DataFrame:
    """What a live tick writes to the cache; it never writes prevClose or reference closes."""
    return ticks.selectExpr("ticker", "price", *ZERO_DEFAULTS, *PERF_COLUMNS)


def merge_cache(cache: DataFrame, updates: DataFrame, only_newer: bool = False) -> DataFrame:
    """Field-wise merge: a null in ``updates`` (or a column it lacks) keeps the cached value.

    ``only_newer`` ignores an update whose timestamp is older than the cached one, so that the
    order in which files of a stream arrive does not matter. Both sides hold one row per
    ticker, so the join keys cannot be skewed.
    """
    fields = [c for c in cache.columns if c != "ticker"]
    shared = [c for c in fields if c in updates.columns]
    joined = cache.join(
        updates.selectExpr("ticker", *[f"{c} as _{c}" for c in shared]), "ticker", "full_outer"
    )
    take = "coalesce(_{0}, {0})"
    if only_newer:
        take = "case when _timestamp < timestamp then {0} else coalesce(_{0}, {0}) end"
    return joined.selectExpr(
        "ticker", *[f"{take.format(c)} as {c}" if c in shared else c for c in fields]
    )


def cached_ticks(cache: DataFrame, positive_only: bool = False) -> DataFrame:
    """Readable ticks of the cache: rows without a price are left out, four fields default to
    zero. ``positive_only`` keeps those with a price above zero (the warm-start set)."""
    usable = cache.where("price > 0" if positive_only else "price is not null")
    return usable.selectExpr("ticker", "price", *ZERO_DEFAULTS, "prevClose", *PERF_COLUMNS)


def allowed_feed(ticks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only ticks whose ticker is on the allow-list table."""
    return ticks.join(allowed.select("ticker").distinct(), "ticker", "left_semi")


def demo_feed(ticks: DataFrame) -> DataFrame:
    """The fixed ten-ticker allow-list as a pushed-down filter."""
    return ticks.where(F.col("ticker").isin(DEMO_TICKERS))


def tick_direction(ticks: DataFrame, bucket_ms: int = 3_600_000, bucket_seqs: int = 1 << 18) -> DataFrame:
    """Adds ``direction``: up or down against the ticker's previous price, else none.

    A plain lag over a ticker would send a hot ticker to one task. Rows are windowed per
    (ticker, time bucket) instead; the last price of each bucket, a table of one row per
    ticker and bucket, carries over to the first row of the next one. Ticks without a time
    (timestamp 0) are in the order of seq alone and are cut into buckets by it.
    """
    order = F.struct("timestamp", "seq")
    untimed = F.when(F.col("timestamp") == 0, F.call_function("div", "seq", F.lit(bucket_seqs))).otherwise(0)
    buckets = {"_bucket": F.call_function("div", "timestamp", F.lit(bucket_ms)), "_part": untimed}
    inside = Window.partitionBy("ticker", *buckets).orderBy("timestamp", "seq")
    rows = ticks.withColumns(buckets).withColumn("_before", F.lag("price").over(inside))
    edges = ticks.withColumns(buckets).groupBy("ticker", *buckets).agg(F.max_by("price", order).alias("_last"))
    across = Window.partitionBy("ticker").orderBy(*buckets)
    carried = edges.select("ticker", *buckets, F.lag("_last").over(across).alias("_carried"))
    prev = F.coalesce("_before", "_carried")
    return (
        rows.join(carried, ["ticker", *buckets])
        .withColumn(
            "direction",
            F.when(F.col("price") > prev, "up").when(F.col("price") < prev, "down").otherwise("none"),
        )
        .select(*ticks.columns, "direction")
    )


def directions_after(ticks: DataFrame, last: DataFrame) -> DataFrame:
    """``tick_direction`` of a micro-batch that follows the ticks ``last(ticker, timestamp, seq, price)``, one per ticker.

    A tick that is older than the last one of its ticker came too late to be compared with its predecessor: it is
    compared with other late ones only, and never with newer ticks.
    """
    known = last.join(ticks.select("ticker").distinct(), "ticker", "left_semi").withColumn("_known", F.lit(True))
    rows = ticks.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    return tick_direction(rows).where("not _known").select(*ticks.columns, "direction")


def last_prices(ticks: DataFrame) -> DataFrame:
    """(ticker, timestamp, seq, price) of the newest tick of each ticker."""
    newest = F.max(F.struct("timestamp", "seq", "price")).alias("t")
    return ticks.groupBy("ticker").agg(newest).select("ticker", "t.*")


def tick_envelopes(ticks: DataFrame, *keep: str) -> DataFrame:
    """Delta messages: (key, value) with ``{"type":"tick","tick":{...}}``, and the columns to
    ``keep`` beside them; absent fields are left out of the JSON."""
    return ticks.select(F.col("ticker").alias("key"), _tick_message(ticks).alias("value"), *keep)


def _tick_message(ticks: DataFrame) -> Column:
    fields = [c for c in ticks.columns if c in SENT_COLUMNS]
    return F.to_json(F.struct(F.lit("tick").alias("type"), F.struct(*fields).alias("tick")))


def snapshot_messages(followed: DataFrame, ticks: DataFrame, batch: int | None) -> DataFrame:
    """What each user of ``followed(username, ticker)`` gets on connect: (username, batch, step, ticker, value).

    A client replaces its state at a snapshot message. So step 0 is a snapshot without ticks, which resets it and
    carries the batch of the cache that follows, and step 1 sends the ticks of the user's tickers one by one. No
    message grows with the table or the watchlist. ``batch`` is that of the live stream, None before its first.
    """
    cut = F.lit(-1 if batch is None else batch).cast("long")
    no_ticks = F.create_map().cast("map<string,string>")
    reset = F.to_json(F.struct(F.lit("snapshot").alias("type"), no_ticks.alias("ticks"), cut.alias("batch")))
    resets = followed.select("username").distinct()
    resets = resets.select("username", cut.alias("batch"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("ticker"), reset.alias("value"))
    rows = followed.select("username", "ticker").join(ticks.withColumn("value", _tick_message(ticks)).select("ticker", "value"), "ticker")
    return resets.unionByName(rows.select("username", cut.alias("batch"), F.lit(1).alias("step"), "ticker", "value"))


def delta_messages(followed: DataFrame, deltas: DataFrame, batch: int | None) -> DataFrame:
    """The deltas (batch, key, value, timestamp, seq) after batch ``batch`` for the users of ``followed``: as above, step 2,
    with timestamp and seq. Of a ticker's deltas in one batch the newest is sent, as it replaces the others at once: so
    a busy ticker costs its followers one message a batch."""
    newest = F.max(F.struct("timestamp", "seq", "value")).alias("d")
    later = deltas.where(F.col("batch") > (-1 if batch is None else batch)).groupBy("batch", F.col("key").alias("ticker")).agg(newest)
    later = later.select("batch", "ticker", "d.*")
    return followed.select("username", "ticker").join(later, "ticker").select(
        "username", "batch", F.lit(2).alias("step"), "ticker", "value", "timestamp", "seq"
    )


def client_state(messages: DataFrame) -> DataFrame:
    """(username, ticker, tick) that a client ends with: at a snapshot it replaces what it has, at a tick it
    replaces that ticker's. Messages come in the order (batch, step, timestamp, seq)."""
    order = F.struct("batch", "step", "timestamp", "seq")
    body = F.from_json("value", f"type string, tick struct<{', '.join(f'{n}:{t}' for n, t in SENT_COLUMNS.items())}>").alias("m")
    rows = messages.select("username", "ticker", order.alias("at"), body)
    resets = rows.where("m.type = 'snapshot'").groupBy("username").agg(F.max("at").alias("reset"))
    newest = rows.where("m.type = 'tick'").groupBy("username", "ticker").agg(F.max("at").alias("at"), F.max_by("m.tick", "at").alias("tick"))
    kept = newest.join(resets, "username", "left").where("reset is null or at > reset")
    return kept.select("username", "ticker", "tick")


def snapshot_envelopes(ticks: DataFrame) -> DataFrame:
    """Snapshot messages, one ticker each: ``{"type":"snapshot","ticks":{T:{...}}}``, for consumers that add
    them up. A client that replaces its state at each of them needs ``snapshot_messages``.
    """
    fields = [c for c in ticks.columns if c not in ("seq", "node")]
    body = F.struct(
        F.lit("snapshot").alias("type"), F.create_map("ticker", F.struct(*fields)).alias("ticks")
    )
    return ticks.select(F.col("ticker").alias("key"), F.to_json(body).alias("value"))


def tick_messages(ticks: DataFrame) -> DataFrame:
    """Keyed JSON records for a topic: key = ticker, value = the tick."""
    return ticks.select(
        F.col("ticker").alias("key"), F.to_json(F.struct(*TICK_COLUMNS)).alias("value")
    )
