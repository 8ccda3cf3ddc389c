import json

import pytest
from pyspark.sql import functions as F

from marketlake.operators import ticks as K
from marketlake.schemas import CACHE, MESSAGE, TICK
from marketlake.sources.cache import CacheTable
from marketlake.streaming import live


def cache_rows(spark, *rows):
    base = dict.fromkeys(CACHE.fieldNames())
    return spark.createDataFrame([{**base, **r} for r in rows], CACHE)


def write_messages(spark, path, rows):
    df = spark.createDataFrame(
        [(f"A.{t}", p, p / 2, None, ts, 1, seq) for t, p, ts, seq in rows], MESSAGE
    )
    df.coalesce(1).write.mode("append").json(path)


def as_dict(df, *columns):
    return {r.ticker: tuple(r[c] for c in columns) for r in df.collect()}


def test_merge_keeps_absent_fields(spark, tmp_path):
    cache = CacheTable(spark, f"{tmp_path}/cache")
    assert cache.read().count() == 0
    cache.merge(cache_rows(spark, {"ticker": "A", "price": 1.0, "perf5d": 5.0}))
    cache.merge(cache_rows(spark, {"ticker": "A", "price": 9.0}, {"ticker": "B", "price": 2.0}))
    assert as_dict(cache.read(), "price", "perf5d") == {"A": (9.0, 5.0), "B": (2.0, None)}
    version = cache.version()
    cache.merge(cache_rows(spark, {"ticker": "B", "price": 2.0}))  # a repeated merge
    assert cache.version() == version + 1
    assert as_dict(cache.read(), "price") == {"A": (9.0,), "B": (2.0,)}


def test_older_update_is_ignored_only_on_request(spark):
    old = cache_rows(spark, {"ticker": "A", "price": 1.0, "timestamp": 10})
    new = cache_rows(spark, {"ticker": "A", "price": 2.0, "timestamp": 9})
    assert as_dict(K.merge_cache(old, new, only_newer=True), "price") == {"A": (1.0,)}
    assert as_dict(K.merge_cache(old, new), "price") == {"A": (2.0,)}


def test_cached_tick_defaults(spark):
    rows = cache_rows(spark, {"ticker": "A", "price": 0.0}, {"ticker": "B", "prevClose": 3.0}, {"ticker": "C", "price": 2.0})
    assert as_dict(K.cached_ticks(rows), "change", "volume", "timestamp", "prevClose") == {
        "A": (0.0, 0, 0, None), "C": (0.0, 0, 0, None)
    }
    assert set(as_dict(K.cached_ticks(rows, positive_only=True), "price")) == {"C"}


def test_enrich_unknown_ticker_passes_through(spark):
    ticks = spark.createDataFrame([("A", 10.0, 8.0, 2.0, 25.0, 1, 1, "n", 1), ("X", 10.0, 8.0, 2.0, 25.0, 1, 1, "n", 2)], TICK)
    cache = cache_rows(spark, {"ticker": "A", "prevClose": 5.0, "ref5d": 4.0, "ref1m": 0.0})
    got = as_dict(K.enrich(ticks, cache), "change", "changePct", "perf5d", "perf1m", "prevClose")
    assert got == {"A": (5.0, 100.0, 150.0, None, 5.0), "X": (2.0, 25.0, None, None, None)}


def test_direction_crosses_buckets(spark):
    hour = 3_600_000
    prices = [(0, 1.0), (1, 2.0), (2, 2.0), (5 * hour, 1.5), (5 * hour + 1, 1.5), (9 * hour, 7.0)]
    rows = [("A", p, 1.0, 0.0, 0.0, ts, 1, "n", i) for i, (ts, p) in enumerate(prices)]
    got = K.tick_direction(spark.createDataFrame(rows, TICK)).orderBy("seq").collect()
    assert [r.direction for r in got] == ["none", "up", "none", "down", "none", "up"]


def test_envelopes(spark):
    ticks = spark.createDataFrame([("A", 10.0, 8.0, 2.0, 25.0, 1, 1, "n", 1)], TICK)
    body = json.loads(K.tick_envelopes(ticks).first().value)
    assert body == {
        "type": "tick",
        "tick": {"ticker": "A", "price": 10.0, "open": 8.0, "change": 2.0, "changePct": 25.0, "timestamp": 1, "volume": 1},
    }
    snap = json.loads(K.snapshot_envelopes(ticks).first().value)
    assert snap["type"] == "snapshot" and snap["ticks"]["A"]["price"] == 10.0


def test_demo_feed(spark):
    ticks = spark.createDataFrame([(t, 1.0, 1.0, 0.0, 0.0, 1, 1, "n", 1) for t in ("AAPL", "ZZZ", "V")], TICK)
    assert {r.ticker for r in K.demo_feed(ticks).collect()} == {"AAPL", "V"}


@pytest.fixture
def relay(spark, tmp_path):
    cache = CacheTable(spark, f"{tmp_path}/cache")
    cache.merge(cache_rows(spark, {"ticker": "AAPL", "price": 4.0, "timestamp": 0, "prevClose": 5.0, "ref5d": 4.0}))
    source = f"{tmp_path}/messages"

    def run():
        ticks = K.normalize_ticks(live.json_source(spark, source, files_per_batch=1))
        live.start_relay(ticks, cache, live.folder_emitter(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()

    return cache, source, run, f"{tmp_path}/out"


def test_relay_equals_batch_restarts_and_never_repeats(spark, relay):
    cache, source, run, out = relay
    start = cache.read()
    first = [("AAPL", 10.0, 5, 1), ("X", 1.0, 6, 2), ("AAPL", 12.0, 9, 3)]
    second = [("AAPL", 8.0, 7, 4), ("X", 3.0, 8, 5)]  # the AAPL tick is older than one seen
    write_messages(spark, source, first)
    run()
    write_messages(spark, source, second)
    run()
    run()  # nothing new
    deltas = spark.read.schema("key string, value string, batch int").json(f"{out}/ticks").collect()
    assert sorted(r.key for r in deltas) == ["AAPL", "AAPL", "AAPL", "X", "X"]
    demo = spark.read.schema("key string, value string").json(f"{out}/demo").collect()
    assert {r.key for r in demo} == {"AAPL"} and len(demo) == 3
    messages = spark.read.schema(MESSAGE).json(source)
    batch = K.cache_fields(K.latest_tick(K.enrich(K.normalize_ticks(messages), start)))
    expected = K.merge_cache(start, batch)
    assert sorted(map(tuple, cache.read().collect())) == sorted(map(tuple, expected.collect()))
    assert as_dict(cache.read(), "price", "change", "perf5d") == {
        "AAPL": (12.0, 7.0, 200.0), "X": (3.0, 1.5, None)
    }


def test_refreshed_reference_is_seen_by_the_next_batch(spark, relay):
    cache, source, run, _ = relay
    write_messages(spark, source, [("AAPL", 10.0, 5, 1)])
    run()
    cache.merge(cache_rows(spark, {"ticker": "AAPL", "prevClose": 8.0}))
    write_messages(spark, source, [("AAPL", 10.0, 6, 2)])
    run()
    assert as_dict(cache.read(), "change") == {"AAPL": (2.0,)}


def test_snapshot(spark, relay):
    cache, source, run, _ = relay
    cache.merge(cache_rows(spark, {"ticker": "ZERO", "price": 0.0}))
    keys = [r.key for r in live.snapshot(cache).collect()]
    assert keys == ["AAPL"]


def test_publish_then_parse(spark, tmp_path):
    write_messages(spark, f"{tmp_path}/m", [("A", 10.0, 5, 1), ("B", 4.0, 6, 2)])
    messages = live.json_source(spark, f"{tmp_path}/m")
    live.publish_ticks(messages, f"{tmp_path}/cp", node="n1", format="json", path=f"{tmp_path}/topic").trigger(
        availableNow=True
    ).start().awaitTermination()
    records = spark.read.schema("key string, value string").json(f"{tmp_path}/topic")
    broken = spark.createDataFrame([("C", "{not json")], records.schema)
    got = live.parse_ticks(records.union(broken), F.lit(1)).collect()
    assert {(r.ticker, r.price, r.open, r.node) for r in got} == {("A", 10.0, 5.0, "n1"), ("B", 4.0, 2.0, "n1")}


def test_latest_state_stream(spark, tmp_path):
    write_messages(spark, f"{tmp_path}/m", [("A", 1.0, 5, 1), ("A", 2.0, 7, 2)])
    write_messages(spark, f"{tmp_path}/m", [("A", 3.0, 6, 3), ("B", 4.0, 1, 4)])
    ticks = K.normalize_ticks(live.json_source(spark, f"{tmp_path}/m", files_per_batch=1))
    query = (
        live.latest_state(ticks).writeStream.outputMode("complete").format("memory").queryName("latest_state")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert as_dict(spark.table("latest_state"), "price") == {"A": (2.0,), "B": (4.0,)}
