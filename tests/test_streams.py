"""Streams that keep state from batch to batch: directions, snapshots, dead letters, watchlists."""

import json

from pyspark.sql import functions as F

from marketlake.operators import changes as CH
from marketlake.operators import ticks as K
from marketlake.operators.quality import ticker_gaps
from marketlake.schemas import CACHE, TICK, USER_TICKERS
from marketlake.sources.cache import CacheTable
from marketlake.sources.calendar import rule_calendar
from marketlake.streaming import live
from marketlake.streaming import watchlists as WL

HOUR = 3_600_000


def ticks_of(spark, *rows):
    return spark.createDataFrame([(t, p, 1.0, 0.0, 0.0, ts, 1, "n", seq) for t, p, ts, seq in rows], TICK)


def emitted(spark, root, schema):
    return spark.read.schema(schema).json(f"{root}/directions").collect()


def test_directions_go_on_from_batch_to_batch_and_repeats_change_nothing(spark, tmp_path):
    state, out = live.direction_state(spark, f"{tmp_path}/state", compact_every=2), f"{tmp_path}/out"
    batches = [
        [("A", 1.0, 1, 1), ("A", 2.0, 2 * HOUR, 2), ("B", 5.0, 3, 3)],
        [("A", 2.0, 3 * HOUR, 4), ("B", 4.0, 4, 5), ("C", 1.0, 5, 6)],
        [("A", 1.5, 4 * HOUR, 7), ("B", 4.5, 1, 8), ("B", 4.25, 6, 9), ("B", 4.75, 2, 10)],  # two that came late
        [("A", 1.75, 5 * HOUR, 11)],
    ]
    for n, rows in enumerate(batches):
        for _ in range(2):  # every batch fails once after its work is done
            live.direction_batch(ticks_of(spark, *rows), n, state, live.folder_emitter(out))
    got = {r.seq: r.direction for r in emitted(spark, out, "seq bigint, direction string")}
    assert got == {1: "none", 2: "up", 3: "none", 4: "none", 5: "down", 6: "none", 7: "down", 8: "none", 9: "up", 10: "up", 11: "up"}


def test_directions_restart_in_the_middle(spark, tmp_path):
    rows = [(t, float((i * 7919) % 13), 1000 + i * 600_000, i) for i in range(60) for t in ("A", "B") if (i + ord(t)) % 3]
    whole = ticks_of(spark, *rows)
    state, out = live.direction_state(spark, f"{tmp_path}/state"), f"{tmp_path}/out"
    for low in (0, 20, 40):
        whole.where(F.col("seq").between(low, low + 19)).write.mode("append").json(f"{tmp_path}/ticks")
        stream = live.json_source(spark, f"{tmp_path}/ticks", TICK)
        live.start_directions(stream, state, live.folder_emitter(out), f"{tmp_path}/cp").awaitTermination()
    expected = {(r.ticker, r.seq, r.direction) for r in K.tick_direction(whole).collect()}
    assert {(r.ticker, r.seq, r.direction) for r in emitted(spark, out, "ticker string, seq bigint, direction string")} == expected


def test_ticks_without_time_are_cut_by_seq(spark):
    rows = [("A", float(i % 3), 0, i) for i in range(50)]
    plain = {r.seq: r.direction for r in K.tick_direction(ticks_of(spark, *rows)).collect()}
    assert {r.seq: r.direction for r in K.tick_direction(ticks_of(spark, *rows), bucket_seqs=7).collect()} == plain
    assert plain[3] == "down" and plain[4] == "up"


def cache_rows(spark, *data):
    base = dict.fromkeys(CACHE.fieldNames())
    return spark.createDataFrame([{**base, **r} for r in data], CACHE)


def fold(messages):
    """What a client does, message by message."""
    state = {}
    for m in messages:
        body = json.loads(m)
        if body["type"] == "snapshot":
            state = dict(body["ticks"])
        elif body["type"] == "tick":
            state[body["tick"]["ticker"]] = body["tick"]
    return {k: (v["price"], v.get("perf5d")) for k, v in state.items()}


def test_a_client_that_connects_in_the_middle_ends_with_the_cache(spark, tmp_path):
    cache, out = CacheTable(spark, f"{tmp_path}/cache", compact_every=2), f"{tmp_path}/out"
    cache.merge(cache_rows(spark, {"ticker": "A", "price": 4.0, "prevClose": 5.0, "ref5d": 4.0}, {"ticker": "Q", "price": 7.0}))
    followed = spark.createDataFrame([("ann", "A"), ("ann", "Q"), ("bob", "B"), ("eve", "Z")], "username string, ticker string")
    emit = live.folder_emitter(out)
    before, cut = live.connect(cache, followed)
    assert cut is None and {r.username for r in before.where("step = 0").collect()} == {"ann", "bob", "eve"}
    connected = {}
    for n, rows in enumerate([[("A", 5.0, 1, 1), ("B", 1.0, 2, 2)], [("A", 6.0, 3, 3), ("A", 7.0, 4, 4)], [("B", 2.0, 5, 5)], [("A", 8.0, 6, 6), ("B", 3.0, 7, 7)]]):
        live.relay_batch(ticks_of(spark, *rows), n, cache, emit)
        first, cut = live.connect(cache, followed)
        connected[cut] = first.collect()
    assert list(connected) == [0, 1, 2, 3]
    end = {r.ticker: (r.price, r.perf5d) for r in K.cached_ticks(cache.read(), positive_only=True).collect()}
    assert end == {"A": (8.0, 100.0), "B": (3.0, None), "Q": (7.0, None)}
    wanted = {"ann": {"A": end["A"], "Q": end["Q"]}, "bob": {"B": end["B"]}, "eve": {}}
    for cut, first in connected.items():
        deltas = K.delta_messages(followed, live.delta_log(spark, out), cut)
        rows = [(r.username, r.batch, r.step, 0, 0, r.value) for r in first]
        rows += [(r.username, r.batch, r.step, r.timestamp, r.seq, r.value) for r in deltas.collect()]
        assert all(r[1] > cut for r in rows if r[2] == 2)
        for user, state in wanted.items():
            # a client that has old values before it connects forgets them
            stale = json.dumps({"type": "tick", "tick": {"ticker": "OLD", "price": 1.0}})
            assert fold([stale, *(r[5] for r in sorted(r for r in rows if r[0] == user))]) == state
        schema = "username string, batch bigint, step int, timestamp bigint, seq bigint, value string"
        named = spark.createDataFrame(rows, schema).withColumn("ticker", F.get_json_object("value", "$.tick.ticker"))
        folded = {(r.username, r.ticker): (r.tick.price, r.tick.perf5d) for r in K.client_state(named).collect()}
        assert folded == {(u, t): v for u, s in wanted.items() for t, v in s.items()}


def test_dead_letters_are_kept_and_counted(spark, tmp_path):
    good = json.dumps({"ticker": "A", "price": 1.5, "timestamp": 3, "volume": 2, "node": "n"})
    bad = ["{not json", "", "[1, 2]", json.dumps({"price": 1.0}), json.dumps({"ticker": "A"}), '{"ticker": "A", "price": "dear"}', good[:20]]
    values = spark.createDataFrame([(v,) for v in [good, *bad, None]], "value string")
    taken = []
    for _ in range(2):
        live.receive_batch(values, 7, live.folder_emitter(f"{tmp_path}/out"), lambda t, n: taken.append((n, [r.price for r in t.collect()])))
    assert taken == [(7, [1.5])] * 2
    dead = spark.read.schema("value string, fault string").json(f"{tmp_path}/out/dead_letters").collect()
    assert sorted(r.value or "" for r in dead) == sorted([*bad, ""])
    faults = {r.value: r.fault for r in dead}
    assert (faults[bad[0]], faults[bad[3]], faults[bad[4]], faults[None]) == ("unparsable", "no ticker", "no price", "empty")
    assert faults[bad[5]] == "unparsable"
    counts = spark.read.schema("records bigint, dead bigint").json(f"{tmp_path}/out/record_counts").collect()
    assert [tuple(c)[:2] for c in counts] == [(9, 8)]


def test_watchlist_batches_equal_the_feed_at_once(spark, tmp_path):
    base = spark.createDataFrame([(u, f"T{t}", t) for u in range(3) for t in range(3)], USER_TICKERS)
    x, feed = 7, []
    for seq in range(90):
        x = x * 48271 % 2147483647
        tickers = [f"T{(x >> s) % 5}" for s in range(0, 3 * (x % 3 + 1), 3)]
        feed.append((seq, x % 4, ["add", "remove", "reorder"][x // 7 % 3], list(dict.fromkeys(tickers))))
    changes = spark.createDataFrame(feed, WL.WATCHLIST_CHANGE)
    expected = {tuple(r) for r in CH.apply_watchlist_changes(base, changes).collect()}
    table = WL.watchlist_table(spark, f"{tmp_path}/t", compact_every=3)
    WL.load_watchlists(table, base)
    for n in range(9):
        for _ in range(1 + n % 2):  # some batches are repeated
            WL.watchlist_batch(changes.where(F.col("seq").between(10 * n, 10 * n + 9)), n, table)
    assert {(r.user_id, r.ticker, r.sort_order) for r in table.read().collect()} == expected


def test_ticker_gaps(spark):
    rows = [("A", d) for d in ("2024-01-11", "2024-01-12", "2024-01-13", "2024-01-17", "2024-01-17", "2024-01-18")]
    rows += [("B", "2024-01-11"), ("B", "2024-01-19"), ("C", "2024-01-11"), (None, "2024-01-12")]
    gaps = ticker_gaps(spark.createDataFrame(rows, "ticker string, date string"), rule_calendar(spark, 2024, 2024)).collect()
    # a Saturday bar does not count, nor does the holiday of the 15th
    assert {(r.ticker, str(r.last_before), str(r.first_after), r.missing) for r in gaps} == {
        ("A", "2024-01-12", "2024-01-17", 1), ("B", "2024-01-11", "2024-01-19", 4)
    }
