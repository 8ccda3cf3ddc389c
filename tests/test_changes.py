"""Change feeds against a loop that replays them one by one."""

import random
from decimal import Decimal

import pytest

from marketlake.operators.changes import apply_position_changes, apply_watchlist_changes

FEED = "seq bigint, user_id bigint, op string, tickers array<string>"
EDITS = (
    "seq bigint, user_id bigint, op string, position_id bigint, ticker string, "
    "shares decimal(18,6), cost_basis decimal(18,6)"
)
BOOK = "id bigint, user_id bigint, ticker string, shares decimal(18,6), cost_basis decimal(18,6)"


def replay_watchlist(base, feed):
    state = {(u, t): s for u, t, s in base}
    for _, user, op, tickers in sorted(feed, key=lambda c: (c[0], c[2] == "remove")):
        for i, ticker in enumerate(tickers):
            if op == "add":
                state.setdefault((user, ticker), 0)
            elif op == "remove":
                state.pop((user, ticker), None)
            elif (user, ticker) in state:
                state[user, ticker] = i
    return {(u, t, s) for (u, t), s in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_watchlist_replay(spark, seed):
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(6)]
    base = [(u, t, rng.randrange(9)) for u in range(5) for t in names if rng.random() < 0.5]
    feed = [
        (i, rng.randrange(6), rng.choice(["add", "remove", "reorder"]), rng.choices(names, k=rng.randrange(1, 5)))
        for i in range(150)
    ]
    for bucket in (7, 1 << 20):
        got = apply_watchlist_changes(
            spark.createDataFrame(base, "user_id bigint, ticker string, sort_order int"),
            spark.createDataFrame(feed, FEED),
            bucket,
        )
        assert sorted(tuple(r) for r in got.collect()) == sorted(replay_watchlist(base, feed))


def test_one_patch_adds_first_then_removes(spark):
    base = spark.createDataFrame([(1, "A", 3)], "user_id bigint, ticker string, sort_order int")
    feed = spark.createDataFrame([(7, 1, "remove", ["X"]), (7, 1, "add", ["X", "Y"])], FEED)
    assert {tuple(r) for r in apply_watchlist_changes(base, feed).collect()} == {(1, "A", 3), (1, "Y", 0)}


@pytest.mark.parametrize("seed", range(4))
def test_position_replay(spark, seed):
    rng = random.Random(seed)
    number = lambda: Decimal(rng.randrange(1, 999))
    base = [(i, i % 3, "T", number(), number()) for i in range(12)]
    feed, new_ids = [], []
    for seq in range(120):
        op = rng.choice(["add", "update", "update", "delete"])
        if op == "add":
            new_ids.append(100 + seq)
            feed.append((seq, rng.randrange(3), op, 100 + seq, "N", number(), number()))
        else:
            target = rng.choice([*range(14), *new_ids, 100 + seq + 1])
            feed.append((seq, rng.randrange(3), op, target, None, number(), number()))
    state = {p[0]: list(p) for p in base}
    for seq, user, op, pid, ticker, shares, basis in feed:
        if op == "add":
            state[pid] = [pid, user, ticker, shares, basis]
        elif pid in state and state[pid][1] == user:
            if op == "delete":
                del state[pid]
            else:
                state[pid][3:] = [shares, basis]
    got = apply_position_changes(spark.createDataFrame(base, BOOK), spark.createDataFrame(feed, EDITS))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(v) for v in state.values())
