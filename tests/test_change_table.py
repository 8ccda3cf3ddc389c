"""Tables of changes, and the cache that several producers write."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from marketlake.schemas import CACHE
from marketlake.sources.cache import CacheTable
from marketlake.sources.changes import ChangeTable
from marketlake.sources.files import folders

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("k", T.StringType()), ("t", T.LongType()), ("v", T.DoubleType()), ("gone", T.BooleanType()))]
)


def rows(spark, *data):
    return spark.createDataFrame([(k, t, v, False) for k, t, v in data], SCHEMA)


def held(df):
    return {r.k: (r.t, r.v) for r in df.collect()}


def cache_rows(spark, *data):
    base = dict.fromkeys(CACHE.fieldNames())
    return spark.createDataFrame([{**base, **r} for r in data], CACHE)


def test_many_batches_leave_a_bounded_number_of_folders(spark, tmp_path):
    table = ChangeTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], ["t"], compact_every=4)
    assert table.newest() is None and table.read().count() == 0
    for n in range(30):
        table.write(rows(spark, (f"k{n % 5}", n, float(n))), n)
        assert len(folders(spark, table.path)) <= 2 * 4 + 2
    assert table.newest() == 29
    assert held(table.read()) == {f"k{n % 5}": (n, float(n)) for n in range(25, 30)}


def test_a_repeated_batch_replaces_itself_and_versions_can_be_read(spark, tmp_path):
    table = ChangeTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], ["t"], compact_every=100)
    table.write(rows(spark, ("a", 1, 1.0), ("b", 1, 1.0)), 0)
    table.write(rows(spark, ("a", 2, 2.0)), 1)
    table.write(rows(spark, ("a", 2, 2.0)), 1)
    table.write(rows(spark, ("a", 0, 9.0), ("b", 3, None)), 2)  # an older row, and a null
    assert held(table.read()) == {"a": (2, 2.0), "b": (3, 1.0)}
    assert held(table.read(0)) == {"a": (1, 1.0), "b": (1, 1.0)}
    before = held(table.read())
    table.compact()
    assert held(table.read()) == before
    # compacted again after a batch that is repeated: nothing is lost or doubled
    table.write(rows(spark, ("a", 0, 9.0), ("b", 3, None)), 2)
    table.write(rows(spark, ("c", 5, 5.0)), 3)
    table.compact()
    assert held(table.read()) == before | {"c": (5, 5.0)}


def test_rows_as_a_whole_and_keys_that_go(spark, tmp_path):
    table = ChangeTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], by_field=False, gone="gone", compact_every=2)
    table.write(rows(spark, ("a", 1, 1.0), ("b", 1, 1.0)))
    table.write(spark.createDataFrame([("a", 0, None, False), ("b", None, None, True)], SCHEMA))
    assert held(table.read()) == {"a": (0, None)}
    table.write(rows(spark, ("b", 7, 7.0)))
    assert held(table.read()) == {"a": (0, None), "b": (7, 7.0)}


def test_an_unfinished_write_does_not_count(spark, tmp_path):
    table = ChangeTable(spark, f"{tmp_path}/t", SCHEMA, ["k"])
    table.write(rows(spark, ("a", 1, 1.0)), 0)
    rows(spark, ("a", 2, 2.0)).write.parquet(f"{table.path}/change-{1:012d}")
    (tmp_path / "t" / f"change-{1:012d}" / "_SUCCESS").unlink()
    assert table.newest() == 0 and held(table.read()) == {"a": (1, 1.0)}


def test_producers_in_any_order_lose_nothing(spark, tmp_path):
    """Nightly, seeds and two streams, each beginning before the other has ended."""
    day = dt.date(2024, 1, 12)
    evening = 1705107600000  # 20:00 in New York
    steps = {
        "night": lambda c: c.merge(cache_rows(spark, {"ticker": "A", "price": 1.0, "timestamp": 5, "prevClose": 0.5, "ref5d": 0.25}), day),
        "seed": lambda c: c.merge_seeds(cache_rows(spark, {"ticker": "N", "price": 3.0, "timestamp": 7, "prevClose": 2.0}), day),
        "east": lambda c: c.merge_live(cache_rows(spark, {"ticker": "A", "price": 9.0, "timestamp": evening + 1, "perf5d": 4.0}), 0, "east"),
        "west": lambda c: c.merge_live(cache_rows(spark, {"ticker": "A", "price": 8.0, "timestamp": evening}, {"ticker": "N", "price": 4.0, "timestamp": 8}), 0, "west"),
    }
    seen = []
    for n, order in enumerate([["night", "seed", "east", "west"], ["west", "east", "seed", "night"], ["east", "night", "west", "seed"]]):
        cache = CacheTable(spark, f"{tmp_path}/{n}")
        for step in order:
            steps[step](cache)
        seen.append({r.ticker: r.asDict() for r in cache.read().collect()})
    assert seen[0] == seen[1] == seen[2]
    a, new = seen[0]["A"], seen[0]["N"]
    assert (a["price"], a["prevClose"], a["ref5d"], a["perf5d"]) == (9.0, 0.5, 0.25, 4.0)
    assert (new["price"], new["prevClose"]) == (4.0, 2.0)


def test_a_close_counts_against_the_ticks_of_its_day(spark, tmp_path):
    cache = CacheTable(spark, f"{tmp_path}/c")
    cache.merge_live(cache_rows(spark, {"ticker": "A", "price": 9.0, "timestamp": 1705107600000}), 0)
    cache.merge(cache_rows(spark, {"ticker": "A", "price": 1.0, "timestamp": 5}), dt.date(2024, 1, 12))
    assert cache.read().first().price == 1.0
    cache.merge(cache_rows(spark, {"ticker": "A", "price": 2.0, "timestamp": 5}), dt.date(2024, 1, 11))  # last written closes count
    assert cache.read().first().price == 9.0


@pytest.mark.parametrize("nights", [5])
def test_closes_stay_a_plain_table(spark, tmp_path, nights):
    cache = CacheTable(spark, f"{tmp_path}/c")
    for n in range(nights):
        cache.merge(cache_rows(spark, {"ticker": "A", "price": float(n)}))
    assert len(folders(spark, cache.closes.path)) <= 4
    assert "Aggregate" not in cache.reference()._jdf.queryExecution().toString()
    assert cache.reference().first().price == nights - 1.0
