"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from marketlake.llm import hard_negatives, queries
from marketlake.llm.oracle import ORACLE
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, v string, score double"


def plain_mine(rows, every=100, positives=5, negatives=10):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for i, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: B023, B905, E731
        scored = sorted((-score(w), b, j, other) for j, (b, other, w) in enumerate(kept) if j != i)
        for ps, p, _, _ in [s for s in scored if s[3] == label][:positives]:
            fits = [s for s in scored if s[3] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps]
            out += [(a, p, rank, s[1], -ps, -s[0]) for rank, s in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def mine(rows, **options):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label=moved, **options)


def test_index_finds_all_that_reach_a_threshold():
    rng = np.random.default_rng(1)
    for round_ in range(150):
        n, d = int(rng.integers(1, 60)), int(rng.integers(0, 20))
        x = (rng.integers(-50, 50, (n, d)) * (rng.random((n, d)) < 0.7) * rng.integers(1, 100 if round_ % 3 else 2, (n, 1))).astype(np.int64)
        index = hard_negatives.Index(x)
        for _ in range(6):
            q = (rng.integers(-50, 50, d) * (rng.random(d) < 0.8)).astype(np.int64)
            scores = x @ q
            least = int(rng.choice(scores)) + int(rng.integers(-3, 4))
            rows, exact = index.at_least(q, least)
            assert sorted(rows.tolist()) == np.flatnonzero(scores >= least).tolist()
            assert exact.tolist() == scores[rows].tolist()


def test_index_leaves_dimensions_out():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(500, 32)) * 100).astype(np.int64)
    index = hard_negatives.Index(x)
    index.lower(0.5 * index.longest)
    assert 0 < sum(index.listed) < 0.9 * x.size


@pytest.mark.parametrize("index_rows", [10_000, 37])
def test_clusters_ties_and_hot_labels(spark, monkeypatch, index_rows):
    monkeypatch.setattr(hard_negatives, "INDEX_ROWS", index_rows)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 12))
    rows = []
    for i in range(900):
        vector = centers[rng.integers(6)] + rng.normal(size=12) * (0 if i % 4 == 0 else 0.2)
        rows.append((i if i % 50 else 100 * (i // 200), [float(np.float32(x)) for x in vector], 3 if i % 3 == 0 else int(rng.integers(10))))
    df = spark.createDataFrame([(*r, "a", "b", 0.0) for r in rows], SCHEMA).repartition(4)
    expected = plain_mine(rows)
    assert expected
    assert found(mine(df)) == expected
    assert found(mine(df, block_values=24)) == expected


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 3.0], 1), (0, [1.0, 2.0, 3.0], 1), (100, [0.0, 0.0, 0.0], 2), (200, [-1.0, 0.5], 4), (300, [], 5),
        (1, [1.0, 2.0, 2.5], 1), (2, [1.0, 2.0, 2.5], 1), (3, [0.5, 1.0, 1.5], 2), (4, [0.5, 1.0, 1.5], 2), (5, [0.6, 1.0], 3), (6, None, 2),
        (8, [nan, 1.0, 1.0], 2), (9, [inf, 1.0, 1.0], 2), (10, [1.0, None, 1.0], 2), (11, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 2),
        (400, [1.0, 1.0, 1.0], None), (12, [-0.001, 0.001, 0.3, 0.4], 5), (13, [0.0], 2), (14, [0.0, 0.0, 0.0, 9.0], 2), (-100, [1.0, 1.0, 0.2], 2),
    ]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    expected = plain_mine(rows)
    assert expected
    assert found(mine(df)) == expected
    assert mine(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0], 1, "", "", 0.0), (1, [3e5, 1.0], 1, "", "", 0.0)], SCHEMA)
    assert mine(huge).count() == 0


def test_query_equals_sql_and_pairs(spark, sf):
    import compare

    names, expected = compare.duck_rows(compare.connect(sf), ORACLE["op12_hard_negatives"])
    df = queries.op12_hard_negatives(spark, sf)
    assert sorted(df.columns) == names
    assert compare.spark_rows(df) == expected and expected
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(df) == plain_mine(rows)
