"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Vectors are cut into two halves; each half has its own centroids, and an entry belongs to the
cell of its two nearest. A query visits cells in the order of summed nearness, taken from a heap
over the two sorted centroid lists, until the cells visited hold enough entries. These entries
are reranked with exact inner products in double precision.

How many entries are enough is measured: for a few rows the nearest are found among all entries, and enough is
what brings the visits to the cells of most of them. Vectors in clusters need few; vectors without any, like the
sample's, need half the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import pick
from marketlake.session import staged

#: Rows that centroids are fitted on, at most, and rows for which the needed number of entries is measured.
SAMPLE_ROWS = 8192
TRIAL_ROWS = 64
RESULT = "query_id long, rank int, vec_id long, score double"


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with v in double precision; vectors that are null, empty, zero or hold null or
    non-finite components are left out, and rows without an id too."""
    rows = pick(df, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from an evenly spaced start; a centroid that loses its points stays where it is."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_centroid(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """The cells (first list, second list) with the largest sums until they hold ``wanted``
    entries, as a mask. A pair enters the heap once its left and upper neighbours were taken."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    f, s = -first[a], -second[b]
    seen = np.zeros((len(a), len(b)), bool)
    depth = [0] * len(a)  # pairs taken in each row of the sorted grid
    heap = [(f[0] + s[0], 0, 0)]
    held = 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        seen[a[i], b[j]] = True
        held += counts[a[i], b[j]]
        depth[i] = j + 1
        if j + 1 < len(b) and (i == 0 or depth[i - 1] > j + 1):
            heapq.heappush(heap, (f[i] + s[j + 1], i, j + 1))
        if i + 1 < len(a) and depth[i + 1] == j:
            heapq.heappush(heap, (f[i + 1] + s[j], i + 1, j))
    return seen


def needed(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By cell, the entries in the cells that are visited before it."""
    order = np.argsort(-(first[:, None] + second[None, :]), axis=None, kind="stable")
    held = np.cumsum(counts.ravel()[order])
    out = np.empty(counts.size, np.int64)
    out[order] = np.r_[0, held[:-1]]
    return out


def nearest_cells(entries: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """(trial, cell) of the ``k`` nearest among all ``entries(vec_id, v, cell)`` of each of a few trial vectors,
    rows of the trial's own id left out. A task keeps k rows a trial, and so many go to the shuffle."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, cell = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                own = ids[:, None] == part["vec_id"].to_numpy()[None, :]
                new = np.where(own, -np.inf, vectors @ np.stack(part["v"].to_numpy()).T)
                cells = np.broadcast_to(part["cell"].to_numpy(), new.shape)
                score, cell = np.hstack([score, new]), np.hstack([cell, cells])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        kept = score > -np.inf
        yield pd.DataFrame({"trial": np.nonzero(kept)[0], "cell": cell[kept], "score": score[kept]})

    found = entries.select("vec_id", "v", "cell").mapInPandas(best, "trial int, cell int, score double")
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "cell")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return np.array(top.select("trial", "cell").collect(), np.int64).reshape(-1, 2)  # TRIAL_ROWS x k at most


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = 20, centroids: int = 32, recall: float = 0.95, probe: float | None = None,
    query_rows: int = 8192, chunk_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest entries found for each row of ``vectors``
    for which ``queries`` (a condition on vec_id) holds, its own row left out.

    The cells visited hold as many entries as it takes to meet the share ``recall`` of the true neighbours of
    ``TRIAL_ROWS`` rows; or, if given, the share ``probe`` of all entries. Every row is indexed; centroids are fitted on at
    most ``SAMPLE_ROWS`` rows. Both are chosen by a hash of the id. Ties go to the smaller vec_id. Rows that repeat an id are
    queries and entries of their own, so an id may have several rankings. Vectors of another length than most (of equally
    many, than the longest) take no part. A cell with more than ``chunk_rows`` entries, or ``query_rows`` queries, is
    cut into chunks. An empty table gives no rows.
    """
    rows = clean_vectors(vectors, id_col, vector_col)
    spark = rows.sparkSession
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == common["n"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    x = np.array([r["v"] for r in sample])
    cut = x.shape[1] // 2
    halves = (slice(0, cut), slice(cut, None))
    books = [fit_centroids(x[:, h], centroids) for h in halves]
    shape = (len(books[0]), len(books[1]))

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int32")
        both = np.stack(v.to_numpy())
        first, second = (nearest_centroid(both[:, h], book) for h, book in zip(halves, books, strict=True))
        return pd.Series(first * shape[1] + second, dtype="int32")

    # written once: a row's number, by which a query knows its own row, must not change when a task is repeated
    entries = staged(rows.withColumns({"cell": cell_of("v"), "row": F.monotonically_increasing_id()}), "entries")
    sizes = np.zeros(shape[0] * shape[1], np.int64)
    for cell, n in entries.groupBy("cell").count().collect():  # at most centroids x centroids rows
        sizes[cell] = n
    counts = sizes.reshape(shape)
    if probe is None:
        trials, ids = x[:TRIAL_ROWS], np.array([r["vec_id"] for r in sample[:TRIAL_ROWS]])
        before = [needed(books[0] @ v[halves[0]], books[1] @ v[halves[1]], counts) for v in trials]
        enough = [before[trial][cell] for trial, cell in nearest_cells(entries, ids, trials, k)]
        wanted = int(np.quantile(enough, recall, method="higher")) + 1 if enough else 1
    else:
        wanted = math.ceil(probe * sizes.sum())
    wanted = max(wanted, k + 1)
    chunks = [max(1, math.ceil(n / chunk_rows)) for n in counts.sum(1)]

    def traverse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part, out = frame.iloc[at : at + 1024], []
                for row, query, v in zip(part["row"], part["vec_id"], part["v"], strict=True):
                    near = [book @ v[h] for book, h in zip(books, halves, strict=True)]
                    seen = visit(near[0], near[1], counts, wanted)
                    out += [(row, query, v, i, chunk, np.packbits(seen[i]).tobytes())
                            for i in np.flatnonzero(seen.any(1)) for chunk in range(chunks[i])]
                yield pd.DataFrame(out, columns=["row", "query_id", "v", "part", "chunk", "seen"])

    asked = entries.filter(queries).select("row", "vec_id", "v")
    visits = asked.mapInPandas(traverse, "row long, query_id long, v array<double>, part int, chunk int, seen binary")
    # hot parts: queries are dealt into as many groups as a part has more than a chunk of them
    deal = max(1, math.ceil(asked.count() / query_rows))
    visits = visits.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(deal)).cast("int"))
    per_part = F.element_at(F.array(*[F.lit(c) for c in chunks]), F.col("part") + 1)
    stored = entries.withColumn("part", F.floor(F.col("cell") / shape[1]).cast("int"))
    stored = stored.withColumn("chunk", F.pmod(F.xxhash64("row"), per_part).cast("int"))
    stored = stored.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))

    def rerank(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        if asked.empty or held.empty:
            return none
        held = held.sort_values("vec_id", kind="stable")
        ids, numbers, column = held["vec_id"].to_numpy(), held["row"].to_numpy(), held["cell"].to_numpy() % shape[1]
        matrix = np.stack(held["v"].to_numpy())
        out = []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            wants = np.unpackbits(np.array([np.frombuffer(s, np.uint8) for s in part["seen"]]), axis=1)[:, : shape[1]]
            # not a matrix product: that may sum equal vectors in different orders and so break ties
            score = np.einsum("qd,nd->qn", np.stack(part["v"].to_numpy()), matrix)
            own = part["row"].to_numpy()[:, None] == numbers[None, :]
            score[(wants[:, column] == 0) | own] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            for row, query, line, top in zip(part["row"], part["query_id"], score, best, strict=True):
                out += [(row, query, ids[t], line[t]) for t in top if line[t] > -np.inf]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]) if out else none

    by = ["part", "chunk", "deal"]
    found = visits.groupBy(*by).cogroup(stored.groupBy(*by)).applyInPandas(
        rerank, "row long, query_id long, vec_id long, score double"
    )
    # a query has at most k rows from each chunk of each part
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
