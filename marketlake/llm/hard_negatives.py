"""Hard-negative mining by threshold joins in the manner of L2AP.

A pair of vectors can only reach a threshold t if the parts not looked at yet can add enough: by Cauchy-Schwarz a
suffix adds at most the product of the two suffix norms. So the inverted index of a threshold leaves out, for each
row, the last dimensions, as soon as their norm is below t over the anchor's norm: no pair can reach t on these
alone. An anchor adds up partial scores over the lists of its dimensions; rows whose partial score and remaining norms
stay below t are dropped on the way, and survivors are scored exactly, in integers.

Thresholds start high and are lowered until the windows are full: that of the positives holds the best rows of
the anchor's own label, those of the negatives lie between two fractions of a positive's score. The best rows found
go on from index to index and raise the thresholds there.

Rows stay where they are; every task indexes blocks of bounded size. Anchors come in broadcast blocks of
bounded size, each against all rows. What a task returns is bounded by the windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from marketlake.llm.common import pick
from marketlake.session import staged

#: Components from here on can't be scored in 64 bits: such rows take no part.
TOO_LARGE = 1 << 26
#: Rows of an index, and components of a block of anchors, at most.
INDEX_ROWS, BLOCK_VALUES = 10_000, 1 << 19
#: Dimensions between two prunings.
STEP = 8


def suffix_norms(values: np.ndarray) -> np.ndarray:
    """Norms of all suffixes along the last axis, of the empty one too, a little above the true ones."""
    norms = np.sqrt(np.cumsum(values[..., ::-1] ** 2, axis=-1)[..., ::-1])
    return np.append(norms, np.zeros((*norms.shape[:-1], 1)), axis=-1) * (1 + 1e-12)


class Index:
    """The inverted index of some rows for thresholds, dimensions of most energy first."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        self.dims = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.values = vectors[:, self.dims].astype(np.float64)
        self.rest = suffix_norms(self.values)
        self.longest = float(self.rest[:, 0].max(initial=0))
        self.level = math.inf

    def lower(self, level: float) -> None:
        """Makes the lists for anchors of norm 1 and a threshold ``level``: those of a dimension hold the rows
        that have a suffix norm of at least ``level`` from there on."""
        if level >= self.level:
            return
        self.level = level if level <= 0 else 0.8 * level  # so that few anchors ask for more
        n = len(self.dims)
        depth = np.full(len(self.rest), n) if self.level <= 0 else (self.rest[:, :n] >= self.level).sum(axis=1)
        # rows of the longest indexed parts first: so every list is a beginning of the rows
        self.order = np.argsort(-depth, kind="stable")
        self.depth = depth[self.order]
        self.listed = [int(np.searchsorted(-self.depth, -j, side="left")) for j in range(n)]
        self.lists = np.ascontiguousarray(self.values[self.order].T)
        self.norms = np.ascontiguousarray(self.rest[self.order].T)
        self.last_norm = self.norms[self.depth, np.arange(len(self.depth))]

    def at_least(self, anchor: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of all rows with a score of ``least`` or more."""
        q = anchor[self.dims].astype(np.float64)
        rest = suffix_norms(q)
        slack = 1 + 1e-9 * rest[0] * self.longest  # more than partial scores can be off
        alive = np.arange(len(self.exact))
        if least - slack > -rest[0] * self.longest:
            alive = self.candidates(q, rest, least - slack)
        scores = self.exact[alive] @ anchor
        return alive[scores >= least], scores[scores >= least]

    def candidates(self, q: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
        self.lower(least / rest[0] if rest[0] else 0.0)
        count = self.listed[0] if self.listed else len(self.exact)
        beyond = rest[self.depth[:count]] * self.last_norm[:count]  # all that a row's dimensions in no list can add
        partial, alive = np.zeros(count), None
        for start in range(0, len(q), STEP):
            end = min(start + STEP, len(q))
            for j in range(start, end):
                if alive is None:
                    partial[: self.listed[j]] += q[j] * self.lists[j, : self.listed[j]]
                else:
                    inside = alive[: np.searchsorted(alive, self.listed[j])]
                    partial[: len(inside)] += q[j] * self.lists[j, inside]
            more = self.listed[end] if end < len(q) else 0  # rows with lists to come
            left = (beyond if alive is None else beyond[alive]).copy()
            ahead = np.arange(more) if alive is None else alive[: np.searchsorted(alive, more)]
            left[: len(ahead)] = rest[end] * self.norms[end, ahead]
            keep = partial + left >= least
            if alive is not None or 2 * np.count_nonzero(keep) < count:
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                partial = partial[keep]
                if not len(alive):
                    break
        return self.order[:count] if alive is None else self.order[alive]


class Best:
    """The first ``size`` rows with scores from ``low`` to ``high``: higher scores, then smaller ids first."""

    def __init__(self, size: int, low: float = -math.inf, high: float = math.inf):
        self.size, self.low, self.high, self.rows = size, low, high, []

    def least(self) -> float:
        """The score a row needs to be taken."""
        return self.rows[-1][0] if len(self.rows) == self.size else self.low

    def with_rows(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> list[tuple[int, int, int]]:
        fit = (scores >= self.least()) & (scores <= self.high)
        scores, ids, uids = scores[fit], ids[fit], uids[fit]
        first = np.lexsort((uids, ids, -scores))[: self.size]
        new = zip(scores[first].tolist(), ids[first].tolist(), uids[first].tolist(), strict=True)
        return sorted([*self.rows, *new], key=lambda r: (-r[0], *r[1:]))[: self.size]


def fill(windows: list[Best], index: Index, allowed: np.ndarray, ids: np.ndarray, uids: np.ndarray, anchor: np.ndarray) -> None:
    """Adds the index's rows to the windows of one anchor, lowering the threshold until no row below it could be taken.
    ``allowed`` masks the index's rows."""
    reach = float(np.sqrt((anchor.astype(np.float64) ** 2).sum())) * index.longest
    least = max(min(w.least() for w in windows), -reach - 1)
    top = min(max(min(w.high for w in windows), least), reach)
    levels = [top - part * (top - least) for part in (1 / 16, 1 / 4)] if any(len(w.rows) < w.size for w in windows) else []
    if math.isinf(windows[0].high):  # best rows of all: of any direction, so rarely near the bound
        levels = [part * reach for part in (1 / 2, 1 / 4, 1 / 8)] if levels else []
    for level in [*levels, None]:
        at = math.ceil(least if level is None else max(level, least))
        rows, scores = index.at_least(anchor, at)
        rows, scores = rows[allowed[rows]], scores[allowed[rows]]
        found = [w.with_rows(scores, ids[rows], uids[rows]) for w in windows]
        need = min(f[-1][0] if len(f) == w.size else w.low for f, w in zip(found, windows, strict=True))
        if at <= max(need, least) or level is None:
            break
        least = max(least, need)
    for f, w in zip(found, windows, strict=True):
        w.rows = f


def whole_vectors(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(vec_id, label, v)`` that take part, components as floor(256 x), with a number ``uid``."""
    scaled = F.transform("v", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    # false for NaN too, which is greater than any number
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(F.lit(256.0) * x.cast("double")) < TOO_LARGE))
    kept = rows.filter("vec_id is not null and label is not null and v is not null").filter(finite)
    return kept.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", scaled.cast("array<int>").alias("v"))


def anchor_blocks(anchors: DataFrame, most: int) -> Iterator[list[Row]]:
    """The anchors in blocks of at most ``most`` components; only one block is on the driver."""
    block, held = [], 0
    for row in anchors.toLocalIterator():
        if block and held + len(row["v"]) > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += max(1, len(row["v"]))
    if block:
        yield block


def matrix(lists: pa.Array, length: int) -> np.ndarray:
    """One row per list, filled up with zeros to the longest or ``length``."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(length, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def join_block(rows: DataFrame, anchors: list[tuple[int, str, list[int], list[tuple]]], size: int, same: bool) -> DataFrame:
    """(anchor, window, uid, vec_id, score): of every task the best rows for the windows of (uid, label, v, windows).

    ``same`` tells whether rows of the anchor's own label are wanted, or those of all others. A window
    is (low, high); its number is its place in the anchor's list."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        state = [[Best(size, *w) for w in windows] for *_, windows in asked]
        longest = max(len(v) for _, _, v, _ in asked)
        vectors = np.zeros((len(asked), longest), np.int64)
        for at, (_, _, v, _) in enumerate(asked):
            vectors[at, : len(v)] = v
        for batch in batches:
            for start in range(0, batch.num_rows, INDEX_ROWS):
                part = batch.slice(start, INDEX_ROWS)
                held = matrix(part.column("v"), longest)
                ids, uids = part.column("vec_id").to_numpy(), part.column("uid").to_numpy()
                labels = np.array(part.column("label").to_pylist(), object)
                all_rows = np.ones(len(ids), bool)
                by_label = {x: np.flatnonzero(labels == x) for x in dict.fromkeys(labels)}
                others = {} if same else {x: labels != x for x in by_label}
                indexes = {x: Index(held[at]) for x, at in by_label.items()} if same else {None: Index(held)}
                for (uid, label, _, _), vector, windows in zip(asked, vectors, state, strict=True):
                    anchor = np.append(vector, np.zeros(held.shape[1] - longest, np.int64))
                    if not windows or same and label not in by_label:
                        continue
                    if same:
                        at = by_label[label]
                        fill(windows, indexes[label], uids[at] != uid, ids[at], uids[at], anchor)
                    else:
                        fill(windows, indexes[None], others.get(label, all_rows), ids, uids, anchor)
        out = [(a[0], n, r[2], r[1], r[0]) for a, windows in zip(asked, state, strict=True) for n, w in enumerate(windows) for r in w.rows]
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "window", "uid", "vec_id", "score"])

    found = rows.select("uid", "vec_id", "label", "v").mapInArrow(scan, "anchor long, window int, uid long, vec_id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def mine(
    vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(256 x), scores are integer inner products. Of every row for which ``anchors`` (a
    condition on vec_id) holds, the positives are its best ``positives`` other rows of the same label, and the negatives
    the best ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` hundredths of the
    positive's. Higher scores come first, then smaller ids. ``label`` is an expression over the columns vec_id and
    label; labels are compared as they are.

    Rows without an id, a label or a vector, and those with a component that is null, not finite or at least ``TOO_LARGE``
    after scaling, take no part. A shorter vector counts as filled up with zeros. Rows that repeat an id are rows,
    and anchors, of their own. A positive below zero has no negatives. An empty table gives no rows.
    """
    rows = pick(vectors, vec_id=id_col, v=vector_col, label="label")
    rows = staged(whole_vectors(rows.withColumn("label", F.col("label") if label is None else label)), "vectors")
    spark, out = vectors.sparkSession, []
    for block in anchor_blocks(rows.filter(anchors), block_values):
        names = {a["uid"]: a["vec_id"] for a in block}
        asked = [(a["uid"], a["label"], list(a["v"]), [(-math.inf, math.inf)]) for a in block]
        best = join_block(rows, asked, positives, same=True).collect()  # at most ``positives`` an anchor of the block
        windows: dict[int, dict[int, int]] = {}
        for r in best:
            if low * r["score"] <= high * r["score"]:
                windows.setdefault(r["anchor"], {}).setdefault(r["score"], len(windows[r["anchor"]]))
        if not windows:
            continue
        # scores s with low * positive <= 100 * s <= high * positive
        asked = [
            (uid, label_, v, [(-(-low * s // 100), high * s // 100) for s in windows[uid]]) for uid, label_, v, _ in asked if uid in windows
        ]
        found = join_block(rows, asked, negatives, same=False)
        pairs = [(r["anchor"], windows[r["anchor"]][r["score"]], names[r["anchor"]], r["vec_id"], r["score"]) for r in best if r["score"] in windows.get(r["anchor"], {})]
        pairs = spark.createDataFrame(pairs, "anchor long, window int, anchor_id long, positive_id long, positive_score long")
        out.append(found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(pairs), ["anchor", "window"]))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, out).select(*columns)
