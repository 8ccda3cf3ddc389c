"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. Block i of a source of weight w (its part of the total) may not
run before slot floor(i / w) and must run before slot ceil((i + 1) / w); among the blocks released,
the one with the earliest deadline takes the slot. A source is then never a whole block ahead of
or behind its weight.

As weights are whole parts, the schedule repeats after a period of as many slots as there are parts.
So only one period is scheduled, for a handful of sources, and the slot of every block of the
corpus follows from a table of that size. When a source runs out, the others go on at their
weights: the schedule is a list of segments, two per source at most. No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import number_within

REST = "(rest)"
#: Bounds the period, and with it the driver's work and the broadcast table.
MAX_PARTS = 10_000


def period(parts: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source's first ``blocks`` blocks in one period, earliest deadline first.
    Slots left empty by missing blocks are closed up."""
    total = sum(parts.values())
    waiting = [(i * total // q, -(-(i + 1) * total // q), s) for s, q in parts.items() for i in range(blocks[s])]
    waiting.sort()
    slots: dict[str, list[int]] = {s: [] for s in parts}
    ready: list[tuple[int, str]] = []
    at = taken = clock = 0
    while taken < len(waiting):
        if not ready and at < len(waiting):
            clock = max(clock, waiting[at][0])
        while at < len(waiting) and waiting[at][0] <= clock:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        slots[heapq.heappop(ready)[1]].append(taken)
        taken += 1
        clock += 1
    return slots


def segments(parts: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, list[tuple]]:
    """Per source: (first block, blocks, first slot, slots a period, blocks a period, slots in it)."""
    left = {s: n for s, n in blocks.items() if n}
    done, slot = dict.fromkeys(blocks, 0), 0
    out: dict[str, list[tuple]] = {s: [] for s in blocks}
    while left:
        live = {s: parts[s] for s in sorted(left)}
        rounds = min(left[s] // q for s, q in live.items())
        take = live if rounds else {s: min(q, left[s]) for s, q in live.items()}
        rounds = max(rounds, 1)
        length = sum(take.values())
        for s, where in period(live, take).items():
            out[s].append((done[s], rounds * take[s], slot, length, take[s], where))
            done[s] += rounds * take[s]
            left[s] -= rounds * take[s]
        slot += rounds * length
        left = {s: n for s, n in left.items() if n}
    return out


SEGMENT = "array<struct<block:long,blocks:long,slot:long,length:long,take:long,slots:array<int>>>"


def mix(
    docs: DataFrame, weights: Mapping[str, int], *, rest: int = 1, block_rows: int = 64,
    source: Column | None = None, order: list[Column] | None = None,
) -> DataFrame:
    """``docs`` with mix_source, mix_block, mix_slot (both from 0) and mix_place, the row's place in
    its block. Sorting by (mix_slot, mix_place) gives the mixture.

    ``weights`` are whole parts per source; sources not named there, and rows without one, share
    the lane "(rest)" of ``rest`` parts. Within a source the order is by a hash of ``order``
    (doc_id unless given), so it is random but repeatable. Rows that agree in it are
    neighbours. Columns of these names in ``docs`` are replaced. An empty table gives no rows.
    """
    parts = {s: int(w) for s, w in weights.items() if s != REST} | {REST: int(rest)}
    if min(parts.values()) < 1 or sum(parts.values()) > MAX_PARTS:
        raise ValueError(f"parts must be at least 1 each and {MAX_PARTS} in all")
    spark = docs.sparkSession
    source = F.col("source") if source is None else source
    lane = F.when(source.isin(*[s for s in parts if s != REST]), source).otherwise(F.lit(REST))
    rows = docs.withColumn("mix_source", lane)
    # at most one row per lane, whatever the input
    counts = dict(rows.groupBy("mix_source").count().collect())
    blocks = {s: math.ceil(counts.get(s, 0) / block_rows) for s in parts}
    table = spark.createDataFrame(list(segments(parts, blocks).items()), f"__lane string, __segments {SEGMENT}")
    order = [F.col("doc_id")] if order is None else order
    numbered = number_within(rows, F.col("mix_source"), order, "__row", sum(counts.values()))
    joined = numbered.join(F.broadcast(table), F.col("mix_source") == F.col("__lane"))
    joined = joined.withColumn("mix_block", F.floor(F.col("__row") / block_rows))
    joined = joined.withColumn(
        "__segment", F.filter("__segments", lambda s: (F.col("mix_block") >= s.block) & (F.col("mix_block") < s.block + s.blocks))[0]
    )
    inside = F.col("mix_block") - F.col("__segment.block")
    take = F.col("__segment.take")
    slot = (
        F.col("__segment.slot") + F.floor(inside / take) * F.col("__segment.length")
        + F.get(F.col("__segment.slots"), (inside % take).cast("int"))
    )
    return joined.withColumns(
        {"mix_slot": slot, "mix_place": (F.col("__row") % block_rows).cast("int")}
    ).drop("__row", "__lane", "__segments", "__segment")


def mixed_order(docs: DataFrame, weights: Mapping[str, int], **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, with their own columns only."""
    placed = mix(docs.select(F.struct("*").alias("__row_of"), F.col("source").alias("__source"), F.col("doc_id").alias("__id")),
                 weights, source=F.col("__source"), order=[F.col("__id")], **options)
    return placed.orderBy("mix_slot", "mix_place").select("__row_of.*")


def with_place(docs: DataFrame, group: int = 1024) -> DataFrame:
    """``docs``, read from Parquet files, with ``place``: the row's number from 0 in the order of the files, by the number of the
    task that wrote them, and of the rows in each. Without files it is null. A column of that name is replaced.

    Only the numbers of rows per file are summed up, in groups of tasks first.
    """
    task = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    part = F.regexp_extract("_metadata.file_name", r"-c(\d+)\.", 1).cast("int")
    try:
        rows = docs.withColumns({"__task": task, "__part": part, "__row": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumn("place", F.lit(None).cast("long"))
    files = docs.select(task.alias("t"), part.alias("p")).groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    files = files.withColumn("g", F.floor(F.col("t") / group))
    until = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("g").agg(F.sum("n").alias("n"))
    groups = groups.select(F.col("g").alias("of"), F.coalesce(F.sum("n").over(until().orderBy("g")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(until("g").orderBy("t", "p")), F.lit(0))
    starts = files.withColumn("inside", inside).join(groups, F.col("g") == F.col("of"))
    starts = starts.select("t", "p", (F.col("base") + F.col("inside")).alias("__base"))
    joined = rows.join(starts, F.col("__task").eqNullSafe(F.col("t")) & F.col("__part").eqNullSafe(F.col("p")))
    return joined.withColumn("place", F.col("__base") + F.col("__row")).drop("__task", "__part", "__row", "__base", "t", "p")
