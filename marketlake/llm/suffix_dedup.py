"""Repeated passages with a sparse suffix array.

Only suffixes at content-selected positions are kept: the position of the least hash in every
window of ``seed`` word runs (a minimiser). Any passage of ``least`` words, wherever it stands, has
such a position, the same one in every copy, and at least ``seed`` of its words follow it.

1. Suffixes are sorted by their first ``seed`` words and equal neighbours are counted. Counts are partial
   before the shuffle, so a passage in a third of all documents is no hot key.
2. Around each position with an equal neighbour the match is extended to the left and right by all
   windows of ``least`` words that hold it. Windows are compared across documents the same way;
   both copies of a repeated window extend from the same position, so none is missed.
3. Windows that repeat are merged into the longest spans.

Nothing is compared pair by pair: a group of m copies costs m rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import pick
from marketlake.session import staged

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, any such number will do
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


class WordRuns:
    """Hashes of runs of words, the same in every task."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode().split(), self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 7)
        return np.array([known[w] for w in words], np.uint64)

    def runs(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """The hash of every run of ``length`` words, from differences of one running sum."""
        n = len(hashes)
        if n < length:
            return np.empty(0, np.uint64)
        if len(self.powers) <= n:
            size = 2 * n + 1
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, MULTIPLIER, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, INVERSE, np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(hashes * self.powers[:n])]
        x = (sums[length:] - sums[:-length]) * self.inverses[: n - length + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def minimisers(runs: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least value (the last one of equals) in any ``window`` neighbours."""
    if len(runs) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(runs[::-1], window)
    found = [at + part.argmin(axis=1) + np.arange(len(part)) for at in range(0, len(views), 1 << 14)
             for part in [views[at : at + (1 << 14)]]]
    return np.unique(len(runs) - 1 - np.concatenate(found))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 50, seed: int = 26
) -> DataFrame:
    """(doc_id, spans, n_words, n_repeated) for every row that has a passage of ``least`` words or more that occurs
    again, in another row or elsewhere in its own.

    ``spans`` is an array of (start, end), the longest runs of words covered by such passages, counted in words
    from 0, end exclusive. Words are what stands between white space. Rows that repeat an id with another
    text are kept apart; rows repeated whole give one row each. Texts that are null or shorter
    have no passage; an empty table gives no rows.
    """
    if not 1 <= seed <= least:
        raise ValueError("seed must be between 1 and least")
    kind = pick(docs, doc_id=id_col).schema["doc_id"].dataType.simpleString()
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    reach = least - seed

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordRuns()
        for frame in frames:
            if frame.empty:
                continue
            keys, ids, places = [], [], []
            for row, text in zip(frame["row"], frame["text"], strict=True):
                runs = words.runs(words.words(text), seed)
                at = minimisers(runs, reach + 1)
                keys.append(runs[at].view(np.int64))
                places.append(at)
                ids.append(np.full(len(at), row, np.int64))
            yield pd.DataFrame({"key": np.concatenate(keys), "row": np.concatenate(ids), "at": np.concatenate(places).astype(np.int32)})

    suffixes = staged(rows.select("row", "text").mapInPandas(sample, "key long, row long, at int"), "suffixes")
    equal = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    seeds = suffixes.join(equal, "key").groupBy("row").agg(F.collect_set("at").alias("at"))

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordRuns()

        def batch(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
            return pd.DataFrame({
                "key": np.concatenate([k for _, k, _ in parts]).view(np.int64),
                "row": np.concatenate([np.full(len(k), row, np.int64) for row, k, _ in parts]),
                "at": np.concatenate([at for _, _, at in parts]).astype(np.int32),
            })

        for frame in frames:
            parts, held = [], 0
            for row, text, at in zip(frame["row"], frame["text"], frame["at"], strict=True):
                runs = words.runs(words.words(text), least)
                starts = (np.asarray(at, np.int64)[:, None] - np.arange(reach + 1)).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts < len(runs))])
                parts.append((row, runs[starts], starts))
                held += len(starts)
                if held > 500_000:
                    yield batch(parts)
                    parts, held = [], 0
            if parts:
                yield batch(parts)

    found = rows.select("row", "text").join(seeds, "row").mapInPandas(extend, "key long, row long, at int")
    windows = staged(found, "windows")
    equal = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    starts = windows.join(equal, "key").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("at"))

    def merge(acc: Column, at: Column) -> Column:
        joins = at <= acc["end"]
        span = F.struct(acc["start"].alias("start"), acc["end"].alias("end"))
        return F.struct(
            F.when(joins, acc["start"]).otherwise(at).alias("start"), (at + least).alias("end"),
            F.when(joins, acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"),
        )

    spans = "array<struct<start:int,end:int>>"
    zero = F.struct(F.element_at("at", 1).alias("start"), F.element_at("at", 1).alias("end"), F.array().cast(spans).alias("spans"))
    last = lambda a: F.concat(a["spans"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))
    merged = starts.select(F.col("row").alias("of"), F.aggregate("at", zero, merge, last).alias("spans"))
    named = rows.select("doc_id", "row", F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")).alias("n_words"))
    joined = named.join(merged, F.col("row") == F.col("of"))
    covered = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return joined.select(F.col("doc_id").cast(kind), "spans", "n_words", covered.alias("n_repeated"))
