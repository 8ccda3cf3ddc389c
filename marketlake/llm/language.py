"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its letters: the first rotated
by two places, the second by one, multiplied element by element. A text bundles (sums) its
trigrams, a language bundles the unit vectors of its texts, and a text is compared with each
language by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import pick

DIM = 1024
#: Documents per language that prototypes are learned from, at most (about: chosen by a hash).
SAMPLE_PER_LANGUAGE = 4000
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Code point -> code point of the lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(len(table)):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Profiles:
    """Trigram vectors, made when first seen; the cache is emptied when it holds ``cache`` of them."""

    def __init__(self, letters: np.ndarray | None = None, dim: int = DIM, cache: int = 40_000) -> None:
        self.dim, self.cache = dim, cache
        self.letters = letter_table() if letters is None else letters
        self.letter_vectors: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, dim), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letter_vectors:
            bits = np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, self.dim)
            self.letter_vectors[code] = (2 * bits - 1).astype(np.int8)
        return self.letter_vectors[code]

    def _row(self, gram: int) -> int:
        row = self.rows.get(gram)
        if row is None:
            row = self.rows[gram] = len(self.rows)
            if row == len(self.matrix):
                self.matrix = np.concatenate((self.matrix, np.empty_like(self.matrix)))
            a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
            self.matrix[row] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return row

    def of(self, text: str | None) -> np.ndarray | None:
        """The text's bundle as a unit vector; None without a letter. Words are set apart by one
        space; other characters count as space. A long text is read in slices that overlap."""
        points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        codes = self.letters[points]
        if not codes.any():
            return None
        codes = np.concatenate(([0], codes, [0])).astype(np.int64)
        codes = codes[~((codes == 0) & (np.concatenate(([1], codes[:-1])) == 0))]
        codes[codes == 0] = 32
        total = np.zeros(self.dim)
        for at in range(0, len(codes) - 2, 1 << 18):
            part = codes[at : at + (1 << 18) + 2]
            grams, counts = np.unique((part[:-2] << 42) | (part[1:-1] << 21) | part[2:], return_counts=True)
            if len(self.rows) > self.cache:
                self.rows, self.matrix = {}, np.empty((1024, self.dim), np.int8)
            at_rows = np.array([self._row(g) for g in grams.tolist()])
            total += counts.astype(np.float32) @ self.matrix[at_rows].astype(np.float32)
        norm = np.linalg.norm(total)
        return total / norm if norm else None


def sampled(labelled: DataFrame, per_language: int) -> DataFrame | None:
    """(lang, text) of at most about ``per_language`` documents of each language; None without any."""
    counts = dict(labelled.filter("lang is not null").groupBy("lang").count().collect())  # one row per language
    if not counts:
        return None
    spark = labelled.sparkSession
    bounds = spark.createDataFrame([(k, int(min(1, per_language / n) * (1 << 30))) for k, n in counts.items()], "lang string, bound long")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return labelled.join(F.broadcast(bounds), "lang").filter(draw <= F.col("bound")).select("lang", "text")


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Language -> prototype (a unit vector) from ``labelled(doc_id, text, lang)``.

    At most about ``per_language`` documents of each language are used, chosen by a hash of the id.
    The parts that tasks return are sums of ``DIM`` numbers per language.
    """
    sample = sampled(labelled, per_language)
    if sample is None:
        return {}

    letters = sample.sparkSession.sparkContext.broadcast(letter_table())  # of one size, whatever the input

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, sums = Profiles(letters.value), {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                vector = profiles.of(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]})

    parts = sample.mapInPandas(bundle, "lang string, sums array<double>")
    added = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    out: dict[str, np.ndarray] = {}
    for lang, pos, s in added.collect():  # DIM rows per language
        out.setdefault(lang, np.zeros(DIM))[pos] = s
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row; score is the cosine with the nearest prototype, at least 0.

    A text that is null or has no letter, and any text if nothing was learned, is ``und`` with score
    0. Of equally near languages the first by name wins. Repeated rows are judged each.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(-1, DIM)

    letters = docs.sparkSession.sparkContext.broadcast(letter_table())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(letters.value)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                vector = profiles.of(text.as_py()) if names else None
                near = None if vector is None else matrix @ vector
                langs.append(UNKNOWN if near is None else names[int(near.argmax())])
                scores.append(0.0 if near is None else float(np.clip(near.max(), 0, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(text_col))
            yield batch.filter(pa.array([any(map(str.isalpha, text)) for text in texts], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)


def low_scores(labelled: DataFrame, prototypes: dict[str, np.ndarray], quantile: float) -> dict[str, float]:
    """Language -> that quantile of the scores of the labelled documents that ``learn`` uses and that have a letter."""
    sample = sampled(labelled, SAMPLE_PER_LANGUAGE)
    if sample is None or not prototypes:
        return {}
    found = identify(sample, prototypes, id_col="lang").filter(F.col("lang_pred") != UNKNOWN)
    return dict(found.groupBy("doc_id").agg(F.percentile_approx("score", quantile, 10_000)).collect())  # one row per language


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: those not held out by the checksum of their id."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    return rows.filter(~held_out(F.col("doc_id")))
