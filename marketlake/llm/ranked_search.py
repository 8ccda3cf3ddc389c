"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents of equal m form a stratum in which the
impact of a term depends on its tf alone. The index keeps, for each term and stratum, the postings by falling tf,
with one impact for each tf. The first impact of every list bounds the stratum: a query sums these bounds, visits
strata from the highest bound down and stops at the first one below its k-th best score.

1. Tasks count the terms of whole texts and keep those that the queries hold. That table is written once.
2. Its counts give N, L and the document frequencies, and with them m and the weights.
3. Postings are dealt out by stratum; a stratum of many documents is cut into parts. Every task indexes its strata
   in groups of bounded size, and its best scores go on from group to group. The best of all tasks are merged.

Queries come in blocks of bounded size, each broadcast, against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from marketlake.llm.common import pick
from marketlake.session import staged

#: Every byte of a term to itself, A-Z in lower case, all others to a space. Bytes from 0x80 on are parts of terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Postings of a group, and documents of a part of a stratum, about.
GROUP_POSTINGS, PART_DOCS = 1 << 20, 1 << 10
#: Terms of a block of queries, each query's counted, at most (one query is never cut).
BLOCK_TERMS = 1 << 19


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return (text or b"").translate(FOLD).split()


class Strata:
    """The index of some documents: ``m`` of each, and the (document, term, tf) of their postings."""

    def __init__(self, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        levels, stratum = np.unique(m, return_inverse=True)
        self.docs_in = np.bincount(stratum)
        at = stratum[doc]
        order = np.lexsort((-tf, at, term))
        self.doc, tf, at, term = doc[order], tf[order], at[order], term[order]
        new_list = np.append(True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])) if len(term) else np.empty(0, bool)
        new_tf = new_list.copy()
        new_tf[1:] |= tf[1:] != tf[:-1]
        first = np.flatnonzero(new_tf)
        # one impact for each tf of a stratum's list
        impacts = 1_000_000_000 * tf[first] // (1000 * tf[first] + 8 * levels[at[first]])
        self.impact = np.repeat(impacts, np.diff(np.append(first, len(tf))))
        self.lists = np.append(np.flatnonzero(new_list), len(tf))  # where the lists start
        heads = self.lists[:-1]
        self.stratum, self.highest = at[heads], self.impact[heads] if len(tf) else heads
        self.terms, starts = np.unique(term[heads], return_index=True)
        self.of_term = dict(zip(self.terms.tolist(), zip(starts.tolist(), np.append(starts[1:], len(heads)).tolist(), strict=True), strict=True))

    def search(self, query: dict[int, int], k: int, least: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best by (score, ``place``) with ``least`` or more, for weights by term."""
        lists = [(w, *self.of_term[t]) for t, w in query.items() if t in self.of_term]
        bound = np.zeros(len(self.docs_in), np.int64)
        for w, lo, hi in lists:
            bound[self.stratum[lo:hi]] += w * self.highest[lo:hi]
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.count_nonzero(bound >= least))]
        held = np.cumsum(self.docs_in[order])
        score = np.zeros(len(place), np.int64)
        docs, scores, at, wanted = np.empty(0, np.int64), np.empty(0, np.int64), 0, 8 * k
        while at < len(order) and bound[order[at]] >= least:
            end = int(np.searchsorted(held, wanted)) + 1
            visited = np.zeros(len(bound), bool)
            visited[order[at:end]] = True
            touched = []
            for w, lo, hi in lists:
                found = lo + np.flatnonzero(visited[self.stratum[lo:hi]])
                start, size = self.lists[found], self.lists[found + 1] - self.lists[found]
                rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                score[self.doc[rows]] += w * self.impact[rows]
                touched.append(self.doc[rows])
            new = np.unique(np.concatenate(touched)) if touched else docs[:0]
            new = new[score[new] >= least]
            docs, scores = np.append(docs, new), np.append(scores, score[new])
            best = np.lexsort((place[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
            at, wanted = end, 2 * (int(held[min(end, len(held)) - 1]) + 4 * k)
        return docs, scores


def query_blocks(asked: DataFrame, most: int) -> Iterator[list[Row]]:
    """The queries in blocks of at most ``most`` terms; only one block is on the driver."""
    block, held = [], 0
    for row in asked.toLocalIterator():
        if block and held + len(row["terms"]) > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["terms"])
    if block:
        yield block


def rank(
    docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    query_id_col: str = "item_id", query_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each row of ``queries``.

    Ties go to the smaller id, ids that are null last. A null text has no terms. Rows that repeat an id are
    documents, or queries, of their own, each ranked for itself. An empty table on either side, and
    a query without terms, gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    asked = pick(queries, item_id=query_id_col, text=query_text_col).withColumn("text", F.col("text").cast("binary"))
    kind = asked.schema["item_id"].dataType.simpleString()

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], names=["query", "item_id", "terms"]
            )

    asked = asked.withColumn("query", F.monotonically_increasing_id()).select("query", "item_id", "text")
    asked = staged(asked.mapInArrow(split, f"query long, item_id {kind}, terms array<binary>"), "queries")
    found = [block_best(rows, block, k) for block in query_blocks(asked.filter(F.size("terms") > 0).select("query", "terms"), block_terms)]
    if not found:
        found = [rows.select(F.lit(0).cast("long").alias("query"), "doc_id", "row", F.lit(0).cast("long").alias("score")).limit(0)]
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def block_best(rows: DataFrame, block: list[Row], k: int) -> DataFrame:
    """(query, doc_id, row, score): for one block of queries the best of every task."""
    spark = rows.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({bytes(t) for q in block for t in q["terms"]}))}
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(numbers)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                n.append(len(words))
                for term, tf in Counter(words).items():
                    number = numbers.get(term)
                    if number is not None:
                        terms.append(number)
                        tfs.append(tf)
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "tfs"]
            )

    held = rows.select("row", "doc_id", "text").mapInArrow(count, f"row long, doc_id {kind}, n long, terms array<int>, tfs array<long>")
    held = staged(held, "terms")
    docs_n, docs_l = held.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's terms
    weight = {t: math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df + 1))) for t, df in frequency.items()}
    asked = [(q["query"], {t: weight[t] for x in q["terms"] if (t := numbers[bytes(x)]) in weight}) for q in block]
    asked = spark.sparkContext.broadcast(asked)
    wide = "decimal(19,0)"
    m = F.expr(f"10 + (cast(n as {wide}) * cast({90 * docs_n} as {wide})) div cast({max(docs_l, 1)} as {wide})").cast("long")
    held = held.filter(F.size("terms") > 0).withColumn("m", m)
    strata = held.groupBy("m").agg(F.count(F.lit(1)).alias("docs"))
    large = staged(strata.filter(F.col("docs") > PART_DOCS).select(F.col("m").alias("of"), "docs"), "strata")
    parts = F.coalesce(F.ceil(F.col("docs") / PART_DOCS), F.lit(1))
    dealt = held.join(large, F.col("m") == F.col("of"), "left").withColumn("part", F.pmod(F.xxhash64("row"), parts))
    dealt = dealt.select("m", "part", "row", "doc_id", "terms", "tfs").repartition("m", "part").sortWithinPartitions("m", "part")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        kinds = None

        def add(group: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(group).combine_chunks()
            ids, row = table["doc_id"].combine_chunks(), table["row"].to_numpy()
            terms, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
            doc = np.repeat(np.arange(len(row)), np.diff(terms.offsets.to_numpy()))
            index = Strata(table["m"].to_numpy(), doc, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy())
            keys = pa.table({"id": ids, "row": row})
            place = np.empty(len(row), np.int64)  # in the order of ties; null ids are sorted last
            place[pc.sort_indices(keys, sort_keys=[("id", "ascending"), ("row", "ascending")]).to_numpy()] = np.arange(len(row))
            for query, weights in asked.value:
                so_far = best.get(query, [])
                least = so_far[-1][0] if len(so_far) == k else 1
                docs, scores = index.search(weights, k, least, place)
                if len(docs):
                    new = zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist(), row[docs].tolist(), strict=True)
                    best[query] = sorted([*so_far, *new], key=lambda x: (-x[0], x[1] is None, x[1], x[2]))[:k]

        group, held = [], 0
        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            # a batch may be large: it is cut where its postings pass the bound
            ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                room = GROUP_POSTINGS - held + int(ends[at])
                end = max(int(np.searchsorted(ends, room, side="right")) - 1, at + (not group))
                if end > at:
                    group.append(batch.slice(at, end - at))
                    held += int(ends[end] - ends[at])
                if end < batch.num_rows:
                    add(group)
                    group, held = [], 0
                at = end
        if group:
            add(group)
        flat = [(q, *x) for q, found in best.items() for x in found]
        if flat:
            query, score, ids, row = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()), pa.array(ids, kinds), pa.array(row, pa.int64()), pa.array(score, pa.int64())],
                names=["query", "doc_id", "row", "score"],
            )

    return dealt.mapInArrow(search, f"query long, doc_id {kind}, row long, score long")
