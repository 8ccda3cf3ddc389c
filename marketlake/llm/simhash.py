"""Near duplicates by SimHash: links within a few bits, found with pivot distance tables.

Candidates come from an equi-join: the 64 bits are cut into blocks, and two fingerprints at most
``bits`` apart agree in ``blocks - bits`` of them, so they share a cell for some choice of blocks.
Within a cell every fingerprint has its row of precomputed distances to the pivots. As a distance
to a pivot can't differ by more than the distance of the pair, pairs whose rows differ by more
than ``bits`` in some coordinate are discarded; the rest is verified bit by bit.

A cell holds distinct fingerprints only, and one with many of them is cut into parts, whose
pairs of parts are separate groups of bounded size. A group reports a forest that spans its
links, not all pairs, so a cluster of near copies can't square the output.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import pick
from marketlake.llm.components import connected_components
from marketlake.session import staged

#: Reference fingerprints, made by a rule.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(24)], np.uint64)

#: For links by Jaccard similarity: a pair at 0.8 shares no cell of 4 least hashes with a chance of
#: (1 - 0.8^4)^32, about 5e-8.
CELLS, CELL_HASHES = 32, 4
FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}") | 1 for i in range(CELLS * CELL_HASHES)], np.uint64)
#: Bits between the SimHashes of sets of runs, at most. At a similarity of 0.8 the cosine of two sets is 0.89 or
#: more, so each bit differs with a chance of at most 0.151, and more than 28 of 64 do with one of about 1e-8: less than
#: that of sharing no cell. (The 55 pairs of sf0.001, sf0.01 and sf0.1 lie at 18 or fewer.)
SIMILAR_BITS = 28
#: What rounding may add to a product of a size and a similarity.
SLACK = 1e-6
#: Sets of a group that are compared in one task: two parts of about so many.
PART_SETS = 256


def word_runs(text: str | None, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words; of all words if there are fewer. None without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in spans], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text; zero without words. A null text has no words."""
    return majority(word_runs(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    rows = pick(docs, doc_id=id_col, text=text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def near_forest(fps: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as positions) that span the links within ``bits`` inside each group."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    fps, group, table = fps[order], group[order], table[order]
    first = table[:, 0].astype(np.int64)
    label = np.arange(len(fps))
    left, ahead, links = label, 0, []
    while left.size:
        ahead += 1
        left = left[left + ahead < len(fps)]
        right = left + ahead
        # sorted by the first pivot within a group: once too far ahead, further ahead is too
        left = left[(group[right] == group[left]) & (first[right] - first[left] <= bits)]
        right = left + ahead
        near = (np.abs(table[left] - table[right]) <= bits).all(axis=1)
        a, b = left[near], right[near]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        links.append(np.stack((a[linked], b[linked])))
        if sum(x.shape[1] for x in links) > 1 << 20 or not left.size:
            a, b = np.concatenate(links, axis=1)
            links = []
            while True:
                least = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, least)
                np.minimum.at(new, b, least)
                np.minimum.at(new, label, new.copy())
                new = new[new]
                if (new == label).all():
                    break
                label = new
    child = np.flatnonzero(label != np.arange(len(label)))
    return order[child], order[label[child]]


def near_edges(fps: DataFrame, bits: int = 4, blocks: int | None = None, part_rows: int = 1024) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps(fp)`` with the components of all links
    within ``bits`` bits. ``blocks`` only sets how many cells there are: more for larger inputs."""
    if blocks is None:
        wanted = math.log2(max(2, fps.count())) - 3
        blocks = next(b for b in range(bits + 2, 33) if (b - bits) * (64 // b) >= wanted or b == bits + 4)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [
        sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        for chosen in itertools.combinations(range(blocks), blocks - bits)
    ]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    celled = fps.select("fp", F.explode(keys).alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    grouped = celled.join(sizes, "cell").select("fp", "cell", own.alias("own"), other.alias("other"))
    grouped = grouped.select("fp", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    sorted_ = grouped.repartition("cell").sortWithinPartitions("cell")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for frame in itertools.chain(frames, [None]):
            if frame is not None:
                cell = np.concatenate((cell, frame["cell"].to_numpy(np.int64)))
                fp = np.concatenate((fp, frame["fp"].to_numpy(np.int64).view(np.uint64)))
                if not len(cell):
                    continue
            # groups that have ended; the last one may go on in the next batch
            end = len(cell) if frame is None else int(np.searchsorted(cell, cell[-1]))
            while end:
                cut = end if end <= 4096 else max(int(np.searchsorted(cell, cell[4096])), 0)
                cut = cut or int(np.searchsorted(cell, cell[0], side="right"))
                a, b = near_forest(fp[:cut], cell[:cut], bits)
                yield pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})
                cell, fp, end = cell[cut:], fp[cut:], end - cut

    return sorted_.mapInPandas(link, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 4, width: int = 4
) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest id reachable by links of
    at most ``bits`` differing bits.

    Texts that are null or without words have fingerprint zero and link like any other. Null ids
    are reported but never become a component's id unless it has no other. Repeated rows are
    reported as often as they occur. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_edges(distinct.select("fp"), bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(heads, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(classes, prints["fp"] == classes["of"]).select("doc_id", "fp", "component_id")


def cells(runs: np.ndarray) -> list[int]:
    """Keys of the cells of a set of runs: two sets share each with the power ``CELL_HASHES`` of their similarity."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(runs), 1024):
        np.minimum(least, (runs[at : at + 1024, None] * FACTORS).min(axis=0), out=least)
    digests = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(CELLS, CELL_HASHES))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def rare_runs(sets: DataFrame, runs: DataFrame, least: float) -> DataFrame:
    """(run, n, place, and the columns of ``sets``) of the rarest runs of ``sets(node, root, size)``: as many as two sets of the
    similarity ``least`` can't differ in, and one more. Each such pair of different roots shares one of them.

    ``runs(node, runs)`` has the sets' runs, which are ordered by ``n``, the number of sets that have them; ``place`` is the run's place
    in that order, from 0. A run that no set of another root has takes its place but is not returned. What many texts
    have in common comes last, so texts that have more than a fifth of their own share no run here.
    """
    each = sets.select("node", "root").join(runs, "node").select("node", "root", F.explode("runs").alias("run"))
    known = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"), (F.min("root") != F.max("root")).alias("mixed")).filter("n > 1")
    shared = each.select("node", "run").join(known, "run").groupBy("node")
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("n", "run", "mixed"))).alias("shared"))
    own = F.col("size") - F.size("shared")
    upto = F.col("size") - F.ceil(F.col("size") * least - SLACK) + 1
    ordered = sets.join(shared, "node").filter(upto > own)
    ordered = ordered.select(*sets.columns, own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), (upto - own).cast("int"))).alias("at", "of"))
    return ordered.filter("of.mixed").select(*sets.columns, F.col("of.run").alias("run"), F.col("of.n").alias("n"), (F.col("own") + F.col("at")).alias("place"))


def similar_edges(nodes: DataFrame, rows: DataFrame, least: float, width: int) -> DataFrame:
    """Edges (a, b) with the components of all links between ``nodes(node, fp, runs, cells, doc_id)`` of at least
    the similarity ``least``. Sets of very different numbers of ``runs`` can't have it, and are no pair. ``rows(doc_id, text)`` has the texts.

    Within a cell all are compared with one of them first. Sets in cells that are not one component then are compared
    where they share a rare run (``rare_runs``), again only those outside a run's largest component (``forests``). So neither
    a cluster of near copies squares nor a group of texts around a common passage.
    """
    celled = nodes.select("node", "fp", F.col("runs").alias("size"), F.explode("cells").alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp", "size")).alias("head"))
    shared = staged(celled.join(sizes.filter("n > 1").drop("n"), "cell"), "cells")
    chosen = staged(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("doc_id"), "chosen")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                runs = np.unique(word_runs(text.as_py(), width))
                columns = [pa.array([node_of(runs)], pa.int64()), pa.array([runs.view(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "runs"])

    texts = rows.join(chosen, "doc_id", "left_semi").select("text")
    runs = staged(texts.mapInArrow(of, "node long, runs array<long>").dropDuplicates(["node"]), "runs")

    def may_link(x: Column, y: Column) -> Column:
        alike = F.least(x["size"], y["size"]) >= F.greatest(x["size"], y["size"]) * least
        return alike & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= SIMILAR_BITS)

    stars = shared.filter(F.col("node") != F.col("head.node")).filter(may_link(F.struct("fp", "size"), F.col("head")))
    stars = staged(stars.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    found = stars.join(runs.toDF("a", "of_a"), "a").join(runs.toDF("b", "of_b"), "b")
    both, all_ = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    linked = staged(found.filter(both >= (all_ - both) * least).select("a", "b"), "similar")
    roots = connected_components(linked).withColumnRenamed("node", "of")
    rooted = shared.join(roots, shared["node"] == roots["of"], "left")
    rooted = staged(rooted.select("cell", "node", "fp", "size", F.coalesce("root", "node").alias("root")), "rooted")
    apart = rooted.groupBy("cell").agg(F.min("root").alias("m"), F.max("root").alias("n")).filter("m <> n")
    left = rooted.join(apart.select("cell"), "cell", "left_semi").select("node", "fp", "size", "root").distinct()
    rare = staged(rare_runs(staged(left, "left"), runs, least), "rare")
    return linked.union(staged(forests(rare, runs, least), "pairs"))


def forests(rare: DataFrame, runs: DataFrame, least: float, part_sets: int = PART_SETS) -> DataFrame:
    """Edges (a, b) between sets of different roots that, with the roots, span the links between sets that share a rare run.

    ``rare`` comes from ``rare_runs``, ``runs(node, runs)`` has the sets. Each run is a group, but of runs that the same sets have
    (a passage) only the first; a group with many sets is cut into parts, whose pairs of parts are groups of their own. A pair is
    looked at where its first common run is. What is long, the sets themselves, goes to a group only for the members that pivot
    distance tables, SimHashes and places leave a partner in it (``contested``).
    """
    of_run = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"of_{seed}") for seed in (1, 2)]
    mains = rare.groupBy("run", "n").agg(
        F.min("root").alias("m"), F.max("root").alias("o"), F.mode("root", True).alias("main"), F.count(F.lit(1)).alias("sets"), *of_run)
    mains = mains.filter("m <> o").groupBy("sets", "main", "of_1", "of_2").agg(F.min(F.struct("n", "run")).alias("first"))
    mains = staged(mains.select(F.col("first.run").alias("run"), "main", "sets"), "mains")
    mixed = staged(rare.join(mains, "run"), "mixed")
    parts = F.ceil(F.col("sets") / part_sets).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    cut = mixed.select("run", "main", "node", "fp", "size", "root", "place", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cut = cut.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")
    key = ["run", "low", "high"]
    together = lambda df: df.repartition(*key).sortWithinPartitions(*key)
    members = together(cut).mapInPandas(by_group(key, lambda group: contested(group, least)), cut.schema)
    members = staged(members, "members")
    order = F.transform(F.sort_array(F.collect_list(F.struct("place", "run"))), lambda x: x["run"])
    sets = mixed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(order.alias("rare")).join(runs, "node")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(similar_forest(group, least), columns=["a", "b"], dtype=np.int64)

    return together(members.join(sets, "node")).mapInPandas(by_group(key, link), "a long, b long")


def by_group(key: list[str], of: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``of`` applied to every group of frames that are sorted by ``key``."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in itertools.chain(frames, [None]):
            last = frame is None
            frame = rest if last else frame if rest is None else pd.concat([rest, frame])
            if frame is None or not len(frame):
                continue
            keys = frame[key].to_numpy()
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
            # the last group may go on in the next batch
            starts = [0, *ends[: None if last else -1]]
            found = [made for s, t in itertools.pairwise(starts) if len(made := of(frame.iloc[s:t]))]
            if found:
                yield pd.concat(found)
            rest = frame.iloc[starts[-1] :]

    return apply


class Partners:
    """The pairs of a group of ``forests`` that sizes, places, pivot distance tables and SimHashes leave."""

    def __init__(self, group: pd.DataFrame, least: float):
        self.node, self.root, self.size, self.own, self.place = (group[c].to_numpy(np.int64) for c in ("node", "root", "size", "own", "place"))
        self.fp, self.least = group["fp"].to_numpy(np.int64).view(np.uint64), least
        self.main, self.crossed = group["main"].iat[0], group["low"].iat[0] != group["high"].iat[0]
        self.outside = np.flatnonzero(self.root != self.main)
        self.table = np.bitwise_count(self.fp[:, None] ^ PIVOTS).astype(np.int8)

    def of(self, i: int) -> np.ndarray:
        """Positions of the partners of one that is outside the largest component; each pair comes once."""
        size, place, least = self.size, self.place, self.least
        far = (self.root == self.root[i]) | ((self.root != self.main) & (np.arange(len(size)) < i))
        if self.crossed:
            far |= self.own == self.own[i]
        j = np.flatnonzero(~far & (np.minimum(size, size[i]) >= np.maximum(size, size[i]) * least))
        j = j[np.minimum(size[j] - place[j], size[i] - place[i]) * (1 + least) >= (size[j] + size[i]) * least - SLACK]
        j = j[(np.abs(self.table[j] - self.table[i]) <= SIMILAR_BITS).all(axis=1)]
        return j[np.bitwise_count(self.fp[j] ^ self.fp[i]) <= SIMILAR_BITS]


def contested(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """The members of a group of ``forests`` that have a partner in it."""
    partners, met = Partners(group, least), np.zeros(len(group), bool)
    for i in partners.outside.tolist():
        j = partners.of(i)
        met[j] = True
        met[i] |= len(j) > 0
    return group[met]


def similar_forest(group: pd.DataFrame, least: float) -> list[tuple[int, int]]:
    """Edges of a group of ``forests``: partners are compared run by run unless they are connected already."""
    partners = Partners(group, least)
    node, root, size, run = partners.node, partners.root, partners.size, group["run"].iat[0]
    sets, rare = group["runs"].to_numpy(), group["rare"].to_numpy()
    before = [None] * len(node)
    up, edges = {}, []

    def top(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    def earlier(i: int) -> set[int]:
        if before[i] is None:
            ordered = rare[i].tolist()
            before[i] = set(ordered[: ordered.index(run)])
        return before[i]

    for i in partners.outside.tolist():
        for k in partners.of(i).tolist():
            x, y = top(root[i]), top(root[k])
            if x == y or not earlier(i).isdisjoint(earlier(k)):
                continue
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if both >= (size[i] + size[k] - both) * least:
                up[x] = y
                edges.append((int(node[i]), int(node[k])))
    return edges


def node_of(runs: np.ndarray) -> int | None:
    """A key of a set of runs, as a signed long; None for an empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(runs.tobytes())).view(np.int64)) if len(runs) else None


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = 0.8, width: int = 5
) -> DataFrame:
    """(doc_id, component_id) per row with an id; component_id is the smallest id reachable by links
    between texts whose sets of runs of ``width`` words have a Jaccard similarity of at least ``least``.

    Candidates share a cell of least hashes (MinHash): at this similarity SimHashes differ in too many bits for
    blocks of bits. Pivot distance tables and SimHashes discard those that are more than ``SIMILAR_BITS`` apart; the
    rest is compared run by run. A text without words is near no other. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, size, keys = [], [], [], []
            for text in batch.column("text"):
                runs = np.unique(word_runs(text.as_py(), width))
                node.append(node_of(runs))
                fp.append(majority(runs))
                size.append(len(runs))
                keys.append(cells(runs) if len(runs) else [])
            fp = pa.array(np.array(fp, np.uint64).view(np.int64))
            columns = [batch.column("doc_id"), pa.array(node, pa.int64()), fp, pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "runs", "cells"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, fp long, runs long, cells array<long>"
    prints = staged(rows.mapInArrow(of, schema), "sets")
    nodes = prints.filter("node is not null").groupBy("node")
    nodes = staged(nodes.agg(F.first("fp").alias("fp"), F.first("runs").alias("runs"), F.first("cells").alias("cells"), F.min("doc_id").alias("doc_id")), "nodes")
    roots = connected_components(similar_edges(nodes, rows, least, width)).withColumnRenamed("node", "of")
    rooted = nodes.join(roots, nodes["node"] == roots["of"], "left")
    rooted = staged(rooted.select("node", "doc_id", F.coalesce("root", "node").alias("root")), "roots")
    heads = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.join(heads, "root").select(F.col("node").alias("of"), "component_id")
    found = prints.select("doc_id", "node").join(classes, F.col("node") == F.col("of"), "left")
    return found.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, the one with the smallest id, with all its columns.

    An id that occurs in several rows goes only if each of them is a near copy of another id; rows
    without an id stay.
    """
    return without_copies(docs, near_duplicates(docs, id_col, text_col), id_col)


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = 0.8, width: int = 5
) -> DataFrame:
    """The same with the components of ``similar_documents``."""
    return without_copies(docs, similar_documents(docs, id_col, text_col, least=least, width=width), id_col)


def without_copies(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    copy = F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))
    judged = found.groupBy("doc_id").agg(F.min(copy).alias("copy"))
    dropped = judged.filter("copy").select(F.col("doc_id").alias("__dropped"))
    return docs.join(dropped, docs[f"`{id_col}`"] == dropped["__dropped"], "left_anti")
