"""SentencePiece encoding and decoding over a relational lattice.

A text is marked as the model does it (one space before it, every space as U+2581) and cut into
words at places that no piece crosses: before marks, around newlines, and between characters that no
chain of pieces links (``word_pattern``), as letters and punctuation. ``encode_words`` is the lattice: words are exploded into
substrings of bounded length, equi-joined to the piece table, the edges found are grouped by word,
and a fold with the higher-order ``aggregate`` keeps the best path to every position. A character
without a piece becomes its UTF-8 bytes.

A unigram model's own scores are log-probabilities, and the best path has the greatest sum. A BPE
model's scores are merge ranks, and their sum says nothing: there, a piece may follow another only
if merging the two side by side leaves them as they are (``Apart``). Just one path meets that at
every step, and it is the one that merging by rank gives, so the ids are the model's own. Ties go
to the longer last piece.

The words of a corpus have no bound, so their encodings can't be broadcast, and a join of every
occurrence would shuffle several times the corpus. So the relation runs on the most frequent
words, at most ``dictionary`` of them, counted over all documents; their encodings are handed to
the tasks. Words that are left are solved by the tasks, those of a unigram model one by one by the same fold, those of a BPE model by
the same lattice as arrays, many words at once (``Lattice``); long words by walking the one path that is left, longest piece
first. A task keeps a bounded number of words.
"""

from __future__ import annotations

import gc
import itertools
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from marketlake.session import staged

MARK = "▁"
WORD = f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n+"
#: Words of the dictionary, and their length, at most.
DICTIONARY = 1 << 17
DICTIONARY_CHARS = 32
#: Stands for the start of a word and for a character as bytes: no piece merges with these.
BYTES = -1
#: The type of an ordinary piece in a model file.
NORMAL = 1
#: Pairs that ``Apart`` remembers, at most.
KEPT_PAIRS = 1 << 18
#: The same of a ``Lattice``, which keeps them as arrays.
LATTICE_PAIRS = 1 << 20
#: Characters of a window whose edges are remembered, and how many windows, at most.
WINDOW = 6
KEPT_WINDOWS = 1 << 16
#: Entries of the table of a ``Lattice``'s steps, at most; longer strings than it holds are searched for.
TABLE_STEPS = 1 << 21
#: Words that a task counts before it hands the counts on, up to the text that passes it.
COUNTED_WORDS = 1 << 18
#: Rows whose ids a task holds before it hands them on, and their words, up to the row that passes it.
BATCH_ROWS, BATCH_WORDS = 512, 1 << 17
#: In a lattice: a place that no path has reached.
UNREACHED = -2


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: piece -> (id, weight on the path), the ids of the 256 bytes, all
    pieces by id. ``ranks`` are a BPE model's scores by piece, None for a unigram model."""

    table: dict[str, tuple[int, float]]
    byte_ids: list[int]
    byte_score: float
    hexes: list[str]
    ranks: dict[str, float] | None

    @property
    def longest(self) -> int:
        return max(map(len, self.table))

    def apart(self) -> Apart | None:
        return Apart({i: p for p, (i, _) in self.table.items()}, self.ranks) if self.ranks else None


class Apart(dict):
    """Whether a piece may follow another in a BPE model, by ``before << 32 | after``: not so if a
    merge joins them. Answers are remembered, a bounded number of them."""

    def __init__(self, names: dict[int, str], ranks: dict[str, float]):
        self.names, self.ranks = names, ranks
        self.longest = max(map(len, ranks))
        self.windows = {}  # the edges from a few characters on, which words share

    def __missing__(self, pair: int) -> bool:
        if len(self) >= KEPT_PAIRS:
            self.clear()
        self[pair] = found = self.holds(pair)
        return found

    def holds(self, pair: int) -> bool:
        two = [self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]]
        return merged("".join(two), self.ranks) == two

    def __reduce__(self):
        return Apart, (self.names, self.ranks)


def merged(text: str, ranks: dict[str, float]) -> list[str]:
    """Merging by rank: always the neighbours of the highest score, the leftmost first."""
    none, parts = -math.inf, list(text)
    joined = [ranks.get(x + y, none) for x, y in itertools.pairwise(parts)]
    while joined and (best := max(joined)) > none:
        k = joined.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del joined[k]
        for at in (k - 1, k):
            if 0 <= at < len(joined):
                joined[at] = ranks.get(parts[at] + parts[at + 1], none)
    return parts


def load_pieces(path: str) -> Pieces:
    """Reads a model file. Control and unknown pieces take no part; user-defined ones are refused."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        proto = ModelProto.FromString(f.read())
    bpe = proto.trainer_spec.model_type == 2
    scores, byte_ids, hexes = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            hexes.append(piece[3:-1])
        elif model.is_control(i) or model.is_unknown(i):
            hexes.append("")
        elif proto.pieces[i].type != NORMAL:
            raise ValueError(f"the model has pieces that are matched before all others, such as {piece!r}")
        else:
            scores[piece] = (i, model.get_score(i))
            hexes.append(piece.replace(MARK, " ").encode().hex())
    if any("\n" in p or MARK in p.lstrip(MARK) or (p.lstrip(MARK) and p.startswith(MARK * 2)) for p in scores):
        raise ValueError("the model has pieces that cross the places where words are cut")
    if not bpe:
        return Pieces(scores, byte_ids, min(score for _, score in scores.values()) - 10.0, hexes, None)
    ranks = {p: score for p, (_, score) in scores.items()}
    # a piece that no merging makes is never used; on the one path left, weights do not matter
    table = {p: (i, 0.0) for p, (i, _) in scores.items() if merged(p, ranks) == [p]}
    return Pieces(table, byte_ids, 0.0, hexes, ranks)


def word_pattern(pieces: Pieces) -> str:
    """Matches the words of a marked text. ``WORD`` is cut further where a character of the largest class meets one that
    is not of it. Characters side by side in a piece, merged or not, are of one class, so no piece crosses that cut."""
    kin = {}

    def root(char: str) -> str:
        while (up := kin.setdefault(char, char)) != char:
            char = up
        return char

    for piece in pieces.ranks or pieces.table:
        for a, b in itertools.pairwise(piece.lstrip(MARK)):
            kin[root(a)] = root(b)
    classes = {}
    for char in sorted(kin):
        classes.setdefault(root(char), []).append(char)
    if not classes:
        return WORD
    largest = "".join(map(re.escape, max(classes.values(), key=len)))
    return f"{MARK}*[{largest}]+|{MARK}*[^{largest}{MARK}\\n]+|{MARK}+|\\n+"


def reachable(table: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float] | None]:
    """The pieces and, with None, all their beginnings: past a string that is neither, no piece follows."""
    return {p[:n]: None for p in table for n in range(1, len(p))} | table


def best_path(
    word: str, reach: dict[str, tuple[int, float] | None], byte_ids: list[int], byte_score: float, apart: Apart | None
) -> tuple[int, ...]:
    """The same for one word, in a task: from each position on to all that its edges lead to."""
    if apart is not None:
        return only_path(word, reach, byte_ids, apart)
    n = len(word)
    best, edges = [0.0] + [-math.inf] * n, [(0, ())] * (n + 1)
    for start in range(n):
        here, end, single = best[start], start + 1, False
        while end <= n:
            edge = reach.get(word[start:end], 0)
            if edge == 0:
                break
            if edge is not None:
                single |= end == start + 1
                if here + edge[1] > best[end]:
                    best[end], edges[end] = here + edge[1], (start, edge[:1])
            end += 1
        if not single:
            data = word[start].encode()
            if here + byte_score * len(data) > best[start + 1]:
                best[start + 1] = here + byte_score * len(data)
                edges[start + 1] = (start, tuple(byte_ids[b] for b in data))
    path, at = [], n
    while at:
        at, ids = edges[at]
        path.append(ids)
    return tuple(i for ids in reversed(path) for i in ids)


def edges_from(text: str, size: int, reach: dict[str, tuple[int, float] | None]) -> tuple[list[tuple[int, int]], bool]:
    """(size, id) of the pieces that ``text`` begins with and that are longer than ``size``, and
    whether a longer text might begin with more."""
    found = []
    while size < len(text):
        size += 1
        edge = reach.get(text[:size], 0)
        if edge == 0:
            return found, False
        if edge is not None:
            found.append((size, edge[0]))
    return found, True


def only_path(word: str, reach: dict[str, tuple[int, float] | None], byte_ids: list[int], apart: Apart) -> tuple[int, ...]:
    """The path of a BPE model through the same lattice, longest edge first. Only one way leads to
    each position, so a position from which none leads on is not entered again."""
    n, at, before, edges = len(word), 0, BYTES, None
    taken, dead, known = [], set(), apart.windows
    while at < n:
        if edges is None:
            window = word[at : at + WINDOW]
            found = known.get(window)
            if found is None:
                found = edges_from(window, 0, reach)
                if len(known) >= KEPT_WINDOWS:
                    known.clear()
                known[window] = found = tuple(found[0]), found[1]
            ahead, more = found
            edges = list(ahead)
            if more and at + WINDOW < n:
                edges += edges_from(word[at : at + WINDOW + apart.longest], WINDOW, reach)[0]
            if not edges or edges[0][0] > 1:
                edges.insert(0, (1, BYTES))
        while edges:
            size, piece = edges.pop()
            end = at + size
            if end not in dead and (before == BYTES or piece == BYTES or apart[before << 32 | piece]):
                taken.append((at, before, edges, piece))
                at, before, edges = end, piece, None
                break
        else:
            dead.add(at)
            at, before, edges, _ = taken.pop()
    ids = []
    for start, _, _, piece in taken:
        ids += (piece,) if piece != BYTES else (byte_ids[b] for b in word[start].encode())
    return tuple(ids)


class Lattice:
    """The lattices of many words of a BPE model at once: edges by one trie of the pieces, then a fold over the places
    of all words. As in the relation, a place keeps the edge of the longest last piece that may follow the one before it."""

    def __init__(self, pieces: Pieces):
        inner = {p[:n] for p in pieces.table for n in range(1, len(p))}
        begun = sorted(inner | pieces.table.keys(), key=lambda p: (p not in inner, len(p), p))
        node = {p: i for i, p in enumerate(begun)}
        top = ord(max(map(max, begun))) + 2  # stands for all characters beyond
        self.first, self.code = np.full(top, BYTES, np.int32), np.zeros(top, np.int32)
        for p in begun:
            if len(p) == 1:
                self.first[ord(p)] = node[p]
        later = sorted({c for p in begun for c in p[1:]})
        self.code[[ord(c) for c in later]] = np.arange(1, len(later) + 1)
        self.width, self.inner = len(later) + 1, len(inner)  # nodes from ``inner`` on are leaves
        longer = [p for p in begun if len(p) > 1]
        self.kind = np.int32 if len(inner) * self.width < np.iinfo(np.int32).max else np.int64
        keys = np.array([node[p[:-1]] * self.width + self.code[ord(p[-1])] for p in longer], self.kind)
        order = np.argsort(keys)
        # after all keys one more, so that each has one not before it
        self.steps = np.append(keys[order], np.iinfo(self.kind).max).astype(self.kind)
        self.to = np.append(np.array([node[p] for p in longer], np.int32)[order], np.int32(BYTES))
        self.piece = np.array([pieces.table.get(p, (BYTES,))[0] for p in begun])
        sizes = np.bincount([len(p) for p in inner], minlength=2)
        self.table_size = int(np.searchsorted(np.cumsum(sizes) * self.width, TABLE_STEPS, "right"))
        self.table_rows = int(sizes[: self.table_size].sum())  # nodes of less than ``table_size`` characters
        self.table = None  # made by the task
        self.apart = pieces.apart()
        self.none = np.array([np.iinfo(np.int64).max]), np.array([False])
        self.pairs, self.free = self.none

    def step(self, node: np.ndarray, code: np.ndarray, size: int) -> np.ndarray:
        """The nodes one character on, BYTES where there is none; ``size`` is the number of characters before."""
        keys = node * self.kind(self.width) + code
        if size < self.table_size:
            if self.table is None:
                self.table = np.full(self.table_rows * self.width, BYTES, np.int32)
                near = self.steps < len(self.table)
                self.table[self.steps[near]] = self.to[near]
            return self.table[keys]
        k = np.searchsorted(self.steps, keys)
        return np.where(self.steps[k] == keys, self.to[k], BYTES)

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, id) of the edges; ``left`` is the number of characters from a place to its word's end."""
        chars = np.minimum(chars, len(self.first) - 1)
        code, at, node, size, found = self.code[chars], np.arange(len(chars)), self.first[chars], 1, []
        single = np.append(self.piece, BYTES)[node] != BYTES  # the last one is for characters that begin no piece
        while at.size:
            known = np.flatnonzero(node != BYTES)
            at, node = at[known], node[known]
            piece = self.piece[node]
            ends = np.flatnonzero(piece != BYTES)
            found.append((at[ends], np.full(len(ends), size), piece[ends]))
            more = np.flatnonzero((node < self.inner) & (left[at] > size))
            at = at[more]
            node = self.step(node[more], code[at + size], size)
            size += 1
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), BYTES)))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def may_follow(self, pairs: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.pairs, pairs)
        new = np.unique(pairs[self.pairs[k] != pairs])
        if len(new):
            if len(self.pairs) + len(new) > LATTICE_PAIRS:
                new, (self.pairs, self.free) = np.unique(pairs), self.none
            at = np.searchsorted(self.pairs, new)
            self.free = np.insert(self.free, at, [self.apart.holds(p) for p in new.tolist()])
            self.pairs = np.insert(self.pairs, at, new)
            k = np.searchsorted(self.pairs, pairs)
        return self.free[k]

    def paths(self, words: list[str]) -> list[bytes | None]:
        """The ids of distinct, non-empty words, as bytes; None for a word with a character that becomes bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        offset = np.arange(len(chars)) - (np.cumsum(sizes) - sizes)[word]
        start, size, piece = self.edges(chars, sizes[word] - offset)
        order = np.argsort(offset.astype(np.min_scalar_type(sizes.max()))[start], kind="stable")  # small types are sorted by radix
        start, size, piece = start[order], size[order], piece[order]
        upto = np.cumsum(np.bincount(offset[start])).tolist()
        here = start + word[start]  # a word has one place more than characters
        there = here + size
        first = np.cumsum(sizes + 1) - sizes - 1
        last = np.full(len(chars) + len(words), UNREACHED)
        last[first] = BYTES
        came = np.zeros(len(last), np.int64)
        for begin, end in itertools.pairwise([0, *upto]):
            a, b, p = here[begin:end], there[begin:end], piece[begin:end]
            open_ = np.flatnonzero((last[a] != UNREACHED) & (last[b] == UNREACHED))
            a, b, p = a[open_], b[open_], p[open_]
            before = last[a]
            joins = np.flatnonzero((before != BYTES) & (p != BYTES))
            may = np.ones(len(a), bool)
            may[joins] = self.may_follow(before[joins] << 32 | p[joins])
            last[b[may]], came[b[may]] = p[may], a[may]
        taken, is_first, at = np.zeros(len(last), bool), np.zeros(len(last), bool), first + sizes
        is_first[first] = True
        while at.size:
            taken[at] = True
            at = came[at]
            at = at[~is_first[at]]
        upto = np.concatenate(([0], np.cumsum(taken)))
        ids, spans = last[taken].astype(np.int32), zip(upto[first].tolist(), upto[first + sizes + 1].tolist(), strict=True)
        lone = np.zeros(len(words), bool)
        lone[np.repeat(np.arange(len(words)), sizes + 1)[np.flatnonzero(taken & (last < 0))]] = True
        return [None if alone else ids[a:b].tobytes() for (a, b), alone in zip(spans, lone.tolist(), strict=True)]


def pair(before: Column, after: Column) -> Column:
    return F.shiftleft(before.cast("long"), 32).bitwiseOR(after.cast("long"))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct, non-empty words. The piece table is broadcast: its size is the
    model's, whatever the input."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.table.items()], "piece string, id int, score double")
    n = F.length("word")
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start") + 1)))
    cuts = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("start")).select("word", "start", size.alias("size"))
    cuts = cuts.withColumn("piece", F.col("word").substr(F.col("start"), F.col("size")))
    joined = cuts.join(F.broadcast(table), "piece", "left").filter("id is not null or size = 1")
    data = F.hex(F.encode("piece", "UTF-8"))
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
    at = F.sequence(F.lit(0), (F.length(data) / 2).cast("int") - 1)
    as_bytes = F.transform(at, lambda k: F.get(byte_ids, F.conv(data.substr(k * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    edges = joined.select(
        "word", (F.col("start") + F.col("size") - 1).alias("end"), (F.col("start") - 1).alias("start"),
        F.coalesce("score", F.size(as_bytes) * pieces.byte_score).alias("score"), F.coalesce("id", F.lit(BYTES)).alias("id"),
        F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes).alias("ids"),
    )
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("end", "start", "score", "ids", "id")).alias("edges"))
    apart = pieces.apart()
    if apart is not None:  # the pairs of neighbours along each word; at a position they are bounded by the pieces' length
        ahead = lambda e: F.filter("edges", lambda d: (d["end"] == e["start"]) & (d["id"] != BYTES))
        inner = F.filter("edges", lambda e: (e["start"] > 0) & (e["id"] != BYTES))
        pairs = F.flatten(F.transform(inner, lambda e: F.transform(ahead(e), lambda d: pair(d["id"], e["id"]))))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[p for p in pairs if apart[p]] for pairs in batch.column("kept").to_pylist()]
                yield batch.set_column(2, "kept", pa.array(found, pa.list_(pa.int64())))

        # a plan node of its own: a scalar function would be moved into the fold's lambda, where it can not run
        grouped = grouped.withColumn("kept", pairs)
        grouped = grouped.mapInArrow(kept, grouped.schema)

    def reach(ends: Column, end: Column) -> Column:
        here = F.filter("edges", lambda e: e["end"] == end)
        if apart is not None:
            before = lambda e: F.get(ends, e["start"])["id"]
            free = lambda e: (e["id"] == BYTES) | (before(e) == BYTES)
            here = F.filter(here, lambda e: free(e) | F.array_contains("kept", pair(before(e), e["id"])))
        scored = F.transform(here, lambda e: F.struct(
            (F.get(ends, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"), e["ids"].alias("ids"),
            e["id"].alias("id")))
        return F.concat(ends, F.array(F.array_max(scored)))

    none = F.array().cast("array<int>")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), none.alias("ids"), F.lit(BYTES).alias("id")))
    ends = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, reach)
    solved = grouped.select("word", ends.alias("ends"))

    def back(acc: Column, end: Column) -> Column:
        best = F.get(F.col("ends"), end)
        step = F.struct((-best["back"]).alias("at"), F.concat(best["ids"], acc["ids"]).alias("ids"))
        return F.when(acc["at"] == end, step).otherwise(acc)

    path = F.aggregate(
        F.sequence(F.length("word"), F.lit(1)), F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("ids")),
        back, lambda acc: acc["ids"],
    )
    return solved.select("word", path.alias("ids"))


def mark(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def marked(text: Column) -> Column:
    """The same for a column; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", text).otherwise(F.concat(F.lit(MARK), F.translate(text, " ", MARK)))


def counted_words(rows: DataFrame, pattern: str) -> DataFrame:
    """(word, n) of all words that a dictionary may have, counted over all rows. Tasks cut the texts and count; a
    task's counts are handed on and summed per word."""

    def handed_on(counts: Counter) -> pa.RecordBatch:
        short = [(w, n) for w, n in counts.items() if len(w) <= DICTIONARY_CHARS]
        return pa.record_batch([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = re.compile(pattern), Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(cut.findall(mark(text.as_py())))
                if len(counts) >= COUNTED_WORDS:
                    yield handed_on(counts)
                    counts.clear()
        yield handed_on(counts)

    counts = rows.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(rows: DataFrame, limit: int, pattern: str) -> DataFrame:
    """The most frequent words, at most ``limit``, with ties left out together. Counts are over all rows."""
    counts = counted_words(rows, pattern)
    # words seen once gain nothing from a dictionary
    counts = staged(counts.filter("n > 1"), "words")
    totals = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    running = totals.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("upto"))
    least = running.filter(F.col("upto") <= limit).agg(F.min("n")).first()[0]
    return counts.filter(F.col("n") >= least if least is not None else F.lit(False)).select("word")


def encode(
    docs: DataFrame, model: str | Pieces, id_col: str = "doc_id", text_col: str = "text", *,
    dictionary: int = DICTIONARY, kept_words: int = 100_000, carry: tuple[str, ...] = (), back: str | None = None,
) -> DataFrame:
    """(doc_id, ids) per row, and the columns to ``carry``: the piece ids of the whole text. A null text gives null, an empty
    one no ids. Repeated rows are encoded each. ``kept_words`` bounds what a task remembers beyond the dictionary. ``back``
    names a column for the text that the ids stand for, as ``decoded`` has it, put together from them by the same task."""
    spark: SparkSession = docs.sparkSession
    pieces = load_pieces(model) if isinstance(model, str) else model
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), *carry)
    pattern = word_pattern(pieces)
    known = encode_words(frequent_words(rows, dictionary, pattern), pieces).toArrow()
    # ids as bytes: half the memory of tuples, and a text's are put together by one join
    known = {w.as_py(): i.values.to_numpy().astype(np.int32).tobytes() for w, i in zip(known["word"], known["ids"], strict=True)}
    lattice = Lattice(pieces) if pieces.ranks else None
    shared = spark.sparkContext.broadcast((known, lattice, pieces.hexes if back else [], (pieces.table, pieces.byte_ids, pieces.byte_score, pieces.apart())))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lattice, hexes, (table, *of_bytes) = shared.value
        reach, cut = reachable(table), re.compile(pattern)
        spelled = [bytes.fromhex(h) for h in hexes].__getitem__
        gc.freeze()  # what was handed to the task stays, so no collection need walk it
        memo = dict(known)

        def learn(words: set[str]) -> dict[str, bytes]:
            """Adds what is not known to ``memo``; returns the long ones, which are not kept."""
            new = [w for w in words if w not in memo]
            while len(memo) > len(known) and len(memo) + len(new) > len(known) + kept_words:  # the dictionary came first, so it stays
                memo.popitem()
            new = [w for w in words if w not in memo]
            short = [w for w in new if len(w) <= DICTIONARY_CHARS]
            memo.update(zip(short, lattice.paths(short) if lattice and short else [None] * len(short), strict=True))
            alone = [w for w in new if memo.get(w) is None]
            found = {w: array("i", best_path(w, reach, *of_bytes)).tobytes() for w in alone}
            memo.update((w, ids) for w, ids in found.items() if w in memo)
            return {w: ids for w, ids in found.items() if w not in memo}

        def encoded(part: pa.RecordBatch, texts: list[list[str] | None]) -> pa.RecordBatch:
            long = learn(set().union(*filter(None, texts)))
            ids = (memo | long).__getitem__ if long else memo.__getitem__
            found = [None if words is None else np.frombuffer(b"".join(map(ids, words)), np.int32) for words in texts]
            part = part.drop_columns(["text"]).append_column("ids", pa.array(found, pa.list_(pa.int32())))
            if back is None:
                return part
            again = [None if ids is None else b"".join(map(spelled, ids.tolist())).removeprefix(b" ") for ids in found]
            return part.append_column(back, pa.array(again, pa.binary()).cast(pa.string()))

        for batch in batches:
            at, texts, words = 0, [], 0
            for text in batch.column("text"):
                text = text.as_py()
                texts.append(None if text is None else cut.findall(mark(text)))
                words += len(texts[-1] or ())
                if len(texts) >= BATCH_ROWS or words >= BATCH_WORDS:
                    yield encoded(batch.slice(at, len(texts)), texts)
                    at, texts, words = at + len(texts), [], 0
            if texts:
                yield encoded(batch.slice(at), texts)

    types = rows.drop("text").schema.add("ids", ArrayType(IntegerType()))
    return rows.mapInArrow(of, types if back is None else types.add(back, StringType()))


def decoded(ids: Column, pieces: Pieces) -> Column:
    """The text of a column of piece ids. Bytes are put together before they are read as UTF-8.
    Exact for every text that holds no U+2581 itself, which the model reads as a space."""
    table = F.split(F.lit(",".join(pieces.hexes)), ",")
    data = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
    return F.regexp_replace(F.decode(data, "UTF-8"), "^ ", "")
