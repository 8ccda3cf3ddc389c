"""Token ids in binary files of patched frame-of-reference blocks.

A file is a sequence of segments, each followed by one byte that means nothing. All numbers are little-endian.

    segment   MAGIC, bytes of the segment, documents, ids, blocks (u32 each)
              document ids (i64 each), a byte per document (1: its id is null), lengths in ids (u32 each)
              block minima (u32 each), widths (u8 each), numbers of exceptions (u16 each)
              block starts (u32 each, and one more for the end), counted from the first block
              blocks
    block     BLOCK ids as differences from the block's minimum, packed at its width, low bits first;
              places of the exceptions (u16 each), their differences (u32 each)

The width is that of a percentile of the block's differences. Wider ones are exceptions: they are packed
as zero and stored in the lists. The last block is filled up with its minimum. The starts give
access to any block, so ids in the middle of a segment are read without the blocks before.

Writing: documents are range-partitioned and sorted by id, tasks encode whole texts and make segments of bounded size, and
Spark's writer commits the files. Encodings of words are remembered within bounds, as most words repeat.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.llm.common import kept_in_worker, pick

MAGIC = b"PFR1"
HEADER = "<4sIIII"
BLOCK = 256
#: The part of a block's differences that its width has room for.
PERCENTILE = 0.9
#: Ids and documents of a segment (the last document may pass the first), segments of a file, at most.
SEGMENT_IDS, SEGMENT_DOCS, FILE_SEGMENTS = 1 << 20, 1 << 16, 8
#: Words that a Python worker remembers, at most, and their length.
KEPT_WORDS, KEPT_CHARS = 800_000, 40
#: White space of the tokenizer's pattern. It never cuts a word from the one space before it, and always cuts
#: letters from punctuation after them.
WHITE = r"\t-\r \x85\xa0  -     　"
LATIN, PUNCTUATION = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ſ", r"!-/:-@\[-`{-~"
WORD = f" ?[{LATIN}]++(?![^{WHITE}{PUNCTUATION}])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` numbers below 2^width -> rows of bytes. 64 numbers fill ``width`` words of 64 bits."""
    values = np.ascontiguousarray(rows.reshape(-1, 64).T.astype(np.uint64))
    words = np.zeros((width, values.shape[1]), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= values[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= values[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(rows), BLOCK * width // 8)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    if not width:
        return np.zeros((len(packed), BLOCK), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    values = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        values[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            values[i] |= words[word + 1] << np.uint64(64 - shift)
        values[i] &= mask
    return np.ascontiguousarray(values.T).astype(np.uint32).reshape(len(packed), BLOCK)


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that start at ``starts`` and have ``sizes``."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The segment of some documents: their ids (None: null), numbers of token ids, and all these ids."""
    blocks = -(-len(ids) // BLOCK)
    rows = np.zeros(blocks * BLOCK, np.uint32)
    rows[: len(ids)] = ids
    if len(ids) % BLOCK:
        rows[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
    rows = rows.reshape(blocks, BLOCK)
    least = rows.min(axis=1, initial=0xFFFFFFFF)
    rows = rows - least[:, None]
    at = max(0, min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1))
    width = bit_lengths(np.partition(rows, at, axis=1)[:, at])
    limit = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    odd_block, odd_place = np.nonzero(rows > limit[:, None])
    odd = rows[odd_block, odd_place]
    rows[odd_block, odd_place] = 0
    count = np.bincount(odd_block, minlength=blocks)
    packed_size = BLOCK * width // 8
    starts = np.concatenate(([0], np.cumsum(packed_size + 6 * count)))
    data = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        packed = pack(rows[of], int(w))
        data[starts[of][:, None] + np.arange(packed.shape[1])] = packed
    first = starts[:-1] + packed_size
    data[places(first, 2 * count)] = odd_place.astype("<u2").view(np.uint8)
    data[places(first + 2 * count, 4 * count)] = odd.astype("<u4").view(np.uint8)
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    body = b"".join((
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.asarray(lengths, "<u4").tobytes(),
        least.astype("<u4").tobytes(), width.astype("u1").tobytes(), count.astype("<u2").tobytes(), starts.astype("<u4").tobytes(),
        data.tobytes(),
    ))
    return struct.pack(HEADER, MAGIC, struct.calcsize(HEADER) + len(body), len(doc_ids), len(ids), blocks) + body


class Segment:
    """A segment's tables; ids are unpacked block by block on demand."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, self.size, self.docs, self.count, blocks = struct.unpack_from(HEADER, data, at)
        if magic != MAGIC or at + self.size > len(data):
            raise ValueError("not a segment of token ids")
        at += struct.calcsize(HEADER)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids, self.nulls, self.lengths = take("<i8", self.docs), take("u1", self.docs), take("<u4", self.docs)
        self.least, self.width, self.odd = take("<u4", blocks), take("u1", blocks), take("<u2", blocks).astype(np.int64)
        self.starts = take("<u4", blocks + 1).astype(np.int64)
        self.data = take("u1", int(self.starts[-1]))

    def blocks(self, low: int, high: int) -> np.ndarray:
        """The ids of blocks ``low`` to ``high`` (not included), the last one's filling too."""
        width, count, starts = self.width[low:high].astype(np.int64), self.odd[low:high], self.starts[low:high]
        rows = np.empty((high - low, BLOCK), np.uint32)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            rows[of] = unpack(self.data[starts[of][:, None] + np.arange(BLOCK * w // 8)], int(w))
        first = starts + BLOCK * width // 8
        place = np.ascontiguousarray(self.data[places(first, 2 * count)]).view("<u2")
        rows[np.repeat(np.arange(high - low), count), place] = np.ascontiguousarray(self.data[places(first + 2 * count, 4 * count)]).view("<u4")
        return (rows + self.least[low:high, None]).reshape(-1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop`` (not included); only the blocks that hold them are unpacked."""
        stop = self.count if stop is None else min(stop, self.count)
        if start >= stop:
            return np.empty(0, np.uint32)
        low, high = start // BLOCK, -(-stop // BLOCK)
        return self.blocks(low, high)[start - low * BLOCK : stop - low * BLOCK]


def segments(data: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        segment = Segment(view, at)
        yield segment
        at += segment.size + 1


class Known(dict):
    """Words and their ids. Asking for other words notes them in ``new``."""

    def __init__(self):
        self.new: set[str] = set()

    def __missing__(self, word: str) -> None:
        self.new.add(word)


class Encoder:
    """Token ids as bytes of little-endian u32. Words of the tokenizer's pattern never cross the places where
    ``WORD`` cuts, so most texts are put together from words; one that holds a special token's text is not cut.

    Words are remembered in two generations: when the younger one is full it replaces the older one, from which words
    that are met again come back. So words that repeat stay."""

    def __init__(self, tokenizer: str, kept_words: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already share the machine
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.line = self.whole("\n")[0]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.blank = re.compile(WORD).findall, re.compile(f"[{WHITE}]+").fullmatch
        self.known, self.older, self.kept_words = Known(), {}, kept_words

    def whole(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u4")

    def words(self, words: list[str]) -> list[bytes]:
        """Words without white space but a first space, all in one text: line ends are cut from words, and no word has one."""
        ids = self.whole("\n".join(words))
        ends = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist()
        data, starts = ids.tobytes(), [0, *(4 * e + 4 for e in ends)]
        return [data[s : 4 * e] for s, e in zip(starts, ends, strict=False)]

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text).tobytes()
        words, known = self.cut(text), self.known
        deque(map(known.__getitem__, words), 0)
        if not known.new:
            return b"".join(map(known.__getitem__, words))
        new = self.encoded(known.new)
        known.new = set()
        known.update(new)
        found = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > KEPT_CHARS:
                del known[w]
        if len(known) > self.kept_words // 2:
            self.known, self.older = Known(), known
        return found

    def encoded(self, words: set[str]) -> dict[str, bytes]:
        older = self.older
        found = {w: older.pop(w) for w in words if w in older}
        found.update((w, self.whole(w).tobytes()) for w in words if w[-1].isspace() and self.blank(w) and w not in found)
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self.words(rest), strict=True) if rest else ())
        return found


def word_wise(tokenizer: str) -> bool:
    """Whether a tokenizer's texts may be cut by ``WORD``: byte-level, by its own pattern, nothing normalised."""
    import json

    model = json.loads(tokenizer)
    before = model.get("pre_tokenizer") or {}
    return not model.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 0,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Writes the ids of every whole text and ``end_id`` after it, in ascending order of the documents' ids (longs).

    ``tokenizer`` is the content of a tokenizer file. A null text is empty; null ids come first. Rows that repeat
    an id follow each other in an order by a hash of the text. An empty table gives no segment.
    """
    if not word_wise(tokenizer):
        raise ValueError("only byte-level tokenizers with their own pattern are supported")
    rows = pick(docs, doc_id=id_col, text=text_col).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "hash", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("long"), "text")
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        encoder = kept_in_worker("encoder", tokenizer, lambda: Encoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        names, parts, held = [], [], 0

        def segment() -> pa.RecordBatch:
            data = write_segment(names, np.array([len(p) // 4 for p in parts]), np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                names.append(doc_id.as_py())
                parts.append(encoder.of(text.as_py()) + end)
                held += len(parts[-1]) // 4
                if held >= segment_ids or len(names) >= SEGMENT_DOCS:
                    yield segment()
                    names, parts, held = [], [], 0
        if names:
            yield segment()

    made = rows.mapInArrow(encode, "segment binary")
    # the writer puts out the bytes of a string as they are
    made.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path, lineSep="\n")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(task, file, before, doc_id, n_tokens, ids_crc32[, ids]) of the documents in the files.

    ``task`` and ``file`` order the files; ``before`` is the number of ids before the document in its file.
    """
    name = r"part-(\d+).*-c(\d+)[^/]*$"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(*[F.regexp_extract("path", name, n).cast("int").alias(c) for n, c in ((1, "task"), (2, "file"))], "content")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, file, content in zip(*batch.columns, strict=True):
                before = 0
                for segment in segments(content.as_buffer()):
                    ids, ends = segment.ids(), np.cumsum(segment.lengths, dtype=np.int64)
                    starts, data = ends - segment.lengths, memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [
                        pa.array(np.full(segment.docs, task.as_py(), np.int32)), pa.array(np.full(segment.docs, file.as_py(), np.int32)),
                        pa.array(before + starts), pa.array(segment.doc_ids, mask=segment.nulls.astype(bool)),
                        pa.array(segment.lengths.astype(np.int64)), pa.array(crc, pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(np.append(starts, ends[-1:]).astype(np.int32), pa.array(ids.astype(np.int32))))
                    names = ["task", "file", "before", "doc_id", "n_tokens", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])
                    before += segment.count

    schema = "task int, file int, before long, doc_id long, n_tokens long, ids_crc32 long"
    return files.mapInArrow(decode, schema + ", ids array<int>" * with_ids)


def with_starts(found: DataFrame, group: int = 1024) -> DataFrame:
    """``found`` of ``read_ids`` with ``start``, the number of ids of all documents before.

    Files are summed up in groups of tasks first, so that no task sorts all files of a large table.
    """
    totals = found.groupBy("task", "file").agg(F.sum("n_tokens").alias("ids")).withColumn("group", F.floor(F.col("task") / group))
    until = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("ids").alias("ids"))
    groups = groups.select(F.col("group").alias("of"), F.coalesce(F.sum("ids").over(until().orderBy("group")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(until("group").orderBy("task", "file")), F.lit(0))
    files = totals.withColumn("inside", inside).join(groups, F.col("group") == F.col("of"))
    files = files.select(F.col("task").alias("t"), F.col("file").alias("f"), (F.col("base") + F.col("inside")).alias("base"))
    joined = found.join(files, (F.col("task") == F.col("t")) & (F.col("file") == F.col("f")))
    return joined.withColumn("start", F.col("base") + F.col("before")).drop("t", "f", "base")
