"""Raw day files: gzip CSV with a header, one file per trading day, all tickers.

Spark binds CSV columns to a given schema by position, so files whose headers list the columns
in another order would silently swap values. Files are grouped by their header, every group is
read with its own header as schema, and columns are then taken by name.
"""

from __future__ import annotations

import csv
import re
import time
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.schemas import BRONZE, RAW_COLUMNS

# File suffix and the spellings of a missing number.
SUFFIX = ".csv.gz"
# the date is the file name, or the folder of a day that was written as several files
DATE_IN_NAME = r"(\d{4}-\d{2}-\d{2})(?:/[^/]+)?\.csv\.gz$"
NULL_NUMBERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]
PROBE = "path string, file string, status string, error string, header array<string>, rows bigint, seconds double"
PROBE_TYPES = pa.schema({
    "path": pa.string(), "file": pa.string(), "status": pa.string(), "error": pa.string(), "header": pa.list_(pa.string()),
    "rows": pa.int64(), "seconds": pa.float64(),
})
# where the reader puts a line whose fields do not match the header
RAGGED = "__ragged_line"


def day_file_globs(root: str, year: int, months: Iterable[int]) -> list[str]:
    """Glob patterns of the day files of some months: ``{root}/{year}/{MM}/*.csv.gz``."""
    return [f"{root.rstrip('/')}/{year}/{month:02d}/*{SUFFIX}" for month in months]


def exported_globs(root: str) -> list[str]:
    """The same for a root written by ``write_day_files``."""
    return [f"{root.rstrip('/')}/*/*/*/*{SUFFIX}"]


def list_files(spark: SparkSession, globs: list[str]) -> list[str]:
    """Sorted paths behind the patterns: names only, no content is read."""
    files = spark.read.format("binaryFile").load(globs).select("path")
    return sorted(row.path for row in files.collect())


def date_of(path: str) -> str | None:
    """The date in a file's name or folder, None without one."""
    match = re.search(DATE_IN_NAME, path)
    return match.group(1) if match else None


def probe_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file, status, error, header, rows, seconds) of every file, from one job whatever their number.

    Each task unzips its files as a whole, so a file that can not be decoded is found before anything is written:
    ``status`` is ok, empty (no line after the header) or unreadable, with the class of the error. A storage that
    fails is no broken file: it fails the task, which Spark repeats, and in the end the job. ``rows`` are the lines after the
    header that are not blank, ``header`` the first line's names, ``file`` the name that reading a file gives its rows.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("file"), "content")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, content in zip(*batch.columns, strict=True):
                began = time.perf_counter()
                status, error, header, rows = probe_content(content.as_buffer())
                row = {
                    "path": path.as_py(), "file": file.as_py(), "status": status, "error": error, "header": header,
                    "rows": rows, "seconds": time.perf_counter() - began,
                }
                yield pa.RecordBatch.from_pylist([row], PROBE_TYPES)

    return files.mapInArrow(probe, PROBE)


def probe_content(content: bytes, piece: int = 1 << 20) -> tuple[str, str | None, list[str] | None, int]:
    """(status, error class, header, rows) of the content of one gzip CSV file, unzipped piece by piece."""
    header, rows, rest, at, view = None, 0, b"", 0, memoryview(content)
    unzip = zlib.decompressobj(31)
    try:
        while at < len(view) or unzip.unused_data:
            if unzip.eof:  # the next member of the file
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
                if not data and at >= len(view):
                    break
            else:
                data = b""
            data += bytes(view[at : at + piece])
            at += piece
            *lines, rest = (rest + unzip.decompress(data)).split(b"\n")
            if lines and header is None:
                header = lines.pop(0)
            rows += sum(map(bool, map(bytes.strip, lines)))
        if len(view) and not unzip.eof:
            return "unreadable", "EOFError", None, 0
        if header is None:
            header, rest = rest, b""
        rows += bool(rest.strip())
        names = next(csv.reader([header.decode("utf-8-sig")]), [])
    except (zlib.error, UnicodeDecodeError, csv.Error) as error:
        return "unreadable", type(error).__name__, None, 0
    return "ok" if rows else "empty", None, names, rows


def header_groups(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths of readable files by header."""
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for row in probe_files(spark, paths).where("header is not null").collect():
        groups[tuple(row.header)].append(row.path)
    return dict(groups)


def read_day_files(
    spark: SparkSession, paths: list[str], groups: dict[tuple[str, ...], list[str]] | None = None
) -> DataFrame:
    """All files as typed bars with ``date`` from the file name, plus ``row_ok``, ``raw`` and ``file``.

    ``groups`` are the paths by header where they are known. ``row_ok`` is false where a declared number does not parse or the row has more or fewer fields
    than the header; ``raw`` then holds the original texts. Missing columns are typed nulls, unknown columns are dropped.
    """
    parts = [_read_group(spark, names, files) for names, files in (groups or header_groups(spark, paths)).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("row_ok").select(*BRONZE.fieldNames())


def quarantined_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("not row_ok").select("date", "raw")


def align(table: DataFrame, date: Column) -> DataFrame:
    """Any table -> bronze columns: known columns cast, missing ones null, others dropped."""
    have = set(table.columns)
    return table.select(
        *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in RAW_COLUMNS.items()],
        date.cast("string").alias("date"),
    )


def write_day_files(bars: DataFrame, root: str) -> None:
    """Exports bars as gzip CSV in ``{root}/{year}/{MM}``-like folders, one folder per day; a
    large day becomes several files."""
    (
        bars.hint("rebalance", "date")
        .withColumns({"year": F.substring("date", 1, 4), "month": F.substring("date", 6, 2)})
        .write.partitionBy("year", "month", "date")
        .option("header", True)
        .option("compression", "gzip")
        .csv(root)
    )


def _read_group(spark: SparkSession, names: tuple[str, ...], paths: list[str]) -> DataFrame:
    # the reader's own spelling of a header may repeat a name; bind by position, select by name
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAGGED]])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("columnNameOfCorruptRecord", RAGGED)
        .csv(paths)
        .withColumn("date", F.regexp_extract("_metadata.file_path", DATE_IN_NAME, 1))
        .withColumn("file", F.col("_metadata.file_path"))
    )
    typed, checks = [], []
    for name, kind in RAW_COLUMNS.items():
        if name not in names:
            typed.append(F.lit(None).cast(kind).alias(name))
        elif isinstance(kind, T.StringType):
            typed.append(F.coalesce(name, F.lit("")).alias(name))
        else:
            text = F.when(~F.trim(name).isin(NULL_NUMBERS), F.trim(name))
            typed.append(text.try_cast(kind).alias(name))
            checks.append(text.isNull() | text.try_cast(kind).isNotNull())
    ok = reduce(lambda a, b: a & b, checks, F.col(RAGGED).isNull())
    texts = F.to_json(F.struct(*[F.col(n) for n in names]))
    line = F.to_json(F.struct(F.col(RAGGED).alias("line")))
    raw = F.when(~ok, F.when(F.col(RAGGED).isNotNull(), line).otherwise(texts))
    return rows.select(*typed, "date", ok.alias("row_ok"), raw.alias("raw"), "file")
