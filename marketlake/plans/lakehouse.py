"""Backfill, commit-only retry and daily ingest: day files -> staged -> bronze -> silver."""

from __future__ import annotations

import logging
import time
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketlake.operators.quality import load_report
from marketlake.sources import lake
from marketlake.sources.raw_files import (
    date_of,
    day_file_globs,
    good_rows,
    list_files,
    probe_files,
    quarantined_rows,
    read_day_files,
)

log = logging.getLogger(__name__)

#: One row per file and load. A date's ``generation`` is the time (ms) at which it was staged.
LEDGER = "date string, rows bigint, bad_rows bigint, status string, generation bigint, file string, seconds double"
DAYS_PER_COMMIT = 50


@dataclass(frozen=True)
class Lake:
    """Paths of the tables under one root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def backfill(
    spark: SparkSession, raw_root: str, tables: Lake, year: int, months: Iterable[int], silver: bool = True
) -> DataFrame:
    """Loads the day files of some months, refreshes silver for the dates loaded, and returns the load report."""
    paths = list_files(spark, day_file_globs(raw_root, year, months))
    report = load_files(spark, paths, tables)
    dates = loaded_dates(report)
    if silver and dates:
        refresh_silver(spark, tables, dates)
    return report


def ingest_day(spark: SparkSession, globs: list[str], tables: Lake, date: str) -> DataFrame:
    """Loads the files of one day among those behind ``globs`` (its month's will do), refreshes silver for it and returns
    the load report, which has no row where the day has no file. A day that was loaded before is replaced."""
    report = load_files(spark, [p for p in list_files(spark, globs) if date_of(p) == date], tables)
    if loaded_dates(report):
        refresh_silver(spark, tables, [date])
    return report


def loaded_dates(report: DataFrame) -> list[str]:
    """The dates that a load has brought into bronze: one row per day, bounded by the calendar."""
    return sorted(r.date for r in report.where("status = 'ok'").select("date").distinct().collect())


def load_files(spark: SparkSession, paths: list[str], tables: Lake) -> DataFrame:
    """Stages day files, commits their dates to bronze and returns a row per file: ``LEDGER``.

    A file that can not be decoded is ``unreadable``, one without a row after its header ``empty``, one without a
    date in its name ``undated``: these are reported and the others go on. A date with a bad row is not loaded,
    its files are ``failed``. Any other failure is raised: a storage in trouble condemns no file.

    Rows are counted while files are looked into, bad rows are observed while staged is written. Only if there are bad
    ones, or the two numbers of rows differ, are the staged rows' flags read to tell which file they are from.
    """
    if not paths:
        return spark.createDataFrame([], LEDGER)
    started = time.perf_counter()
    # one row per file, whose paths the driver holds anyway
    files = {f.path: f.asDict() | {"date": date_of(f.path), "bad_rows": 0} for f in probe_files(spark, paths).collect()}
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, f in files.items():
        if f["status"] == "ok" and f["date"] is None:
            f["status"] = "undated"
        if f["status"] == "ok":
            groups[tuple(f["header"])].append(path)
        else:
            f["rows"] = 0
            log.error("not loaded, %s %s: %s", f["status"], f["error"] or "", path)
    if groups:
        counts = Observation("staged")
        rows = read_day_files(spark, paths, dict(groups))
        rows = rows.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("row_ok")).alias("bad_rows"))
        lake.write_staged(rows, tables.path("staged"))
        seen = counts.get
        dates = sorted({f["date"] for f in files.values() if f["status"] == "ok"})
        if seen["bad_rows"] or seen["rows"] != sum(f["rows"] for f in files.values()):
            flags = lake.read_staged(spark, tables.path("staged")).where(F.col("date").isin(dates))
            by_file = {r.file: r for r in load_report(flags, "file").collect()}
            for f in files.values():
                if f["status"] == "ok" and (r := by_file.get(f["file"])):
                    f.update(rows=r.rows, bad_rows=r.bad_rows)
        bad = {f["date"] for f in files.values() if f["bad_rows"]}
        for f in files.values():
            if f["status"] == "ok" and f["date"] in bad:
                f["status"] = "failed"
        generations = _generations(spark, tables, dates)
        for f in files.values():
            f["generation"] = generations.get(f["date"]) if f["status"] in ("ok", "failed") else None
        _commit(spark, tables, [d for d in dates if d not in bad], sorted(bad), files.values())
    _record(spark, tables, [f for f in files.values() if f["status"] not in ("ok", "failed")])
    seconds = time.perf_counter() - started
    rows = sum(f["rows"] for f in files.values())
    log.info("%d files, %d rows in %.1f s (%.0f rows/s)", len(files), rows, seconds, rows / seconds)
    return _ledger_rows(spark, files.values())


def commit_staged(
    spark: SparkSession, tables: Lake, dates: list[str] | None = None
) -> DataFrame:
    """Staged -> bronze in commits of up to fifty days; returns the report of these dates, a row per file.

    Without ``dates`` every staged date is loaded that no earlier run has committed as it is staged now: this is
    the retry after a failure, and it takes a corrected day that was staged again. A date with a bad row is not
    loaded; its bad rows go to the quarantine table and it is reported as failed, while the other dates go on.
    """
    generations = _generations(spark, tables, dates)
    if dates is None:
        done = {(r.date, r.generation) for r in committed(spark, tables).where("status = 'ok'").select("date", "generation").distinct().collect()}
        generations = {d: g for d, g in generations.items() if (d, g) not in done}
    staged = lake.read_staged(spark, tables.path("staged")).where(F.col("date").isin(list(generations)))
    files = [r.asDict() | {"generation": generations[r.date]} for r in load_report(staged, "date", "file").collect()]
    bad = {f["date"] for f in files if f["bad_rows"]}
    for f in files:
        f["status"] = "failed" if f["date"] in bad else "ok"
    _commit(spark, tables, sorted({f["date"] for f in files} - bad), sorted(bad), files)
    return _ledger_rows(spark, files)


def _commit(spark: SparkSession, tables: Lake, good: list[str], bad: list[str], files: Iterable[dict]) -> None:
    """The good dates to bronze, the bad rows of the others to quarantine, and both to the ledger."""
    staged = lake.read_staged(spark, tables.path("staged"))
    # one entry per day: bounded by the calendar, so the driver may walk through it
    for start in range(0, len(good), DAYS_PER_COMMIT):
        batch = good[start : start + DAYS_PER_COMMIT]
        lake.write_bronze(good_rows(staged.where(F.col("date").isin(batch))), tables.path("bronze"))
        _record(spark, tables, [f for f in files if f["date"] in batch and f["status"] == "ok"])
    if bad:
        rows = quarantined_rows(staged.where(F.col("date").isin(bad)))
        lake.write_quarantine(rows, tables.path("quarantine"))
        _record(spark, tables, [f for f in files if f["date"] in bad and f["status"] == "failed"])


def _generations(spark: SparkSession, tables: Lake, dates: list[str] | None = None) -> dict[str, int]:
    """When each staged date was written (ms); no column of staged is read for it."""
    staged = lake.read_staged(spark, tables.path("staged"))
    if dates is not None:
        staged = staged.where(F.col("date").isin(dates))
    written = F.max(F.unix_millis("_metadata.file_modification_time"))
    return dict(staged.groupBy("date").agg(written).collect())


def committed(spark: SparkSession, tables: Lake) -> DataFrame:
    """The ledger: one row per file and load. Staged dates with status ok may be removed by
    a storage rule; nothing here deletes input."""
    try:
        return spark.read.schema(LEDGER).json(tables.path("manifest"))
    except AnalysisException:  # nothing committed yet
        return spark.createDataFrame([], LEDGER)


def open_quarantine(spark: SparkSession, tables: Lake) -> DataFrame:
    """Bad rows (raw, date) of the dates whose newest load failed; a date that was loaded since is settled."""
    newest = F.max(F.struct("generation", (F.col("status") == "failed").alias("open"))).alias("last")
    loads = committed(spark, tables).where("status in ('ok', 'failed')").groupBy("date").agg(newest)
    rows = lake.read_quarantine(spark, tables.path("quarantine"))
    return rows.join(loads.where("last.open").select("date"), "date", "left_semi").select("raw", "date")


def refresh_silver(spark: SparkSession, tables: Lake, dates: list[str] | None = None) -> None:
    """Bronze -> silver for the given dates, or for all of them. Only these partitions are read
    and replaced."""
    bronze = lake.read_bronze(spark, tables.path("bronze"))
    if dates is not None:
        bronze = bronze.where(F.col("date").isin(dates))
    lake.write_silver(bronze, tables.path("silver"))


def ingest_new_files(
    spark: SparkSession, raw_root: str, tables: Lake, checkpoint: str, files_per_run: int = 1
) -> None:
    """Daily ingest: loads every day file not seen before, one at a time, and refreshes silver. A file that can
    not be loaded is in the ledger and stops no other.

    A file stream finds the files and its checkpoint remembers them; only their paths travel
    through it (the content column is pruned), because the files themselves are read by header.
    Unlike a cursor on names, a late file with an earlier name is found too.
    """

    def load(batch: DataFrame, _batch_id: int) -> None:
        paths = sorted(row.path for row in batch.select("path").collect())  # files_per_run at most
        dates = loaded_dates(load_files(spark, paths, tables))
        if dates:
            refresh_silver(spark, tables, dates)

    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv.gz")
        .option("maxFilesPerTrigger", files_per_run)
        .load(raw_root)
        .select("path")
    )
    query = (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _ledger_rows(spark: SparkSession, files: Iterable[dict]) -> DataFrame:
    names = [part.split()[0] for part in LEDGER.split(", ")]
    return spark.createDataFrame([tuple(f.get(n) for n in names) for f in files], LEDGER)


def _record(spark: SparkSession, tables: Lake, files: list[dict]) -> None:
    if files:
        _ledger_rows(spark, files).coalesce(1).write.mode("append").json(tables.path("manifest"))
