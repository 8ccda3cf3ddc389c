import gzip
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marketlake.operators.quality import compare_counts, counts_per_date, missing_sessions
from marketlake.plans import lakehouse as LH
from marketlake.sources import lake
from marketlake.sources import raw_files as raw
from marketlake.sources.calendar import rule_calendar

HEAD = "ticker,volume,open,close,high,low,window_start,transactions,otc"
NS = 1_000_000_000


def day_file(root, date, lines, head=HEAD):
    folder = f"{root}/{date[:4]}/{date[5:7]}"
    os.makedirs(folder, exist_ok=True)
    with gzip.open(f"{folder}/{date}.csv.gz", "wt") as out:
        out.write("\n".join([head, *lines]) + "\n")
    return f"{folder}/{date}.csv.gz"


def line(ticker, close, start, volume=100):
    return f"{ticker},{volume},1.5,{close},3.5,0.5,{start},7,"


@pytest.fixture
def tables(tmp_path):
    return LH.Lake(f"{tmp_path}/lake")


def closes(spark, tables):
    return {(r.ticker, r.date): r.close for r in lake.read_bronze(spark, tables.path("bronze")).collect()}


def test_columns_follow_header_names(spark, tmp_path):
    a = day_file(tmp_path, "2024-01-02", [line("A", 2.5, 10)])
    b = day_file(tmp_path, "2024-01-03", ["9,B,4.5,8.5,extra"], "window_start,ticker,close,volume,unknown")
    rows = {r.ticker: r for r in raw.read_day_files(spark, [a, b]).collect()}
    assert (rows["A"].close, rows["A"].volume, rows["A"].date, rows["A"].otc) == (2.5, 100.0, "2024-01-02", "")
    assert (rows["B"].close, rows["B"].volume, rows["B"].window_start) == (4.5, 8.5, 9)
    assert rows["B"].open is None and rows["B"].otc is None and rows["B"].row_ok
    assert "unknown" not in rows["B"].asDict()


def test_missing_number_spellings_are_null_not_errors(spark, tmp_path):
    f = day_file(tmp_path, "2024-01-02", ["A,NaN,,N/A,1,2,3,null,x"])
    r = raw.read_day_files(spark, [f]).first()
    assert (r.volume, r.open, r.close, r.transactions, r.otc, r.row_ok) == (None, None, None, None, "x", True)


def test_backfill_reads_only_its_months_and_isolates_bad_files(spark, tmp_path, tables):
    root = f"{tmp_path}/raw"
    day_file(root, "2024-01-02", [line("A", 1.0, NS), line("B", 2.0, NS)])
    day_file(root, "2024-01-03", [line("A", 3.0, NS), line("B", "oops", NS)])
    day_file(root, "2024-02-01", [line("A", 4.0, NS)])
    day_file(root, "2024-03-01", [line("A", 5.0, NS)])
    report = {r.date: (r.rows, r.bad_rows, r.status) for r in LH.backfill(spark, root, tables, 2024, [1, 2]).collect()}
    assert report == {
        "2024-01-02": (2, 0, "ok"), "2024-01-03": (2, 1, "failed"), "2024-02-01": (1, 0, "ok")
    }
    assert closes(spark, tables) == {
        ("A", "2024-01-02"): 1.0, ("B", "2024-01-02"): 2.0, ("A", "2024-02-01"): 4.0
    }
    bad = spark.read.parquet(tables.path("quarantine")).collect()
    assert len(bad) == 1 and "oops" in bad[0].raw

    # the repaired file is loaded again; nothing else changes, nothing is doubled
    day_file(root, "2024-01-03", [line("A", 3.0, NS), line("B", 6.0, NS)])
    LH.backfill(spark, root, tables, 2024, [1, 2])
    assert closes(spark, tables)[("B", "2024-01-03")] == 6.0
    assert lake.read_bronze(spark, tables.path("bronze")).count() == 5


def test_unreadable_files_are_reported_and_the_others_loaded(spark, tmp_path, tables):
    root = f"{tmp_path}/raw"
    files = [day_file(root, f"2024-01-0{d}", [line("A", float(d), NS)] * 500) for d in range(2, 7)]
    with open(files[1], "rb") as whole:
        content = whole.read()
    with open(files[1], "wb") as cut:
        cut.write(content[: len(content) // 2])
    with open(files[3], "wb") as junk:
        junk.write(b"this is not gzip")
    report = {r.date: r.status for r in LH.load_files(spark, files, tables).collect()}
    assert report == {
        "2024-01-02": "ok", "2024-01-03": "unreadable", "2024-01-04": "ok",
        "2024-01-05": "unreadable", "2024-01-06": "ok",
    }
    assert {d for _, d in closes(spark, tables)} == {"2024-01-02", "2024-01-04", "2024-01-06"}
    assert LH.committed(spark, tables).where("status = 'unreadable'").count() == 2
    alone = LH.load_files(spark, [files[3]], tables).collect()
    assert [(r.date, r.status) for r in alone] == [("2024-01-05", "unreadable")]


def test_a_broken_file_does_not_stop_the_ingest(spark, tmp_path, tables):
    root, checkpoint = f"{tmp_path}/raw", f"{tmp_path}/checkpoint"
    with open(day_file(root, "2024-01-02", [line("A", 2.0, NS)]), "wb") as junk:
        junk.write(b"this is not gzip")
    LH.ingest_new_files(spark, root, tables, checkpoint)
    day_file(root, "2024-01-03", [line("A", 3.0, NS)])
    LH.ingest_new_files(spark, root, tables, checkpoint)
    assert closes(spark, tables) == {("A", "2024-01-03"): 3.0}
    status = {r.date: r.status for r in LH.committed(spark, tables).collect()}
    assert status == {"2024-01-02": "unreadable", "2024-01-03": "ok"}


def test_other_failures_are_not_taken_for_broken_files(spark, tmp_path, tables, monkeypatch):
    def full(*_):
        raise AnalysisException("no space left")

    monkeypatch.setattr(LH.lake, "write_staged", full)
    with pytest.raises(AnalysisException):
        LH.load_files(spark, [day_file(f"{tmp_path}/raw", "2024-01-02", [line("A", 2.0, NS)])], tables)


@pytest.mark.parametrize("ragged", ["B,100", line("B", 2.0, NS) + ",1,2"])
def test_rows_with_a_wrong_number_of_fields_are_bad(spark, tmp_path, tables, ragged):
    files = [
        day_file(f"{tmp_path}/raw", "2024-01-02", [line("A", 1.0, NS), ragged]),
        day_file(f"{tmp_path}/raw", "2024-01-03", [line("A", 3.0, NS)]),
    ]
    report = {r.date: (r.rows, r.bad_rows, r.status) for r in LH.load_files(spark, files, tables).collect()}
    assert report == {"2024-01-02": (2, 1, "failed"), "2024-01-03": (1, 0, "ok")}
    assert closes(spark, tables) == {("A", "2024-01-03"): 3.0}
    assert ragged in spark.read.parquet(tables.path("quarantine")).first().raw


def test_header_only_file(spark, tmp_path, tables):
    files = [day_file(f"{tmp_path}/raw", "2024-01-02", []), day_file(f"{tmp_path}/raw", "2024-01-03", [line("A", 1.0, NS)])]
    LH.load_files(spark, files, tables)
    assert closes(spark, tables) == {("A", "2024-01-03"): 1.0}


def test_many_days_are_committed_in_batches(spark, tmp_path, tables, monkeypatch):
    monkeypatch.setattr(LH, "DAYS_PER_COMMIT", 2)
    files = [day_file(f"{tmp_path}/raw", f"2024-01-0{d}", [line("A", float(d), NS)]) for d in range(2, 7)]
    LH.load_files(spark, files, tables)
    assert len(closes(spark, tables)) == 5
    assert LH.committed(spark, tables).count() == 5


def test_commit_only_retry_loads_what_is_missing(spark, tmp_path, tables):
    files = [day_file(f"{tmp_path}/raw", f"2024-01-0{d}", [line("A", float(d), NS)]) for d in (2, 3)]
    lake.write_staged(raw.read_day_files(spark, files), tables.path("staged"))  # and then it failed
    LH.commit_staged(spark, tables, ["2024-01-02"])
    retried = LH.commit_staged(spark, tables)
    assert [r.date for r in retried.collect()] == ["2024-01-03"]
    assert len(closes(spark, tables)) == 2


def test_empty_backfill(spark, tmp_path, tables):
    assert LH.load_files(spark, [], tables).count() == 0


def test_daily_ingest_takes_new_and_late_files_once(spark, tmp_path, tables):
    root, checkpoint = f"{tmp_path}/raw", f"{tmp_path}/checkpoint"
    start = 1704207000 * NS  # 2024-01-02 09:50 in New York
    day_file(root, "2024-01-03", [line("A", 3.0, start + 86400 * NS)])
    LH.ingest_new_files(spark, root, tables, checkpoint)
    day_file(root, "2024-01-02", [line("A", 2.0, start)])  # late, with an earlier name
    day_file(root, "2024-01-04", [line("A", 4.0, start + 2 * 86400 * NS)])
    LH.ingest_new_files(spark, root, tables, checkpoint)
    LH.ingest_new_files(spark, root, tables, checkpoint)
    assert sorted(closes(spark, tables).values()) == [2.0, 3.0, 4.0]
    assert LH.committed(spark, tables).count() == 3
    silver = lake.read_silver(spark, tables.path("silver")).collect()
    assert {(r.date, r.session, str(r.timestamp)) for r in silver} == {
        (f"2024-01-0{d}", "market", f"2024-01-0{d} 09:50:00") for d in (2, 3, 4)
    }


def bars(spark, rows):
    return raw.align(
        spark.createDataFrame(rows, "ticker string, close double, window_start bigint, date string"),
        F.col("date"),
    )


def test_silver_refresh_replaces_only_touched_dates(spark, tables):
    lake.write_bronze(bars(spark, [("A", 1.0, NS, "2024-01-02"), ("A", 2.0, NS, "2024-01-03")]), tables.path("bronze"))
    LH.refresh_silver(spark, tables)
    lake.write_bronze(bars(spark, [("A", 9.0, NS, "2024-01-03")]), tables.path("bronze"))
    LH.refresh_silver(spark, tables, ["2024-01-03"])
    LH.refresh_silver(spark, tables, ["2024-01-03"])
    silver = lake.read_silver(spark, tables.path("silver"))
    assert sorted((r.date, r.close) for r in silver.collect()) == [("2024-01-02", 1.0), ("2024-01-03", 9.0)]


def test_silver_by_ticker(spark, tables):
    lake.write_silver(bars(spark, [("A", 1.0, NS, "2024-01-02"), ("B", 2.0, NS, "2024-01-02")]), tables.path("s"), True)
    assert os.path.isdir(f"{tables.path('s')}/date=2024-01-02/ticker=B")
    assert lake.read_silver(spark, tables.path("s")).where("ticker = 'B'").first().close == 2.0


def test_gaps_and_counts(spark):
    rows = [("A", 1.0, NS, d) for d in ("2024-01-11", "2024-01-17", "2024-01-17")]
    df = bars(spark, rows)
    gaps = missing_sessions(df, rule_calendar(spark, 2024, 2024))
    assert sorted(str(r.date) for r in gaps.collect()) == ["2024-01-12", "2024-01-16"]
    expected = spark.createDataFrame([("2024-01-11", 1), ("2024-01-17", 3), ("2024-01-18", 1)], "date string, rows bigint")
    diff = {tuple(r) for r in compare_counts(expected, counts_per_date(df)).collect()}
    assert diff == {("2024-01-17", 3, 2), ("2024-01-18", 1, None)}
