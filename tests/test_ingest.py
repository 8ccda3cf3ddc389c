"""Looking into day files, reports by file, generations of a staged day, scratch folders."""

import gzip
import os
import subprocess
import sys

import pytest
from test_lakehouse import HEAD, NS, closes, day_file, line

from marketlake.plans import lakehouse as LH
from marketlake.session import release_scratch, scratch_path, scratch_root, staged
from marketlake.sources import lake
from marketlake.sources import raw_files as raw


@pytest.fixture
def tables(tmp_path):
    return LH.Lake(f"{tmp_path}/lake")


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_probe_of_contents(piece):
    whole = gzip.compress(b"a,b\r\n1,2\r\n \r\n\n3,4")
    assert raw.probe_content(whole, piece) == ("ok", None, ["a", "b"], 2)
    two = gzip.compress(b'"a,x",b\n1,2\n3,') + gzip.compress(b"4\n5,6\n")
    assert raw.probe_content(two, piece) == ("ok", None, ["a,x", "b"], 3)
    assert raw.probe_content(gzip.compress(b"a,b\n"), piece) == ("empty", None, ["a", "b"], 0)
    assert raw.probe_content(gzip.compress(b"a,b"), piece) == ("empty", None, ["a", "b"], 0)
    assert raw.probe_content(b"", piece) == ("empty", None, [], 0)
    assert raw.probe_content(gzip.compress(os.urandom(3000))[:2000], piece)[:2] in [("unreadable", "EOFError")]
    assert raw.probe_content(b"no gzip at all", piece)[:2] == ("unreadable", "error")
    assert raw.probe_content(gzip.compress(b"\xff\xfe,b\n1,2\n"), piece)[:2] == ("unreadable", "UnicodeDecodeError")


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(name, count):
        files = [day_file(f"{tmp_path}/{name}", f"2024-01-{d:02d}", [line("A", 1.0, NS)], HEAD if d % 2 else "ticker,close") for d in range(1, count + 1)]
        spark.sparkContext.setJobGroup(name, name)
        rows = raw.read_day_files(spark, files).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few, many = jobs("few", 4), jobs("many", 28)
    assert (few[0], many[0]) == (4, 28) and few[1] == many[1]


def test_report_has_a_row_for_every_file(spark, tmp_path, tables):
    root = f"{tmp_path}/raw"
    files = [
        day_file(root, "2024-01-02", [line("A", 1.0, NS), line("B", "oops", NS)]),
        day_file(root, "2024-01-03", []),
        day_file(root, "2024-01-04", [line("A", 1.0, NS), "", line("B", 2.0, NS)]),
    ]
    os.rename(day_file(root, "2024-01-05", [line("A", 1.0, NS)]), f"{root}/notes.csv.gz")
    files.append(f"{root}/notes.csv.gz")
    rows = LH.load_files(spark, files, tables).collect()
    found = {os.path.basename(r.file): (r.date, r.status, r.rows, r.bad_rows) for r in rows}
    assert found == {
        "2024-01-02.csv.gz": ("2024-01-02", "failed", 2, 1), "2024-01-03.csv.gz": ("2024-01-03", "empty", 0, 0),
        "2024-01-04.csv.gz": ("2024-01-04", "ok", 2, 0), "notes.csv.gz": (None, "undated", 0, 0),
    }
    assert all(r.seconds > 0 for r in rows)
    assert LH.committed(spark, tables).count() == 4


def test_rows_of_quoted_lines_are_counted_as_read(spark, tmp_path, tables):
    """Where lines are no rows the rows that were read are reported."""
    f = day_file(f"{tmp_path}/raw", "2024-01-02", ["ticker,volume,open,close,high,low,window_start,transactions,otc", line("A", 2.0, NS)])
    report = LH.load_files(spark, [f], tables).collect()
    assert [(r.rows, r.bad_rows, r.status) for r in report] == [(2, 1, "failed")]


def test_an_undated_file_does_not_stop_the_ingest(spark, tmp_path, tables):
    root, checkpoint = f"{tmp_path}/raw", f"{tmp_path}/checkpoint"
    os.rename(day_file(root, "2024-01-02", [line("A", 2.0, NS)]), f"{root}/2024/notes.csv.gz")
    LH.ingest_new_files(spark, root, tables, checkpoint)
    day_file(root, "2024-01-03", [line("A", 3.0, NS)])
    LH.ingest_new_files(spark, root, tables, checkpoint)
    assert closes(spark, tables) == {("A", "2024-01-03"): 3.0}


def test_storage_in_trouble_condemns_no_file(spark, tmp_path, tables):
    root = f"{tmp_path}/raw"
    files = [day_file(root, "2024-01-02", [line("A", 2.0, NS)]), f"{root}/2024/01/2024-01-09.csv.gz"]
    with pytest.raises(Exception, match="2024-01-09|PATH_NOT_FOUND"):
        LH.load_files(spark, files, tables)
    assert LH.committed(spark, tables).count() == 0


def test_a_corrected_day_is_committed_again_and_its_quarantine_settled(spark, tmp_path, tables):
    root = f"{tmp_path}/raw"
    files = [day_file(root, f"2024-01-0{d}", [line("A", float(d), NS)]) for d in (2, 3)]
    files.append(day_file(root, "2024-01-04", [line("A", "oops", NS)]))
    LH.load_files(spark, files, tables)
    assert [r.date for r in LH.open_quarantine(spark, tables).collect()] == ["2024-01-04"]
    corrected = [day_file(root, "2024-01-03", [line("A", 33.0, NS)]), day_file(root, "2024-01-04", [line("A", 4.0, NS)])]
    lake.write_staged(raw.read_day_files(spark, corrected), tables.path("staged"))  # and then it failed
    before = os.stat(f"{tables.path('bronze')}/date=2024-01-02").st_mtime_ns
    assert {r.date for r in LH.commit_staged(spark, tables).collect()} == {"2024-01-03", "2024-01-04"}
    assert closes(spark, tables) == {("A", "2024-01-02"): 2.0, ("A", "2024-01-03"): 33.0, ("A", "2024-01-04"): 4.0}
    assert os.stat(f"{tables.path('bronze')}/date=2024-01-02").st_mtime_ns == before
    assert LH.commit_staged(spark, tables).count() == 0
    assert LH.open_quarantine(spark, tables).count() == 0


def test_backfill_refreshes_silver(spark, tmp_path, tables):
    day_file(f"{tmp_path}/raw", "2024-01-02", [line("A", 2.0, NS)])
    LH.backfill(spark, f"{tmp_path}/raw", tables, 2024, [1])
    assert lake.read_silver(spark, tables.path("silver")).first().close == 2.0


def test_one_day_leaves_other_dates_alone(spark, tmp_path, tables):
    root = f"{tmp_path}/raw"
    for day, close in (("2024-01-02", 1.0), ("2024-01-03", 2.0)):
        day_file(root, day, [line("A", close, NS)])
    month = raw.day_file_globs(root, 2024, [1])
    assert [r.status for r in LH.ingest_day(spark, month, tables, "2024-01-03").collect()] == ["ok"]
    assert [r.date for r in lake.read_silver(spark, tables.path("silver")).select("date").collect()] == ["2024-01-03"]
    LH.ingest_day(spark, month, tables, "2024-01-03")  # loaded again: replaced
    assert lake.read_bronze(spark, tables.path("bronze")).count() == 1
    assert LH.ingest_day(spark, month, tables, "2024-01-04").count() == 0


def test_scratch_is_released(spark):
    kept = staged(spark.range(3), "three")
    assert kept.count() == 3 and scratch_path(spark, "x").startswith(scratch_root(spark))
    root = scratch_root(spark).removeprefix("file:")
    assert os.listdir(root)
    release_scratch(spark)
    assert not os.path.exists(root) or not os.listdir(root)


def test_scratch_needs_no_setting_and_ends_with_the_application(tmp_path):
    """A session without spark.checkpoint.dir, in a process of its own."""
    code = """
import sys
from pyspark.sql import SparkSession
from marketlake.session import scratch_root, staged
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()
assert staged(spark.range(3), "three").count() == 3
print("ROOT", scratch_root(spark))
spark.stop()
"""
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code, f"{tmp_path}/warehouse"], capture_output=True, text=True, timeout=200, env=env)
    assert "ROOT" in done.stdout, done.stderr[-2000:]
    root = done.stdout.split("ROOT", 1)[1].strip().removeprefix("file:")
    assert not os.path.exists(root)
