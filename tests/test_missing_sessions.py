"""The calendar of missing_sessions spans the data, whatever its years."""

import datetime as dt

from marketlake.queries import REGISTRY


def test_years_outside_the_sample(spark, tmp_path):
    days = [dt.date(1988, 12, 28), dt.date(1989, 1, 4), dt.date(2004, 3, 1), dt.date(2004, 3, 4)]
    spark.createDataFrame([(d,) for d in days], "l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.date for r in REGISTRY["missing_sessions"](spark, str(tmp_path)).collect()}
    assert {dt.date(1988, 12, 29), dt.date(1989, 1, 3), dt.date(2004, 3, 2), dt.date(2004, 3, 3)} <= got
    assert not got & {*days, dt.date(1989, 1, 2)} and min(got) > days[0] and max(got) < days[-1]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert REGISTRY["missing_sessions"](spark, str(tmp_path)).count() == 0
