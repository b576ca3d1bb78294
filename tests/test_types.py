"""Value helpers, against datetime and arithmetic by hand."""

from datetime import UTC, date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark import types as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_time_of_day_and_parts(spark):
    for h, m, s, ns in ((0, 0, 0, 0), (23, 59, 59, 999_999_999), (12, 34, 56, 789)):
        t = one(spark, T.time_of_day(h, m, s, ns))
        assert t == ((h * 60 + m) * 60 + s) * 10**9 + ns
        parts = T.time_parts(F.lit(t).cast("long"))
        assert tuple(one(spark, parts[k]) for k in ("hour", "minute", "second", "nanosecond")) == (h, m, s, ns)
    for bad in ((24, 0, 0, 0), (0, 60, 0, 0), (0, 0, 60, 0), (0, 0, 0, 10**9), (-1, 0, 0, 0)):
        with pytest.raises(Exception, match="out of range"):
            one(spark, T.time_of_day(*bad))


def test_dates(spark):
    at = datetime(2024, 2, 29, 23, 30, tzinfo=UTC)
    for hours in (-12, 0, 1, 14):
        got = one(spark, T.civil_date(F.lit(at), hours * 3600))
        assert got == at.astimezone(timezone(timedelta(hours=hours))).date()
    for d in (date(1970, 1, 1), date(1969, 12, 31), date(2024, 2, 29)):
        assert one(spark, T.unix_day(F.lit(d))) == (d - date(1970, 1, 1)).days * 86400


def test_value_or(spark):
    assert one(spark, T.value_or(F.lit(None).cast("int"), 7)) == 7 and one(spark, T.value_or(F.lit(3), 7)) == 3
