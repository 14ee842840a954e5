import datetime as dt

import pytest

from barloom.operators import sessions
from barloom.schemas import HOLIDAYS
from barloom.session import scratch_path
from barloom.sources.history import read_holidays


@pytest.fixture(scope="module")
def named(spark):
    closed = [dt.date(2026, 2, d) for d in range(16, 21)] + [dt.date(2026, 6, 22)]
    rows = [(d, "closed day", True) for d in closed]
    rows.append((dt.date(2026, 2, 23), "first session", False))
    return spark.createDataFrame(rows, HOLIDAYS)


@pytest.fixture(scope="module")
def days(named):
    return sessions.calendar(named, "2026-02-01", "2026-07-01")


def test_kinds(spark, named):
    dates = spark.createDataFrame(
        [(dt.date(2026, *md),) for md in ((6, 14), (6, 22), (2, 23), (6, 23))], "date date"
    )
    got = {r.date: (r.kind, r.desc) for r in sessions.classify_days(dates, named).collect()}
    assert got == {
        dt.date(2026, 6, 14): ("weekend", None),
        dt.date(2026, 6, 22): ("holiday", "closed day"),
        dt.date(2026, 2, 23): ("trading", "first session"),
        dt.date(2026, 6, 23): ("trading", None),
    }


@pytest.mark.parametrize(
    "local, session, prior",
    [
        ("2026-06-14 09:00:00", (6, 15), (6, 12)),
        ("2026-06-15 09:00:00", (6, 15), (6, 12)),
        ("2026-06-15 13:00:00", (6, 16), (6, 15)),
        ("2026-06-15 13:01:00", (6, 16), (6, 15)),
        ("2026-06-23 09:00:00", (6, 23), (6, 19)),
        ("2026-02-15 23:30:00", (2, 23), (2, 13)),
    ],
)
def test_session(spark, days, local, session, prior):
    instant = dt.datetime.fromisoformat(local) - dt.timedelta(hours=8)
    orders = spark.createDataFrame([(1, instant)], "id int, ts timestamp_ntz")
    row = sessions.session_for(orders, days).first()
    assert (row.session, row.prior) == (dt.date(2026, *session), dt.date(2026, *prior))


def test_neighbours(spark, days):
    dates = spark.createDataFrame([(dt.date(2026, 2, 18),)], "date date")
    assert sessions.next_session(dates, days).first().next_session == dt.date(2026, 2, 23)
    assert sessions.prev_session(dates, days).first().prev_session == dt.date(2026, 2, 13)


def test_holiday_files(spark, named):
    path = scratch_path(spark, "years")
    array = '[{"date":"2026-01-01","desc":"new year","closed":true}]'
    named.coalesce(1).write.json(path)
    spark.createDataFrame([(array,)], "value string").coalesce(1).write.mode("append").text(
        f"{path}-text"
    )
    assert read_holidays(spark, path).count() == named.count()
    row = spark.read.schema(HOLIDAYS).json(f"{path}-text").first()
    assert (row.date, row.closed) == (dt.date(2026, 1, 1), True)
