from __future__ import annotations

from datetime import datetime, timedelta
from itertools import product

import pytest

from streetbook.functions import hours as H
from streetbook.operators import browse as B
from streetbook.sources import catalog as S

MON = datetime(2024, 1, 1, 11, 30)


def at(hour, minute=0, day=1):
    return datetime(2024, 1, day, hour, minute)


def ask(spark, lines, function):
    df = spark.createDataFrame([(lines,)], "h array<string>")
    return df.select(function("h").alias("x")).first()["x"]


@pytest.mark.parametrize(
    "lines, when, options, want",
    [
        (["Mon: 09:00-18:00"], at(9), {}, True),
        (["Mon: 09:00-18:00"], at(18), {}, True),
        (["Mon: 09:00-18:00"], at(18, 1), {}, False),
        (["Daily: 9:00 - 18:00"], at(9, 0, 6), {}, True),
        (["Every day: 00:00-24:00"], at(23, 59), {}, True),
        (["Mo,Sa: 08:30-12:00"], at(9, 0, 6), {}, True),
        (["Mo,Sa: 08:30-12:00"], at(9, 0, 6), {"every": ("Daily",), "two_letter": False}, False),
        (["Mo-Fr: 08:30-12:00"], at(9, 0, 3), {}, False),
        (["Mo-Fr: 08:30-12:00"], at(9, 0, 3), {"expand_ranges": True}, True),
        (["Fr-Mo: 08:30-12:00"], at(9, 0, 7), {"expand_ranges": True}, True),
        (["Fr-Mo: 08:30-12:00"], at(9, 0, 3), {"expand_ranges": True}, False),
        (["Mon: 20:00-03:00"], at(21), {}, False),
        (["Mon: 20:00-03:00"], at(21), {"overnight": True}, True),
        (["Mon: 20:00-03:00"], at(2, 0, 2), {"overnight": True}, True),
        (["Mon: 20:00-03:00"], at(4, 0, 2), {"overnight": True}, False),
        (["Mon 09:00-18:00", "Mon: closed", "a: b: c"], at(10), {}, False),
        ([], at(10), {}, False),
        (None, at(10), {}, False),
    ],
)
def test_is_open(spark, lines, when, options, want):
    assert ask(spark, lines, lambda c: H.is_open(c, when, **options)) is want


@pytest.mark.parametrize(
    "lines, when, want",
    [
        (["Mon: 09:00-10:00", "Mon: 11:00-12:00"], MON, "Открыто до 12:00"),
        (["Mon: 09:00-10:00", "Mon: 14:00-15:00"], MON, "Закрыто до 14:00 сегодня"),
        (["Tue: 09:00-10:00"], MON, None),
        (None, MON, None),
    ],
)
def test_status(spark, lines, when, want):
    assert ask(spark, lines, lambda c: H.open_status(c, when)) == want


@pytest.mark.parametrize(
    "lines, want",
    [
        (["Mon: 09:00-18:00"], (True, None, None)),
        (["Mon: 12:00-18:00"], (False, "сегодня", "12:00")),
        (["Mon: 09:00-10:00"], (False, "Пн", "09:00")),
        (["Wed,Sat: 10:00-11:00", "Tue: bad"], (False, "Ср", "10:00")),
        (["Sun: 10:00-11:00", "Fri: 1-2"], (False, "Пт", "1")),
        (["x: 1-2"], (False, None, None)),
        (None, (False, None, None)),
    ],
)
def test_next_opening(spark, lines, want):
    got = ask(spark, lines, lambda c: H.next_opening(c, MON))
    assert (got["is_open"], got["day"], got["time"]) == want


def test_format(spark):
    got = ask(spark, ["Mon,Fri: 1-2", "Daily: 3-4", "Mo: 5-6", "bad"], H.format_hours)
    assert [(r["days"], r["times"]) for r in got] == [("Пн-Пт", "1-2"), ("Пн-Вт-Ср-Чт-Пт-Сб-Вс", "3-4"), ("", "5-6")]


def test_map_form(spark):
    df = spark.createDataFrame([({"Mon": "09:00-10:00"},)], "h map<string,string>")
    assert df.select(H.fold_hours_map("h").alias("x")).first()["x"] == ["Mon: 09:00-10:00"]


WEEKS = [
    None, [], ["none"], ["Mon: closed"], ["Mon: 09:00-18:00"], ["Mon: 09:00-18:00", "Mon: 17:00-20:00"], ["Daily: 00:00-24:00"],
    ["Fri,Sat: 20:00-03:00"], ["Mo-Fr: 08:30-12:00", "Sa: 24:00-02:00"], ["Fr-Mo: 23:59-00:00"], ["Sun: 10:00-10:00"], ["Sun: 25:00-26:00"],
]


@pytest.mark.parametrize("options", [{}, {"overnight": True}, {"expand_ranges": True, "overnight": True}, {"every": ("Daily",), "two_letter": False}])
def test_index_agrees_with_the_lines(spark, options):
    df = spark.createDataFrame(list(enumerate(WEEKS)), "id int, working_hours array<string>")
    moments = [datetime(2024, 1, 1) + timedelta(days=d, seconds=s) for d, s in product(range(7), (0, 1, 10800, 10801, 36000, 43201, 64800, 64801, 72000, 86340, 86399))]
    asked = [H.is_open("working_hours", m, **options).alias(f"m{i}") for i, m in enumerate(moments)]
    want = {r["id"]: [bool(r[f"m{i}"]) for i in range(len(moments))] for r in df.select("id", *asked).collect()}
    got = {i: [False] * len(moments) for i in want}
    for r in B.hours_index(df, **options).collect():
        assert 0 <= r.begin <= r.end < 86400
        for i, m in enumerate(moments):
            got[r.id][i] |= r.day == m.weekday() and r.begin <= H.seconds_of_day(m) <= r.end
    assert got == want


def test_stored_index_reads_one_day(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(WEEKS)), "id long, working_hours array<string>")
    S.save_hours(B.hours_index(df, overnight=True), f"{tmp_path}/hours")
    index = S.load_hours(spark, f"{tmp_path}/hours")
    night = datetime(2024, 1, 6, 1, 15)
    found = B.open_in(df, index, night)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in B.open_at(df, night, overnight=True).collect()) == [6, 7]
    plan = index.filter("day = 5 and begin <= 4500 and `end` >= 4500").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "LessThanOrEqual(begin,4500), GreaterThanOrEqual(end,4500)" in plan
