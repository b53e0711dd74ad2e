"""Opening hours: lists of ``"days: open-close"`` lines, asked at a given moment."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetbook.dicts import phrases as P
from streetbook.functions.expr import col, let, trim_all

EVERY_DAY = ("Daily", "All", "Every")
DAY_CODES = "".join(d[:2] for d in P.WEEK_DAYS)
DAY_END = 24 * 3600 - 1


def fold_hours_map(hours: Column | str) -> Column:
    """Map day -> time turned into the list shape."""
    return F.transform(F.map_entries(col(hours)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))


def _minutes(clock: Column) -> Column:
    """Minutes after midnight of ``H:MM``; 24:00 is the end of the day; null when it is no clock time."""
    pattern = r"^(\d{1,2}):([0-5]\d)$"
    hour = F.regexp_extract(clock, pattern, 1).try_cast("int")
    minute = F.regexp_extract(clock, pattern, 2).try_cast("int")
    total = hour * 60 + minute
    return F.when(total <= 24 * 60, total)


def hour_lines(hours: Column | str) -> Column:
    """Array of ``struct<days, times, open, close, open_min, close_min>`` of the well-formed lines.

    A line that has no single ``open-close`` pair keeps its days and times, with null clock fields.
    """

    def parse(line: Column) -> Column:
        def build(both: Column) -> Column:
            ok = F.size(both["pair"]) == 2
            start = F.when(ok, trim_all(F.get(both["pair"], F.lit(0))))
            end = F.when(ok, trim_all(F.get(both["pair"], F.lit(1))))
            return let(F.struct(both["days"].alias("days"), both["times"].alias("times"), start.alias("open"), end.alias("close")), clock)

        def clock(x: Column) -> Column:
            minutes = [_minutes(x["open"]).alias("open_min"), _minutes(x["close"]).alias("close_min")]
            return F.struct(*[x[n].alias(n) for n in ("days", "times", "open", "close")], *minutes)

        days, times = F.substring_index(line, ": ", 1), F.substring_index(line, ": ", -1)
        return let(F.struct(days.alias("days"), times.alias("times"), F.split(times, "-").alias("pair")), build)

    lines = F.filter(col(hours), lambda line: F.size(F.split(line, ": ")) == 2)
    return F.coalesce(F.transform(lines, parse), F.array().cast(
        "array<struct<days:string,times:string,open:string,close:string,open_min:int,close_min:int>>"
    ))


def _names_day(days: Column, day: int, every: Sequence[str], two_letter: bool) -> Column:
    """``days`` holds the name of day 0..6 (Monday first) or a word for every day."""
    name = P.WEEK_DAYS[day][:2] if two_letter else P.WEEK_DAYS[day]
    out = F.contains(days, F.lit(name))
    for word in every:
        out = out | F.contains(days, F.lit(word))
    return out


def _in_range(days: Column, day: int) -> Column:
    """``days`` holds a range such as ``Mo-Fr`` that covers the day."""
    pattern = r"([A-Z][a-z]{1,2})\s*-\s*([A-Z][a-z]{1,2})"

    def index(code: Column) -> Column:
        return F.floor((F.instr(F.lit(DAY_CODES), F.substring(code, 1, 2)) - 1) / 2)

    def covers(hit: Column) -> Column:
        first = index(F.regexp_extract(hit, pattern, 1))
        last = index(F.regexp_extract(hit, pattern, 2))
        inside = F.when(first <= last, (first <= day) & (last >= day)).otherwise((first <= day) | (last >= day))
        return (first >= 0) & (last >= 0) & inside

    return F.exists(F.regexp_extract_all(days, F.lit(pattern), F.lit(0)), covers)


def _of_day(line: Column, day: int, every: Sequence[str], two_letter: bool, expand_ranges: bool) -> Column:
    out = _names_day(line["days"], day, every, two_letter)
    return out | _in_range(line["days"], day) if expand_ranges else out


def _open_now(line: Column, seconds: int, overnight: bool) -> Column:
    start, end = line["open_min"] * 60, line["close_min"] * 60
    inside = (start <= seconds) & (end >= seconds)
    if overnight:
        inside = inside | ((end < start) & (start <= seconds))
    return F.coalesce(inside, F.lit(False))


def seconds_of_day(as_of: datetime) -> int:
    return as_of.hour * 3600 + as_of.minute * 60 + as_of.second


def is_open(
    hours: Column | str,
    as_of: datetime,
    every: Sequence[str] = EVERY_DAY,
    two_letter: bool = True,
    expand_ranges: bool = False,
    overnight: bool = False,
) -> Column:
    """Open at ``as_of``, both bounds included.

    By default a day counts only when its name stands in the line, and a closing time before the opening time never
    matches. ``expand_ranges`` reads ``Mo-Fr``; ``overnight`` lets a line run past midnight, also from the day before.
    """
    day, now = as_of.weekday(), seconds_of_day(as_of)

    def covers(line: Column) -> Column:
        out = _of_day(line, day, every, two_letter, expand_ranges) & _open_now(line, now, overnight)
        if overnight:
            start, end = line["open_min"] * 60, line["close_min"] * 60
            late = _of_day(line, (day + 6) % 7, every, two_letter, expand_ranges) & (end < start) & (end >= now)
            out = out | F.coalesce(late, F.lit(False))
        return out

    return F.exists(hour_lines(hours), covers)


def week_spans(
    hours: Column | str,
    every: Sequence[str] = EVERY_DAY,
    two_letter: bool = True,
    expand_ranges: bool = False,
    overnight: bool = False,
) -> Column:
    """Distinct ``struct<day, begin, end>``, day 0..6 and seconds of that day, both included: when ``is_open`` holds.

    Options as there. No span crosses midnight: a line that runs past it gives one for each of the two days.
    """

    def spans(line: Column) -> Column:
        begin, end = line["open_min"] * 60, line["close_min"] * 60
        late = end < begin if overnight else F.lit(False)

        def of(day: int) -> Column:
            span = F.struct(F.lit(day).alias("day"), begin.alias("begin"), F.when(late, DAY_END).otherwise(F.least(end, F.lit(DAY_END))).alias("end"))
            rest = F.struct(F.lit((day + 1) % 7).alias("day"), F.lit(0).alias("begin"), end.alias("end"))
            known = _of_day(line, day, every, two_letter, expand_ranges) & begin.isNotNull() & end.isNotNull()
            return F.array(F.when(known, span), F.when(known & late, rest))

        return F.concat(*[of(day) for day in range(7)])

    found = F.flatten(F.transform(hour_lines(hours), lambda line: let(line, spans)))
    return F.array_distinct(F.filter(found, lambda s: s["begin"] <= s["end"]))


def open_status(hours: Column | str, as_of: datetime) -> Column:
    """Card label: until when the first open line runs, else when the last line of the day opens; null if no line."""
    day = as_of.weekday()
    now = as_of.hour * 3600 + as_of.minute * 60
    today = F.filter(
        hour_lines(hours),
        lambda x: _names_day(x["days"], day, ("Daily", "All"), False) & x["open"].isNotNull(),
    )

    def label(lines: Column) -> Column:
        running = F.get(F.filter(lines, lambda x: _open_now(x, now, False)), F.lit(0))
        last = F.try_element_at(lines, F.lit(-1))
        return F.when(running.isNotNull(), F.concat(F.lit(P.OPEN_LABEL), running["close"])).when(
            last.isNotNull(), F.concat(F.lit(P.CLOSED_LABEL), last["open"], F.lit(P.CLOSED_TODAY_LABEL))
        )

    return let(today, label)


def next_opening(hours: Column | str, as_of: datetime) -> Column:
    """``struct<is_open, day, time>``: the next opening of a closed company, within seven days."""
    day, now = as_of.weekday(), seconds_of_day(as_of)

    def find(lines: Column) -> Column:
        def of_day(d: int) -> Column:
            return F.filter(lines, lambda x: _names_day(x["days"], d, ("Daily",), False))

        def option(label: str, time: Column) -> Column:
            return F.when(time.isNotNull(), F.struct(F.lit(label).alias("day"), time.alias("time")))

        running = F.exists(of_day(day), lambda x: _open_now(x, now, False))
        later = F.get(F.filter(of_day(day), lambda x: x["open_min"] * 60 > now), F.lit(0))["open"]
        options = [option(P.TODAY_LABEL, later)]
        for offset in range(1, 8):
            d = (day + offset) % 7
            options.append(option(P.LOCAL_DAYS[d], F.get(of_day(d), F.lit(0))["open"]))
        when = F.when(~running, F.coalesce(*options))
        return F.struct(running.alias("is_open"), when["day"].alias("day"), when["time"].alias("time"))

    return let(F.filter(hour_lines(hours), lambda x: x["open"].isNotNull()), find)


def format_hours(hours: Column | str) -> Column:
    """Display lines ``struct<days, times>`` with local day names; a daily line names all seven."""
    names = F.array(
        *[F.struct(F.lit(en).alias("en"), F.lit(ru).alias("ru")) for en, ru in zip(P.WEEK_DAYS, P.LOCAL_DAYS)]
    )

    def show(line: Column) -> Column:
        named = F.transform(F.filter(names, lambda n: F.contains(line["days"], n["en"])), lambda n: n["ru"])
        every = F.when(F.contains(line["days"], F.lit("Daily")), F.lit("-".join(P.LOCAL_DAYS))).otherwise("")
        days = F.when(F.size(named) > 0, F.array_join(named, "-")).otherwise(every)
        return F.struct(days.alias("days"), line["times"].alias("times"))

    return F.transform(hour_lines(hours), show)
