"""Start-time statuses.

Instants of one listing and of `now` are wall clocks of the same zone, so all
arithmetic is on day numbers and seconds of the day: a daylight-saving night
counts the clock difference and no session zone can leak in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.classify import is_local_tip, theme
from playbill.functions.dates import clock_seconds, parse_day
from playbill.functions.text import col

EVENING_SECONDS = 17 * 3600


def _offset(day: Column, seconds: Column, now: dt.datetime) -> Column:
    """Seconds from `now` to a wall-clock instant (negative when past)."""
    of_day = now.hour * 3600 + now.minute * 60 + now.second + now.microsecond / 1e6
    return F.datediff(day, F.lit(now.date())) * 86400 + seconds - F.lit(of_day)


def starts_at(start_date="start_date", start_time="start_time") -> Column:
    seconds = clock_seconds(start_time)
    clock = F.make_interval(hours=F.floor(seconds / 3600).cast("int"), mins=F.floor(seconds % 3600 / 60).cast("int"))
    return parse_day(start_date).cast("timestamp_ntz") + clock


def seconds_to_start(now: dt.datetime) -> Column:
    return _offset(parse_day("start_date"), clock_seconds("start_time"), now)


def seconds_to_end(now: dt.datetime) -> Column:
    """An end clock before the start clock on the same day means the next day."""
    start_day, s, e = parse_day("start_date"), clock_seconds("start_time"), clock_seconds("end_time")
    end_day = parse_day(F.coalesce(F.nullif(col("end_date"), F.lit("")), col("start_date")))
    overnight = s.isNotNull() & (end_day == start_day) & (e < s)
    return _offset(F.when(overnight, F.date_add(end_day, 1)).otherwise(end_day), e, now)


def minutes_to_start(now: dt.datetime) -> Column:
    return F.floor(seconds_to_start(now) / 60).cast("int")


def status(now: dt.datetime, soon_minutes: int = 90) -> Column:
    """now / soon / tonight / later_today / started / tomorrow, or null.

    A missing end is never guessed: without one a started listing is only 'started'.
    """
    today, tomorrow = F.lit(now.date()), F.lit(now.date() + dt.timedelta(days=1))
    day, start, end = parse_day("start_date"), seconds_to_start(now), seconds_to_end(now)
    evening = clock_seconds("start_time") >= EVENING_SECONDS
    return (
        F.when(start.isNull(), F.when(day == tomorrow, "tomorrow"))
        .when(F.coalesce((start <= 0) & (end >= 0), F.lit(False)), "now")
        .when((day == today) & start.between(0, soon_minutes * 60), "soon")
        .when((day == today) & (start > 0) & evening, "tonight")
        .when((day == today) & (start > 0), "later_today")
        .when(day == today, "started")
        .when(day == tomorrow, "tomorrow")
    )


def status_confidence(status_col: Column) -> Column:
    """Without a start clock a status is only of medium confidence."""
    return F.when(status_col.isNull(), F.lit(None).cast("string")).when(clock_seconds("start_time").isNull(), "medium").otherwise("high")


def evening_match(now: dt.datetime) -> Column:
    return F.coalesce(
        (parse_day("start_date") == F.lit(now.date()))
        & (clock_seconds("start_time") >= EVENING_SECONDS)
        & (seconds_to_start(now) >= 0),
        F.lit(False),
    )


def last_minute(now: dt.datetime, low: int = 30, high: int = 180) -> Column:
    """struct(minutes, label) when a known start lies inside the window, else null."""
    m = minutes_to_start(now)
    hours, rest = F.floor(m / 60).cast("string"), (m % 60).cast("string")
    label = (
        F.when(m < 60, F.concat(F.lit("in "), m.cast("string"), F.lit(" min")))
        .when(m % 60 == 0, F.concat(F.lit("in "), hours, F.lit(" h")))
        .otherwise(F.concat(F.lit("in "), hours, F.lit(" h "), rest, F.lit(" min")))
    )
    return F.when(m.between(low, high), F.struct(m.alias("minutes"), label.alias("label")))


def go_now_band(now: dt.datetime, distance: Column) -> Column:
    """near / fairly_near / further_away inside the planning envelope, else null."""
    m = minutes_to_start(now)
    ok = m.between(45, 240) & (distance >= 0)
    return (
        F.when(ok & (distance <= 10), "near")
        .when(ok & (distance <= 25) & (m >= 75), "fairly_near")
        .when(ok & (distance <= 50) & (m >= 120), "further_away")
    )


def preset_matches(preset: str | None, now: dt.datetime, distance: Column) -> Column:
    """Quick-choice predicates; presets that only set other filters always pass."""
    if preset == "go_now":
        return go_now_band(now, distance).isNotNull()
    if preset == "last_minute":
        return last_minute(now).isNotNull()
    if preset == "evening":
        return evening_match(now)
    if preset == "hidden_gems":
        return (theme()["zone"] == "hidden_gems") | F.coalesce(is_local_tip("source_names"), F.lit(False))
    if preset == "family":
        return theme()["zone"] == "family_zone"
    return F.lit(True)
