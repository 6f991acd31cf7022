"""Dates, clocks and period predicates.  `today`/`now` are always parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.text import col, let, txt

FAR = dt.date(9999, 12, 31)


def parse_day(c) -> Column:
    """Strict ISO date or null."""
    return F.try_to_date(col(c), "yyyy-MM-dd")


def days_until(start, today: dt.date) -> Column:
    return F.coalesce(F.datediff(parse_day(start), F.lit(today)), F.lit(9999))


def window_of(preset: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """Inclusive window of a period preset; a Sunday belongs to the running weekend."""
    if preset == "weekend":
        saturday = today + dt.timedelta(days=5 - today.weekday())
        return max(today, saturday), saturday + dt.timedelta(days=1)
    days = vocab.PRESET_DAYS.get(preset)
    return today, FAR if days is None else today + dt.timedelta(days=days)


def in_window(day: Column, preset: str, today: dt.date) -> Column:
    lo, hi = window_of(preset, today)
    return day.between(F.lit(lo), F.lit(hi))


def period_matches(start, end, excluded, preset: str, today: dt.date) -> Column:
    """A listing runs on at least one day of the window that it does not exclude."""
    lo, hi = window_of(preset, today)
    first = parse_day(start)
    last = F.greatest(first, F.coalesce(parse_day(end), first))
    from_day, to_day = F.greatest(first, F.lit(lo)), F.least(last, F.lit(hi))
    days_off = F.array_distinct(
        F.filter(
            F.transform(F.coalesce(col(excluded), F.array().cast("array<string>")), lambda d: F.try_to_date(d, "yyyy-MM-dd")),
            lambda d: d.between(from_day, to_day),
        )
    )
    # Valid dates are ISO text, so the comparison on the raw column is implied; it is the part a scan can prune with.
    return (col(start) <= F.lit(hi.isoformat())) & F.coalesce(
        (first <= F.lit(hi)) & (last >= F.lit(lo)) & (F.datediff(to_day, from_day) + 1 > F.size(days_off)), F.lit(False)
    )


def in_horizon(start, demo, today: dt.date, days: int) -> Column:
    """Starts within the next `days` days (at least one), and is not a demo row."""
    end = today + dt.timedelta(days=max(1, int(days)))
    raw = col(start).between(today.isoformat(), end.isoformat())  # implied; lets the scan skip files
    return raw & ~F.coalesce(col(demo), F.lit(False)) & F.coalesce(parse_day(start).between(F.lit(today), F.lit(end)), F.lit(False))


def clock_minutes(c) -> Column:
    """Minutes since midnight of an HH:MM or HH:MM:SS clock; null when invalid or missing."""
    c = F.trim(col(c))
    ok = c.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d(:([0-5]?\d|60|61))?$")
    part = lambda i: F.regexp_extract(c, r"^(\d{1,2}):(\d{1,2})", i).cast("int")
    return F.when(ok, part(1) * 60 + part(2))


def clock_seconds(c) -> Column:
    """Like `clock_minutes`, with the seconds part."""
    sec = F.regexp_extract(F.trim(col(c)), r"^\d{1,2}:\d{1,2}:(\d{1,2})$", 1)
    return clock_minutes(c) * 60 + F.when(sec == "", 0).otherwise(sec.cast("int"))


def listing_clock(start_time, title) -> Column:
    """HH:MM from the clock field, else from the tail of the title."""
    field = txt(start_time)
    head = r"^(\d{1,2}):(\d{2})"
    tail = r"(?iuU)(?:kl\.?\s*|[-–]\s*)(\d{1,2})[:.](\d{2})\s*$"
    fmt = lambda c, rx: F.concat(F.lpad(F.regexp_extract(c, rx, 1), 2, "0"), F.lit(":"), F.regexp_extract(c, rx, 2))
    return F.when(field.rlike(head), fmt(field, head)).when(txt(title).rlike(tail), fmt(txt(title), tail))


def strict_clock(c) -> Column:
    """First five characters of a strict HH:MM[:SS] clock, else null."""
    c = col(c)
    return F.when(c.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$"), F.substring(c, 1, 5))


# --- Swedish date phrases -------------------------------------------------

_MONTH_ALT = "|".join(vocab.MONTHS_SV)
_ANY_MONTH = "|".join(sorted(set(vocab.MONTHS_SV + vocab.MONTHS_SV_SHORT), key=lambda m: -len(m)))


def month_number(name: Column) -> Column:
    """Month of a full or three-letter Swedish name (first three letters are unique)."""
    pos = F.array_position(F.array(*[F.lit(m) for m in vocab.MONTHS_SV_SHORT]), F.substring(F.lower(name), 1, 3))
    return F.when(pos > 0, pos.cast("int"))


def make_day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null when there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _num(text: Column, rx: str, i: int) -> Column:
    got = F.regexp_extract(text, rx, i)
    return F.when(got != "", got.cast("int"))


def _roll(day: Column, explicit: Column, today: dt.date, anchor: Column | None = None) -> Column:
    """Without an explicit year, a day before this month means next year; 29 February then gives null."""
    anchor = day if anchor is None else anchor
    behind = explicit.isNull() & (anchor < F.lit(today.replace(day=1)))
    return F.when(behind, make_day(F.year(day) + 1, F.month(day), F.dayofmonth(day))).otherwise(day)


def swedish_range(c, today: dt.date) -> Column:
    """struct(start, end) of the first Swedish date phrase in a text.

    Understands '10 september', '28-29 september', '12 maj - 15 augusti', with or
    without a year and with abbreviated months.  A range across months is preferred to
    a range within one, and that to a single day.
    """
    text = F.regexp_replace(F.lower(txt(c)), r"[–—›]", "-")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\.", "")
    m = rf"(?:{_ANY_MONTH})"
    forms = [rf"(?U)\b\d{{1,2}} {m} ?- ?\d{{1,2}} {m}\b", rf"(?U)\b\d{{1,2}} ?- ?\d{{1,2}} {m}\b", rf"(?U)\b\d{{1,2}} {m}\b"]

    def phrase(t):
        found = F.coalesce(*[F.nullif(F.regexp_extract(t, rx, 0), F.lit("")) for rx in forms])
        return F.struct(_num(t, r"(?U)\b(20\d{2})\b", 1).alias("year"), found.alias("found"))

    def numbers(p):
        days, months = F.regexp_extract_all(p["found"], F.lit(r"\d{1,2}"), F.lit(0)), F.regexp_extract_all(p["found"], F.lit(m), F.lit(0))
        return F.struct(p["year"].alias("year"), F.transform(days, lambda d: d.cast("int")).alias("d"), F.transform(months, month_number).alias("m"))

    def days(n):
        year = F.coalesce(n["year"], F.lit(today.year))
        edge = lambda i: make_day(year, F.try_element_at(n["m"], F.lit(i)), F.try_element_at(n["d"], F.lit(i)))
        return F.struct(n["year"].alias("year"), edge(1).alias("start"), edge(-1).alias("end"))

    def rolled(x):
        return F.struct(_roll(x["start"], x["year"], today, x["end"]).alias("start"), _roll(x["end"], x["year"], today).alias("end"))

    def ordered(x):
        over = make_day(F.year(x["end"]) + 1, F.month(x["end"]), F.dayofmonth(x["end"]))
        return F.struct(x["start"].alias("start"), F.when(x["end"] < x["start"], over).otherwise(x["end"]).alias("end"))

    out = let(let(let(let(let(text, phrase), numbers), days), rolled), ordered)
    return let(out, lambda x: F.when(x["start"].isNotNull() & x["end"].isNotNull(), x))


def numeric_day(c, today: dt.date) -> Column:
    """First d/m or d/m/yyyy in a text, rolled forward when the year is missing."""
    rx = r"\b(\d{1,2})/(\d{1,2})(?:/(20\d{2}))?\b"

    def day(t):
        return F.struct(_num(t, rx, 3).alias("year"), make_day(F.coalesce(_num(t, rx, 3), F.lit(today.year)), _num(t, rx, 2), _num(t, rx, 1)).alias("day"))

    return let(let(txt(c), day), lambda x: _roll(x["day"], x["year"], today))


def numeric_prefix(c, year: Column) -> Column:
    """struct(start, end, rest) of a line starting with d/m, d-d/m or d/m-d/m."""
    line = F.trim(F.regexp_replace(F.regexp_replace(txt(c), r"[–—]", "-"), r"(?U)\s+", " "))
    rx = r"^(\d{1,2})(?:/(\d{1,2}))?(?: ?- ?(\d{1,2})/(\d{1,2}))? (.+)$"

    def parts(t):
        d1, m1, d2, m2 = (_num(t, rx, i) for i in (1, 2, 3, 4))
        start = make_day(year, F.coalesce(m1, m2), d1)
        end = F.when(d2.isNull(), start).otherwise(make_day(year, m2, d2))
        return F.struct(start.alias("start"), end.alias("end"), F.regexp_extract(t, rx, 5).alias("rest"))

    return let(let(line, parts), lambda x: F.when(x["start"].isNotNull() & x["end"].isNotNull(), x))


def explicit_price(c) -> Column:
    """struct(low, high, status) of an explicitly stated price; silence is 'unknown', never free."""
    text = F.regexp_replace(F.lower(txt(c)), r"(?U)\s+", " ")
    free_rx = r"(?U)\b(fri entré|gratis|kostnadsfria biljetter|kostnadsfritt)\b"
    pair_rx, one_rx = r"(?U)\b(\d{1,5})\s*[-–—]\s*(\d{1,5})\s*kronor\b", r"(?U)\b(\d{1,5})\s*kronor\b"
    number = lambda t, rx, i: F.nullif(F.regexp_extract(t, rx, i), F.lit("")).cast("double")

    def price(t):
        free = t.rlike(free_rx)
        low = F.coalesce(number(t, pair_rx, 1), number(t, one_rx, 1))
        high = F.coalesce(number(t, pair_rx, 2), number(t, one_rx, 1))
        status = F.when(free, "free").when(low.isNotNull(), "known").otherwise("unknown")
        return F.struct(F.when(~free, low).alias("low"), F.when(~free, high).alias("high"), status.alias("status"))

    return let(text, price)
