"""Compact presentation texts (P4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.dates import parse_day
from playbill.functions.text import col, nz, txt


def short_number(c: Column) -> Column:
    """Shortest form of an amount: no trailing zeros, at most six significant digits."""
    whole = c == F.floor(c)
    plain = F.format_string("%.2f", c)
    return F.when(whole, F.floor(c).cast("string")).otherwise(F.regexp_replace(plain, r"\.?0+$", ""))


def price_label() -> Column:
    currency = F.upper(F.coalesce(F.nullif(col("currency"), F.lit("")), F.lit("SEK")))
    suffix = F.when(currency == "SEK", " kr").otherwise(F.concat(F.lit(" "), currency))
    low, high = col("price_min"), col("price_max")
    return (
        F.when(col("price_status") == "free", "Gratis")
        .when(F.coalesce(col("price_status"), F.lit("unknown")) != "known", "Pris saknas")
        .when(low.isNull(), "Pris saknas")
        .when(high > low, F.concat(short_number(low), F.lit("–"), short_number(high), suffix))
        .otherwise(F.concat(F.lit("Från "), short_number(low), suffix))
    )


def _day_text(day: Column) -> Column:
    names = F.array(*[F.lit(d) for d in vocab.WEEKDAYS_SV_SHORT])
    months = F.array(*[F.lit(m) for m in vocab.MONTHS_SV_SHORT])
    return F.concat_ws(
        " ", F.element_at(names, F.weekday(day) + 1), F.dayofmonth(day).cast("string"), F.element_at(months, F.month(day))
    )


def date_label(today: dt.date) -> Column:
    start, end = parse_day("start_date"), parse_day("end_date")
    base = (
        F.when(start == F.lit(today), "Idag").when(start == F.lit(today + dt.timedelta(days=1)), "Imorgon").otherwise(_day_text(start))
    )
    clock = lambda c: F.substring(nz(c), 1, 5)
    with_time = F.concat(base, F.coalesce(F.concat(F.lit(" · "), clock("start_time"), F.coalesce(F.concat(F.lit("–"), clock("end_time")), F.lit(""))), F.lit("")))
    return (
        F.when(start.isNull(), "Datum saknas")
        .when((start < F.lit(today)) & (end >= F.lit(today)), F.concat(F.lit("Pågår till "), _day_text(end)))
        .otherwise(with_time)
    )


def place_label(distance: Column | None = None, approximate: Column | None = None) -> Column:
    venue, city = nz("venue"), nz("city")
    both = venue.isNotNull() & city.isNotNull() & (F.lower(venue) != F.lower(city))
    place = F.when(both, F.concat_ws(", ", venue, city)).otherwise(F.coalesce(venue, city, F.lit("Plats ej angiven")))
    if distance is None:
        return place
    about = F.when(approximate, "ca ").otherwise("") if approximate is not None else F.lit("")
    return F.when(distance.isNull(), place).otherwise(F.concat(place, F.lit(" · "), about, short_number(distance), F.lit(" km")))


def context_label(city: Column, when: Column, radius: Column, price: Column) -> Column:
    place = F.coalesce(F.nullif(city, F.lit("")), F.lit("Hela Sverige"))
    within = F.when((place != "Hela Sverige") & radius.isNotNull(), F.concat(F.lit("inom "), radius.cast("int").cast("string"), F.lit(" km")))
    return F.concat_ws(" · ", place, when, within, F.when(F.coalesce(price, F.lit("")) != "", F.lower(price)))


def tonight_summary(distance: Column, price_text: Column) -> Column:
    return F.concat_ws(
        " · ",
        F.concat(F.lit("Start "), F.substring(nz("start_time"), 1, 5)),
        F.concat(short_number(distance), F.lit(" km")),
        F.nullif(price_text, F.lit("")),
    )


def status_label() -> Column:
    status = F.lower(txt("status"))
    return (
        F.when(status.isin("cancelled", "canceled"), "Inställt").when(status == "postponed", "Uppskjutet")
        .when(status == "rescheduled", "Flyttat").otherwise("")
    )
