"""Row-level quality: core integrity, noise, weak titles and missing details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.dates import parse_day
from playbill.functions.text import codes, col, nz, search_text, search_text_py, txt

DETAIL_FIELDS = ["start_time", "precise_venue", "end_time", "booking", "price", "door_time", "age_limit"]


def _core_breaks():
    start, end = parse_day(F.trim(col("start_date"))), parse_day(F.trim(col("end_date")))
    return [
        (nz("title").isNull(), "title_missing"),
        (start.isNull(), "start_invalid"),
        (start.isNotNull() & nz("end_date").isNotNull() & end.isNull(), "end_invalid"),
        (end < start, "end_before_start"),
        (nz("venue").isNull() & nz("city").isNull(), "place_missing"),
    ]


def _price_doubts():
    status = F.lower(F.trim(F.coalesce(F.nullif(col("price_status"), F.lit("")), F.lit("unknown"))))
    return [
        ((status == "known") & col("price_min").isNull(), "known_price_missing"),
        ((status == "free") & (col("price_min") != 0), "free_but_priced"),
    ]


def _any(pairs) -> Column:
    hit = F.lit(False)
    for cond, _ in pairs:
        hit = hit | F.coalesce(cond, F.lit(False))
    return hit


def restricted_reasons() -> Column:
    """Broken core fields: they cap the rank, they never hide the listing."""
    return codes(*_core_breaks())


def is_restricted() -> Column:
    return _any(_core_breaks())


def review_reasons() -> Column:
    return codes(*_price_doubts())


def quality_level() -> Column:
    return F.when(is_restricted(), "restricted").when(_any(_price_doubts()), "review").otherwise("pass")


def gate_score(score: Column) -> Column:
    """A listing with broken core fields cannot rank above the cap."""
    return F.when(is_restricted(), F.least(score, F.lit(vocab.QUALITY_SCORE_CAP))).otherwise(score)


def is_noise(title="title") -> Column:
    """Navigation text, bare dates, URLs or nothing: severity high."""
    raw = F.trim(txt(title))
    # One pattern, so that a filter normalises the title once; normalised texts hold letters, digits and blanks only.
    whole = "|".join(sorted({search_text_py(t) for t in vocab.NOISE_TITLES}))
    return (
        raw.rlike("(?iuU)" + vocab.DATE_ONLY_RE) | raw.rlike("(?iuU)" + vocab.TIME_ONLY_RE)
        | search_text(raw).rlike(f"^((http|https|www) |({whole})?$)")
    )


def noise_severity(title="title", records="source_records") -> Column:
    """high (see `is_noise`), review, or none."""
    norm = search_text(F.trim(txt(title)))
    review = F.length(norm) <= 3
    if records is not None:
        raws = F.filter(
            F.array_distinct(F.transform(col(records), lambda r: search_text(r["raw_title"]))),
            lambda t: t != "",
        )
        review = review | F.coalesce((F.size(raws) >= 2) & ~F.array_contains(raws, norm), F.lit(False))
    return F.when(is_noise(title), "high").when(review, "review").otherwise("none")


def title_issue() -> Column:
    norm = search_text(F.trim(txt("title")))
    # Stored with accents in the published list; compared after accent removal, so accented entries never match.
    generic = [t for t in vocab.GENERIC_TITLES]
    return (
        F.when(norm == "", "title_missing")
        .when(F.length(norm) < 4, "very_short")
        .when(norm.isin(generic), "too_generic")
        .when((norm == search_text("event_type")) | (norm == search_text("category")), "repeats_category")
    )


def metadata_issues() -> Column:
    no_venue, no_city = nz("venue").isNull(), nz("city").isNull()
    no_link = F.nullif(txt("official_url"), F.lit("")).isNull() & F.nullif(txt("ticket_url"), F.lit("")).isNull()
    return codes(
        (no_venue & no_city, "place_missing"),
        (no_venue & ~no_city, "venue_missing"),
        (nz("start_date").isNull(), "date_missing"),
        ((txt("start_time") == "") & no_venue, "time_and_venue_missing"),
        (no_link, "no_link"),
    )


def has_precise_venue() -> Column:
    venue, city = F.lower(F.trim(txt("venue"))), F.lower(F.trim(txt("city")))
    return ~venue.isin(vocab.GENERIC_VENUES) & ((city == "") | (venue != city))


def has_known_price() -> Column:
    return F.coalesce(col("price_status").isin("known", "free"), F.lit(False))


def has_detail(field: str) -> Column:
    """Whether one of the seven practical fields is filled."""
    if field == "precise_venue":
        return has_precise_venue()
    if field == "price":
        return has_known_price()
    if field == "booking":
        return F.coalesce(F.nullif(col("booking_url"), F.lit("")), F.nullif(col("ticket_url"), F.lit(""))).isNotNull()
    return nz(field).isNotNull()


def missing_detail(field: str) -> Column:
    return ~has_detail(field)
