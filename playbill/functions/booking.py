"""Booking links: what a URL is, who sells the ticket, and what may be claimed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.text import col, contains_any, txt


def url_path(url) -> Column:
    """Lower-case path, '/' when the URL has none."""
    return F.lower(F.coalesce(F.nullif(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), F.lit("/")))


def host(url) -> Column:
    """Lower-case host name without surrounding dots, '' when there is none."""
    return F.coalesce(F.trim(F.lower(F.try_parse_url(col(url), F.lit("HOST"))), F.lit(".")), F.lit(""))


def bare_host(url) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_generic_landing(url) -> Column:
    return F.coalesce((txt(url) != "") & url_path(url).isin(vocab.GENERIC_PATHS), F.lit(False))


def url_kind(url) -> Column:
    """booking, ticket, schedule, info, or none; ordered substring evidence."""
    low = F.lower(txt(url))
    return (
        F.when(low == "", "none")
        .when(contains_any(low, vocab.BOOKING_HINTS), "booking")
        .when(contains_any(low, vocab.TICKET_HINTS), "ticket")
        .when(contains_any(low, vocab.SCHEDULE_HINTS), "schedule")
        .otherwise("info")
    )


def url_confidence(url, kind: Column | None = None) -> Column:
    kind, path = url_kind(url) if kind is None else kind, url_path(url)
    deep = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) >= 2
    return (
        F.when(kind.isin("booking", "ticket"), "high")
        .when(kind == "schedule", "medium")
        .when((kind == "info") & ~path.isin(vocab.GENERIC_PATHS) & deep, "medium")
        .otherwise("low")
    )


_LABELS = {"booking": "book", "ticket": "buy_ticket", "schedule": "see_times", "info": "read_more"}


def with_cta(df):
    """Adds `cta` (null without any link) and `cta_quality`.

    An explicit booking link is trusted, a ticket link is judged by its URL, and an
    official page is never turned into a booking claim.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    df = df.withColumns({"_b": blank("booking_url"), "_t": blank("ticket_url"), "_o": blank("official_url")})
    df = df.withColumns({"_url": F.coalesce("_b", "_t", "_o"), "_class": F.when(F.col("_b").isNull(), url_kind(F.coalesce("_t", "_o")))})
    kind = (
        F.when(F.col("_b").isNotNull(), "booking")
        .when(F.col("_class") == "schedule", "schedule")
        .when(F.col("_t").isNotNull() & F.col("_class").isin("booking", "ticket"), F.col("_class"))
        .otherwise("info")
    )
    df = df.withColumn("_kind", kind)
    track = F.col("_kind").isin("booking", "ticket")
    label = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])[F.col("_kind")]
    confidence = F.when(F.col("_b").isNotNull(), "high").otherwise(url_confidence("_url", F.col("_class")))
    cta = F.struct(
        label.alias("label"), F.col("_url").alias("url"), F.col("_kind").alias("kind"), confidence.alias("confidence"), track.alias("track_as_booking")
    )
    weak = (F.col("_kind") == "info") & url_path("_url").isin(vocab.GENERIC_PATHS)
    status = F.when(F.col("_url").isNull(), "missing").when(weak, "weak").when(track, "bookable").otherwise("useful")
    return df.withColumns({"cta": F.when(F.col("_url").isNotNull(), cta), "cta_quality": status}).drop("_b", "_t", "_o", "_url", "_class", "_kind")


def partner_key(host_col: Column) -> Column:
    """First partner (registry order) whose domain is the host or a parent of it."""
    out = F.lit(None).cast("string")
    for key, _, domains in reversed(vocab.PARTNERS):
        rx = r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"
        out = F.when(host_col.rlike(rx), key).otherwise(out)
    return out


def attribution(url) -> Column:
    """struct(key, name, domain, affiliate_status, direct): partner, direct host or unknown."""
    h = bare_host(url)
    key = partner_key(h)
    names = F.create_map(*[F.lit(x) for k, n, _ in vocab.PARTNERS for x in (k, n)])
    has_host = h != ""
    return F.struct(
        F.coalesce(key, F.when(has_host, "direct").otherwise("unknown")).alias("key"),
        F.coalesce(F.try_element_at(names, key), F.when(has_host, h).otherwise(F.lit(vocab.UNKNOWN))).alias("name"),
        h.alias("domain"),
        F.lit("unassessed").alias("affiliate_status"),
        (key.isNull() & has_host).alias("direct"),
    )


def ticket_link(booking="booking_url", ticket="ticket_url") -> Column:
    return F.coalesce(F.nullif(col(booking), F.lit("")), F.nullif(col(ticket), F.lit("")))


def with_attribution(df):
    """Partner columns from the booking or ticket link; rows without a link keep what they had."""
    a = attribution(F.col("_link"))
    has = F.col("_link").isNotNull()
    take = lambda field, old: F.when(has, a[field]).otherwise(F.col(old))
    return (
        df.withColumn("_link", ticket_link())
        .withColumns(
            {
                "booking_partner_key": take("key", "booking_partner_key"),
                "booking_partner": take("name", "booking_partner"),
                "booking_partner_domain": take("domain", "booking_partner_domain"),
                "affiliate_status": take("affiliate_status", "affiliate_status"),
            }
        )
        .drop("_link")
    )


def booking_target(cta="cta") -> Column:
    """Target of a booking click; needs `with_cta`."""
    return F.when(col(cta)["track_as_booking"], col(cta)["url"])


def info_target() -> Column:
    return F.coalesce(F.nullif(F.col("official_url"), F.lit("")), F.nullif(F.col("ticket_url"), F.lit("")))


# --- static URL safety ------------------------------------------------------

def is_http(url) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(col(url), F.lit("PROTOCOL"))).isin("http", "https") & (host(url) != ""), F.lit(False))


def is_public_http(url) -> Column:
    """Web scheme, a host, and no local name or private, loopback or reserved literal address."""
    h = host(F.trim(col(url)))
    private = h.rlike(
        r"^(127\.|10\.|0\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|2(2[4-9]|[3-5]\d)\.)[\d.]+$|^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe80:.*)\]?$"
    )
    return is_http(F.trim(col(url))) & (h != "localhost") & ~h.endswith(".local") & ~private


def is_social(url) -> Column:
    return host(url).rlike(r"(^|\.)(" + "|".join(s.replace(".", r"\.") for s in vocab.SOCIAL_HOSTS) + ")$")


def is_root(url) -> Column:
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    query = F.coalesce(F.try_parse_url(col(url), F.lit("QUERY")), F.lit(""))
    return path.isin("", "/") & (query == "")


def is_ticketish(url) -> Column:
    return contains_any(url_path(url), vocab.TICKET_PATHS)


def same_site(a, b) -> Column:
    """Equal hosts, or one is a subdomain of the other."""
    x, y = host(a), host(b)
    return (x != "") & (y != "") & (
        (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))
    )


def absolute_url(page, href) -> Column:
    """A link seen on a page as an absolute URL."""
    page, href = col(page), F.trim(col(href))
    origin = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(page, r"^(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    with_slash = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    bare = F.regexp_extract(page, r"^([^?#]+)", 1)
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#") | (href == ""), F.concat(bare, href))
        .otherwise(F.concat(with_slash, href))
    )
    # '.' and '..' are resolved as a browser does, segment by segment.
    host, path, tail = F.regexp_extract(joined, r"^(https?://[^/?#]*)", 1), F.regexp_extract(joined, r"^https?://[^/?#]*([^?#]*)", 1), F.regexp_extract(joined, r"([?#].*)$", 1)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    parts = F.split(F.concat(F.substring(path, 2, 1 << 30), F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")), "/")
    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(host, F.lit("/"), walked, tail)).otherwise(joined)
