"""Text normalisation as Catalyst expressions.

Spark has no built-in Unicode decomposition.  Rather than pay for a Python
worker on every row, the compatibility decomposition is turned into a
character table once (from `unicodedata`, by rule) and applied with
`translate`, which stays inside whole-stage codegen.  The few hundred code
points that decompose into more than one character are expanded first, and
only in rows that contain one.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab

_SEP, _KV = "\u0001", "\u0002"

FILLER_WORDS_RE = rf"(?U)\b({vocab.FILLER_WORDS_RE})\b"


@lru_cache(maxsize=1)
def _decomposition():
    """(from, to, many): one-to-one pairs, deletions, and one-to-many expansions.

    Only code points that matter downstream are listed: combining marks (dropped)
    and those whose decomposition holds an ASCII character.  Everything else is
    turned into a blank or dropped by the callers whichever form it is in.
    """
    source, target, marks, many = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if not plain:
            marks.append(ch)
            continue
        if plain == ch or not any(ord(c) < 128 for c in plain):
            continue
        if len(plain) == 1:
            source.append(ch)
            target.append(plain)
        else:
            many[ch] = plain
    return "".join(source + marks), "".join(target), many


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """Trimmed text, or null when blank."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def txt(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_marks(c) -> Column:
    """Compatibility decomposition without combining marks."""
    source, target, many = _decomposition()
    c = txt(c)
    table = F.expr(
        "str_to_map('{}', '{}', '{}')".format(
            _SEP.join(k + _KV + v.replace("\\", "\\\\").replace("'", "\\'") for k, v in many.items()), _SEP, _KV
        )
    )
    expanded = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    has_wide = F.length(F.translate(c, "".join(many), "")) < F.length(c)
    wide = F.when(has_wide, expanded).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(wide, source, target)).otherwise(c)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def search_text(c) -> Column:
    """Accent-free lower-case words separated by single blanks."""
    return _squeeze(F.lower(strip_marks(c)))


def search_text_py(value: str) -> str:
    """`search_text` for constants met while a plan is being built."""
    value = unicodedata.normalize("NFKD", value or "")
    value = "".join(ch for ch in value if not unicodedata.combining(ch)).lower()
    return " ".join("".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in value).split())


def dedupe_text(c) -> Column:
    """`search_text` without filler words that differ between calendars."""
    return _squeeze(F.regexp_replace(F.lower(strip_marks(c)), FILLER_WORDS_RE, " "))


def city_key(c) -> Column:
    ascii_only = F.regexp_replace(strip_marks(c), r"[^\x00-\x7F]", "")
    bare = F.regexp_replace(ascii_only, r"(?i)\b(kommun|stad|city|sweden|sverige)\b", " ")
    return _squeeze(F.lower(bare))


def recall_title(c) -> Column:
    return _squeeze(F.regexp_replace(F.lower(strip_marks(c)), "&", " och "))


def title_identity(c) -> Column:
    """Title as used to recognise the same listing: spelling variants and suffixes removed."""
    c = F.regexp_replace(txt(c), r"(?iuU)stand[\s-]?up", "standup")
    c = F.regexp_replace(c, r"(?iuU)\bÖSK\b", "Örebro SK")
    c = F.regexp_replace(c, r"(?iuU)\s*(?:[-–]\s*|kl\.?\s*)\d{1,2}[:.]\d{2}\s*$", "")
    c = F.regexp_replace(c, r"(?iuU)\s*[-–]\s*extrainsatt matinéföreställning\s*$", "")
    return dedupe_text(c)


def words(c) -> Column:
    """Distinct words of an already normalised text; no words for ''."""
    return F.array_distinct(F.filter(F.split(col(c), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union
    ).otherwise(F.lit(0.0))


def contains_any(c: Column, needles) -> Column:
    """True if any literal occurs in the text (inside words too); one scan for all literals."""
    return c.rlike("|".join(re.escape(needle) for needle in needles))


def codes(*pairs) -> Column:
    """Array of the values whose condition holds, in order.

    Built from `concat`, not from a filtered array: higher-order functions fall out of
    generated code and would take every condition with them.
    """
    empty = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(value if isinstance(value, Column) else F.lit(value))).otherwise(empty) for cond, value in pairs])


def clean_names(names) -> Column:
    """Trimmed, distinct, sorted names without blanks."""
    names = F.coalesce(col(names), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")))


def names_or_record_sources(names, records) -> Column:
    """Source names of a listing, falling back to its provenance records."""
    own = clean_names(names)
    return F.when(F.size(own) > 0, own).otherwise(clean_names(F.transform(col(records), lambda r: r["source"])))


def category_label(event_type, category) -> Column:
    """Type, else category, else the unknown label."""
    return F.trim(F.coalesce(F.nullif(col(event_type), F.lit("")), F.nullif(col(category), F.lit("")), F.lit("Okänd")))


def sorted_union(a, b) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(col(a), empty), F.coalesce(col(b), empty))))


def stable_id(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(col(c)), 1, 20))


def localized(c) -> Column:
    """Swedish value of a language map, else English, trimmed."""
    c = col(c)
    return F.trim(F.coalesce(F.nullif(c["sv"], F.lit("")), F.nullif(c["en"], F.lit("")), F.lit("")))


def json_context(c) -> Column:
    """Context text as a map; anything unreadable is an empty map."""
    parsed = F.from_json(col(c), "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def ratio(num: Column, den: Column) -> Column:
    """Quotient as double; null for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def filter_signature(*parts) -> Column:
    """Stable key of the filters behind one result list."""
    return F.concat_ws("␟", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def impression_key(signature, listing_id) -> Column:
    return F.concat_ws(":", col(signature), col(listing_id))
