"""Taxonomy, segments and sport scope."""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.text import codes, col, contains_any, dedupe_text, recall_title, sorted_union, txt

_NO_TAGS = "array<string>"


# --- tag rules: words are looked up, only phrases and stems need a pattern ----------

_WORD_RULE = re.compile(r"\\b(\w+)\\b")  # a rule that is one whole word
_NOT_PLAIN = re.compile(r"\[[^\]]*\]\??|\(\?:[^)]*\)\??|\w\?|\\\w")


class TagRules(NamedTuple):
    """Rules by how they are tested: whole words with their tags, and patterns with a text that every match holds."""

    words: dict[str, tuple[str, ...]]
    patterns: list[tuple[str, str, tuple[str, ...]]]


def tag_rules(rules: dict[str, list[str]], sports: dict[str, list[str]]) -> TagRules:
    """Sorts the rules of all families; a rule of a single sport also gives 'Sport'."""
    words, patterns = defaultdict(list), defaultdict(list)
    for tag, pattern in [(t, p) for t, ps in rules.items() for p in ps] + [(t, p) for t, ps in sports.items() for p in ps]:
        tags = [tag, "Sport"] if tag in sports and pattern in sports[tag] else [tag]
        word = _WORD_RULE.fullmatch(pattern)
        (words[word[1]] if word else patterns[pattern]).extend(tags)
    plain = lambda p: max(_NOT_PLAIN.split(p), key=len)
    return TagRules({w: tuple(dict.fromkeys(t)) for w, t in words.items()}, [(plain(p), p, tuple(dict.fromkeys(t))) for p, t in patterns.items()])


TAGS = tag_rules(vocab.TAG_RULES, vocab.SPORT_TAG_RULES)


def taxonomy_text(title, description) -> Column:
    return F.lower(F.concat_ws(" ", txt(title), txt(description)))


def tags_of(text: Column, rules: TagRules = TAGS) -> Column:
    """Sorted tags whose rules occur in a lower-case text.

    The text is cut into words once.  The words that are rules come out of one set intersection,
    and only they are looked up.  A pattern is tried where the text holds its longest plain part.
    """
    listed = lambda tags: F.array(*[F.lit(t) for t in tags])
    known = F.array_intersect(F.split(text, r"(?U)\W+"), listed(rules.words))
    table = F.create_map(*[x for w, tags in rules.words.items() for x in (F.lit(w), listed(tags))])
    by_word = F.flatten(F.transform(known, lambda w: F.element_at(table, w)))
    by_pattern = [F.when(F.contains(text, F.lit(plain)) & text.rlike("(?U)" + pattern), listed(tags)) for plain, pattern, tags in rules.patterns]
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(F.array(by_word, *by_pattern)))))


def classify(df, title="title", description="description", event_type="event_type", category="category"):
    """Adds `new_type`, `new_category`, `new_tags`; only generic buckets are upgraded."""
    df = df.withColumn("_text", taxonomy_text(title, description)).withColumn("new_tags", tags_of(F.col("_text")))
    has = lambda tag: F.array_contains("new_tags", tag)
    kind = F.coalesce(F.nullif(col(event_type), F.lit("")), F.lit("Evenemang"))
    cat = F.coalesce(F.nullif(col(category), F.lit("")), F.lit("Okategoriserat"))
    main = F.coalesce(*[F.when(has(tag), F.lit(tag)) for tag, _ in vocab.TYPE_PRIORITY])
    mapped = F.coalesce(*[F.when(has(tag), F.lit(t)) for tag, t in vocab.TYPE_PRIORITY])
    collector = F.arrays_overlap("new_tags", F.array(*[F.lit(t) for t in vocab.COLLECTOR_TAGS]))
    fair = contains_any(F.col("_text"), vocab.COLLECTOR_FAIR_WORDS)
    new_type = (
        F.when(main.isNotNull(), F.when(kind.isin(vocab.GENERIC_TYPES), mapped).otherwise(kind))
        .when(collector & fair, F.lit("Mässa"))
        .otherwise(kind)
    )
    raw_generic = F.coalesce(col(category).isin("Okategoriserat", "Evenemang"), F.lit(False))
    new_cat = (
        F.when(main.isNotNull(), F.when(cat.isin(vocab.GENERIC_CATEGORIES), main).otherwise(cat))
        .when(collector, F.when(has("Samlarkort"), "Samlarkort").when(has("Retro & nostalgi"), "Retro & nostalgi").otherwise(cat))
        .when(raw_generic & (F.size("new_tags") > 0), F.try_element_at("new_tags", F.lit(1)))
        .otherwise(cat)
    )
    return df.withColumns({"new_type": new_type, "new_category": new_cat}).drop("_text")


def apply_taxonomy(df):
    """Catalogue form: type, category and tags replaced in place."""
    out = classify(df)
    return out.withColumns(
        {"event_type": F.col("new_type"), "category": F.col("new_category"), "tags": sorted_union("tags", "new_tags")}
    ).drop("new_type", "new_category", "new_tags")


def joined(*parts, tags=None) -> Column:
    cells = [txt(p) for p in parts]
    if tags is not None:
        cells.append(F.array_join(F.coalesce(col(tags), F.array().cast(_NO_TAGS)), " "))
    return F.concat_ws(" ", *cells)


def frontier_segments(title="title", event_type="event_type", category="category", venue="venue", tags="tags") -> Column:
    """All segments whose words occur in the text (inside words too), else the rest bucket."""
    text = F.lower(joined(title, event_type, category, venue, tags=tags))
    hits = codes(*[(contains_any(text, w), s) for s, w in vocab.FRONTIER_SEGMENTS.items()])
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(vocab.FRONTIER_OTHER)))


def recall_segment(category) -> Column:
    """First discovery segment whose words occur in a free-form category."""
    text = recall_title(category)
    out = F.lit(vocab.RECALL_OTHER)
    for name, needles in reversed(vocab.RECALL_SEGMENTS):
        out = F.when(contains_any(text, needles), name).otherwise(out)
    return out


def sport_allowed(title="title", event_type="event_type", category="category", tags="tags", description="description") -> Column:
    """Sport is shown only with team-sport evidence; titles and tags outrank descriptions."""
    team, single = "(?iuU)" + vocab.TEAM_SPORT_RE, "(?iuU)" + vocab.INDIVIDUAL_SPORT_RE
    league = "(?iuU)" + vocab.TEAM_LEAGUE_RE
    kind, cat = F.trim(F.lower(txt(event_type))), F.trim(F.lower(txt(category)))
    tag_list = F.coalesce(col(tags), F.array().cast(_NO_TAGS))
    head = F.concat_ws(" ", txt(title), cat, F.array_join(tag_list, " "))
    body = txt(description)
    declared = kind.isin(vocab.SPORT_TYPES) | cat.isin(vocab.SPORT_TYPES)
    tagged = F.exists(tag_list, lambda t: F.lower(t).isin(vocab.SPORT_TYPES))
    is_sport = declared | tagged | head.rlike(team) | head.rlike(single)
    league_fixture = F.concat_ws(" ", txt(title), body).rlike(league) & txt(title).rlike("(?U)" + vocab.FIXTURE_TITLE_RE)
    return (
        F.when(~declared & kind.isin(vocab.CULTURE_TYPES), True)
        .when(~is_sport, True)
        .when(head.rlike(single), False)
        .when(head.rlike(team), True)
        .when(body.rlike(single), False)
        .otherwise(body.rlike(team) | league_fixture)
    )


def collector_match(subcategory: str = "all", title="title", description="description", category="category", tags="tags") -> Column:
    hay = F.lower(joined(title, description, category, tags=tags))
    if subcategory == "all":
        return contains_any(hay, [t.lower() for t in vocab.COLLECTOR_TAGS]) | F.coalesce(
            col(category).isin(vocab.COLLECTOR_TAGS), F.lit(False)
        )
    if subcategory == "card_games":
        return contains_any(hay, vocab.CARD_GAME_WORDS)
    return F.contains(hay, F.lit(subcategory.lower()))


def is_local_tip(source_names) -> Column:
    return F.arrays_overlap(col(source_names), F.array(*[F.lit(s) for s in vocab.LOCAL_TIP_SOURCES]))


def theme(event_type="event_type", category="category", tags="tags") -> Column:
    """struct(theme, zone), first matching theme in fixed order."""
    text = F.lower(joined(event_type, category, tags=tags))
    name, zone = F.lit(vocab.THEME_OTHER[0]), F.lit(vocab.THEME_OTHER[1])
    for key, place, needles in reversed(vocab.THEMES):
        hit = contains_any(text, needles)
        name, zone = F.when(hit, key).otherwise(name), F.when(hit, place).otherwise(zone)
    return F.struct(name.alias("theme"), zone.alias("zone"))


def is_sport(event_type="event_type", category="category") -> Column:
    return F.array_contains(F.split(dedupe_text(joined(event_type, category)), " "), "sport")


def is_staged(event_type="event_type", category="category", tags="tags") -> Column:
    """Staged productions, for which repeated dates are expected."""
    return contains_any(dedupe_text(joined(event_type, category, tags=tags)), vocab.STAGED_WORDS)


# --- type guesses used while ingesting -------------------------------------

def _first_match(text: Column, rules, default: str) -> Column:
    out = F.lit(default)
    for label, needles in reversed(rules):
        out = F.when(contains_any(text, needles), label).otherwise(out)
    return out


def guess_fair_type(title, description) -> Column:
    return _first_match(
        taxonomy_text(title, description),
        [("Mässa", ["mässa", "expo", "trade fair"]), ("Festival", ["festival"]),
         ("Konsert", ["konsert", "concert"]), ("Konferens", ["kongress"])],
        "Evenemang",
    )


def guess_linked_data_type(title, description) -> Column:
    return _first_match(
        taxonomy_text(title, description),
        [("Mässa", ["mässa", "expo", "fair"]), ("Konsert", ["konsert", "concert", "live music"]), ("Festival", ["festival"])],
        "Evenemang",
    )


def guess_calendar_type(prefix, title) -> Column:
    return _first_match(
        taxonomy_text(prefix, title),
        [("Konsert", ["konsert", "musik"]), ("Teater", ["teater"]), ("Scenkonst", ["scenkonst", "dans"]),
         ("Familj", ["för barn", "familj"]), ("Utställning", ["utställning", "konst"]),
         ("Föreläsning", ["föreläsning", "samtal"]), ("Marknad", ["marknad", "mässa"]),
         ("Aktivitet", ["delta själv", "workshop", "prova på"])],
        "Evenemang",
    )


def classify_tile(df, title="title", venue="venue"):
    """Adds `tile_type` and `tile_category` of ticket-shop tiles.

    The taxonomy of title and venue decides; where it leaves the generic local bucket, plain wording
    and strong venue words do, in fixed order.
    """
    generic = df.withColumns({"_type": F.lit("Evenemang"), "_category": F.lit(vocab.TILE_BUCKET)})
    judged = classify(generic, title, venue, "_type", "_category")
    text = F.lower(F.concat_ws(" ", txt(title), txt(venue)))
    kind, category = F.col("new_type"), F.col("new_category")
    open_ = (kind == "Evenemang") & (category == vocab.TILE_BUCKET)
    for words, tile_type, tile_category in reversed(vocab.TILE_WORDS):
        hit = open_ & contains_any(text, words)
        kind, category = F.when(hit, tile_type).otherwise(kind), F.when(hit, tile_category).otherwise(category)
    return judged.withColumns({"tile_type": kind, "tile_category": category}).drop("_type", "_category", "new_type", "new_category", "new_tags")
