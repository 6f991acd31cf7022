"""Extraction rules: one row per landed calendar, read by one job.

FIXED VALUES.  `mode` says what a listing starts from: a heading or link with its
box, a text line, or the whole page.  `dates` names the date form, and regular
expressions are Java patterns over lower-case text.
"""

FIELDS = (
    "source_key string, mode string, dates string, link_like string, skip_title string, need string, forbid string, min_len int, max_len int, "
    "venue string, city string, region string, event_type string, free_like string, tags array<string>, id_prefix string"
)

_NAV = r"^(läs mer|visa mer|till evenemangskalendern|rensa alla filter|evenemang|köp biljett|se hela kalendern|kalender)$"
_FREE = r"\b(gratis|fri entré|ingen kostnad|kostnadsfri)\b"
_O = ("Örebro", "Örebro län")

RULES = [
    # source, mode, dates, link, skip, need, forbid, min, max, venue, city, region, type, free, tags, id prefix
    ("conventum", "box_link", "numeric", "/arrangemang/.", _NAV, None, None, 3, 220, "Conventum", *_O, None, None, [], "conventum-"),
    ("visitorebro_editorial", "line", "prefix", None, None, None, None, 3, 220, None, *_O, None, r"\(g\)|fri entr[eé]", [], "visitorebro-"),
    ("orebro_konserthus", "page", "swedish", None, None, None, None, 1, 220, "Örebro Konserthus", *_O, "Konsert", None, ["Musik"], "orebro-kh-"),
    ("orebro_teater", "dated_link", "heading", "/forestallning", _NAV, None, None, 3, 180, "Örebro Teater", *_O, "Teater", None, ["Teater"], "orebro-teater-"),
    ("stockholmsmassan", "box_heading", "swedish", None, None, None, None, 1, 180, "Stockholmsmässan", "Stockholm", "", None, None, [], "stockholmsmassan-"),
    ("elmia", "box_heading", "swedish", None, None, None, None, 1, 180, "Elmia", "Jönköping", "", None, None, [], "elmia-"),
    ("malmomassan", "box_heading", "swedish", None, None, None, None, 1, 180, "Malmömässan", "Malmö", "", None, None, [], "malmomassan-"),
    ("lov_orebro", "box_heading", "swedish", None, r"^(lov örebro|tips på fler aktiviteter)$", None, None, 1, 180, "", *_O, "Aktivitet", r"\bgratis\b", ["Familj", "Barn"], "lovorebro-"),
    ("city_orebro", "box_heading", "swedish", None, _NAV, None, None, 3, 180, "", *_O, None, _FREE, [], "city-orebro-"),
    ("kulturkvarteret", "box_any", "swedish", None, _NAV, None, None, 3, 180, "Kulturkvarteret", *_O, None, None, [], "candidate-kulturkvarteret-"),
    ("wadkoping", "box_any", "swedish", None, _NAV, None, None, 3, 180, "Wadköping", *_O, None, None, [], "candidate-wadkoping-"),
    ("orebro_university", "link", "swedish", None, None, r"öppet för alla.*örebro|örebro.*öppet för alla", r"endast öpp(na|et) för studenter|endast för (studenter|anställda)|stockholm|campus grythyttan|digitalt (seminarium|evenemang)", 3, 180, "Örebro universitet", *_O, None, None, ["öppet för alla"], "candidate-orebro_university-"),
    ("orebro_county_museum", "box_link", "swedish", None, _NAV, None, r"/tag/|/sok|\?query=", 3, 180, "Örebro läns museum", "", "Örebro län", None, None, [], "candidate-orebro_county_museum-"),
    ("orebro_church", "box_heading", "numeric", None, _NAV, None, r"gudstjänst|mässa|andakt", 3, 180, "", *_O, None, _FREE, [], "candidate-orebro_church-"),
    ("karlslund", "box_heading", "swedish", None, r"^(aktuellt|besöksupplevelser|program & evenemang|öppettider & besöksinformation)$|öppettider|kontakt|tillgänglighet|historia", None, None, 3, 180, "Karlslunds herrgård med trädgård", *_O, None, _FREE, ["Karlslund"], "candidate-karlslund-"),
    ("makeriet", "box_heading", "swedish", None, _NAV, None, None, 3, 180, "Makeriet i Örebro", *_O, None, _FREE, [], "candidate-makeriet-"),
    ("tickster_orebro", "box_link", "swedish", "/events/", _NAV, None, r"säsongskort|årskort|presentkort", 3, 180, "", *_O, None, None, [], "tickster-orebro-"),
    ("osk_bandy", "box_link", "swedish", "/events/|/e/", _NAV, None, r"säsongskort|årskort", 3, 180, "", *_O, "Sport", None, ["Sport", "Bandy"], "osk_bandy-"),
    ("osk_fotboll", "fixture", "iso_or_swedish", None, None, r"behrn arena", None, 3, 180, "Behrn Arena", *_O, "Sport", None, ["Sport", "Fotboll"], "osk_fotboll-"),
    ("orebro_hockey", "fixture", "iso_or_swedish", None, None, r"behrn arena", None, 3, 180, "Behrn Arena", *_O, "Sport", None, ["Sport", "Hockey"], "orebro_hockey-"),
    ("kortcentralen", "box_heading", "swedish", None, None, None, None, 1, 140, "", None, "", "Mässa", None, [], "kortcentralen-"),
    ("showtic", "box_heading", "swedish", None, None, None, None, 1, 180, "", None, "", "Stand-up", None, [], "showtic-"),
]

# Places that are safer to recognise by name than to guess.
KNOWN_PLACES = ["Stockholm", "Göteborg", "Malmö", "Örebro", "Karlstad", "Uppsala", "Västerås", "Linköping", "Norrköping", "Halmstad", "Alingsås", "Kristianstad", "Mölndal", "Skara"]
LINE_LOOK_BACK, LINE_LOOK_AHEAD = 18, 10
HOME_WORDS = ["örebro", "ösk"]
