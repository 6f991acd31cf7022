"""Vocabularies and thresholds.

Everything in this module is a FIXED VALUE: it has to equal the published
behaviour for results to be right, so it is stated as plain data and nothing
here computes anything.
"""

# --- Fixed values: places -------------------------------------------------
CITY_COORDS = {
    "Örebro": (59.2753, 15.2134),
    "Stockholm": (59.3293, 18.0686),
    "Göteborg": (57.7089, 11.9746),
    "Malmö": (55.6050, 13.0038),
    "Jönköping": (57.7826, 14.1618),
    "Uppsala": (59.8586, 17.6389),
    "Västerås": (59.6099, 16.5448),
    "Linköping": (58.4108, 15.6214),
    "Norrköping": (58.5877, 16.1924),
    "Karlstad": (59.3793, 13.5036),
    "Eskilstuna": (59.3712, 16.5098),
    "Karlskoga": (59.3267, 14.5239),
    "Kumla": (59.1277, 15.1434),
    "Lindesberg": (59.5920, 15.2304),
    "Nora": (59.5193, 15.0398),
    "Hallsberg": (59.0657, 15.1117),
    "Arboga": (59.3939, 15.8388),
    "Köping": (59.5140, 15.9926),
    "Oslo": (59.9139, 10.7522),
    "Köpenhamn": (55.6761, 12.5683),
}
CITY_ALIASES = {"copenhagen": "Köpenhamn", "gothenburg": "Göteborg", "malmoe": "Malmö"}
EARTH_RADIUS_KM = 6371.0

# --- Fixed values: ranking ------------------------------------------------
MAJOR_VENUES = {
    "Stockholmsmässan": 8,
    "Elmia": 8,
    "Svenska Mässan": 8,
    "Svenska Mässan Gothia Towers": 8,
    "Malmömässan": 7,
    "Strawberry Arena": 8,
    "Avicii Arena": 7,
    "Ullevi": 8,
    "Scandinavium": 6,
}
MAJOR_HINTS = {
    "international": 4, "nordic": 3, "scandinavia": 3, "world": 4,
    "expo": 2, "festival": 3, "championship": 4, "mässa": 2,
    "fair": 2, "show": 2,
}
INTEREST_PROFILES = {
    "Musik": ("musik", "konsert", "festival", "rock", "metal", "jazz", "artist"),
    "Stand-up": ("stand up", "stand-up", "komiker", "comedy", "humor"),
    "Sport": ("sport", "fotboll", "hockey", "innebandy", "match", "mästerskap"),
    "Familj": ("familj", "barn", "kids", "lov", "lek", "cirkus"),
    "Samlarkort & TCG": ("samlarkort", "sportkort", "pokemon", "tcg", "magic", "lorcana", "yu gi oh", "card show"),
    "Gaming & retro": ("gaming", "tv spel", "retro", "retromania", "nintendo", "playstation", "xbox"),
    "Mat & dryck": ("mat", "food", "dryck", "vin", "ol", "beer", "smak"),
    "Teater & show": ("teater", "musikal", "show", "scen", "theatre", "musical"),
    "Mässor": ("massa", "expo", "fair", "utstallning", "konferens"),
    "Teknik & industri": ("teknik", "tech", "industri", "industrial", "hallbarhet", "miljo", "fordon"),
}
PRICE_LIMITS = {"any": None, "free": 0, "max_100": 100, "max_250": 250, "max_500": 500}
PRESET_DAYS = {"today": 0, "weekend": None, "next_7_days": 7, "next_30_days": 30, "next_3_months": 92}
WIDER_PERIODS = {
    "today": ["next_7_days", "next_30_days", "next_3_months"],
    "weekend": ["next_7_days", "next_30_days", "next_3_months"],
    "next_7_days": ["next_30_days", "next_3_months"],
    "next_30_days": ["next_3_months"],
    "next_3_months": [],
}
RADIUS_STEPS = [25, 50, 100, 200, 300]
QUALITY_SCORE_CAP = 18

# --- Fixed values: taxonomy -----------------------------------------------
TAG_RULES = {
    "Stand-up": [r"\bstand[\s-]?up\b", r"\bkomiker\b", r"\bcomedy\b", r"\bhumor\b"],
    "Samlarkort": [r"\bsamlarkort\b", r"\bsamlarbilder\b", r"\btrading cards?\b", r"\bcard show\b", r"\btcg\b", r"\bpok[ée]mon\b", r"\byu[\s-]?gi[\s-]?oh\b", r"\blorcana\b", r"\bmagic(?: the gathering)?\b", r"\bone piece\b"],
    "Sportkort": [r"\bhockeykort\b", r"\bfotbollskort\b", r"\bsportkort\b", r"\bsports cards?\b"],
    "Retro & nostalgi": [r"\bretro\b", r"\bnostalgi\b", r"\b80[\s-]?tal\b", r"\b90[\s-]?tal\b", r"\bretromania\b"],
    "Gaming": [r"\bgaming\b", r"\btv[\s-]?spel\b", r"\bnintendo\b", r"\bsega\b", r"\bplaystation\b", r"\bxbox\b", r"\besport\b", r"\be-sport\b"],
    "Comic/anime": [r"\bcomic\b", r"\bcomics\b", r"\banime\b", r"\bmanga\b", r"\bcosplay\b"],
    "Lego": [r"\blego\b", r"\bklossfestival"],
    "Leksaker": [r"\bleksak", r"\btoy\b", r"\bbarbie\b", r"\bhe[\s-]?man\b"],
    "Teknik": [r"\btech\b", r"\bteknik\b", r"\btechnology\b"],
    "Industri": [r"\bindustri\b", r"\bindustrial\b", r"\btillverkning\b"],
    "Miljö & hållbarhet": [r"\bmiljö\b", r"\bhållbar", r"\bavfall\b", r"\brecycling\b", r"\bcircular\b"],
    "Fordon": [r"\bfordon\b", r"\bautomotive\b", r"\bbilmässa\b", r"\bmotor\b", r"\brally\b", r"\bmotorsport\b"],
    "Mat & dryck": [r"\bmatfestival\b", r"\bfood festival\b", r"\bmatmarknad\b", r"\bvinmässa\b", r"\bölmässa\b", r"\bstreet food\b"],
    "Teater": [r"\bteater\b", r"\btheatre\b", r"\bdrama\b", r"\bskådespel\b"],
    "Musikal/show": [r"\bmusikal\b", r"\bmusical\b", r"\bshow\b", r"\brevy\b", r"\bcirkus\b"],
    "Dans": [r"\bdansföreställning\b", r"\bbalett\b", r"\bdance show\b"],
    "Konsert": [r"\bkonsert\b", r"\bconcert\b", r"\blive music\b", r"\bgig\b"],
    "Festival": [r"\bfestival\b"],
    "Marknad": [r"\bmarknad\b", r"\bloppis\b", r"\bflea market\b", r"\bjulmarknad\b", r"\bmatmarknad\b"],
    "Utställning": [r"\butställning\b", r"\bexhibition\b", r"\bvernissage\b", r"\bkonsthall\b"],
    "Föreläsning": [r"\bföreläsning\b", r"\blecture\b", r"\bförfattarsamtal\b", r"\bsamtalskväll\b"],
    "Familj": [r"\bfamiljeföreställning\b", r"\bfamiljedag\b", r"\bbarnteater\b", r"\bbarnföreställning\b", r"\bför barn\b"],
    "Sport": [
        r"\bsportevent\b", r"\bmästerskap\b", r"\bchampionship\b", r"\bfotboll\b", r"\bsoccer\b",
        r"\bishockey\b", r"\bhockey\b", r"\bshl\b", r"\bhockeyallsvenskan\b", r"\bbasket\b", r"\bhandboll\b",
        r"\binnebandy\b", r"\bvolleyboll\b", r"\bvolleyball\b", r"\bbandy\b", r"\btennis\b", r"\bpadel\b",
        r"\bfriidrott\b", r"\bathletics\b", r"\blöpning\b", r"\bmaraton\b", r"\bmarathon\b", r"\bcykel\b",
        r"\bcycling\b", r"\bsimning\b", r"\bswimming\b", r"\bskidor\b", r"\bskiing\b", r"\bgolf\b",
        r"\bamerikansk fotboll\b", r"\bamerican football\b", r"\bsuperettan\b", r"\belitettan\b",
        r"\ballsvenskan\b", r"\bsvenska cupen\b", r"\börebro sk\b", r"\börebro hockey\b",
    ],
}
SPORT_TAG_RULES = {
    "Badminton": [r"\bbadminton\b"], "Bandy": [r"\bbandy\b"],
    "Bordtennis": [r"\bbordtennis\b", r"\btable tennis\b"],
    "Motorsport": [r"\bmotorsport\b", r"\brally\b", r"\bspeedway\b", r"\bmotocross\b", r"\bgokart\b"],
    "Orientering": [r"\borientering\b", r"\borienteering\b"],
    "Ridsport": [r"\bridsport\b", r"\bdressyr\b", r"\bhästhoppning\b"],
    "Kampsport": [r"\bkampsport\b", r"\bboxning\b", r"\bjudo\b", r"\bkarate\b", r"\btaekwondo\b", r"\bbrottning\b"],
    "Curling": [r"\bcurling\b"], "Rugby": [r"\brugby\b"],
    "Gymnastik": [r"\bgymnastik\b"], "Triathlon": [r"\btriathlon\b", r"\btriatlon\b"],
    "Kajak": [r"\bkajak\b", r"\bkayak\b"], "Skridskor": [r"\bskridsko(?:r|åkning)\b", r"\bkonståkning\b"],
}
TYPE_PRIORITY = [
    ("Stand-up", "Stand-up"), ("Teater", "Teater"), ("Musikal/show", "Show"),
    ("Dans", "Dans"), ("Konsert", "Konsert"), ("Sport", "Sport"),
    ("Marknad", "Marknad"), ("Utställning", "Utställning"),
    ("Föreläsning", "Föreläsning"), ("Familj", "Familj"),
]
COLLECTOR_TAGS = ["Samlarkort", "Sportkort", "Retro & nostalgi", "Gaming", "Comic/anime", "Lego", "Leksaker"]
COLLECTOR_FAIR_WORDS = ["mässa", "festival", "show", "expo", "retromania", "samlarkortsfestival"]
CARD_GAME_WORDS = ["pokémon", "pokemon", "tcg", "magic", "yu-gi-oh", "lorcana", "one piece"]
GENERIC_TYPES = ["", "Evenemang", "Event", "Okänt", "Okategoriserat"]
GENERIC_CATEGORIES = ["", "Evenemang", "Okategoriserat"]

# --- Fixed values: frontier and recall segments ---------------------------
FRONTIER_SEGMENTS = {
    "Stora konserter": ["konsert", "arena", "festival"],
    "Lokal livemusik": ["live", "livemusik", "jazz", "rock", "pop", "musik"],
    "Teater & scenkonst": ["teater", "scenkonst", "föreställning", "dans", "musikal"],
    "Stand-up & humor": ["stand-up", "standup", "komedi", "humor"],
    "Museum & utställning": ["museum", "utställning", "konst", "vernissage", "openart"],
    "Familj & barn": ["familj", "barn", "lov", "kids"],
    "Publiksport": ["fotboll", "hockey", "innebandy", "match", "sport"],
    "Marknad & mässa": ["marknad", "mässa", "loppis", "expo"],
    "Mat & dryck": ["mat", "dryck", "vin", "öl", "gastronomi", "food"],
    "Samtal & föreläsning": ["föreläsning", "samtal", "seminarium", "litteratur", "författar"],
    "Workshop & deltagande": ["workshop", "verkstad", "prova på", "öppet hus", "kurs"],
    "Nattliv & klubb": ["klubb", "nightclub", "dj", "nattliv"],
    "Natur & utomhus": ["natur", "vandring", "friluft", "fåg", "outdoor"],
    "Säsong & högtid": ["jul", "påsk", "midsommar", "halloween", "advent", "nyår"],
    "Förening & lokalsamhälle": ["förening", "hembygd", "community", "bygdegård"],
    "Student & universitet": ["universitet", "student", "campus", "disputation", "docent", "forskning"],
}
FRONTIER_OTHER = "Övrigt / ännu ej klassificerat"
TRUSTED_SOURCES = [
    "City Örebro", "Lov Örebro", "Visit Örebro", "Visit Örebro – redaktionella eventlistor",
    "Conventum", "Örebro Konserthus", "Örebro Teater", "ÖSK Fotboll", "Örebro Hockey",
]
LOCAL_SOURCES = TRUSTED_SOURCES
RECALL_SEGMENTS = [
    ("Musik", ("konsert", "musik", "dans", "musikal")),
    ("Scen & teater", ("teater", "scen", "show", "stand up", "standup", "underhallning")),
    ("Sport", ("sport", "fotboll", "hockey", "innebandy", "match")),
    ("Familj", ("familj", "barn", "lov", "pyssel")),
    ("Mässa & marknad", ("massa", "marknad", "loppis")),
    ("Mat & dryck", ("mat", "dryck", "festival")),
    ("Förening & prova på", ("forening", "prova pa", "aktivitet")),
    ("Kultur & museum", ("museum", "utstallning", "kultur", "visning")),
]
RECALL_OTHER = "Övrigt"
UNKNOWN = "Okänd"

# --- Fixed values: sport scope --------------------------------------------
TEAM_SPORT_RE = (
    r"\b(?:fotboll(?:s\w+)?|soccer|football|futsal|ishockey|ice hockey|hockey|shl|hockeyallsvenskan|"
    r"basket(?:boll|ball)?|handboll|handball|volley(?:boll|ball)?|innebandy|floorball|bandy|"
    r"rugby|curling|baseboll|baseball|softboll|softball|cricket|vattenpolo|water polo|lacrosse|kabaddi|"
    r"counter[ -]strike|league of legends|dota 2)\b"
)
INDIVIDUAL_SPORT_RE = (
    r"\b(?:badminton\w*|bordtennis|table tennis|tennis|padel|golf|friidrott|athletics|"
    r"löpning|running|maraton|marathon|triathlon|triatlon|orientering|orienteering|"
    r"cykel(?:lopp|tävling)?|cycling|simning|swimming|skidor|skiing|"
    r"motorsport|rally|speedway|motocross|gokart|ridsport|dressyr|hästhoppning|"
    r"kampsport|boxing|boxning|judo|karate|taekwondo|brottning|gymnastik|gymnastics|"
    r"kajak\w*|kayak\w*|paddling|skridskor|skridskoåkning|konståkning|"
    r"yoga|pilates|fitness|vandring|hiking|klättring|climbing|fäktning|fencing)\b"
)
TEAM_LEAGUE_RE = r"\b(?:allsvenskan(?:s)?|superettan|elitettan)\b"
FIXTURE_TITLE_RE = r"\w\s*[-–]\s*\w"
SPORT_TYPES = ["sport", "sports", "sport & hälsa", "sports & wellbeing", "sports & well-being"]
CULTURE_TYPES = ["konsert", "teater", "show", "stand-up", "dans", "scen & film", "utställning", "föreläsning", "marknad", "mässa"]

# --- Fixed values: noise, titles, venues ----------------------------------
NOISE_TITLES = [
    "las mer", "läs mer", "read more", "mer info", "mer information",
    "boka", "boka nu", "boka biljett", "boka biljetter", "kop biljett",
    "köp biljett", "kop biljetter", "köp biljetter", "tickets", "biljetter",
    "event", "evenemangskalender", "kalender", "program",
    "till evenemanget", "visa evenemang", "se evenemang",
]
DATE_ONLY_RE = r"^(?:mon|tis|ons|tor|fre|lor|lör|son|sön)?\s*\d{1,2}(?:[./-]\d{1,2})?(?:[./-]\d{2,4})?(?:\s+[a-zåäö]{3,10})?$"
TIME_ONLY_RE = r"^(?:kl\.?\s*)?\d{1,2}[:.]\d{2}$"
GENERIC_TITLES = [
    "event", "evenemang", "aktivitet", "aktiviteter", "program", "kalender",
    "konsert", "match", "teater", "show", "festival", "mässa", "utställning",
    "workshop", "föreläsning", "familjeaktivitet", "sport",
]
GENERIC_VENUES = [
    "", "örebro", "orebro", "örebro län", "orebro lan", "conventum",
    "online", "digitalt", "digital", "se arrangörens sida", "plats ej angiven",
]

# --- Fixed values: duplicate and production matching ----------------------
ROOM_SUFFIXES = ["stora scenen", "lilla scenen", "foajen", "konsertsalen", "arena", "kongress"]
STAGED_WORDS = ["teater", "scen", "show", "musikal", "forestallning", "dans"]
MERGE_SCORE = 0.88
REVIEW_SCORE = 0.70
TITLE_FLOOR = 0.52
PRODUCTION_TITLE_FLOOR = 0.92
PRODUCTION_VENUE_FLOOR = 0.82
RECALL_TITLE_FLOOR = 0.78
NEAR_DUPLICATE_FLOOR = 0.84
PRICE_CONFLICT_NOTE = "Priskonflikt mellan källor: {} / {}"

# --- Fixed values: booking ------------------------------------------------
GENERIC_PATHS = ["", "/", "/sv", "/sv/", "/en", "/en/"]
BOOKING_HINTS = ["book", "boka", "booking", "reserve", "reservation", "checkout"]
TICKET_HINTS = ["ticket", "biljett", "tickets", "biljetter", "eventim", "ticketmaster"]
SCHEDULE_HINTS = ["time", "times", "tider", "schedule", "calendar", "kalender"]
PARTNERS = [
    ("ticketmaster", "Ticketmaster", ("ticketmaster.se", "ticketmaster.com")),
    ("tickster", "Tickster", ("tickster.com", "secure.tickster.com")),
    ("eventim", "Eventim", ("eventim.se", "eventim.com")),
    ("nortic", "Nortic", ("nortic.se",)),
    ("billetto", "Billetto", ("billetto.se", "billetto.com")),
]
STRONG_CTA = [("köp din biljett", "ticket"), ("köp biljetter", "ticket"), ("köp biljett", "ticket"),
              ("boka nu", "booking"), ("boka", "booking")]
MEDIUM_CTA = [("biljetter", "ticket")]
SOCIAL_HOSTS = [
    "facebook.com", "instagram.com", "linkedin.com", "tiktok.com",
    "youtube.com", "youtu.be", "x.com", "twitter.com", "threads.net",
]
TICKET_PATHS = ["/ticket", "/tickets", "/biljett", "/biljetter", "/boka", "/booking",
                "/checkout", "/purchase", "/event/", "/events/"]

# --- Fixed values: detail pages -------------------------------------------
SHOWTIME_BLOCKED = ["öppettid", "biljettkassa", "telefon", "telefontid", "kundservice", "reception"]
SHOWTIME_STRONG = ["pågår", "tider", "tid:", "tid ", "slut", "föreställning", "evenemang"]
KNOWN_ROOMS = {
    "CONVENTUM KONGRESS": "Conventum Kongress",
    "CONVENTUM ARENA": "Conventum Arena",
    "HJALMAR BERGMAN TEATERN": "Hjalmar Bergman Teatern",
}

# --- Fixed values: dates --------------------------------------------------
MONTHS_SV = ["januari", "februari", "mars", "april", "maj", "juni",
             "juli", "augusti", "september", "oktober", "november", "december"]
MONTHS_SV_SHORT = ["jan", "feb", "mar", "apr", "maj", "jun", "jul", "aug", "sep", "okt", "nov", "dec"]
WEEKDAYS_SV_SHORT = ["mån", "tis", "ons", "tors", "fre", "lör", "sön"]

# --- Fixed values: source health ------------------------------------------
SEASONAL_SOURCES = ["Lov Örebro"]
NON_ERROR_STATES = ["OK", "Pilot", "Delvis", "Säsongstom", "Ej konfigurerad", "TESTLÄGE"]
CORE_SOURCES = ["Conventum", "Örebro Teater", "City Örebro", "Tickster Örebro", "ÖSK Fotboll"]
LOCAL_TIP_SOURCES = ["City Örebro", "Lov Örebro"]
IMPORT_ERROR_TEXTS = {
    "timeout": "Tidsgränsen för källan överskreds.",
    "connection": "Källan kunde inte nås.",
    "http": "Källan svarade med ett HTTP-fel.",
    "json": "Källans svar kunde inte tolkas som förväntat.",
    "other": "Importen misslyckades. Kontrollera källans format och tillgänglighet.",
}
IMPORT_ERROR_CLASSES = {
    "Timeout": "timeout", "ConnectTimeout": "timeout", "ReadTimeout": "timeout",
    "ConnectionError": "connection", "HTTPError": "http", "JSONDecodeError": "json",
}

# --- Fixed values: engagement and conversions -----------------------------
ENGAGEMENT_ACTIONS = [
    "impression", "activity_open", "cta_click", "booking_outbound",
    "sponsored_impression", "sponsored_click", "ad_impression", "ad_click",
    "conversion_received", "conversion_confirmed",
]
CONVERSION_STATES = ["pending", "confirmed", "rejected", "refunded"]
CLICK_PREFIX = "upc_"
TOKEN_TTL_SECONDS = 1800
TOKEN_FUTURE_SKEW_SECONDS = 60
UNKNOWN_SOURCE = "Okänd källa"
UNKNOWN_TYPE = "Okänd typ"
UNKNOWN_PARTNER = "Okänd partner"

# --- Fixed values: visual themes (ordered, first hit wins) -----------------
THEMES = [
    ("music", "main_stage", ["konsert", "musik", "festival", "rock", "jazz", "pop", "live"]),
    ("sport", "arena", ["sport", "fotboll", "hockey", "match", "innebandy"]),
    ("family", "family_zone", ["familj", "barn", "lov", "kids"]),
    ("stage", "show_tent", ["teater", "scen", "show", "dans", "musikal", "föreställning"]),
    ("market", "night_market", ["marknad", "mässa", "expo", "loppis"]),
    ("food", "food_district", ["mat", "dryck", "vin", "öl", "food"]),
]
THEME_OTHER = ("other", "hidden_gems")

# --- Fixed values: source registry (key, name, kind, city, trust, enabled) --
SOURCES = [
    ("visitstockholm", "Visit Stockholm", "official_destination_api", None, "high", True),
    ("osk_bandy", "ÖSK Bandy", "official_club_ticketing", "Örebro", "high", True),
    ("orebro_badminton", "Örebro Badminton", "official_club_schedule", "Örebro", "high", False),
    ("orebro_konserthus", "Örebro Konserthus", "official_venue", "Örebro", "high", True),
    ("orebro_teater", "Örebro Teater", "official_venue", "Örebro", "high", True),
    ("city_orebro", "City Örebro", "official_local_city_calendar", "Örebro", "high", True),
    ("lov_orebro", "Lov Örebro", "official_municipal_activity_calendar", "Örebro", "high", True),
    ("osk_fotboll", "ÖSK Fotboll", "official_club_schedule", "Örebro", "high", True),
    ("orebro_hockey", "Örebro Hockey", "official_club_schedule", "Örebro", "high", True),
    ("kfum_orebro_basket", "KFUM Örebro Basket", "official_club_schedule", "Örebro", "high", True),
    ("kfum_orebro_volley", "KFUM Örebro Volley", "official_club_schedule", "Örebro", "high", True),
    ("osk_handboll_dam", "ÖSK Handboll Dam", "official_club_schedule", "Örebro", "high", True),
    ("osk_handboll_herr", "ÖSK Handboll Herr", "official_club_schedule", "Örebro", "high", True),
    ("kif_orebro", "KIF Örebro DFF", "official_club_schedule", "Örebro", "high", True),
    ("orebro_black_knights", "Örebro Black Knights", "official_club_schedule", "Örebro", "high", True),
    ("ibf_orebro", "IBF Örebro", "official_club_schedule", "Örebro", "high", True),
    ("kulturkvarteret", "Kulturkvarteret", "official_venue", "Örebro", "high", True),
    ("wadkoping", "Wadköping", "official_municipal_venue", "Örebro", "high", True),
    ("orebro_university", "Örebro universitet", "official_institution", "Örebro", "high", True),
    ("orebro_county_museum", "Örebro läns museum", "official_museum", "Örebro", "high", True),
    ("orebro_church", "Svenska kyrkan i Örebro", "official_community", "Örebro", "high", True),
    ("karlslund", "Karlslund", "official_municipal_destination", "Örebro", "high", True),
    ("makeriet", "Makeriet i Örebro", "official_venue", "Örebro", "high", True),
    ("tickster_orebro", "Tickster Örebro", "ticketing_city_listing", "Örebro", "high", True),
    ("visitorebro_editorial", "Visit Örebro – redaktionella eventlistor", "official_destination", "Örebro", "high", True),
    ("conventum", "Conventum", "official_venue", "Örebro", "high", True),
    ("showtic", "Showtic", "ticketing_calendar", None, "high", False),
    ("kortcentralen", "Kortcentralen", "specialist_calendar", None, "medium_high", False),
    ("tickster_collectors", "Tickster – samlare/retro", "ticketing_search", None, "high", False),
    ("ticketmaster", "Ticketmaster", "api", None, "high", True),
    ("visitsweden", "Visit Sweden", "api", None, "high", True),
    ("stockholmsmassan", "Stockholmsmässan", "official_venue", "Stockholm", "high", False),
    ("elmia", "Elmia", "official_venue", "Jönköping", "high", False),
    ("svenska_massan", "Svenska Mässan Gothia Towers", "official_venue", "Göteborg", "high", False),
    ("malmomassan", "Malmömässan", "official_venue", "Malmö", "high", False),
]
SOURCE_ALIASES = {
    "Visit Örebro": "visitorebro_editorial",
    "Conventum": "conventum",
    "Ticketmaster": "ticketmaster",
    "Visit Sweden": "visitsweden",
    "Showtic": "showtic",
    "Kortcentralen": "kortcentralen",
    "Tickster": "tickster_collectors",
}
TRUST_SCORES = {"high": 3, "medium_high": 2, "medium": 1, "low": 0}
DEFAULT_TRUST = 1

# --- Fixed values: city-API categories -------------------------------------
CITY_API_TYPES = {
    "exhibitions": "Utställning", "music": "Konsert", "sports": "Sport",
    "stage-film": "Scen & film", "guided-tours": "Guidning",
    "family": "Familj", "food-drink": "Mat & dryck", "markets": "Marknad",
}

# Words that say nothing about which event a title names.
FILLER_WORDS_RE = r"live|official|tickets?|biljetter|tour|202[0-9]"

# Wording of ticket-shop tiles, in the order in which it decides, with type and category.
TILE_BUCKET = "Lokalt"
TILE_WORDS = [
    (["middag", "vinprovning", "ölprovning", "matmarknad"], "Mat & dryck", "Mat & dryck"),
    (["ritz", "nattklubb", "klubbkväll", "dj ", "danskväll", "dansband"], "Nattliv", "Nattliv"),
    (["rockbar", "jazz", "konsert", "live", " late night jam", "jam "], "Konsert", "Musik"),
    (["dockteater"], "Teater", "Teater"),
]
