"""Word lists, code lists and patterns which define the results."""

from __future__ import annotations

# --- fixed values: whitespace ------------------------------------------------
# Every character that counts as whitespace.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ZERO_WIDTH = "\u200b\ufeff"

# --- fixed values: strings a CSV reader takes for a missing value --------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: column roles --------------------------------------------------
IDENTIFIERS = ("user_id", "course_id")
BIRTH_ALIASES = ("date of birth", "dob", "birthdate", "birth date", "year of birth", "yob", "ear of birth")
COUNTRY_ALIASES = ("cc_by_ip", "country_by_ip", "country", "region")
CITY_ALIASES = ("city",)
POSTAL_ALIASES = ("postal_code", "postalcode", "postal code", "zip", "zip_code")
EDUCATION_ALIASES = ("level of education", "loe", "education_level", "education level")
GENDER_ALIASES = ("gender",)
COUNTER_NAME_PARTS = (
    "nforum", "number of ", "events within the forum", "interactions", "posts", "comments",
    "views", "votes", "clicks", "plays", "nevents", "nplay",
)

# --- fixed values: generalization --------------------------------------------------
# Country codes put in the northern half. The list is rough and is kept as it is.
NORTH_COUNTRIES = tuple(
    """
    US CA MX GL GB IE FR DE ES IT NL BE LU PT SE NO DK FI IS
    PL CZ SK HU AT CH SI HR BA RS ME MK AL GR RO BG LT LV EE
    UA MD BY CN JP KR TW HK MO IN PK BD LK NP BT MV SG MY TH
    VN PH ID KH LA MM MN KZ UZ TM TJ KG AE SA IR IQ IL JO LB
    SY TR YE OM QA KW BH AM AZ GE ZA EG NG ET KE TZ DZ MA TN
    GH CI CM UG SD SN RW ZM ZW MW MZ AO NA BW GA GM GN GW LS
    LR LY ML MR NE SC SL SO SS TD TG BI BJ BF CD CG CV DJ ER
    GQ KM MG MU RE SH ST SZ AU NZ
    """.split()
)
COUNTRY_MISSING = ("", "NAN", "NONE", "UNKNOWN")
NORTH_CITY, SOUTH_CITY, UNKNOWN_CITY = "Tokyo", "São Paulo", "UnknownCity"
POSTAL_MISSING = ("", "nan", "none", "null", "na")
EDUCATION_MISSING = ("", "nan", "none", "null", "unknown")
LOW_EDUCATION, HIGH_EDUCATION = "≤Secondary", "Tertiary+"
LOW_EDUCATION_PARTS = ("less than", "primary", "elementary", "middle", "secondary", "high school", "hs")
HIGH_EDUCATION_PARTS = (
    "associate", "bachelor", "college", "undergrad", "master", "graduate", "professional",
    "doctor", "doctoral", "phd", "dphil", "md", "jd",
)
GENDER_MISSING = ("", "nan", "none", "null")
BIRTH_EARLY, BIRTH_LATE, BIRTH_SPLIT_YEAR = "pre-2000", "2000+", 2000
HIGH_COUNT_THRESHOLD = 1
COUNT_BINS = ((0, "0"), (5, "1-5"), (20, "6-20"), (None, "21+"))

# --- fixed values: text ---------------------------------------------------------------
LEGAL_TERMS = (
    "arbitration", "waiver", "indemnify", "indemnification", "liable", "liability",
    "jurisdiction", "venue", "assignment", "severability", "warranty", "limitation",
    "limitation of liability", "consent", "processing", "processor", "controller", "ccpa",
    "gdpr", "transfer", "retention", "opt-out", "opt in", "cookies", "beacons",
    "do not sell", "profiling", "biometric", "geolocation",
)
# English function words which can meet a token of three or more letters.
STOPWORDS = tuple(
    """
    about above after again against ain all and any are aren because been before being
    below between both but can couldn did didn does doesn doing don down during each few
    for from further had hadn has hasn have haven having her here hers herself him himself
    his how into isn its itself just mightn more most mustn myself needn nor not now off
    once only other our ours ourselves out over own same shan she should shouldn some such
    than that the their theirs them themselves then there these they this those through too
    under until very was wasn were weren what when where which while who whom why will with
    won wouldn you your yours yourself yourselves
    """.split()
)
RARE_ZIPF = 3.0
VOCABULARY_ZIPF = 1.5

# --- fixed values: pages ---------------------------------------------------------------
HTML_SKIP_ALL = ("script", "style", "noscript")
HTML_SKIP_CONTENT = ("script", "style", "noscript", "header", "footer", "nav", "form")
# Entity and its character; the ampersand comes last so that nothing is decoded twice.
HTML_ENTITIES = (
    ("&nbsp;", "\u00a0"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&hellip;", "…"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
)
# Two-label public suffixes; pass your own list for others.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.nz", "co.nz", "geek.nz", "govt.nz", "net.nz", "org.nz", "school.nz",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp",
    "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "ac.in", "co.in", "edu.in", "gov.in", "net.in", "org.in",
    "ac.kr", "co.kr", "go.kr", "or.kr", "ac.za", "co.za", "gov.za", "org.za",
    "com.ar", "com.hk", "com.mx", "com.my", "com.ph", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.vn", "co.id", "co.il", "co.ke", "co.th",
)

# --- fixed values: the fifteen features of a document -------------------------------------
FEATURES = (
    "n_words", "n_sents", "avg_sentence_length", "flesch_kincaid_grade", "gunning_fog",
    "smog_index", "dale_chall", "coleman_liau", "ari", "ttr", "yule_k", "entropy",
    "avg_zipf", "rare_frac", "legalese_frac",
)
