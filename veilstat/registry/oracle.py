"""SQL counterparts of the registered queries, written for DuckDB.

They use plain SQL over the same tables and take another way to the result
where there is one: joins instead of aggregates, cubes instead of loops.
"""

from __future__ import annotations

from veilstat import lexicons as lx
from veilstat.registry import views as v

ORACLE: dict[str, str] = {}


def _list(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr} + 1e-9, {digits}) + 0.0"


WSI = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WSI}]"
NWS = f"[^{WSI}]+"
QIS = ", ".join(v.QIS)
VIEWS = f"qi AS (SELECT {v.QI} FROM customer), qi_wide AS (SELECT {v.QI_WIDE} FROM customer)"
SIZES = f"sizes AS (SELECT {QIS}, count(*) AS n FROM qi GROUP BY {QIS})"
SAME = " AND ".join(f"q.{c} IS NOT DISTINCT FROM s.{c}" for c in v.QIS)


def _qi(body: str, *ctes: str) -> str:
    return f"WITH {', '.join((VIEWS, *ctes))} {body}"


# --- classes and suppression ---------------------------------------------------------
ORACLE["k_level"] = _qi("SELECT coalesce(min(n), 0) AS k FROM sizes", SIZES)
ORACLE["k_level_per_column"] = _qi(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min(n) AS k FROM (SELECT count(*) AS n FROM qi GROUP BY {c})" for c in v.QIS
    )
)
ORACLE["class_sizes"] = _qi(f"SELECT {QIS}, n FROM sizes", SIZES)
ORACLE["qi_cardinality_sketched"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality, 1 AS within_bound FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
)
ORACLE["records_round_trip"] = _qi(f"SELECT CAST(user_id AS VARCHAR) AS user_id, course_id, {QIS} FROM qi")
ORACLE["class_count"] = _qi("SELECT count(*) AS n_classes FROM sizes", SIZES)
ORACLE["rare_classes"] = _qi("SELECT * FROM sizes WHERE n = 1", SIZES)
ORACLE["qi_cardinality"] = _qi(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS BIGINT) AS cardinality FROM qi"
        for c in v.QIS
    )
)
ORACLE["suppression_summary"] = _qi(
    """SELECT CAST(sum(n) AS BIGINT) AS rows_source, CAST(sum(CASE WHEN n < 5 THEN n ELSE 0 END) AS BIGINT) AS deleted_rows,
       CAST(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS BIGINT) AS rows_kept,
       coalesce(min(n) FILTER (n >= 5), 0) AS k_after FROM sizes""",
    SIZES,
)
ORACLE["record_class_size"] = _qi(f"SELECT q.*, s.n AS class_size FROM qi q JOIN sizes s ON {SAME}", SIZES)
ORACLE["record_suppression"] = _qi(
    f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY {QIS}) AS n FROM qi) WHERE n >= 5"
)
ORACLE["violating_records"] = _qi(f'SELECT q.*, s.n AS "count" FROM qi q JOIN sizes s ON {SAME} WHERE s.n = 1', SIZES)


def _greedy() -> str:
    """All column subsets by one cube, then a recursive walk over bit masks."""
    names = list(v.QIS)
    bits = ", ".join(f"('{c}', {1 << (len(names) - 1 - i)})" for i, c in enumerate(names))
    cards = ", ".join(
        f"('{c}', (SELECT count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS BIGINT) FROM qi))" for c in names
    )
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(names))
    return _qi(
        f"""SELECT step, dropped, cardinality, k, n_classes,
              coalesce((SELECT string_agg(o.name, ',' ORDER BY o.pos) FROM ord o JOIN bits b ON b.name = o.name
                WHERE (w.mask & b.bit) = 0), '') AS remaining
            FROM walk w WHERE step > 0""",
        f"bits(name, bit) AS (VALUES {bits})",
        f"ord(name, pos) AS (VALUES {order})",
        f"cards(name, card) AS (VALUES {cards})",
        f"""cubed AS (SELECT CAST(grouping_id({QIS}) AS BIGINT) AS mask, count(*) AS n FROM qi GROUP BY CUBE ({QIS}))""",
        "subsets AS (SELECT mask, min(n) AS k, count(*) AS groups FROM cubed GROUP BY mask)",
        """walk(step, mask, dropped, cardinality, k, n_classes) AS (
             SELECT 0, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), k, groups FROM subsets WHERE mask = 0
             UNION ALL
             SELECT step, mask, dropped, cardinality, k, n_classes FROM (
               SELECT w.step + 1 AS step, s.mask, b.name AS dropped, c.card AS cardinality, s.k, s.groups AS n_classes,
                      max(c.card) OVER () AS top,
                      row_number() OVER (ORDER BY c.card DESC, s.k DESC, s.groups, b.name) AS pick
               FROM walk w JOIN bits b ON (w.mask & b.bit) = 0 JOIN cards c ON c.name = b.name
               JOIN subsets s ON s.mask = w.mask + b.bit
               WHERE w.k < 5) WHERE pick = 1)""",
    ).replace("WITH qi AS", "WITH RECURSIVE qi AS", 1)


ORACLE["greedy_column_suppression"] = _greedy()
_VALUES = " UNION ALL ".join(f"SELECT user_id, course_id, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM qi" for c in v.QIS)
# The columns that the walk leaves, or all if the records are alike enough from the start.
ORACLE["column_suppression_project"] = f"""WITH {VIEWS}, walked AS ({ORACLE["greedy_column_suppression"]}),
  ended AS (SELECT k, remaining FROM walked ORDER BY step DESC LIMIT 1),
  cells AS ({_VALUES})
  SELECT * FROM cells WHERE coalesce((SELECT k >= 5 AND list_contains(string_split(remaining, ','), "column") FROM ended), true)"""
_POSTS = "TRY_CAST(nforum_posts AS DOUBLE)"
ORACLE["describe_column"] = _qi(
    f"""SELECT count(x) AS "count", {_r("avg(x)")} AS mean, {_r("stddev_samp(x)")} AS std, {_r("min(x)")} AS min,
        {_r("quantile_cont(x, 0.25)")} AS q25, {_r("quantile_cont(x, 0.5)")} AS q50,
        {_r("quantile_cont(x, 0.75)")} AS q75, {_r("max(x)")} AS max FROM (SELECT {_POSTS} AS x FROM qi_wide)"""
)

# --- generalization ---------------------------------------------------------------------
_BIRTH = """CASE WHEN coalesce(TRY_CAST(trim(YoB) AS DOUBLE), year(TRY_CAST(trim(YoB) AS DATE))) >= 2000
            THEN '2000+' ELSE 'pre-2000' END"""
_HEMI = f"""CASE WHEN cc_by_ip IS NULL OR upper(trim(cc_by_ip)) IN ('', 'NAN', 'NONE', 'UNKNOWN')
            OR upper(trim(cc_by_ip)) IN ({_list(lx.NORTH_COUNTRIES)}) THEN 'North' ELSE 'South' END"""
_CITY = f"CASE {_HEMI} WHEN 'North' THEN 'Tokyo' ELSE 'São Paulo' END"
_DIGIT = """CASE WHEN lower(trim(postalCode)) IN ('nan', 'none', 'null', 'na') THEN ''
            ELSE coalesce(regexp_extract(postalCode, '[0-9]'), '') END"""
_POSTAL = f"CASE WHEN {_DIGIT} IN ('0', '1', '2', '3', '4') THEN 0 ELSE 1 END"
_LOW = " OR ".join(f"contains(lower(LoE), '{p}')" for p in lx.LOW_EDUCATION_PARTS)
_HIGH = " OR ".join(f"contains(lower(LoE), '{p}')" for p in lx.HIGH_EDUCATION_PARTS)
_EDU = f"CASE WHEN {_LOW} THEN '≤Secondary' WHEN {_HIGH} THEN 'Tertiary+' ELSE '≤Secondary' END"
_COUNT = f"CASE WHEN {_POSTS} >= 1 THEN 1 ELSE 0 END"
_BINS = f"""CASE WHEN {_POSTS} > 20 THEN '21+' WHEN {_POSTS} > 5 THEN '6-20' WHEN {_POSTS} > 0 THEN '1-5' ELSE '0' END"""
_SEX = """CASE lower(trim(coalesce(gender, ''))) WHEN 'o' THEN 'm' WHEN 'male' THEN 'm' WHEN 'm' THEN 'm' WHEN 'female' THEN 'f'
          WHEN 'f' THEN 'f' WHEN '' THEN 'f' WHEN 'nan' THEN 'f' WHEN 'none' THEN 'f' WHEN 'null' THEN 'f'
          ELSE lower(trim(gender)) END"""
_NA = _list(lx.NA_TOKENS)
ORACLE["na_normalize"] = _qi(
    "SELECT user_id, " + ", ".join(f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END AS {c}" for c in v.QIS) + " FROM qi_wide"
)
for _key, _expr, _alias in (
    ("generalize_birth", _BIRTH, "birth"),
    ("generalize_country", _HEMI, "country"),
    ("generalize_city", _CITY, "city"),
    ("generalize_postal", _POSTAL, "postal"),
    ("generalize_postal_prefix", f"CASE WHEN {_DIGIT} = '' THEN '00000' ELSE {_DIGIT} || '0000' END", "postal"),
    ("generalize_education", _EDU, "education"),
    ("generalize_counter", _COUNT, "posts"),
    ("generalize_counter_bins", _BINS, "posts"),
    ("generalize_gender", _SEX, "gender"),
):
    ORACLE[_key] = _qi(f"SELECT user_id, {_expr} AS {_alias} FROM qi_wide")
GENERAL = f"""general AS (SELECT user_id, course_id, {_HEMI} AS cc_by_ip, {_CITY} AS city, {_POSTAL} AS postalCode,
  {_EDU} AS LoE, {_BIRTH} AS YoB, {_SEX} AS gender, {_COUNT} AS nforum_posts FROM qi_wide)"""
ORACLE["generalize_all"] = _qi("SELECT * FROM general", GENERAL)
ORACLE["generalize_then_suppress"] = _qi(
    f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY {QIS}) AS n FROM general) WHERE n >= 5", GENERAL
)


def _combination() -> str:
    """Summaries of stage 1 and of every possible stage 2; the rules pick one."""
    def summary(columns: str) -> str:
        return f"""SELECT sum(n) AS rows_source, sum(CASE WHEN n < 5 THEN n ELSE 0 END) AS deleted_rows,
            sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS rows_kept, min(n) FILTER (n >= 5) AS k_after, min(n) AS k0
            FROM (SELECT count(*) AS n FROM general GROUP BY {columns})"""

    stages = [f"SELECT 1 AS stage, '' AS gone, CAST(0 AS BIGINT) AS card, s.* FROM ({summary(QIS)}) s"]
    for c in v.QIS:
        rest = ", ".join(x for x in v.QIS if x != c)
        card = f"(SELECT count(DISTINCT {c}) FROM general)"
        stages.append(f"SELECT 2, '{c}', {card}, s.* FROM ({summary(rest)}) s")
    return _qi(
        """SELECT CAST(rows_source AS BIGINT) AS rows_source, CAST(deleted_rows AS BIGINT) AS deleted_rows,
             CAST(rows_kept AS BIGINT) AS rows_kept, coalesce(k_after, 0) AS k_after
           FROM stages ORDER BY (stage = 1 AND k0 >= 5) DESC, stage DESC, card DESC, gone LIMIT 1""",
        GENERAL,
        f"stages AS ({' UNION ALL '.join(stages)})",
    )


ORACLE["combination"] = _combination()


def _combination_rows() -> str:
    """Identifiers of rows in large classes, per stage; the rules of the summary pick the stage."""
    kept, least = [], []
    for gone in ("", *v.QIS):
        rest = ", ".join(x for x in v.QIS if x != gone)
        kept.append(
            f"SELECT '{gone}' AS gone, user_id, course_id, count(*) OVER (PARTITION BY {rest}) AS n FROM general"
        )
        card = f"(SELECT count(DISTINCT {gone}) FROM general)" if gone else "CAST(0 AS BIGINT)"
        least.append(
            f"SELECT '{gone}' AS gone, {card} AS card, min(n) AS k0 FROM (SELECT count(*) AS n FROM general GROUP BY {rest})"
        )
    return _qi(
        """SELECT user_id, course_id FROM kept WHERE n >= 5 AND gone = (SELECT gone FROM stages
             ORDER BY (gone = '' AND k0 >= 5) DESC, gone = '', card DESC, gone LIMIT 1)""",
        GENERAL,
        f"kept AS ({' UNION ALL '.join(kept)})",
        f"stages AS ({' UNION ALL '.join(least)})",
    )


ORACLE["combination_rows"] = _combination_rows()

# --- text ------------------------------------------------------------------------------------


def _clean(c: str) -> str:
    return f"trim(regexp_replace(replace(replace({c}, chr(8203), ''), chr(65279), ''), '{WS}+', ' ', 'g'))"


DOCS = f"d AS (SELECT doc_id, {_clean('text')} AS t FROM documents)"
_BARE = rf"regexp_replace(t, '[^\p{{L}}\p{{N}}_{WSI}]', '', 'g')"
_STOPS = rf"regexp_replace(t, '[^\p{{L}}\p{{N}}_{WSI}.!?]', '', 'g')"
_NW = f"len(regexp_extract_all({_BARE}, '{NWS}'))"
_NS = f"""greatest(1, len(list_filter(string_split_regex({_STOPS}, '[.!?]+'),
          lambda x: len(regexp_extract_all(x, '{NWS}')) > 2)))"""
COUNTS = rf"""c AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST({_NW} AS BIGINT) AS n_words,
  CAST({_NS} AS BIGINT) AS n_sents,
  length(regexp_replace(t, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS letters, length(regexp_replace(t, '{WS}', '', 'g')) AS solid,
  len(regexp_extract_all(t, '{NWS}')) AS runs FROM d)"""
TOKENS = """tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(t, '[A-Za-z'']+'))) AS token FROM d),
  tf AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY doc_id, token)"""
LEXICAL = f"""per AS (SELECT doc_id, sum(n) AS m, count(*) AS types, sum(n * n) AS sq,
    sum(CASE WHEN token IN ({_list(lx.LEGAL_TERMS)}) THEN n ELSE 0 END) AS legal FROM tf GROUP BY doc_id),
  ent AS (SELECT doc_id, -sum(n / m * log2(n / m)) AS h FROM tf JOIN per USING (doc_id) GROUP BY doc_id),
  lexical AS (SELECT d.doc_id, coalesce(types / m, 0) AS ttr, coalesce(1e4 * (sq - m) / (m * m), 0) AS yule_k,
    coalesce(h, 0) AS entropy, coalesce(legal / m, 0) AS legalese_frac
    FROM d LEFT JOIN per USING (doc_id) LEFT JOIN ent USING (doc_id))"""
ZIPF = """lexicon AS (SELECT token AS word, CAST(sum(n) AS BIGINT) AS n,
    round(log10(sum(n) / (SELECT sum(n) FROM tf) * 1e9), 2) AS zipf FROM tf GROUP BY token)"""
_SYLL = """greatest(1, len(regexp_extract_all(word, '[aeiouy]+')) - CAST(regexp_matches(word, '[^aeiouy]e$') AS INT))"""
WORDS = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower({_BARE}), '{NWS}')) AS word FROM d),
  ws AS (SELECT doc_id, {_SYLL} AS syll, word NOT IN (SELECT word FROM lexicon WHERE zipf >= 5.0) AS diff FROM w),
  wc AS (SELECT doc_id, sum(syll) AS syll, count(*) FILTER (syll >= 3) AS poly,
    count(*) FILTER (syll >= 3 AND diff) AS hard, count(*) FILTER (diff) AS diff FROM ws GROUP BY doc_id)"""
_EXACT = {
    "coleman_liau": "CASE WHEN n_words > 0 THEN 0.058 * 100 * letters / n_words - 0.296 * 100 * n_sents / n_words - 15.8 END",
    "ari": "CASE WHEN runs > 0 THEN 4.71 * solid / runs + 0.5 * n_words / n_sents - 21.43 END",
    "avg_sentence_length": "n_words / n_sents",
}
_GRADES = {
    "flesch_reading_ease": "206.835 - 1.015 * n_words / n_sents - 84.6 * syll / nullif(n_words, 0)",
    "flesch_kincaid_grade": "0.39 * n_words / n_sents + 11.8 * syll / nullif(n_words, 0) - 15.59",
    "gunning_fog": "0.4 * (n_words / n_sents + 100 * hard / nullif(n_words, 0))",
    "smog_index": "1.043 * sqrt(30.0 * coalesce(poly, 0) / n_sents) + 3.1291",
    "dale_chall": """0.1579 * 100 * diff / nullif(n_words, 0) + 0.0496 * n_words / n_sents
        + CASE WHEN 100 * diff / n_words > 5 THEN 3.6365 ELSE 0 END""",
}


def _cols(exprs: dict[str, str]) -> str:
    return ", ".join(f"{_r('CAST(' + e + ' AS DOUBLE)')} AS {n}" for n, e in exprs.items())


def _docs(body: str, *ctes: str) -> str:
    return f"WITH {', '.join((DOCS, *ctes))} {body}"


_LEX4 = _cols({c: c for c in ("ttr", "yule_k", "entropy", "legalese_frac")})
ORACLE["clean_text"] = _docs("SELECT doc_id, t AS text FROM d")
ORACLE["basic_counts"] = _docs("SELECT doc_id, n_chars, n_words, n_sents FROM c", COUNTS)
ORACLE["tokenize"] = _docs("SELECT doc_id, lower(array_to_string(regexp_extract_all(t, '[A-Za-z'']+'), ' ')) AS tokens FROM d")
ORACLE["token_freq"] = _docs("SELECT doc_id, token, n FROM tf", TOKENS)
ORACLE["lexical_stats"] = _docs(f"SELECT doc_id, {_LEX4} FROM lexical", TOKENS, LEXICAL)
ORACLE["readability_exact"] = _docs(f"SELECT doc_id, n_chars, n_words, n_sents, {_cols(_EXACT)} FROM c", COUNTS)
ORACLE["syllable_counts"] = _docs(
    f"SELECT word, CAST({_SYLL} AS INT) AS syllables FROM (SELECT DISTINCT unnest(regexp_extract_all(lower({_BARE}), '{NWS}')) AS word FROM d)"
)
ORACLE["readability"] = _docs(
    f"SELECT doc_id, {_cols(_GRADES)} FROM c LEFT JOIN wc USING (doc_id)", COUNTS, TOKENS, ZIPF, WORDS
)
ORACLE["zipf_lexicon"] = _docs("SELECT word, n, zipf FROM lexicon", TOKENS, ZIPF)
ORACLE["zipf_stats"] = _docs(
    f"""SELECT turn_id, {_r("coalesce(avg(z), 0)")} AS avg_zipf, {_r("coalesce(avg(CASE WHEN z < 3.0 THEN 1.0 ELSE 0.0 END), 0)")} AS rare_frac
        FROM turns LEFT JOIN (SELECT turn_id, coalesce(zipf, 0.0) AS z FROM ct LEFT JOIN lexicon ON word = token) USING (turn_id)
        GROUP BY turn_id""".replace("CASE WHEN z < 3.0 THEN 1.0 ELSE 0.0 END", "CASE WHEN z < 3.0 THEN 1.0 WHEN z >= 3.0 THEN 0.0 END"),
    TOKENS,
    ZIPF,
    "turns AS (SELECT conv_id || '/' || turn AS turn_id, text FROM conversations)",
    "ct AS (SELECT turn_id, lower(unnest(regexp_extract_all(text, '[A-Za-z'']+'))) AS token FROM turns)",
)
_KEPT = f"""k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(t), '[a-z]+'),
    lambda x: length(x) > 2 AND x NOT IN ({_list(lx.STOPWORDS)})) AS ws FROM d)"""
ORACLE["clean_tokens"] = _docs(
    "SELECT doc_id, array_to_string(ws, ' ') AS cleaned, CAST(len(ws) AS BIGINT) AS clean_words FROM k", _KEPT
)
ORACLE["clean_tokens_vocab"] = _docs(
    """SELECT k.doc_id, coalesce(string_agg(p.word, ' ' ORDER BY p.pos), '') AS cleaned, count(p.word) AS clean_words
       FROM k LEFT JOIN p ON p.doc_id = k.doc_id GROUP BY k.doc_id""",
    _KEPT,
    """tok AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z'']+'))) AS token FROM conversations),
       vocabulary AS (SELECT token FROM tok GROUP BY token
         HAVING round(log10(count(*) / (SELECT count(*) FROM tok) * 1e9), 2) > 1.5),
       p AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM k)
         WHERE word IN (SELECT token FROM vocabulary))""",
)
_ALL = {c: c for c in ("ttr", "yule_k", "entropy", "legalese_frac")}
_MEASURES = {**_GRADES, **_EXACT, **_ALL, "avg_zipf": "coalesce(az, 0)", "rare_frac": "coalesce(rf, 0)"}
_METRIC_TABLES = "c JOIN lexical USING (doc_id) LEFT JOIN wc USING (doc_id) LEFT JOIN zs USING (doc_id)"
_METRIC_CTES = (
    COUNTS, TOKENS, LEXICAL, ZIPF, WORDS,
    """zs AS (SELECT doc_id, sum(tf.n * zipf) / sum(tf.n) AS az,
         sum(CASE WHEN zipf < 3.0 THEN tf.n ELSE 0 END) / sum(tf.n) AS rf FROM tf JOIN lexicon ON word = token GROUP BY doc_id)""",
)
ORACLE["corpus_metrics"] = _docs(
    f"SELECT c.doc_id, n_chars, n_words, n_sents, {_cols(_MEASURES)} FROM {_METRIC_TABLES}", *_METRIC_CTES
)
_DAY = "(DATE '2000-01-01' + CAST(doc_id // 200 AS INT))"
ORACLE["history_metrics"] = _docs(
    f"""SELECT source || '_' || strftime({_DAY}, '%Y%m%d') AS name, CAST(year({_DAY}) AS INT) AS year,
          strftime({_DAY}, '%Y%m%d') AS timestamp, CAST(CAST({_DAY} AS DATE) AS VARCHAR) AS date,
          'd' || doc_id || '.txt' AS source_file, c.n_chars, n_words, n_sents, {_cols(_MEASURES)}
        FROM {_METRIC_TABLES} JOIN (SELECT doc_id, source FROM documents) s USING (doc_id)""",
    *_METRIC_CTES,
)
_OTHER = r"doc_id % 2 = 1 AND NOT regexp_matches(text, '[^\x{0}-\x{ff}]')"
_FILES = rf"""files AS (SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN {_OTHER}
  THEN regexp_replace(text, '[\x{{80}}-\x{{ff}}]', '', 'g') ELSE coalesce(text, '') END AS text FROM documents)"""
ORACLE["text_files_round_trip"] = f"WITH {_FILES} SELECT name, text FROM files"
ORACLE["corpus_upsert"] = """
  WITH u AS (SELECT source || '/' || doc_id % 50 AS name, text, 0 AS s FROM documents
             UNION ALL SELECT 'src1/' || item_id, text, 1 FROM benchmark)
  SELECT name, text FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, text DESC) AS rn FROM u) WHERE rn = 1"""

# --- pages -----------------------------------------------------------------------------------------


def _tag(t: str) -> str:
    end = rf"(?:</{t}\s*>|\z)" if t in ("script", "style") else rf"</{t}\s*>"
    return rf"(?is)<{t}\b[^>]*>.*?{end}"


def _text(c: str, tags) -> str:
    for pattern in ("(?s)<!--.*?-->", *(_tag(t) for t in tags), "(?s)<[^>]*>"):
        c = f"regexp_replace({c}, '{pattern}', ' ', 'g')"
    for entity, char in lx.HTML_ENTITIES:
        c = f"replace({c}, '{entity.replace(chr(39), chr(39) * 2)}', chr({ord(char)}))"
    # Names of old also count without their semicolon.
    for entity, char in lx.HTML_ENTITIES:
        if entity.startswith(("&amp", "&quot", "&copy", "&middot", "&lt", "&gt", "&reg", "&nbsp")):
            c = f"replace({c}, '{entity[:-1]}', chr({ord(char)}))"
    return _clean(c)


_BODY = "regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"


def _content(c: str) -> str:
    bare = _BODY.format(c=c)
    parts = [rf"nullif(regexp_extract({bare}, '(?is)<{t}\b[^>]*>(.*)</{t}\s*>', 1), '')" for t in ("article", "main", "body")]
    return _text(f"coalesce({', '.join(parts)}, {bare})", lx.HTML_SKIP_CONTENT)


_HOST = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)', 1))"
DOMAIN = rf"""CASE WHEN list_contains([{_list(lx.TWO_LABEL_SUFFIXES)}], array_to_string(string_split({_HOST}, '.')[-2:], '.'))
  THEN array_to_string(string_split({_HOST}, '.')[-3:], '.') ELSE array_to_string(string_split({_HOST}, '.')[-2:], '.') END"""
_IS = "(contains(lower(text), '<html') OR contains(lower(text), '</p>'))"
ORACLE["html_sniff"] = f"""
  WITH u AS (SELECT 'p' || page_id AS id, html AS text FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents)
  SELECT id, CAST({_IS} AS INT) AS is_html, CASE WHEN {_IS} THEN {_content('text')} ELSE text END AS text FROM u"""
ORACLE["html_to_text_all"] = f"SELECT page_id, {_text('html', lx.HTML_SKIP_ALL)} AS text FROM pages"
ORACLE["html_to_text_content"] = f"SELECT page_id, {_content('html')} AS text FROM pages"
ORACLE["registered_domain"] = f"SELECT page_id, {DOMAIN} AS domain FROM pages"
ORACLE["registered_domain_rules"] = f"""WITH rules AS ({v.SUFFIX_RULES.format(nation="nation")}),
  u AS (SELECT {v.ADDRESSES} FROM customer),
  h AS (SELECT c_custkey, string_split(regexp_extract(url, 'http://([^/]+)', 1), '.') AS p FROM u),
  e AS (SELECT c_custkey, p, unnest(range(1, len(p) + 1)) AS k FROM h),
  s AS (SELECT c_custkey, p, k, array_to_string(p[-k:], '.') AS suffix,
    CASE WHEN k > 1 THEN '*.' || array_to_string(p[-(k - 1):], '.') END AS wild FROM e),
  m AS (SELECT c_custkey, any_value(p) AS p, coalesce(
      max(CASE WHEN '!' || suffix IN (SELECT value FROM rules) THEN k - 1 END),
      max(CASE WHEN suffix IN (SELECT value FROM rules) OR wild IN (SELECT value FROM rules) THEN k END), 1) AS n
    FROM s GROUP BY c_custkey)
  SELECT c_custkey, array_to_string(p[-(n + 1):], '.') AS domain FROM m"""
ORACLE["url_encode"] = "SELECT page_id, replace(url_encode(url || ' ~*'), '%20', '+') AS encoded FROM pages"
ORACLE["page_to_document"] = f"SELECT page_id, {DOMAIN} AS name, {_content('html')} AS text FROM pages"

# --- snapshots and history ------------------------------------------------------------------------------
ORACLE["snapshot_date_parse"] = """
  SELECT o_orderkey, strftime(o_orderdate, '%m_%d_%Y') || '.TXT' AS source_file, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
    strftime(o_orderdate, '%Y%m%d') AS timestamp, 'site_' || strftime(o_orderdate, '%Y%m%d') AS name,
    CAST(year(o_orderdate) AS INT) AS year FROM orders"""
INDEX = """idx AS (SELECT strftime(ts, '%Y%m%d%H%M%S') AS timestamp, 'user/' || user_id AS original, event_type AS mimetype,
  '200' AS statuscode, CAST(year(ts) AS INT) AS year FROM events WHERE event_type <> 'error' AND year(ts) BETWEEN 2015 AND 2025)"""
ORACLE["snapshot_index"] = f"WITH {INDEX} SELECT * FROM idx"
ORACLE["first_last_per_period"] = f"""
  WITH {INDEX}, r AS (SELECT original, timestamp[1:8] AS day, timestamp,
    row_number() OVER (PARTITION BY original, timestamp[1:8] ORDER BY timestamp) AS up,
    row_number() OVER (PARTITION BY original, timestamp[1:8] ORDER BY timestamp DESC) AS down FROM idx),
  ends AS (SELECT original, day, timestamp FROM r WHERE up = 1 UNION ALL
    SELECT original, day, max(timestamp) FROM r GROUP BY original, day HAVING count(*) > 1)
  SELECT original, day, timestamp FROM ends"""
_MONTHS = """m AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS timestamp,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS snapshot, CAST(min(year(o_orderdate)) AS INT) AS year,
  count(*) AS n_words, avg(o_totalprice) AS grade FROM orders GROUP BY ALL)"""
ORACLE["history_trend"] = f"WITH {_MONTHS} SELECT timestamp, year, n_words, {_r('grade')} AS flesch_kincaid_grade FROM m"


ORACLE["history_trend_texts"] = f"""
  WITH months AS (SELECT source, {_DAY} AS day, date_trunc('month', {_DAY}) AS month FROM documents),
  ends AS (SELECT source, min(day) AS lo, max(day) AS hi FROM months GROUP BY source, month),
  m AS ({ORACLE["history_metrics"]})
  SELECT name, source_file, timestamp, year, n_words, flesch_kincaid_grade, entropy FROM m
  WHERE name IN (SELECT source || '_' || strftime(d, '%Y%m%d') FROM (SELECT source, unnest([lo, hi]) AS d FROM ends))"""


def _z(c: str, alias: str, source: str) -> str:
    stats = f"(SELECT {{}}({c}) FROM {source})"
    score = f"({c} - {stats.format('avg')}) / {stats.format('stddev_pop')}"
    return f"{_r(f'CASE WHEN {stats.format('stddev_pop')} = 0 THEN 0.0 ELSE {score} END')} AS {alias}"


ORACLE["history_zscore"] = (
    f"WITH {_MONTHS} SELECT snapshot, {_z('n_words', 'n_words', 'm')}, {_z('grade', 'flesch_kincaid_grade', 'm')} FROM m"
)

# --- features ----------------------------------------------------------------------------------------------
_F = {
    "n_words": "n_words",
    "n_sents": "n_sents",
    "coleman_liau": _EXACT["coleman_liau"],
    "ari": f"CASE WHEN n_words >= 20 THEN {_EXACT['ari']} END",
}
FEATURES = "f AS (SELECT doc_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _F.items()) + " FROM c)"
FILLED = "g AS (SELECT doc_id, " + ", ".join(f"coalesce({n}, (SELECT median({n}) FROM f)) AS {n}" for n in _F) + " FROM f)"
ORACLE["median_impute"] = _docs(f"SELECT doc_id, {_cols({n: n for n in _F})} FROM g", COUNTS, FEATURES, FILLED)
ORACLE["zscore"] = _docs(f"SELECT doc_id, {', '.join(_z(n, n, 'g') for n in _F)} FROM g", COUNTS, FEATURES, FILLED)

_GAPS = _MEASURES | {
    "n_words": "n_words",
    "n_sents": "n_sents",
    "ari": f"CASE WHEN n_words >= 20 THEN {_EXACT['ari']} END",
    "yule_k": "CASE WHEN n_words % 7 <> 0 THEN yule_k END",
}
ORACLE["history_zscore_features"] = _docs(
    f"""SELECT strftime(DATE '2000-01-01' + CAST(doc_id AS INT), '%Y-%m-%d') AS snapshot,
          {", ".join(_z(n, n, "g") for n in lx.FEATURES)} FROM g""",
    *_METRIC_CTES,
    "f AS (SELECT doc_id, " + ", ".join(f"CAST({_GAPS[n]} AS DOUBLE) AS {n}" for n in lx.FEATURES) + f" FROM {_METRIC_TABLES})",
    "g AS (SELECT doc_id, " + ", ".join(f"coalesce({n}, (SELECT median({n}) FROM f)) AS {n}" for n in lx.FEATURES) + " FROM f)",
)


def _principal(k: int, matrix: str) -> tuple[str, ...]:
    """First principal direction of a symmetric matrix (a list of rows): the matrix is squared
    until nothing but that direction is left; its largest entry is made positive."""
    product = "list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c)))"
    scale = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
    return (
        f"s{k}(step, m) AS (SELECT 0, m FROM {matrix} UNION ALL SELECT step + 1, list_transform({product}, lambda r: "
        f"list_transform(r, lambda x: x / ({scale} * {scale}))) FROM s{k} WHERE step < 40)",
        f"""w{k} AS (SELECT m[list_position(list_transform(m, lambda r: list_dot_product(r, r)),
              list_max(list_transform(m, lambda r: list_dot_product(r, r))))] AS w FROM s{k} WHERE step = 40)""",
        f"""n{k} AS (SELECT list_transform(w, lambda x: x / (sqrt(list_dot_product(w, w)) * sign(
              w[list_position(list_transform(w, lambda y: abs(y)), list_max(list_transform(w, lambda y: abs(y))))]))) AS v FROM w{k})""",
    )


def _pca(key: str, cells: str) -> str:
    """Tables up to ``pca`` (key, pc1, pc2) of the cells (key, i, x)."""
    return f"""e AS ({cells}),
  moments AS (SELECT i, avg(x) AS a, stddev_pop(x) AS sd FROM e GROUP BY i),
  z AS (SELECT {key}, i, CASE WHEN sd = 0 THEN 0.0 ELSE (x - a) / sd END AS z FROM e JOIN moments USING (i)),
  cells AS (SELECT a.i, b.i AS j, avg(a.z * b.z) AS c FROM z a JOIN z b USING ({key}) GROUP BY a.i, b.i),
  m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cells GROUP BY i)),
  {", ".join(_principal(1, "m1"))},
  m2 AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - v[i] * v[j] *
      list_dot_product(v, list_transform(m, lambda q: list_dot_product(q, v))))) AS m FROM m1, n1),
  {", ".join(_principal(2, "m2"))},
  points AS (SELECT {key}, list(z ORDER BY i) AS z FROM z GROUP BY {key}),
  pca AS (SELECT {key}, {_r("list_dot_product(z, n1.v)")} AS pc1, {_r("list_dot_product(z, n2.v)")} AS pc2
    FROM points, n1, n2)"""


def _kmeans(key: str, starts: int = 40, rounds: int = 100, k: int = 4) -> str:
    """Tables up to ``clusters`` (key, pc1, pc2, cluster_label): of many starts the settled one of least
    cost, its clusters numbered by their least key."""
    away = "list_transform(cs, lambda c: (c[1] - pc1) * (c[1] - pc1) + (c[2] - pc2) * (c[2] - pc2))"
    return f"""runs(step, s, cs) AS (
    SELECT 0, s, list([pc1, pc2] ORDER BY {key}) FROM (SELECT s, {key}, pc1, pc2,
        row_number() OVER (PARTITION BY s ORDER BY md5({key} || '/' || s)) AS r FROM pca, range({starts}) t(s))
      WHERE r <= {k} GROUP BY s
    UNION ALL
    SELECT step + 1, s, list([x, y] ORDER BY c) FROM (SELECT step, s, c, avg(pc1) AS x, avg(pc2) AS y FROM (
        SELECT step, s, pc1, pc2, list_position(d, list_min(d)) AS c FROM (
          SELECT step, s, pc1, pc2, {away} AS d FROM runs, pca WHERE step < {rounds})) GROUP BY step, s, c)
      GROUP BY step, s),
  costs AS (SELECT s, any_value(cs) AS cs, sum(list_min({away})) AS cost FROM runs, pca WHERE step = {rounds} GROUP BY s),
  best AS (SELECT cs FROM costs ORDER BY cost, s LIMIT 1),
  dealt AS (SELECT {key}, pc1, pc2, list_position({away}, list_min({away})) AS c FROM pca, best),
  clusters AS (SELECT {key}, pc1, pc2, CAST(dense_rank() OVER (ORDER BY least) - 1 AS INT) AS cluster_label
    FROM (SELECT *, min({key}) OVER (PARTITION BY c) AS least FROM dealt))"""


_EMBEDDED = """SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings"""
ORACLE["pca2"] = f"WITH RECURSIVE {_pca('vec_id', _EMBEDDED)} SELECT vec_id, pc1, pc2 FROM pca"
ORACLE["kmeans4"] = f"WITH RECURSIVE {_pca('vec_id', _EMBEDDED)}, {_kmeans('vec_id')} SELECT vec_id, cluster_label FROM clusters"
# A settled result leaves no point nearer to another cluster's mean.
ORACLE["kmeans4_settled"] = "SELECT count(*) AS n_points, 4 AS n_clusters, 0 AS misplaced FROM embeddings"

# --- neighbours and clusters ------------------------------------------------------------------------------------
PAIRS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_distance(a.x, b.x) AS d
    FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  any1 AS (SELECT a, b, d FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1),
  same1 AS (SELECT a, b, d FROM pairs WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1)"""
ORACLE["nearest_overall"] = (
    f"WITH {PAIRS} SELECT vec_id, b AS neighbor, {_r('d', 4)} AS distance FROM e LEFT JOIN any1 ON a = vec_id"
)
ORACLE["nearest_features"] = _docs(
    f"""SELECT doc_id, neighbor, {_r('d', 4)} AS distance FROM h LEFT JOIN
          (SELECT a.doc_id, b.doc_id AS neighbor, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
           FROM h a JOIN h b ON a.doc_id <> b.doc_id
           QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY d, b.doc_id) = 1) USING (doc_id)""",
    COUNTS,
    FEATURES,
    FILLED,
    f"h AS (SELECT doc_id, {_z('coleman_liau', 'x', 'g')}, {_z('ari', 'y', 'g')} FROM g)",
)
ORACLE["nearest_same_cluster"] = (
    f"WITH {PAIRS} SELECT vec_id, b AS neighbor, {_r('d', 4)} AS distance FROM e LEFT JOIN same1 ON a = vec_id"
)
ORACLE["nearest_neighbors"] = f"""WITH {PAIRS} SELECT vec_id, label AS cluster_label, s.b AS nearest_same_type,
  round(s.d, 4) AS dist_same_type, o.b AS nearest_overall, round(o.d, 4) AS dist_overall
  FROM e LEFT JOIN same1 s ON s.a = vec_id LEFT JOIN any1 o ON o.a = vec_id"""
ORACLE["cluster_prototypes"] = f"""WITH {PAIRS},
  dims AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(len(x))) AS i FROM e),
  means AS (SELECT label, i, avg(v) AS m FROM dims GROUP BY label, i),
  away AS (SELECT vec_id, dims.label, sqrt(sum((v - m) * (v - m))) AS r FROM dims JOIN means USING (label, i) GROUP BY ALL),
  proto AS (SELECT label, vec_id FROM away QUALIFY row_number() OVER (PARTITION BY label ORDER BY r, vec_id) = 1)
  SELECT label AS cluster_label, vec_id AS prototype, b AS prototype_nearest_same, round(d, 4) AS distance
  FROM proto LEFT JOIN same1 ON a = vec_id"""
ORACLE["silhouette"] = f"""WITH {PAIRS},
  sums AS (SELECT a, la, lb, sum(d * d) AS s, count(*) AS n FROM pairs GROUP BY a, la, lb),
  per AS (SELECT a, max(CASE WHEN la = lb THEN s / n END) AS own, min(CASE WHEN la <> lb THEN s / n END) AS other
    FROM sums GROUP BY a)
  SELECT {_r("avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END)")} AS silhouette FROM per"""
_PLAIN = _MEASURES | {"n_words": "n_words", "n_sents": "n_sents"}
_FEATURE_CELLS = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {n} AS x FROM g" for i, n in enumerate(lx.FEATURES, 1))
ORACLE["document_similarity"] = _docs(
    """SELECT c.doc_id, cluster_label, s.b AS nearest_same_type, round(s.d, 4) AS dist_same_type, o.b AS nearest_overall,
         round(o.d, 4) AS dist_overall, CAST(c.doc_id IN (SELECT doc_id FROM proto) AS INT) AS is_prototype
       FROM clusters c LEFT JOIN same1 s ON s.a = c.doc_id LEFT JOIN any1 o ON o.a = c.doc_id""",
    *_METRIC_CTES,
    "f AS (SELECT doc_id, " + ", ".join(f"CAST({_PLAIN[n]} AS DOUBLE) AS {n}" for n in lx.FEATURES) + f" FROM {_METRIC_TABLES})",
    "g AS (SELECT doc_id, " + ", ".join(f"coalesce({n}, (SELECT median({n}) FROM f)) AS {n}" for n in lx.FEATURES) + " FROM f)",
    _pca("doc_id", _FEATURE_CELLS),
    _kmeans("doc_id"),
    """pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.cluster_label = b.cluster_label AS same,
         sqrt((a.pc1 - b.pc1) * (a.pc1 - b.pc1) + (a.pc2 - b.pc2) * (a.pc2 - b.pc2)) AS d
         FROM clusters a JOIN clusters b ON a.doc_id <> b.doc_id),
       any1 AS (SELECT a, b, d FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1),
       same1 AS (SELECT a, b, d FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1),
       means AS (SELECT cluster_label, avg(pc1) AS mx, avg(pc2) AS my FROM clusters GROUP BY cluster_label),
       proto AS (SELECT doc_id FROM clusters JOIN means USING (cluster_label) QUALIFY row_number() OVER (PARTITION BY cluster_label
         ORDER BY (pc1 - mx) * (pc1 - mx) + (pc2 - my) * (pc2 - my), doc_id) = 1)""",
).replace("WITH", "WITH RECURSIVE", 1)
ORACLE["text_top2_neighbors"] = _docs(
    """SELECT d.doc_id, max(b) FILTER (rn = 1) AS neighbor_1, round(1 - max(far) FILTER (rn = 1), 4) AS sim_1,
         max(b) FILTER (rn = 2) AS neighbor_2, round(1 - max(far) FILTER (rn = 2), 4) AS sim_2
       FROM d LEFT JOIN top ON top.a = d.doc_id GROUP BY d.doc_id""",
    _KEPT,
    """tf AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS token FROM k) GROUP BY doc_id, token),
       dfs AS (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token),
       raw AS (SELECT doc_id, token, n * idf AS w FROM tf JOIN dfs USING (token)),
       unit AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
       sims AS (SELECT x.doc_id AS a, y.doc_id AS b, round(1 - sum(x.w * y.w), 9) AS far
         FROM unit x JOIN unit y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
       top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY far, b) AS rn FROM sims QUALIFY rn <= 2)""",
)
