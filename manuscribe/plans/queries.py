"""Queries over the driver's tables, each with the same result in DuckDB's SQL where SQL can express it.

The documents lack most of what the rules look for, so many queries run on a
seeded text: one engine-neutral replacement in every m-th document, the same
expression in both engines. Word lists are small literal tables or made from
the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, paragraphs, tokens
from ..operators import chapters, grammar, lexical, phrases, runs, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def seed(m: int, *swaps: tuple[str, str]) -> str:
    """SQL of the seeded text; swaps are SQL expressions."""
    t = "text"
    for old, new in swaps:
        t = f"replace({t}, {old}, {new})"
    return f"CASE WHEN doc_id % {m} = 0 THEN {t} ELSE text END"


def _docs(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(text).alias("text"))


def _lines_sql(text: str = "text") -> str:
    return f"""p AS (SELECT doc_id, string_split({text}, chr(10)) AS ps FROM documents),
    l AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(ps) AS line, generate_subscripts(ps, 1) AS line_no, len(ps) AS n FROM p) WHERE NOT (line_no = n AND line = ''))"""


#: rule -> (seeded text, RE2 search)
SEEDED = {
    "double_space": (seed(3, ("'. '", "'.  '")), "  +"),
    "editing_marker": (seed(5, ("' the '", "' NOTE: '")), r"\[\[|<<|NOTE:"),
    "square_bracket": (seed(7, ("', '", "' [ '")), r"[\[\]]"),
    "split_year": (seed(4, ("' of '", "' 19 84 '")), rf"(^|{NOT_W})(19|20)\s{{1,2}}[0-9]{{2}}({NOT_W}|$)"),
    "spaced_hyphen": (seed(6, ("' and '", "' - '")), rf"{W}\s+-\s+{W}"),
    "em_dash_spacing": (seed(5, ("', '", "' — '")), r"\s—|—\s"),
    "bad_ellipsis": (seed(4, ("'. '", "'... '")), r"\.\.\.|\.…|…\.|…\s*…"),
    "title_period": (seed(6, ("' la '", "' Mr. '")), rf"(?i)(^|{NOT_W})({structure.TITLES})\."),
    "time_periods": (seed(3, ("' de '", "' 5 p.m.x '")), rf"(?i)(^|{NOT_W})\d{{1,2}}\s?(a\.m\.|p\.m\.){W}"),
    "amid": (seed(3, ("' that '", "' amid '")), rf"(?i)(^|{NOT_W})amid({NOT_W}|$)"),
    "non_british_date": (seed(3, ("' with '", "' 3/4/2020 '"), ("' la '", "' March 3rd, 1999 '"), ("' der '", "' Monday, May 4 '")), rf"(?i)(^|{NOT_W})((?:{structure.MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,?\s+(?:{structure.MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?)({NOT_W}|$)"),
    "contraction_quote": (seed(4, ("' on '", "'x‘Twas '")), rf"{W}‘(?:{structure.CONTRACTIONS})({NOT_W}|$)"),
}
SEEDED_INTENDED = {
    "time_periods": (seed(3, ("' de '", "' 5 p.m. '")), rf"(?i)(^|{NOT_W})\d{{1,2}}\s?(a\.m\.|p\.m\.)"),
    "contraction_quote": (seed(4, ("' on '", "' ‘Twas '")), rf"‘(?:{structure.CONTRACTIONS})({NOT_W}|$)"),
}


def _line_rule(name: str, rule: str, text: str, where: str, intended: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return structure.line_issues(lines(_docs(spark, sf_dir, text)), intended, {rule}).select("doc_id", "line_no", "line")

    run.__doc__ = f"Lines with {rule}."
    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_lines_sql(text)} SELECT doc_id, line_no, line FROM l WHERE {where}"


for _name, (_text, _re) in SEEDED.items():
    _line_rule(_name, _name, _text, f"regexp_matches(line, '{_re}')")
for _name, (_text, _re) in SEEDED_INTENDED.items():
    _line_rule(f"{_name}_intended", _name, _text, f"regexp_matches(line, '{_re}')", True)
_line_rule("en_dash", "en_dash", seed(3, ("' en '", "'é–'"), ("' the '", "' a–b '")), rf"len(list_filter(regexp_extract_all(line, '{W}+\s*–\s*{W}+'), lambda x: NOT regexp_matches(x, '^[0-9A-Za-z]+\s*–\s*[0-9A-Za-z]+$'))) > 0")
_line_rule("smart_single_open", "smart_single_open", seed(3, ("' in '", "' ‘in '"), ("' of '", "' of’ '")), f"regexp_extract(line, '([‘’])[^‘’]*$', 1) = '‘' AND NOT regexp_matches(line, '{SEEDED['contraction_quote'][1]}')")
_line_rule("straight_double_odd", "straight_double_odd", seed(3, ("' the '", "' \"the '")), "(length(line) - length(replace(line, '\"', ''))) % 2 = 1")
_line_rule(
    "straight_single_odd", "straight_single_odd", seed(3, ("' le '", "' '' '"), ("' the '", "' ''the '"), ("' and '", "' and'' '")),
    r"""len(list_filter(range(1, len(string_split(line, ''''))), lambda k: NOT (
        (regexp_matches(string_split(line, '''')[k], '[\p{L}\p{N}]$') AND ((k + 1 = len(string_split(line, '''')) AND string_split(line, '''')[k + 1] = '') OR regexp_matches(string_split(line, '''')[k + 1], '^[\p{L}\p{N}\s.,;:!?)\]}"”—–-]')))
        OR (regexp_matches(string_split(line, '''')[k + 1], '^[\p{L}\p{N}]') AND ((k = 1 AND string_split(line, '''')[k] = '') OR regexp_matches(string_split(line, '''')[k], '[\s(\[{"“”‘’-]$')))))) % 2 = 1""",
)
_line_rule(
    "multi_punct", "multi_punct", seed(4, ("'. '", "' !!! '"), ("', '", "'!!! '")),
    rf"""len(list_filter(range(1, len(string_split_regex(line, '!!!'))), lambda k: NOT regexp_matches(string_split_regex(line, '!!!')[k], '{W}$')
        AND length(regexp_replace(array_to_string(string_split_regex(line, '!!!')[1:k], ''), '[^“”"‘’'']', '', 'g')) % 2 = 0
        AND NOT regexp_matches(string_split_regex(line, '!!!')[k + 1], '^[”"’'']'))) > 0""",
)

_ELLIPSIS = seed(3, ("'. '", "'…'"), ("' the '", "' … '"), ("', '", "'…, '"), ("' of '", "'…,of '"), ("' and '", "' “… '"))


@_query(
    rf"""WITH {_lines_sql(_ELLIPSIS)}, x AS (SELECT doc_id, line_no, string_split(line, '…') AS s FROM l WHERE contains(line, '…')),
    e AS (SELECT doc_id, line_no, k, array_to_string(s[1:k], '…') AS b, array_to_string(s[k + 1:], '…') AS a FROM (SELECT *, unnest(range(1, len(s))) AS k FROM x)),
    f AS (SELECT doc_id, line_no, k, CASE
        WHEN regexp_matches(regexp_replace(b, '^\s+|\s+$', '', 'g'), '^[“”"''‘’]*$') OR regexp_matches(b, '(^|[.!?…,:;—–(\[{{-])\s*[“"‘'']\s*$') THEN CASE WHEN a[1] = ' ' THEN 'start_space' END
        WHEN regexp_matches(b, '\s$') THEN 'space_before' WHEN a = '' OR a[1] = ' ' THEN NULL
        WHEN a[1] = ',' THEN CASE WHEN a[2] = ' ' OR regexp_matches(a, '^,[”’"''] ') THEN NULL ELSE 'comma_after' END
        WHEN regexp_matches(a, '^[’”")\]}}!?—–:;]') THEN NULL ELSE 'no_space_after' END AS fault FROM e)
    SELECT doc_id, line_no, arg_min(fault, k) AS fault FROM f WHERE fault IS NOT NULL GROUP BY doc_id, line_no"""
)
def ellipsis_spacing(spark, sf_dir):
    """The first fault of each line's ellipses."""
    d = structure.line_issues(lines(_docs(spark, sf_dir, _ELLIPSIS)), only={"ellipsis"})
    return d.select("doc_id", "line_no", F.regexp_replace("type", "^ellipsis_", "").alias("fault"))


@_query(
    rf"""WITH {_lines_sql()}, t AS (SELECT doc_id, line_no, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{W}+|{NOT_W}+') AS s FROM l)),
    w AS (SELECT doc_id, line_no, i, lower(x) AS x, lag(x) OVER o AS sep, lower(lag(x, 2) OVER o) AS was FROM t WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
    r AS (SELECT *, sum(CASE WHEN was = x AND regexp_matches(sep, '^\s+$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS run FROM w WHERE regexp_matches(x, '^{W}')),
    g AS (SELECT doc_id, line_no, x, run, count(*) // 2 AS n FROM r GROUP BY ALL)
    SELECT doc_id, line_no, x AS word, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL HAVING sum(n) > 0"""
)
def repeated_word(spark, sf_dir):
    """Words said twice in a row."""
    return structure.repeated_words(lines(_docs(spark, sf_dir))).groupBy("doc_id", "line_no", F.lower("word").alias("word")).agg(F.count("*").alias("n"))


_COMMA = seed(2, ("concat('.', chr(10))", "concat(',', chr(10))"))


@_query(
    rf"""WITH {_lines_sql(_COMMA)}, m AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM l WHERE regexp_matches(line, '\S'))
    SELECT doc_id, line_no, line FROM m WHERE regexp_matches(line, '.+,\s*$') AND NOT coalesce(regexp_matches(nxt, '^[\s\p{{Cf}}]*[“"‘'']') OR regexp_matches(nxt, '(?i)^[\s\p{{Cf}}]*(and|but|so|or|then|yet)({NOT_W}|$)'), false)"""
)
def line_end_comma(spark, sf_dir):
    """Lines that end in a comma and are not carried on."""
    return structure.line_end_comma(lines(_docs(spark, sf_dir, _COMMA))).select("doc_id", "line_no", "line")


_PARAS = seed(3, ("concat('.', chr(10))", "concat(chr(10), chr(10))"), ("', '", "concat(chr(10), '”)', chr(10), chr(10))"))


@_query(
    rf"""WITH {_lines_sql(_PARAS)}, q AS (SELECT *, sum(CASE WHEN regexp_matches(line, '\S') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM l),
    g AS (SELECT doc_id, para, sum(len(regexp_extract_all(line, '[A-Za-z0-9]+(?:[’''][A-Za-z0-9]+)?'))) AS n, max(line_no) AS line_no, arg_max(line, line_no) AS line FROM q WHERE regexp_matches(line, '\S') GROUP BY doc_id, para)
    SELECT doc_id, line_no, line FROM g WHERE n >= 10 AND regexp_replace(line, '[\s”’"'')\]}}]+$', '') <> '' AND NOT regexp_matches(regexp_replace(line, '[\s”’"'')\]}}]+$', ''), '[.!?…,:;—–-]$')"""
)
def paragraph_no_terminal(spark, sf_dir):
    """Paragraphs that end without terminal punctuation."""
    return structure.paragraph_no_terminal(lines(_docs(spark, sf_dir, _PARAS))).select("doc_id", "line_no", "line")


_QUOTES = seed(3, ("'. '", "'.” '"), ("concat('.', chr(10))", "concat('. “x', chr(10), chr(10))"), ("' the '", "' “the” '"))


@_query(
    rf"""WITH {_lines_sql(_QUOTES)}, c AS (SELECT doc_id, line_no, unnest(m) AS q, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[“”]') AS m FROM l)),
    s AS (SELECT *, lag(q) OVER (PARTITION BY doc_id ORDER BY line_no, i) AS was FROM c),
    st AS (SELECT l.*, NOT regexp_matches(line, '\S') AS blank, regexp_extract(line, '([“”])[^“”]*$', 1) AS last FROM l),
    sx AS (SELECT *, last_value(nullif(last, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS begins, max(line_no) OVER (PARTITION BY doc_id) AS final FROM st)
    SELECT 'stray_closing_quote' AS type, doc_id, line_no, count(*) AS n FROM s WHERE q = '”' AND (was IS NULL OR was = '”') GROUP BY ALL
    UNION ALL SELECT 'continued_without_quote', doc_id, line_no, 1 FROM sx WHERE begins AND NOT blank AND state = '“' AND NOT regexp_matches(line, '^[\s\p{{Cf}}]*[“"‘'']')
    UNION ALL SELECT 'open_at_end', doc_id, CASE WHEN blank THEN 1 ELSE line_no END, 1 FROM sx WHERE line_no = final AND coalesce(nullif(last, ''), state) = '“'"""
)
def quote_state(spark, sf_dir):
    """Faults of smart double quotes across lines."""
    return structure.quote_state(lines(_docs(spark, sf_dir, _QUOTES))).groupBy("type", "doc_id", "line_no").agg(F.count("*").alias("n"))


_MIXED = seed(3, ("'. '", "'.  '"), ("' that '", "' amid '"), ("', '", "' [ '"), ("' la '", "' Mr. '"))
_COUNTED = ("double_space", "amid", "square_bracket", "title_period")


@_query("WITH " + _lines_sql(_MIXED) + " " + " UNION ALL ".join(f"SELECT '{n}' AS type, count(*) AS n FROM l WHERE regexp_matches(line, '{SEEDED[n][1]}') HAVING count(*) > 0" for n in _COUNTED))
def structure_issue_counts(spark, sf_dir):
    """Issues per type."""
    return runs.issue_counts(structure.check(_docs(spark, sf_dir, _MIXED)).filter(F.col("type").isin(*_COUNTED)))


@_query(f"WITH {_lines_sql()} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY doc_id")
def line_inventory(spark, sf_dir):
    """Lines and characters per document."""
    return lines(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@_query(rf"""WITH s AS (SELECT doc_id, string_split_regex({_PARAS}, '\n\s*\n') AS x FROM documents), u AS (SELECT doc_id, unnest(list_filter(list_transform(x, lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '')) AS y FROM s)
    SELECT doc_id, count(*) AS n_paragraphs, max(length(y)) AS longest FROM u GROUP BY doc_id""")
def paragraph_inventory(spark, sf_dir):
    """Paragraphs per document and the longest."""
    return paragraphs(_docs(spark, sf_dir, _PARAS)).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("paragraph")).cast("long").alias("longest"))


CRUTCH = {"the": 300.0, "and": 250.0, "that": 100.0, "with": 20.0, "like": 80.0}
_CRUTCH_SQL = ", ".join(f"('{w}', CAST({g} AS DOUBLE))" for w, g in CRUTCH.items())
_TOKENS_SQL = rf"t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{W}+')) AS token FROM documents)"


@_query(rf"""WITH r(word, guideline) AS (VALUES {_CRUTCH_SQL}), {_TOKENS_SQL}, c AS (SELECT lower(token) AS word, count(*) AS n FROM t GROUP BY 1),
    w AS (SELECT CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS total_words FROM documents)
    SELECT word, coalesce(n, 0) AS n, total_words, coalesce(n, 0) * 10000.0::DOUBLE / total_words AS per_10k, guideline, coalesce(n, 0) * 10000.0::DOUBLE / total_words > guideline AS above FROM r LEFT JOIN c USING (word), w""")
def crutch_overview(spark, sf_dir):
    """Crutch words per 10,000 words against guidelines."""
    return lexical.crutch_overview(_docs(spark, sf_dir), lexical.table(spark, list(CRUTCH.items()), ("word", "guideline")))


@_query(rf"""SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, len(list_filter(regexp_extract_all(lower(text), '{W}+'), lambda x: x = 'the')) AS n,
    len(list_filter(regexp_extract_all(lower(text), '{W}+'), lambda x: x = 'the')) * 1000.0::DOUBLE / nullif(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')), 0) AS per_1k FROM documents""")
def like_rate_by_doc(spark, sf_dir):
    """A word's rate per 1,000 words in each document."""
    return lexical.word_rate(_docs(spark, sf_dir), "the")


_HOUSE = seed(3, ("' the '", "' color '"), ("' and '", "' Gray '"), ("' la '", "' WHISKEY '"))
_HOUSE_SQL = ", ".join(f"('{a}', '{b}')" for a, b in lexical.HOUSE_SPELLING.items())


@_query(rf"""WITH r(wrong, preferred) AS (VALUES {_HOUSE_SQL}), t AS (SELECT doc_id, unnest(regexp_extract_all({_HOUSE}, '{W}+')) AS token FROM documents)
    SELECT doc_id, token, CASE WHEN token = upper(token) THEN upper(preferred) WHEN token[1] = upper(token[1]) THEN upper(preferred[1]) || lower(preferred[2:]) ELSE preferred END AS suggestion, count(*) AS n
    FROM t JOIN r ON lower(token) = wrong GROUP BY ALL""")
def house_spelling(spark, sf_dir):
    """Words that the house spells otherwise."""
    return lexical.house_spelling(_docs(spark, sf_dir, _HOUSE))


_SPELL_SQL = rf"""st AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?s)\[.*?\]', '', 'g'), '{W}(?:[\p{{L}}\p{{N}}_''-]*{W})?')) AS token FROM documents),
    sp AS (SELECT * FROM st WHERE NOT regexp_matches(token, '^[0-9.,%]+$') AND NOT (token = upper(token) AND token <> lower(token)))"""


def _lexicon(docs: DataFrame, k: int) -> DataFrame:
    t = tokens(docs, "text", "doc_id").groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"))
    return t.filter(F.col("d") >= k).select("word", "n")


def _lex_sql(k: int) -> str:
    return f"a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS token FROM documents), lx AS (SELECT lower(token) AS word, count(*) AS n FROM a GROUP BY 1 HAVING count(DISTINCT doc_id) >= {k})"


_FLAG = [("the", "THE"), ("erin", "urine"), ("of the", "off the"), ("and", "&")]


@_query(f"WITH {_SPELL_SQL}, r(w, s) AS (VALUES ('the', 'THE'), ('erin', 'urine'), ('of the', 'off the'), ('and', '&')) SELECT doc_id, token, s AS suggestion, count(*) AS n FROM sp JOIN r ON lower(token) = w WHERE w <> 'and' GROUP BY ALL")
def flag_words(spark, sf_dir):
    """Words flagged by a mapping, but those that an upper-case entry allows."""
    allowed = lexical.table(spark, [("AND",), ("of",)], ("word",))
    return lexical.flag_words(_docs(spark, sf_dir), lexical.table(spark, _FLAG, ("wrong_lower", "right")), allowed)


_BASE = "CASE WHEN token_lower LIKE '%''s' THEN token_lower[:-3] WHEN token_lower LIKE '%s' AND length(token_lower) > 3 THEN token_lower[:-2] ELSE token_lower END"
_UNKNOWN_SQL = f"u0 AS (SELECT lower(token) AS token_lower, count(*) AS n, count(DISTINCT doc_id) AS docs FROM sp GROUP BY 1), u AS (SELECT token_lower, n, docs FROM u0 WHERE token_lower NOT IN (SELECT word FROM lx) AND {_BASE} NOT IN (SELECT word FROM lx))"


@_query(f"WITH {_SPELL_SQL}, {_lex_sql(3)}, {_UNKNOWN_SQL} SELECT * FROM u")
def spell_unknown(spark, sf_dir):
    """Words that fewer than three documents know."""
    d = _docs(spark, sf_dir)
    return lexical.unknown_words(d, _lexicon(d, 3))


@_query(f"""WITH {_SPELL_SQL}, {_lex_sql(3)}, {_UNKNOWN_SQL}, c AS (SELECT token_lower, word, n, levenshtein(plain, word) AS distance FROM (SELECT token_lower, regexp_replace(token_lower, '[^\\x00-\\x7F]', '#', 'g') AS plain FROM u) JOIN lx ON token_lower[:1] = word[:1] AND abs(length(word) - length(token_lower)) <= 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY token_lower ORDER BY distance, n DESC, word) AS k FROM c WHERE distance BETWEEN 1 AND 2)
    SELECT token_lower, word AS suggestion, CAST(distance AS INTEGER) AS distance FROM b WHERE k = 1""")
def spell_suggest(spark, sf_dir):
    """The nearest known word of unknown ones, at most two edits away."""
    d = _docs(spark, sf_dir)
    lex = _lexicon(d, 3)
    return lexical.suggestions(lexical.unknown_words(d, lex), lex)


_KEEP_SQL = ", ".join(f"'{w}'" for w in lexical.KEEP_WORDS)
_LR_SQL = rf"""WITH {_lex_sql(2).replace(" AS (", " AS MATERIALIZED (")}, c AS MATERIALIZED (SELECT doc_id, lower(token) AS token_lower, count(*) AS n FROM a WHERE length(token) >= 4 AND NOT regexp_matches(token, '^[A-Z][a-z]+$') AND NOT regexp_matches(lower(token), '^[lr]') AND lower(token) NOT IN ({_KEEP_SQL}) GROUP BY 1, 2),
    w AS MATERIALIZED (SELECT DISTINCT token_lower FROM c WHERE token_lower NOT IN (SELECT word FROM lx)),
    m AS (SELECT token_lower, s, unnest(range(1, len(s))) AS k FROM (SELECT token_lower, string_split(regexp_replace(token_lower, '([aeiouy][bcdfghjkmnpqtvwxz][lr][aeiouy])', '#\1', 'g'), '#') AS s FROM w)),
    i AS (SELECT token_lower, length(array_to_string(s[1:k], '')) + 3 AS i FROM m),
    x AS (SELECT token_lower, i, token_lower[:i - 1] || CASE WHEN token_lower[i] = 'l' THEN 'r' ELSE 'l' END || token_lower[i + 1:] AS sw FROM i),
    f AS MATERIALIZED (SELECT token_lower, arg_min(sw, i) AS suggestion FROM x WHERE sw IN (SELECT word FROM lx) GROUP BY 1)"""


@_query(_LR_SQL + " SELECT doc_id, token_lower, suggestion, CAST(n AS BIGINT) AS n FROM c JOIN f USING (token_lower)")
def lr_confusion(spark, sf_dir):
    """Unknown words that a swap of l and r makes known."""
    d = _docs(spark, sf_dir)
    return lexical.lr_swaps(d, _lexicon(d, 2))


@_query(_LR_SQL + " SELECT token_lower, suggestion, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM c JOIN f USING (token_lower) GROUP BY ALL")
def lr_by_word(spark, sf_dir):
    """The same per word."""
    return lr_confusion(spark, sf_dir).groupBy("token_lower", "suggestion").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


_CAPS_SQL = "cap AS (SELECT lower(token) AS token_lower, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS token FROM documents) WHERE regexp_matches(token, '^[A-Z]') AND length(token) >= 3 GROUP BY 1)"


@_query(f"WITH {_CAPS_SQL} SELECT * FROM cap")
def capitalised_tokens(spark, sf_dir):
    """Capitalised words and their counts."""
    return lexical.capitalised(_docs(spark, sf_dir))


@_query(f"WITH {_CAPS_SQL}, {_lex_sql(3)} SELECT * FROM cap WHERE token_lower NOT IN (SELECT word FROM lx)")
def name_candidates(spark, sf_dir):
    """Capitalised words that the lexicon lacks."""
    d = _docs(spark, sf_dir)
    lex = _lexicon(d, 3).select(F.col("word").alias("token_lower"))
    return lexical.capitalised(d).join(lex, "token_lower", "left_anti")


# a longest common subsequence grows row by row: of each pair's row, the best of all places so far
_DRIFT_SQL = f"""WITH RECURSIVE {_CAPS_SQL}, p AS MATERIALIZED (SELECT c.token_lower AS canonical, v.token_lower AS variant, c.n AS canonical_n, v.n AS variant_n FROM cap c JOIN cap v ON c.n >= 3 AND v.n <= 2 AND c.token_lower[1] = v.token_lower[1]
        AND least(length(c.token_lower), length(v.token_lower)) * 200 >= (length(c.token_lower) + length(v.token_lower)) * 90 AND levenshtein(c.token_lower, v.token_lower) * 10 <= length(c.token_lower) + length(v.token_lower)),
    r AS (SELECT canonical, variant, 0 AS i, list_transform(range(0, length(variant) + 1), lambda x: 0::BIGINT) AS best FROM p
        UNION ALL SELECT canonical, variant, i + 1, list_prepend(0::BIGINT, list_transform(range(1, length(variant) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(best[k + 1], best[k] + CASE WHEN canonical[i + 1] = variant[k] THEN 1 ELSE 0 END))))) FROM r WHERE i < length(canonical)),
    drift AS (SELECT p.*, 200.0::DOUBLE * best[-1] / (length(canonical) + length(variant)) AS score FROM p JOIN r USING (canonical, variant) WHERE i = length(canonical) AND 200 * best[-1] >= 90 * (length(canonical) + length(variant)))"""


@_query(f"{_DRIFT_SQL} SELECT canonical, variant, canonical_n, variant_n, score FROM drift")
def name_drift(spark, sf_dir):
    """Rare names close to common ones."""
    return lexical.name_drift(lexical.capitalised(_docs(spark, sf_dir)))


@_query(f"{_DRIFT_SQL} SELECT canonical, canonical_n, string_agg(variant || ':' || variant_n, ',' ORDER BY variant_n DESC, score DESC, variant) AS variants FROM drift GROUP BY ALL")
def drift_groups(spark, sf_dir):
    """The variants of each common name, most frequent and closest first."""
    g = lexical.drift_groups(name_drift(spark, sf_dir))
    return g.select("canonical", "canonical_n", F.array_join(F.transform("variants", lambda x: F.concat_ws(":", x["variant"], x["variant_n"].cast("string"))), ",").alias("variants"))


_COMPOUND = seed(3, ("' of the '", "' of-the '"), ("' it was '", "' itwas '"))


def _phrase_sql(text: str, pairs: list[tuple[str, str]]) -> str:
    """Counts by (family, phrase): separators doubled, so that neighbours can share one."""
    d = rf"d AS (SELECT ' ' || regexp_replace(lower({text}), '(\s)', '\1\1', 'g') || ' ' AS t FROM documents)"
    each = [rf"SELECT '{a}' AS family, '{p}' AS phrase, CAST(sum(len(regexp_extract_all(t, '{NOT_W}{p.replace(' ', '  ')}{NOT_W}'))) AS BIGINT) AS n FROM d" for a, p in pairs]
    return d + ", h AS (" + " UNION ALL ".join(each) + ")"


@_query(f"WITH {_phrase_sql(_COMPOUND, [('of the', 'of the'), ('of the', 'of-the'), ('it was', 'it was'), ('it was', 'itwas')])} SELECT v.family, p.n AS preferred_n, v.phrase AS variant, v.n AS variant_n FROM h v JOIN h p ON v.family = p.family AND p.phrase = p.family WHERE v.phrase <> v.family AND v.n > 0")
def compound_counts(spark, sf_dir):
    """Variants of compounds in use."""
    fams = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("family"), F.array(F.lit(b)).alias("alts")) for a, b in (("of the", "of-the"), ("it was", "itwas"), ("unused", "un-used"))])))
    return lexical.compound_counts(_docs(spark, sf_dir, _COMPOUND), fams)


_CLICHES = ["of the", "and the", "to be the", "on the on"]


@_query(f"WITH {_phrase_sql('text', [(c, c) for c in _CLICHES])} SELECT phrase, n FROM h WHERE n > 0")
def cliche_counts(spark, sf_dir):
    """Set phrases and their counts."""
    return lexical.phrase_hits(_docs(spark, sf_dir), lexical.table(spark, [(c,) for c in _CLICHES], ("phrase",))).groupBy("phrase").agg(F.sum("n").alias("n"))


_SIMILE = seed(2, ("' as '", "' like a '"), ("' de '", "' like the '"))


@_query(rf"""WITH s AS (SELECT doc_id AS chapter, unnest(regexp_extract_all(lower({_SIMILE}), '{NOT_W}like\s+((?:a|an|the|some)\s+\p{{L}}+)', 1)) AS x FROM documents),
    n AS (SELECT chapter, regexp_replace(x, '^(a|an|the|some)\s+', '') AS x FROM s),
    q AS (SELECT chapter, 'like ' || CASE WHEN regexp_matches(x, '[^s][^s][^s]s$') THEN x[:-2] ELSE x END AS phrase FROM n),
    g AS (SELECT phrase, chapter - lag(chapter) OVER (PARTITION BY phrase ORDER BY chapter) AS gap FROM (SELECT DISTINCT * FROM q))
    SELECT phrase, (SELECT count(*) FROM q WHERE q.phrase = g.phrase) AS n, min(gap) AS least_gap FROM g GROUP BY phrase HAVING min(gap) < 8""")
def simile_repeats(spark, sf_dir):
    """Similes that come back within eight chapters."""
    return lexical.simile_repeats(lexical.similes(_docs(spark, sf_dir, _SIMILE)))


_LEMMAS = seed(5, ("' the '", "' smiled '"), ("' and '", "' just '"), ("' of '", "' shook '"), ("' la '", "' whispering '"))
_FORMS_SQL = ", ".join(f"('{f}', '{w}')" for f, w in lexical.inflections().items())
_LEMMA_SQL = rf"r(form, lemma) AS (VALUES {_FORMS_SQL}), t AS (SELECT doc_id, lower(unnest(regexp_extract_all({_LEMMAS}, '\p{{L}}+'))) AS form FROM documents), lc AS (SELECT lemma, doc_id, count(*) AS n FROM t JOIN r USING (form) GROUP BY ALL)"


def _lemmas(spark, sf_dir):
    return lexical.lemma_counts(_docs(spark, sf_dir, _LEMMAS), lexical.table(spark, list(lexical.inflections().items()), ("form", "lemma")))


@_query(f"WITH {_LEMMA_SQL} SELECT lemma, CAST(sum(n) AS BIGINT) AS total, count(*) AS docs FROM lc GROUP BY lemma")
def lemma_totals(spark, sf_dir):
    """Focus lemmas and their counts."""
    return _lemmas(spark, sf_dir).groupBy("lemma").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))


@_query(f"""WITH {_LEMMA_SQL}, k AS (SELECT *, sum(n) OVER (PARTITION BY lemma) AS total, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, doc_id) AS i FROM lc)
    SELECT lemma, CAST(total AS BIGINT) AS total, doc_id AS top_doc, CAST(n AS BIGINT) AS top_n, n::DOUBLE / total AS share FROM k WHERE i = 1 AND total >= 25 AND n >= 6 AND n::DOUBLE / total >= 0.01""")
def lemma_concentration(spark, sf_dir):
    """Lemmas bunched in one document."""
    return lexical.lemma_concentration(_lemmas(spark, sf_dir), share=0.01)


_WARD = seed(3, ("' for '", "' forward '"), ("' with '", "' towards '"), ("' the '", "' toward '"), ("' la '", "' Upward '"), ("' de '", "' homewards '"))
_WARD_SQL = rf"x AS (SELECT doc_id, unnest(list_filter(regexp_extract_all({_WARD}, '{W}+'), lambda y: regexp_matches(y, '(?i)^({'|'.join(grammar.WARDS)})s?$'))) AS token FROM documents)"


@_query(f"WITH {_WARD_SQL} SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL")
def ward_tokens(spark, sf_dir):
    """-ward words per document."""
    return grammar.ward_tokens(_docs(spark, sf_dir, _WARD)).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@_query(f"""WITH {_WARD_SQL}, y AS (SELECT lower(token) AS t FROM x), z AS (SELECT t, CASE WHEN t = 'toward' THEN 'toward_to_towards' WHEN t = 'forward' THEN 'forward_to_forwards' WHEN t LIKE '%ward' THEN 'ward_add_s' END AS rule FROM y)
    SELECT rule, t || 's' AS replacement, count(*) AS n FROM z WHERE rule IS NOT NULL GROUP BY ALL""")
def ward_rules(spark, sf_dir):
    """-ward words by the rule that changes them."""
    return grammar.ward_rules(grammar.ward_tokens(_docs(spark, sf_dir, _WARD))).groupBy("rule", "replacement").agg(F.count("*").alias("n"))


_SPANS = [(1, 1, "toward", 0, 6), (1, 1, "forward", 10, 17), (1, 2, "upward", 3, 9), (2, 1, "backwards", 5, 14)]
_HITS = [(1, 1, 4, 12, "A"), (1, 1, 6, 10, "B"), (1, 1, 15, 30, "C"), (2, 1, 14, 20, "A")]
_WARD_FIX = f"t(doc_id, para_no, token, s, e) AS (VALUES {', '.join(map(str, _SPANS))}), m(doc_id, para_no, ms, me, rule) AS (VALUES {', '.join(map(str, _HITS))})".replace('"', "'")


@_query(f"WITH {_WARD_FIX} SELECT t.doc_id, t.para_no, t.token, coalesce(bool_or(NOT (me <= s OR ms >= e)), false) AS flagged, coalesce(string_agg(CASE WHEN NOT (me <= s OR ms >= e) THEN rule END, ',' ORDER BY rule), '') AS rules FROM t LEFT JOIN m USING (doc_id, para_no) GROUP BY t.doc_id, t.para_no, t.token")
def ward_overlap(spark, sf_dir):
    """-ward words with the matches that overlap them."""
    t = lexical.table(spark, _SPANS, ("doc_id", "para_no", "token", "s", "e"))
    m = lexical.table(spark, _HITS, ("doc_id", "para_no", "ms", "me", "rule"))
    return grammar.ward_overlap(t, m).select("doc_id", "para_no", "token", "flagged", F.array_join("rules", ",").alias("rules"))


_MATCHES = [(1, 0, 1, "COMMA_COMPOUND_SENTENCE_2", "a, but b", "but"), (1, 0, 2, "COMMA_COMPOUND_SENTENCE", "a, but b", "but"), (1, 0, 3, "COMMA_COMPOUND_SENTENCE_3", "a, but b", "but"), (1, 9, 4, "OTHER", "a, but b", ""), (2, 5, 5, "COMMA_COMPOUND_SENTENCE_3", "x so y", "so"), (2, 5, 6, "COMMA_COMPOUND_SENTENCE_3", "x so y", "so"), (2, 8, 7, "OFF", "z", "")]
_MATCH_SQL = f"m(doc_id, off, ord, rule, context, suggestion) AS (VALUES {', '.join(map(str, _MATCHES))})"
_MATCH_COLS = ("doc_id", "off", "ord", "rule", "context", "suggestion")
_BEST_SQL = "b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, context, rule LIKE 'COMMA%' ORDER BY CASE rule WHEN 'COMMA_COMPOUND_SENTENCE' THEN 0 WHEN 'COMMA_COMPOUND_SENTENCE_2' THEN 1 WHEN 'COMMA_COMPOUND_SENTENCE_3' THEN 2 ELSE 99 END, ord) AS k FROM m)"


def _matches(spark):
    return grammar.kept_matches(lexical.table(spark, _MATCHES, _MATCH_COLS), lexical.table(spark, [("OFF",)], ("rule",)), lexical.table(spark, [("qq",)], ("phrase",)))


@_query(f"WITH {_MATCH_SQL}, {_BEST_SQL} SELECT doc_id, off, ord, rule, context, suggestion FROM b WHERE (k = 1 OR rule NOT LIKE 'COMMA%') AND rule <> 'OFF'")
def grammar_comma_best(spark, sf_dir):
    """The strongest comma match of each context."""
    return grammar.comma_best(_matches(spark))


@_query(f"WITH {_MATCH_SQL} SELECT coalesce(rule, 'total') AS rule, count(*) AS n FROM m WHERE rule <> 'OFF' GROUP BY ROLLUP (rule)")
def grammar_rule_counts(spark, sf_dir):
    """Matches per rule, and all."""
    return grammar.rule_counts(_matches(spark)).select(F.coalesce("rule", F.lit("total")).alias("rule"), "n")


_PHRASE_SQL = rf"{_lines_sql()}, ph AS (SELECT doc_id, line_no, x AS phrase FROM (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS x FROM l) WHERE length(x) >= 15 AND NOT (regexp_replace(x, '[^A-Za-z]', '', 'g') <> '' AND regexp_replace(x, '[^A-Za-z]', '', 'g') = upper(regexp_replace(x, '[^A-Za-z]', '', 'g'))))"


@_query(f"WITH {_PHRASE_SQL} SELECT phrase, count(*) AS n, min({{'d': doc_id, 'l': line_no}}).d AS doc_id, min({{'d': doc_id, 'l': line_no}}).l AS line_no FROM ph GROUP BY phrase")
def dup_exact(spark, sf_dir):
    """Different lines with counts and first places."""
    return phrases.exact_repeats(phrases.phrase_lines(_docs(spark, sf_dir)))


@_query()
def dup_phrases(spark, sf_dir):
    """Nearly equal lines."""
    return phrases.near_repeats(phrases.phrase_lines(_docs(spark, sf_dir)))


_PARAGRAPHS = "CASE WHEN doc_id % 7 = 0 THEN concat('Chapter ', CAST(doc_id % 5 AS VARCHAR(9)), ': x') WHEN doc_id % 31 = 1 THEN 'Epilogue' ELSE text END"
_SEG_SQL = rf"""g AS (SELECT doc_id // 100 AS book, doc_id AS para_idx, {_PARAGRAPHS} AS text FROM documents),
    h AS (SELECT *, regexp_matches(text, '(?i)^(?:rule|chapter)\s*(?:#\s*)?(\d+)') AS ch, regexp_matches(text, '(?i)^\s*epilogue([^\p{{L}}\p{{N}}_]|$)') AS ep FROM g),
    k AS (SELECT *, ch OR ep AS heading, sum(CAST(ch OR ep AS INT)) OVER w AS chapter, coalesce(last_value(CASE WHEN ch THEN CAST(regexp_extract(text, '(\d+)', 1) AS INT) END IGNORE NULLS) OVER w, 0) AS ln, sum(CAST(ep AND NOT ch AS INT)) OVER w AS e FROM h WINDOW w AS (PARTITION BY book ORDER BY para_idx ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, ln + e - coalesce(last_value(CASE WHEN ch THEN e END IGNORE NULLS) OVER (PARTITION BY book ORDER BY para_idx ROWS UNBOUNDED PRECEDING), 0) AS number FROM k)"""


def _segments(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 100).alias("book"), F.col("doc_id").alias("para_idx"), F.expr(_PARAGRAPHS).alias("text"))
    return chapters.segments(d)


@_query(f"""WITH {_SEG_SQL}, c AS (SELECT book, chapter, max(number) AS number, CAST(count_if(NOT heading) AS BIGINT) AS paragraphs, string_agg(text, chr(10) || chr(10) ORDER BY para_idx) FILTER (NOT heading) AS body FROM s GROUP BY book, chapter),
    f AS (SELECT *, CASE WHEN number = 0 THEN 'preamble.txt' ELSE format('chapter_{{:03d}}.txt', CAST(number AS INT)) END AS file_name FROM c WHERE paragraphs > 0)
    SELECT book, file_name, paragraphs, body FROM (SELECT *, row_number() OVER (PARTITION BY book, file_name ORDER BY chapter DESC) AS i FROM f) WHERE i = 1""")
def chapter_segments(spark, sf_dir):
    """Chapters of a manuscript made of the documents."""
    return chapters.chapters(_segments(spark, sf_dir)).select("book", "file_name", "paragraphs", "body")


@_query(f"WITH {_SEG_SQL} SELECT book, para_idx, CAST(number AS BIGINT) AS number FROM (SELECT *, row_number() OVER (PARTITION BY book, number ORDER BY para_idx) AS i FROM s WHERE heading) WHERE i > 1")
def chapter_duplicates(spark, sf_dir):
    """Headings with a number that came before."""
    return chapters.duplicate_numbers(_segments(spark, sf_dir)).select("book", "para_idx", F.col("number").cast("long").alias("number"))


_RUNS = [("b", 0, 0, "Plain", "Normal", "", "", False, False), ("b", 1, 0, "a [x] \"q\"", "Odd", "yellow", "FF0000", True, True), ("b", 1, 1, "it's", "Odd", "AUTO", "000000", False, False), ("b", 2, 0, "‘a’ it's", "Quote", "", "auto", False, False)]


@_query("SELECT * FROM (VALUES ('unknown_style', 1, 1::BIGINT), ('highlight', 1, 1), ('non_black_text', 1, 1), ('square_brackets', 1, 1), ('strikethrough', 1, 1), ('underline', 1, 1), ('straight_double_quote', 1, 1), ('straight_single_quote', 1, 1)) v(type, para_idx, n)")
def docx_artefacts(spark, sf_dir):
    """Formatting artefacts of a small manuscript."""
    r = lexical.table(spark, _RUNS, ("book", "para_idx", "run_idx", "text", "style", "highlight", "color", "strike", "underline"))
    return chapters.artefacts(r.withColumn("highlight", F.nullif("highlight", F.lit(""))).withColumn("color", F.nullif("color", F.lit("")))).select("type", "para_idx", "n")


@_query("SELECT source, count(*) AS entries, (SELECT count(DISTINCT word) FROM w) AS merged FROM w GROUP BY source".replace("SELECT source", "WITH w(word, source) AS (VALUES ('a', 'book'), ('b', 'book'), ('b', 'house'), ('c', 'house'), ('d', 'house')) SELECT source", 1))
def dictionary_counts(spark, sf_dir):
    """Entries per dictionary, and of all together."""
    w = lexical.table(spark, [("a", "book"), ("b", "book"), ("b", "house"), ("c", "house"), ("d", "house")], ("word", "source"))
    return w.groupBy("source").agg(F.count_distinct("word").alias("entries")).crossJoin(w.agg(F.count_distinct("word").alias("merged")))
