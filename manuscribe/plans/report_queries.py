"""Queries of contexts, reports and rule files, each with its DuckDB SQL; registered with those of `queries`."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import lines
from ..operators import chapters, contexts, grammar, lexical, phrases, runs, structure
from ..sources import rules
from .queries import _SIMILE, NOT_W, W, _docs, _lines_sql, _phrase_sql, _query, seed

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SENTENCES = r"string_split(regexp_replace({}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


def _sql_rows(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_ASKED = ["The", "that", "eth", "zzq"]


@_query(rf"""WITH d AS (SELECT doc_id, text, translate(coalesce(text, ''), '’—…', '''  ') AS t FROM documents), a AS (SELECT *, unnest({_ASKED!r}) AS word FROM d),
    s AS (SELECT *, lower(word) AS target, {_SENTENCES.format('t')} AS s FROM a),
    f AS (SELECT *, list_filter(s, lambda x: list_contains(list_transform(string_split_regex(x, '\s+'), lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{N}}_'']', '', 'g'))), target))[1] AS sent, regexp_extract(lower(t), '{W}*' || target || '{W}*') AS longer FROM s),
    g AS (SELECT *, instr(lower(t), longer) - 1 AS pos FROM f)
    SELECT doc_id, word, CASE WHEN sent IS NOT NULL THEN {_STRIP.format('sent')} WHEN longer <> '' THEN {_STRIP.format('substring(t, greatest(pos - 60, 0) + 1, pos + 60 - greatest(pos - 60, 0))')} ELSE substring({_STRIP.format("coalesce(text, '')")}, 1, 120) END AS context FROM g""")
def word_contexts(spark, sf_dir):
    """The sentence, or else the surroundings, in which a word stands."""
    d = _docs(spark, sf_dir)
    hits = d.select("doc_id", F.explode(F.array(*[F.lit(w) for w in _ASKED])).alias("word"))
    return contexts.by_word(hits, d).select("doc_id", "word", "context")


@_query(rf"""WITH d AS (SELECT doc_id, text, (doc_id * 37) % greatest(length(text), 1) AS off FROM documents WHERE text IS NOT NULL), s AS (SELECT *, {_SENTENCES.format('text')} AS s FROM d),
    f AS (SELECT *, list_filter(s, lambda x: instr(text, x) - 1 <= off AND off < instr(text, x) - 1 + length(x))[1] AS sent FROM s)
    SELECT doc_id, CAST(off AS BIGINT) AS off, {_STRIP.format('coalesce(sent, substring(text, greatest(off - 60, 0) + 1, off + 5 + 60 - greatest(off - 60, 0)))')} AS context FROM f""")
def offset_contexts(spark, sf_dir):
    """The sentence at an offset."""
    d = _docs(spark, sf_dir).filter("text IS NOT NULL")
    hits = d.select("doc_id", F.pmod(F.col("doc_id") * 37, F.greatest(F.length("text"), F.lit(1))).alias("off"), F.lit(5).alias("length"))
    return contexts.by_offset(hits, d).select("doc_id", "off", "context")


@_query(rf"""WITH p AS (SELECT doc_id, text, string_split(text, ' that ') AS p FROM documents), k AS (SELECT doc_id, text, p, unnest(range(1, len(p))) AS no FROM p), a AS (SELECT *, length(array_to_string(p[1:no], ' that ')) AS pos FROM k)
    SELECT doc_id, CAST(no AS INTEGER) AS no, {_STRIP.format('substring(text, greatest(pos - 60, 0) + 1, pos + 6 + 60 - greatest(pos - 60, 0))')} AS context FROM a""")
def window_contexts(spark, sf_dir):
    """Sixty characters about every hit."""
    return contexts.around(_docs(spark, sf_dir), " that ").select("doc_id", "no", "context")


_MASKS = ["of the", "th", "the of ", "and", "."]


@_query("SELECT doc_id, md5(replace(replace(replace(replace(replace(coalesce(text, ''), 'the of ', 'CUSTOMPHRASE0'), 'of the', 'CUSTOMPHRASE1'), 'and', 'CUSTOMPHRASE2'), 'th', 'CUSTOMPHRASE3'), '.', 'CUSTOMPHRASE4')) AS digest FROM documents")
def masked_phrases(spark, sf_dir):
    """Digests of texts with dictionary phrases masked, longest first."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(contexts.masked(F.col("text"), _MASKS)).alias("digest"))


_ERRORS = [
    (1, "Color", "house", "Colour", "", 1, "a Color."), (1, "color", "house", "", "", 2, "a Color."), (1, "colr", "unknown", "", "", 3, "x"), (2, "colr", "unknown", "color", "", 4, "y"),
    (2, "truck", "flagged", "lorry", "truck => lorry", 5, "z"), (2, "truck", "unknown", "trick", "", 6, "w"), (3, "truck", "flagged", "lorry", "Truck => lorry", 7, "v"), (3, "apol", "unknown", "", "", 8, ""), (3, "colr", "unknown", "collar", "", 9, "y"),
]
_ERROR_COLS = ("doc_id", "word", "type", "suggestion", "rule", "ord", "context")
_ERROR_SQL = f"e(doc_id, word, type, suggestion, rule, ord, context) AS (VALUES {_sql_rows(_ERRORS)}), u AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(word), context ORDER BY ord) AS k FROM e) WHERE k = 1)"


@_query(f"WITH {_ERROR_SQL}, g AS (SELECT word, string_agg(DISTINCT type, ', ' ORDER BY type) AS types, coalesce(arg_min(suggestion, ord) FILTER (suggestion <> ''), '') AS suggestion, coalesce(string_agg(DISTINCT rule, ', ' ORDER BY rule) FILTER (type = 'flagged' AND rule <> ''), '') AS rules, count(*) AS n FROM u GROUP BY word) SELECT *, CAST(row_number() OVER (ORDER BY lower(word), word) AS INTEGER) AS place FROM g")
def spelling_report(spark, sf_dir):
    """Spelling errors by word: types, first suggestion, rules and count, each error once, in the order of words."""
    e = contexts.unique_errors(lexical.table(spark, _ERRORS, _ERROR_COLS))
    return contexts.by_error_word(e).withColumn("place", F.row_number().over(Window.orderBy(F.lower("word"), "word")))


@_query(f"WITH {_ERROR_SQL} SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id")
def spelling_by_file(spark, sf_dir):
    """Spelling errors per text."""
    return contexts.unique_errors(lexical.table(spark, _ERRORS, _ERROR_COLS)).groupBy("doc_id").agg(F.count("*").alias("n"))


_CONTEXT_SQL = rf"""{_lines_sql()}, t AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, '[A-Za-z][A-Za-z''-]*')) AS token FROM l), c AS (SELECT DISTINCT lower(token) AS token_lower, doc_id, line_no, line FROM t WHERE regexp_matches(token, '^[A-Z]') AND length(token) >= 3)"""


@_query(f"WITH {_CONTEXT_SQL} SELECT token_lower, CAST(no AS INTEGER) AS no, doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY token_lower ORDER BY doc_id, line_no) AS no FROM c) WHERE no <= 10")
def name_contexts(spark, sf_dir):
    """The first ten lines of every capitalised word."""
    return contexts.first_lines(lines(_docs(spark, sf_dir)), lambda x: x.rlike("^[A-Z]") & (F.length(x) >= 3))


_TITLED = "concat(source, '_', lang, '-the o''book.docx')"


@_query(rf"""WITH f AS (SELECT doc_id, trim(translate(regexp_replace({_TITLED}, '\.docx$', ''), '_-', '  ')) AS stem FROM documents)
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(stem), '\p{{L}}+|[^\p{{L}}]+'), lambda x: upper(x[1]) || x[2:]), '') AS title,
    CAST(CAST(round_even(greatest(doc_id * 1.5 - 10, 0), 0) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(round_even(greatest(doc_id * 1.5 - 10, 0), 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS took,
    strftime(TIMESTAMP '2024-01-31 22:00:00' + to_seconds(CAST(doc_id AS BIGINT) * 61), '%Y-%m-%d %H:%M:%S') AS stamp FROM f""")
def run_labels(spark, sf_dir):
    """Titles of file names, durations and time stamps as reports print them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-31 22:00:00")) + F.col("doc_id") * 61)
    return d.select("doc_id", contexts.title_of(F.expr(_TITLED.replace("''", "\\'"))).alias("title"), contexts.duration(F.col("doc_id") * F.lit(1.5) - 10).alias("took"), contexts.stamp(at).alias("stamp"))


_SAID = "he ran like/- a wolf . it was like/- the old grey man s dog . she felt like/- this . they went like/- quickly and . like/- me . like/- a slow red fox".split()
_TAGS = {"a": "DET", "the": "DET", "this": "PRON", "me": "PRON", "he": "PRON", "it": "PRON", "she": "PRON", "they": "PRON", "old": "ADJ", "grey": "ADJ", "slow": "ADJ", "red": "ADJ", "wolf": "NOUN", "man": "NOUN", "dog": "NOUN", "fox": "NOUN", "quickly": "ADV"}
#: Noun chunks that start at these places, with their roots.
_CHUNKS = {5: "wolf", 11: "Dog"}
_TAGGED = [(1 + (i >= 20), i, t.split("/")[0], t.split("/")[0], _TAGS.get(t.split("/")[0], "X"), _CHUNKS.get(i)) for i, t in enumerate(_SAID)]
_TAGGED_SQL = f"t(doc_id, token_no, token, lemma, pos, chunk) AS (VALUES {_sql_rows(_TAGGED)})"


def _tagged(spark: SparkSession) -> DataFrame:
    return lexical.table(spark, _TAGGED, ("doc_id", "token_no", "token", "lemma", "pos", "chunk")).withColumn("chunk", F.col("chunk").cast("string"))


@_query(f"""WITH {_TAGGED_SQL}, k AS (SELECT * FROM t WHERE token = 'like'), a AS (SELECT k.doc_id, k.token_no, t.token, t.lemma, t.pos, t.chunk, t.token_no - k.token_no AS i FROM k JOIN t ON t.doc_id = k.doc_id AND t.token_no BETWEEN k.token_no + 1 AND k.token_no + 5),
    n AS (SELECT doc_id, token_no, min(i) AS i FROM a WHERE pos IN ('NOUN', 'PROPN', 'PRON') GROUP BY ALL),
    f AS (SELECT a.doc_id, a.token_no, max(CASE WHEN a.i = 1 THEN a.chunk END) AS chunk, max(CASE WHEN a.i = 1 THEN a.pos END) AS pos, 'like ' || coalesce(string_agg(a.token, ' ' ORDER BY a.i) FILTER (a.i < n.i AND a.pos IN ('ADJ', 'ADV', 'DET')) || ' ', '') || max(CASE WHEN a.i = n.i THEN a.lemma END) AS found FROM a LEFT JOIN n USING (doc_id, token_no) GROUP BY a.doc_id, a.token_no),
    p AS (SELECT doc_id, token_no, pos, CASE WHEN chunk IS NOT NULL THEN 'like ' || lower(chunk) ELSE lower(found) END AS phrase FROM f), g AS (SELECT doc_id, token_no, pos, CASE WHEN phrase = 'like wolf' THEN 'like beast' ELSE phrase END AS phrase FROM p WHERE phrase IS NOT NULL)
    SELECT doc_id, token_no, phrase FROM g WHERE coalesce(pos, '') <> 'PRON' AND string_split(phrase, ' ')[2] NOT IN ('this', 'that', 'these', 'those') AND phrase <> 'like dog'""")
def simile_keys(spark, sf_dir):
    """What tagged texts compare to, by looking ahead, with groups and skipped phrases."""
    return contexts.simile_keys(_tagged(spark), lexical.table(spark, [("like wolf", "like beast")], ("phrase", "key")), ["like dog"])


@_query(f"WITH {_TAGGED_SQL} SELECT doc_id, token_no, coalesce(lag(pos) OVER w, '') AS prev, coalesce(lead(pos) OVER w, '') AS next FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY token_no)")
def tag_neighbours(spark, sf_dir):
    """Parts of speech before and after every token."""
    return contexts.neighbours(_tagged(spark)).select("doc_id", "token_no", "prev", "next")


_SIMILE_SQL = rf"""s AS (SELECT doc_id AS chapter, unnest(regexp_extract_all(lower({_SIMILE}), '{NOT_W}like\s+((?:a|an|the|some)\s+\p{{L}}+)', 1)) AS x FROM documents), n AS (SELECT chapter, regexp_replace(x, '^(a|an|the|some)\s+', '') AS x FROM s),
    q AS (SELECT chapter, CASE WHEN regexp_matches(x, '[^s][^s][^s]s$') THEN x[:-2] ELSE x END AS head FROM n)"""


@_query(f"WITH {_SIMILE_SQL} SELECT head, count(*) AS n FROM q GROUP BY head")
def simile_heads(spark, sf_dir):
    """What similes compare to."""
    return contexts.simile_heads(lexical.similes(_docs(spark, sf_dir, _SIMILE)))


@_query(f"WITH {_SIMILE_SQL}, c AS (SELECT head, count(*) AS n, string_agg(CAST(chapter AS VARCHAR), ',' ORDER BY chapter) AS chapters FROM q GROUP BY head), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, head) AS place FROM c) SELECT CAST(place AS INTEGER) AS place, 'like ' || head AS phrase, n, chapters FROM r WHERE place <= 500")
def simile_report(spark, sf_dir):
    """The 500 most frequent similes, and the chapters of each in order."""
    s = lexical.similes(_docs(spark, sf_dir, _SIMILE)).groupBy("phrase").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("chapter")).alias("c"))
    top = s.orderBy(F.desc("n"), "phrase").limit(500)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "phrase")).alias("place"), "phrase", "n", F.array_join(F.col("c").cast("array<string>"), ",").alias("chapters"))


_CRUTCHED = seed(2, ("' the '", "' Like '"), ("' and '", "' just '"), ("' der '", "' very '"), ("' la '", "' REALLY '"))
_CRUTCH_ROWS = list(lexical.CRUTCH.items())


@_query(rf"""WITH r(word, guideline) AS (VALUES {', '.join(f"('{w}', CAST({g} AS DOUBLE))" for w, g in _CRUTCH_ROWS)}), d AS (SELECT {_CRUTCHED} AS text FROM documents), c AS (SELECT lower(token) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{W}+')) AS token FROM d) GROUP BY 1),
    w AS (SELECT CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS total_words FROM d)
    SELECT word, coalesce(n, 0) AS n, total_words, coalesce(n, 0) * 10000.0::DOUBLE / total_words AS per_10k, guideline, coalesce(n, 0) * 10000.0::DOUBLE / total_words > guideline AS above FROM r LEFT JOIN c USING (word), w""")
def crutch_words(spark, sf_dir):
    """The five crutch words against their guidelines."""
    return lexical.crutch_overview(_docs(spark, sf_dir, _CRUTCHED), lexical.table(spark, _CRUTCH_ROWS, ("word", "guideline")))


_LEMMAS_25 = [("grin", c, n) for c, n in ((1, 20), (2, 4), (3, 2))] + [("sigh", c, 7) for c in range(1, 6)] + [("nod", 1, 24), ("nod", 2, 1), ("shrug", 1, 13), ("shrug", 2, 13)]


@_query(f"""WITH l(lemma, doc_id, n) AS (VALUES {_sql_rows(_LEMMAS_25)}), k AS (SELECT *, sum(n) OVER (PARTITION BY lemma) AS total, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, doc_id) AS i FROM l),
    c AS (SELECT lemma, total, doc_id, n, n::DOUBLE / total AS share FROM k WHERE i = 1 AND total >= 25 AND n >= 6 AND n::DOUBLE / total >= 0.25) SELECT lemma, CAST(total AS BIGINT) AS total, doc_id AS top_doc, CAST(n AS BIGINT) AS top_n, share, CAST((SELECT sum(n) FROM c) AS BIGINT) AS all_top, CAST(row_number() OVER (ORDER BY total DESC, lemma) AS INTEGER) AS place FROM c""")
def concentration_report(spark, sf_dir):
    """Lemmas bunched in one chapter at the house's thresholds, most frequent first, and the hits in their top chapters."""
    c = lexical.lemma_concentration(lexical.table(spark, _LEMMAS_25, ("lemma", "doc_id", "n")).withColumn("n", F.col("n").cast("long")))
    return c.crossJoin(F.broadcast(c.agg(F.sum("top_n").alias("all_top")))).withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "lemma")))


_MATCHED = [
    (1, 0, 1, "COMMA_COMPOUND_SENTENCE", "a but b", ", but", "grammar"), (1, 9, 2, "COMMA_COMPOUND_SENTENCE", "x so y", ", So", "grammar"), (1, 12, 3, "COMMA_COMPOUND_SENTENCE", "p and q", ", and", "style"),
    (2, 0, 4, "COMMA_COMPOUND_SENTENCE", "u or v", ", or", "grammar"), (2, 7, 5, "OTHER", "qq in it", "", "grammar"), (2, 8, 6, "OFF", "z", "", "grammar"), (3, 8, 7, "OTHER", "z", "", "typographical"), (3, 9, 8, "LATE", "zz", "", "grammar"),
]
_MATCHED_COLS = ("doc_id", "off", "ord", "rule", "context", "suggestion", "issue_type")
_MATCHED_SQL = f"m(doc_id, off, ord, rule, context, suggestion, issue_type) AS (VALUES {_sql_rows(_MATCHED)})"


def _matched(spark: SparkSession, **how) -> DataFrame:
    return grammar.kept_matches(lexical.table(spark, _MATCHED, _MATCHED_COLS), lexical.table(spark, [("OFF",)], ("rule",)), lexical.table(spark, [("qq",)], ("phrase",)), **how)


@_query(f"WITH {_MATCHED_SQL} SELECT ord, rule FROM m WHERE rule <> 'OFF' AND NOT contains(context, 'qq') AND issue_type IN ('grammar', 'style')")
def grammar_kept(spark, sf_dir):
    """Matches left by disabled rules, ignored phrases and issue types."""
    return _matched(spark, issue_types=["grammar", "style"]).select("ord", "rule")


@_query(f"WITH {_MATCHED_SQL} SELECT CASE WHEN contains(lower(suggestion), 'but') THEN 'but' WHEN contains(lower(suggestion), 'so') THEN 'so' WHEN contains(lower(suggestion), 'and') THEN 'and' ELSE 'other' END AS word, count(*) AS n FROM m WHERE rule = 'COMMA_COMPOUND_SENTENCE' GROUP BY 1")
def comma_groups(spark, sf_dir):
    """Comma matches by conjunction."""
    return _matched(spark).filter(F.col("rule") == grammar.COMMA).groupBy(grammar.comma_word(F.lower("suggestion")).alias("word")).agg(F.count("*").alias("n"))


@_query(f"WITH {_MATCHED_SQL}, c AS (SELECT rule, count(*) AS n, min(ord) AS first FROM m WHERE rule <> 'OFF' AND NOT contains(context, 'qq') GROUP BY rule) SELECT rule, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS place FROM c")
def grammar_order(spark, sf_dir):
    """Rules by count, equal ones as first seen."""
    c = _matched(spark).groupBy("rule").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return c.select("rule", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"))


@_query(f"WITH {_MATCHED_SQL}, h(doc_id, off, what) AS (VALUES (1, 0, 'a'), (1, 1, 'b'), (2, 8, 'c'), (4, 0, 'd')) SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = h.doc_id AND m.off = h.off)")
def house_suppressed(spark, sf_dir):
    """House hits but where any match starts."""
    h = lexical.table(spark, [(1, 0, "a"), (1, 1, "b"), (2, 8, "c"), (4, 0, "d")], ("doc_id", "off", "what"))
    return grammar.without_matched(h, lexical.table(spark, _MATCHED, _MATCHED_COLS)).select("doc_id", "off", "what")


_WARDED = [(1, 1, "toward", 0, 6), (1, 1, "forward", 10, 17), (1, 2, "upward", 3, 9), (2, 1, "backwards", 5, 14), (3, 1, "forwards", 0, 8)]
_WARD_HITS = [(1, 1, 4, 12, "A"), (1, 1, 6, 10, "B"), (2, 1, 13, 20, "A"), (9, 1, 0, 1, "C")]


@_query(f"WITH t(doc_id, para_no, token, s, e) AS (VALUES {_sql_rows(_WARDED)}), m(doc_id, para_no, ms, me, rule) AS (VALUES {_sql_rows(_WARD_HITS)}), j AS (SELECT t.*, m.rule FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND t.para_no = m.para_no AND NOT (me <= s OR ms >= e)) SELECT count(DISTINCT doc_id * 100 + para_no) AS paragraphs, count(DISTINCT CASE WHEN rule IS NOT NULL THEN doc_id * 10000 + para_no * 100 + s END) AS flagged, count(DISTINCT doc_id * 10000 + para_no * 100 + s) AS tokens, count(DISTINCT rule) AS rules FROM j")
def ward_summary(spark, sf_dir):
    """Paragraphs, flagged tokens, tokens and distinct rules of the -ward audit."""
    t = lexical.table(spark, _WARDED, ("doc_id", "para_no", "token", "s", "e"))
    return grammar.ward_summary(grammar.ward_overlap(t, lexical.table(spark, _WARD_HITS, ("doc_id", "para_no", "ms", "me", "rule"))))


@_query("WITH t(token, prev, next) AS (VALUES ('forward', 'X', 'X'), ('forward', 'VERB', 'X'), ('onward', 'X', 'NOUN'), ('Onward', 'X', 'X'), ('backwards', 'X', 'NOUN'), ('towards', 'X', 'NOUN'), ('toward', 'VERB', 'NOUN')) SELECT rule, token, rule = 'forward_to_forwards' AS advisory FROM (SELECT token, CASE WHEN lower(token) = 'toward' THEN 'toward_to_towards' WHEN lower(token) = 'forward' AND prev <> 'VERB' AND next <> 'NOUN' THEN 'forward_to_forwards' WHEN lower(token) LIKE '%ward' AND lower(token) <> 'forward' AND next <> 'NOUN' THEN 'ward_add_s' WHEN lower(token) LIKE '%wards' AND lower(token) <> 'towards' AND next = 'NOUN' THEN 'wards_to_ward' END AS rule FROM t) WHERE rule IS NOT NULL")
def ward_advisory(spark, sf_dir):
    """-ward rules with parts of speech around, and which are advice only."""
    rows = [("forward", "X", "X"), ("forward", "VERB", "X"), ("onward", "X", "NOUN"), ("Onward", "X", "X"), ("backwards", "X", "NOUN"), ("towards", "X", "NOUN"), ("toward", "VERB", "NOUN")]
    t = lexical.table(spark, [(1, 1, i, *r) for i, r in enumerate(rows)], ("doc_id", "para_no", "s", "token", "prev", "next"))
    return grammar.ward_rules(t.select("doc_id", "para_no", "s", "token"), t.select("doc_id", "para_no", "s", "prev", "next")).select("rule", "token", "advisory")


_PAIRED = [("a", "b", 9, 1, 1, 1, 2, 1, 96.0), ("c", "d", 9, 2, 1, 2, 1, 3, 99.0), ("e", "f", 1, 9, 3, 1, 3, 2, 97.0), ("g", "h", 9, 1, 2, 1, 2, 2, 97.0), ("i", "j", 3, 3, 1, 1, 1, 2, 100.0)]


@_query(f"WITH p(phrase_a, phrase_b, n_a, n_b, doc_a, line_a, doc_b, line_b, score) AS (VALUES {_sql_rows(_PAIRED)}), o AS (SELECT *, row_number() OVER (ORDER BY greatest(n_a, n_b) DESC, abs(n_a - n_b) DESC, score DESC, doc_a, line_a, doc_b, line_b) AS place FROM p) SELECT CAST(place AS INTEGER) AS place, phrase_a, phrase_b FROM o WHERE place <= 4")
def reported_pairs(spark, sf_dir):
    """The pairs that a report of four lists, in its order."""
    p = phrases.reported(lexical.table(spark, _PAIRED, ("phrase_a", "phrase_b", "n_a", "n_b", "doc_a", "line_a", "doc_b", "line_b", "score")), 4)
    hi, lo = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    return p.select(F.row_number().over(Window.orderBy(hi.desc(), (hi - lo).desc(), F.desc("score"), "doc_a", "line_a", "doc_b", "line_b")).alias("place"), "phrase_a", "phrase_b")


_FAMILIES = [("it was", 0, "itwas"), ("of the", 1, "of-the"), ("in the", 2, "in-the")]
_FAMILY_TEXT = seed(3, ("' of the '", "' of-the '"), ("' it was '", "' itwas '"), ("' in the '", "' in-the '"))


@_query(f"WITH {_phrase_sql(_FAMILY_TEXT, [(f, p) for f, _, a in _FAMILIES for p in (f, a)])}, o(family, ordinal) AS (VALUES ('it was', 0), ('of the', 1), ('in the', 2)) SELECT v.family, p.n AS preferred_n, v.phrase AS variant, v.n AS variant_n, CAST(row_number() OVER (ORDER BY o.ordinal) AS INTEGER) AS place FROM h v JOIN h p ON v.family = p.family AND p.phrase = p.family JOIN o ON o.family = v.family WHERE v.phrase <> v.family AND v.n > 0 AND v.family <> 'of the'")
def compound_report(spark, sf_dir):
    """Compound variants in the order of the rule file, without a whitelisted family."""
    fams = lexical.table(spark, _FAMILIES, ("family", "ordinal", "alt")).withColumn("alts", F.array("alt"))
    got = lexical.compound_counts(_docs(spark, sf_dir, _FAMILY_TEXT), fams.select("family", "alts"), lexical.table(spark, [("Of The",)], ("word",)))
    return got.join(fams.select("family", "ordinal"), "family").withColumn("place", F.row_number().over(Window.orderBy("ordinal"))).drop("ordinal")


_ORDERED = seed(3, ("'. '", "'.  '"), ("' that '", "' amid '"))


@_query("WITH " + _lines_sql(_ORDERED) + r""", i AS (SELECT 'double_space' AS type, doc_id, line_no FROM l WHERE regexp_matches(line, '  +') UNION ALL SELECT 'amid', doc_id, line_no FROM l WHERE regexp_matches(line, '(?i)(^|[^\p{L}\p{N}_])amid([^\p{L}\p{N}_]|$)'))
    SELECT CAST(place AS INTEGER) AS place, type, doc_id, CAST(line_no AS INTEGER) AS line_no FROM (SELECT *, row_number() OVER (ORDER BY type, doc_id, line_no) AS place FROM i) WHERE place <= 500""")
def structure_report(spark, sf_dir):
    """The first 500 structural issues by type, text and line."""
    i = structure.line_issues(lines(_docs(spark, sf_dir, _ORDERED)), only={"double_space", "amid"}).select("type", "doc_id", "line_no")
    return i.orderBy("type", "doc_id", "line_no").limit(500).withColumn("place", F.row_number().over(Window.orderBy("type", "doc_id", "line_no")))


_FORMATTED = [("b", i, 0, f"[{i}]" if i < 3 else "plain", "Odd" if i % 2 else "Normal", "", "", False, i == 4) for i in range(8)]


@_query(f"WITH r(book, para_idx, run_idx, text, style, highlight, color, strike, underline) AS (VALUES {_sql_rows(_FORMATTED)}), a AS (SELECT 'unknown_style' AS type, para_idx FROM r WHERE style = 'Odd' UNION ALL SELECT 'square_brackets', para_idx FROM r WHERE regexp_matches(text, '[\\[\\]]') UNION ALL SELECT 'underline', para_idx FROM r WHERE underline) SELECT type, para_idx, count(*) OVER (PARTITION BY type) AS n, count(*) OVER (PARTITION BY type) <= 3 AS itemised FROM a")
def artefact_items(spark, sf_dir):
    """Formatting artefacts, and which types are few enough to be itemised."""
    r = lexical.table(spark, _FORMATTED, ("book", "para_idx", "run_idx", "text", "style", "highlight", "color", "strike", "underline"))
    r = r.withColumn("highlight", F.nullif("highlight", F.lit(""))).withColumn("color", F.nullif("color", F.lit("")))
    return chapters.artefacts(r, 3).select("type", "para_idx", "n", "itemised")


_STATUS = [("01", 0, "✅ fine"), ("02", 0, "⚠️ three issues"), ("03", 1, "✅ fine"), ("08", 0, "ℹ️ note"), ("09", 0, ""), ("10", 0, "❌ stop")]
_STATUS_SQL = f"s(step, rc, line) AS (VALUES {_sql_rows(_STATUS)}), i AS (SELECT step, rc, CASE WHEN rc <> 0 OR line LIKE '❌%' THEN '❌' WHEN line LIKE '⚠%' THEN '⚠️' WHEN line LIKE '✅%' THEN '✅' WHEN line LIKE 'ℹ%' THEN 'ℹ️' ELSE '' END AS icon FROM s)"


@_query(f"WITH {_STATUS_SQL} SELECT count(*) AS steps, CAST(count_if(icon = '❌') AS BIGINT) AS failed, CAST(count_if(icon = '⚠️') AS BIGINT) AS warnings, NOT coalesce(bool_or(rc <> 0 OR (step <> '02' AND icon IN ('❌', '⚠️'))), false) AS clean FROM i")
def gate_counts(spark, sf_dir):
    """Steps, failures and warnings of a run, and whether it is clean."""
    return runs.gate(lexical.table(spark, _STATUS, ("step", "rc", "line")), ["02"])


@_query(f"WITH {_STATUS_SQL} SELECT step, icon FROM i")
def step_icons(spark, sf_dir):
    """The icon of each step's last line."""
    return runs.status(lexical.table(spark, _STATUS, ("step", "rc", "line"))).select("step", "icon")


@_query("WITH " + _lines_sql(_ORDERED) + " SELECT CASE WHEN n = 0 THEN '✅' ELSE '⚠️' END AS icon, CASE WHEN n = 0 THEN '✅ Spaces: clean' ELSE '⚠️ Spaces: ' || n END AS line FROM (SELECT count(*) AS n FROM l WHERE regexp_matches(line, '  +'))")
def status_line(spark, sf_dir):
    """A step's last line."""
    return runs.status_line(structure.line_issues(lines(_docs(spark, sf_dir, _ORDERED)), only={"double_space"}), "Spaces")


_DICT = "Alpha\n#include more.txt\n# note\nBeta phrase\n\nalpha\n"
_MORE = "Gamma\n'Delta'\n#include book.txt\n"
_FLAGS = "Truck => lorry\nno arrow\ntruck => van\nof the => off the\n"
_FAMS = "it was <= itwas, it-was\nbroken\nIt Was <= itt\nof the <= of-the\n"
_SUPPRESS = "RULE_ONE\nsome phrase\n# note\n\n"
_EXPECTED = [
    ("dictionary", "Alpha", "book.txt"), ("dictionary", "Beta phrase", "book.txt"), ("dictionary", "alpha", "book.txt"), ("dictionary", "Gamma", "more.txt"), ("dictionary", "'Delta'", "more.txt"),
    ("folded", "alpha", "book.txt"), ("folded", "beta phrase", "book.txt"), ("folded", "gamma", "more.txt"), ("folded", "delta", "more.txt"),
    ("raw", "alpha", "book.txt"), ("raw", "#include more.txt", "book.txt"), ("raw", "# note", "book.txt"), ("raw", "beta phrase", "book.txt"),
    ("system", "gamma", "more.txt"), ("system", "'delta'", "more.txt"), ("system", "#include book.txt", "more.txt"), ("flag", "truck", "van"), ("flag", "of the", "off the"), ("family", "It Was", "itt"), ("family", "of the", "of-the"),
    ("accepted", "Alpha", ""), ("accepted", "#include more.txt", ""), ("accepted", "# note", ""), ("accepted", "Beta phrase", ""), ("accepted", "alpha", ""), ("disabled", "RULE_ONE", ""), ("ignored", "some phrase", ""), ("allowed", "Gamma", "more.txt"),
    ("allowed", "'Delta'", "more.txt"), ("allowed", "Alpha", "book.txt"), ("allowed", "Beta phrase", "book.txt"), ("allowed", "alpha", "book.txt"), ("resolved", "book.txt", "book"), ("resolved", "other.txt", "root"),
]


@_query(f"SELECT * FROM (VALUES {_sql_rows(_EXPECTED)}) v(loader, entry, detail)")
def rule_files(spark, sf_dir):
    """Every loader of rule files over one small set of them."""
    with tempfile.TemporaryDirectory() as d:
        at = Path(d)
        for name, text in (("book.txt", _DICT), ("more.txt", _MORE), ("flags.txt", _FLAGS), ("fams.txt", _FAMS), ("off.txt", _SUPPRESS)):
            (at / name).write_text(text, encoding="utf-8")
        disabled, ignored = rules.suppressions(spark, at / "off.txt", at / "missing.txt")
        parts = [
            rules.lexicon(spark, at / "book.txt").select(F.lit("dictionary"), "word", "source"),
            rules.lexicon(spark, at / "book.txt", folded=True).select(F.lit("folded"), "word", "source"),
            rules.repeatable(spark, at / "book.txt").select(F.lit("raw"), "word", "source"),
            rules.system_words(spark, at / "more.txt").select(F.lit("system"), "word", "source"),
            rules.system_words(spark, at / "missing.txt").select(F.lit("system"), "word", "source"),
            rules.flag_words(spark, at / "flags.txt").select(F.lit("flag"), "wrong_lower", "right"),
            rules.families(spark, at / "fams.txt").select(F.lit("family"), "family", F.array_join("alts", ",")),
            rules.accepted_lines(spark, at / "book.txt").select(F.lit("accepted"), "line", F.lit("")),
            disabled.select(F.lit("disabled"), "rule", F.lit("")),
            ignored.select(F.lit("ignored"), "phrase", F.lit("")),
            rules.allow_file(spark, at / "more.txt").select(F.lit("allowed"), "word", "source"),
            spark.createDataFrame([("resolved", n, "book" if rules.resolve(n, at, "/nowhere").parent == at else "root") for n in ("book.txt", "other.txt")], "a string, b string, c string"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.toDF("loader", "entry", "detail")
