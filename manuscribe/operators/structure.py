"""Structural rules over lines, paragraphs and whole texts.

Every rule gives rows (type, doc_id, line_no, line). Lines in `accepted` are
skipped and end paragraphs. Rules that look at one line are one projection over
one scan; the others are windows within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ASCII_NUMBER_WORD, lines, token_array

# Fixed values.
TITLES = "Mr|Mrs|Ms|Dr|St|Prof|Rev|Gen|Gov|Hon|Pres|Sen|Lt|Col|Maj|Capt|Cmdr|Adm|Sgt|Cpl"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
CONTRACTIONS = "Cause|Twas|Tis|Em|Bout|Round|Til|Fore|Neath|Tweren’t|Twasn’t"
OPENERS = "“\"‘'"

DOUBLE_SPACE, REPEATED, MULTI_PUNCT = "double_space", "repeated_word", "multi_punct"

#: Fixed values. Rules that a search on one line decides: name -> Java pattern.
SEARCHES = {
    "double_space": "  +",
    "editing_marker": r"\[\[|<<|NOTE:",
    "square_bracket": r"[\[\]]",
    "split_year": r"(?U)\b(19|20)\s{1,2}[0-9]{2}\b",
    "spaced_hyphen": r"(?U)\b\w+\s+-\s+\w+\b",
    "em_dash_spacing": r"(?U)\s—|—\s",
    "bad_ellipsis": r"(?U)\.\.\.|\.…|…\.|…\s*…",
    "title_period": rf"(?iU)\b({TITLES})\.",
    "time_periods": r"(?iU)\b\d{1,2}\s?(a\.m\.|p\.m\.)\b",
    "amid": r"(?iU)\bamid\b",
    "non_british_date": rf"(?iU)\b((?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,?\s+(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?)\b",
    "contraction_quote": rf"(?U)\b‘(?:{CONTRACTIONS})\b",
}

#: What the same rules were meant to find: no word character is needed after "p.m." or before an opening quote.
INTENDED = {
    "time_periods": r"(?iU)\b\d{1,2}\s?(a\.m\.|p\.m\.)",
    "contraction_quote": rf"(?U)‘(?:{CONTRACTIONS})\b",
}


def _marked(line: Column, needle: str, judge) -> Column:
    """judge(before, after) at every place of a one-character needle in the line."""
    parts = F.split(line, needle)
    at = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: judge(F.array_join(F.slice(parts, F.lit(1), k), needle), F.array_join(F.slice(parts, k + 1, F.size(parts)), needle)))


def en_dash(line: Column, intended: bool = False) -> Column:
    """A spaced or tight dash between words, but for plain ranges."""
    plain = r"^([0-9]+|[A-Za-z])\s*–\s*([0-9]+|[A-Za-z])$" if intended else r"^[0-9A-Za-z]+\s*–\s*[0-9A-Za-z]+$"
    return F.exists(F.regexp_extract_all(line, F.lit(r"(?U)\b\w+\s*–\s*\w+\b"), F.lit(0)), lambda x: ~x.rlike(plain))


def multi_punct(line: Column) -> Column:
    """Three or more of !? or four or more dots, not after a word; not before a closing quote or inside quotes."""
    parts = F.split(F.regexp_replace(line, r"(?U)(?<!\w)([!?]{3,}|\.{4,})", "\ue000$1\ue001"), "\ue000")
    at = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))

    def bad(k: Column) -> Column:
        before = F.array_join(F.slice(parts, F.lit(1), k), "")
        quotes = F.length(before) - F.length(F.translate(before, "\u201c\u201d\"\u2018\u2019'", ""))
        after = F.substring_index(F.element_at(parts, k + 1), "\ue001", -1)
        return ~F.substring(after, 1, 1).isin("\u201d", "\"", "\u2019", "'") & (quotes % 2 == 0)

    return F.exists(at, bad)


def ellipsis_fault(line: Column) -> Column:
    """The first fault of the line's ellipses: start_space, space_before, comma_after, no_space_after, or null."""

    def judge(before: Column, after: Column) -> Column:
        bare = F.regexp_replace(before, r"(?U)^\s+|\s+$", "")
        start = F.regexp_replace(bare, "^[“”\"'‘’]+|[“”\"'‘’]+$", "") == ""
        right = F.regexp_replace(before, r"(?U)\s+$", "")
        spoken = right.rlike(r"(?U)(^|[.!?…,:;—–(\[{-])\s*[“\"‘']$")
        one, two, three = (F.substring(after, i, 1) for i in (1, 2, 3))
        return (
            F.when(start | spoken, F.when(one == " ", "start_space"))
            .when(before.rlike(r"(?U)\s$"), "space_before")
            .when((after == "") | (one == " "), F.lit(None))
            .when(one == ",", F.when((two == " ") | (two.isin("”", "’", "\"", "'") & (three == " ")), F.lit(None)).otherwise("comma_after"))
            .when(one.isin("’", "”", "\"", ")", "]", "}", "!", "?", "—", "–", ":", ";"), F.lit(None))
            .otherwise("no_space_after")
        )

    return F.get(F.filter(_marked(line, "…", judge), lambda x: x.isNotNull()), F.lit(0))


def straight_single_odd(line: Column) -> Column:
    """An odd number of straight single quotes that are no apostrophes."""

    def mark(before: Column, after: Column) -> Column:
        p, n = F.substring(before, -1, 1), F.substring(after, 1, 1)
        p, n = F.when(before == "", "").otherwise(p), F.when(after == "", "").otherwise(n)
        word_p, word_n = p.rlike(r"^[\p{L}\p{N}]$"), n.rlike(r"^[\p{L}\p{N}]$")
        inner = word_p & (word_n | (n == "") | n.rlike(r"(?U)^\s$") | n.isin(*".,;:!?)]}\"”—–-"))
        lead = word_n & ((p == "") | p.rlike(r"(?U)^\s$") | p.isin(*"([{-\"“”‘’"))
        return ~(inner | lead)

    return F.size(F.filter(_marked(line, "'", mark), lambda x: x)) % 2 == 1


def smart_single_open(line: Column) -> Column:
    """The last smart single quote of the line is an opening one, and no contraction has one."""
    last = F.regexp_extract(line, "([‘’])[^‘’]*$", 1)
    return (last == "‘") & ~line.rlike(SEARCHES["contraction_quote"])


def straight_double_odd(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit("\""), F.lit("")))) % 2 == 1


def line_issues(ls: DataFrame, intended: bool = False, only: set[str] | None = None) -> DataFrame:
    """(type, doc_id, line_no, line) of every rule that needs one line only, but repeated words.

    `only` names the rules wanted; "ellipsis" stands for its four faults.
    """
    line = F.col("line")
    hits = [(name, lambda p=p: line.rlike(p)) for name, p in (SEARCHES | (INTENDED if intended else {})).items()]
    hits += [
        ("en_dash", lambda: F.contains(line, F.lit("–")) & en_dash(line, intended)),
        ("multi_punct", lambda: line.rlike(r"[!?]{3}|\.{4}") & multi_punct(line)),
        ("smart_single_open", lambda: F.contains(line, F.lit("‘")) & smart_single_open(line)),
        ("straight_double_odd", lambda: F.contains(line, F.lit("\"")) & straight_double_odd(line)),
        ("straight_single_odd", lambda: F.contains(line, F.lit("'")) & straight_single_odd(line)),
    ]
    array = [F.struct(F.lit(name).alias("type"), hit().alias("hit")) for name, hit in hits if only is None or name in only]
    if only is None or "ellipsis" in only:
        fault = F.when(F.contains(line, F.lit("…")), ellipsis_fault(line))
        array.append(F.struct(F.concat(F.lit("ellipsis_"), fault).alias("type"), F.lit(True).alias("hit")))
    wanted = lambda x: x["hit"] & x["type"].isNotNull()
    return ls.select("doc_id", "line_no", "line", F.inline(F.filter(F.array(*array), wanted))).select("type", "doc_id", "line_no", "line")


def repeated_words(ls: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, word): one row per repeated word, unless `allowed` (word) has "x x"."""
    pat = r"(?iU)\b(\w+)\s+\1\b"
    out = ls.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(pat), F.lit(1))).alias("word"))
    if allowed is None:
        return out
    pair = F.concat_ws(" ", F.lower("word"), F.lower("word"))
    return out.join(allowed.select(F.lower("word").alias("_a")), pair == F.col("_a"), "left_anti")


def _starts(line: Column, what: str) -> Column:
    return F.regexp_replace(line, r"(?U)^[\s\p{Cf}]+", "").rlike(what)


def line_end_comma(ls: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Lines that end in a comma unless the next written line opens a quote or goes on with a conjunction."""
    if accepted is not None:
        ls = ls.join(accepted.select(F.col("line").alias("_l")), F.regexp_replace("line", r"(?U)^\s+|\s+$", "") == F.col("_l"), "left_anti")
    told = ls.filter(F.col("line").rlike(r"(?U)\S"))
    nxt = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    told = told.withColumn("_next", nxt).filter(F.col("line").rlike(r"(?U).,\s*$"))
    excused = F.coalesce(_starts(F.col("_next"), f"^[{OPENERS}]") | _starts(F.col("_next"), r"(?iU)^(?:and|but|so|or|then|yet)\b"), F.lit(False))
    return told.filter(~excused).select(F.lit("line_end_comma").alias("type"), "doc_id", "line_no", "line")


def _paragraphs(ls: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Lines with `ok` (accepted), `group` (accepted lines so far) and `para` (breaks so far)."""
    if accepted is None:
        ls = ls.withColumn("ok", F.lit(False))
    else:
        a = accepted.select(F.col("line").alias("_l")).distinct()
        ls = ls.join(a, F.regexp_replace("line", r"(?U)^\s+|\s+$", "") == F.col("_l"), "left").withColumn("ok", F.col("_l").isNotNull()).drop("_l")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    blank = ~F.col("line").rlike(r"(?U)\S")
    return ls.withColumn("blank", blank).withColumn("group", F.sum(F.col("ok").cast("int")).over(w)).withColumn("para", F.sum((F.col("ok") | F.col("blank")).cast("int")).over(w))


def paragraph_no_terminal(ls: DataFrame, accepted: DataFrame | None = None, least_words: int = 10) -> DataFrame:
    """Last lines of paragraphs of so many words that end without terminal punctuation."""
    p = _paragraphs(ls, accepted).filter("NOT ok AND NOT blank")
    n = F.size(token_array(F.col("line"), ASCII_NUMBER_WORD))
    last = p.groupBy("doc_id", "para").agg(F.sum(n).alias("n"), F.max_by(F.struct("line_no", "line"), "line_no").alias("l")).filter(F.col("n") >= least_words)
    bare = F.regexp_replace(F.col("l.line"), "(?U)[\\s”’\"')\\]}]+$", "")
    # a line of closers only leaves nothing to judge
    return last.filter((bare != "") & ~bare.rlike("[.!?…,:;—–-]$")).select(F.lit("paragraph_no_terminal").alias("type"), "doc_id", F.col("l.line_no").alias("line_no"), F.col("l.line").alias("line"))


def quote_state(ls: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Faults of smart double quotes across lines; accepted lines reset the state.

    stray_closing_quote, a row per closing quote without an opener;
    continued_without_quote, a paragraph that begins inside an open quote without a
    quote of its own; open_at_end, a text that ends inside one.
    """
    p = _paragraphs(ls, accepted).withColumn("marks", F.regexp_extract_all("line", F.lit("[“”]"), F.lit(0)))
    p = p.withColumn("last", F.when(~F.col("ok"), F.element_at(F.when(F.size("marks") > 0, F.col("marks")), -1)))
    before = Window.partitionBy("doc_id", "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("state", F.last("last", True).over(before)).filter("NOT ok")
    ahead = F.concat(F.array(F.coalesce("state", F.lit("”"))), F.col("marks"))
    stray = F.size(F.filter(F.arrays_zip(F.col("marks").alias("q"), F.slice(ahead, F.lit(1), F.size("marks")).alias("b")), lambda x: (x["q"] == "”") & (x["b"] == "”")))
    closing = p.select("doc_id", "line_no", "line", F.explode(F.array_repeat(F.lit("stray_closing_quote"), stray)).alias("type"))
    begins = F.lag("blank").over(Window.partitionBy("doc_id", "group").orderBy("line_no"))
    cont = p.withColumn("begins", F.coalesce(begins, F.lit(True))).filter("begins AND NOT blank AND state = '“'").filter(~_starts(F.col("line"), f"^[{OPENERS}]"))
    end = p.groupBy("doc_id", "group").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("line_no"))).alias("q"), F.max_by(F.struct("line_no", "line", "blank"), "line_no").alias("l"))
    final = ls.groupBy("doc_id").agg(F.max("line_no").alias("end"))
    end = end.join(final, "doc_id").filter((F.col("q") == "“") & (F.col("l.line_no") == F.col("end")))
    at_end = end.select(F.lit("open_at_end").alias("type"), "doc_id", F.when(F.col("l.blank"), 1).otherwise(F.col("l.line_no")).alias("line_no"), F.when(F.col("l.blank"), "").otherwise(F.col("l.line")).alias("line"))
    cont = cont.select(F.lit("continued_without_quote").alias("type"), "doc_id", "line_no", "line")
    return closing.select("type", "doc_id", "line_no", "line").unionByName(cont).unionByName(at_end)


def check(docs: DataFrame, accepted: DataFrame | None = None, allowed: DataFrame | None = None, intended: bool = False) -> DataFrame:
    """All structural issues of documents (doc_id, text)."""
    ls = lines(docs)
    told = ls
    if accepted is not None:
        told = ls.join(accepted.select(F.col("line").alias("_l")).distinct(), F.regexp_replace("line", r"(?U)^\s+|\s+$", "") == F.col("_l"), "left_anti")
    out = line_issues(told, intended).unionByName(repeated_words(told, allowed).select(F.lit("repeated_word").alias("type"), "doc_id", "line_no", F.col("word").alias("line")))
    for more in (line_end_comma(ls, accepted), paragraph_no_terminal(ls, accepted), quote_state(ls, accepted)):
        out = out.unionByName(more)
    return out
