"""Where a hit stands in its text: sentences, windows, masks; and what reports make of hits.

Texts are cut into sentences once; hits meet the sentences by equi-joins, and
only hits without a sentence see the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sentences, strip, token_array

# Fixed values.
WIDTH, HEAD = 60, 120
MOST_CONTEXTS = 10


def plain(text: Column) -> Column:
    """Curly apostrophes straight, long dashes and ellipses as spaces."""
    return F.translate(F.coalesce(text, F.lit("")), "’—…", "'  ")


def bare(word: Column) -> Column:
    """Lower case, without all but word characters and apostrophes."""
    return F.lower(F.regexp_replace(word, r"(?U)[^\w']", ""))


def bare_words(sentence: Column, empty: Column) -> Column:
    """The different bare words of a sentence, if asked the empty one too where something has no word character."""
    words = F.split(F.lower(F.regexp_replace(sentence, r"(?U)[^\w'\s]", "")), r"(?U)\s+")
    return F.array_union(F.array_remove(words, ""), F.when(empty & sentence.rlike(r"(?U)(?<!\S)[^\w'\s]+(?!\S)"), F.array(F.lit(""))).otherwise(F.expr("CAST(array() AS array<string>)")))


def window(text: Column, start: Column, end: Column, width: int = WIDTH) -> Column:
    """The text from `width` characters before start (from 0) to `width` after end."""
    lo = F.greatest(start - width, F.lit(0))
    return strip(F.substring(text, (lo + 1).cast("int"), (end + width - lo).cast("int")))


def by_word(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits (doc_id, word) with context: the first sentence that has the word, else 60 characters about a longer word with it, else the text's first 120.

    Different words of a text are looked up once each, all in one pass over its
    sentences, so its words are not shuffled; a null text gives an empty context.
    """
    asked = hits.select("doc_id", "word").distinct().groupBy("doc_id").agg(F.collect_set("word").alias("_asked")).withColumn("_targets", F.array_distinct(F.transform("_asked", bare)))
    # a text is more work than its bytes: tasks are dealt by texts
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = asked.join(docs.select("doc_id", "text").repartition(tasks, "doc_id"), "doc_id", "left").select("doc_id", "_asked", "_targets", F.coalesce("text", F.lit("")).alias("text"))
    said = F.transform(sentences(plain(F.col("text"))), lambda x: F.struct(x.alias("sentence"), F.array_intersect(bare_words(x, F.array_contains("_targets", "")), F.col("_targets")).alias("found")))
    # one after another, each sentence adds the words not found before
    new = lambda seen, x: F.array_except(x["found"], F.transform(seen, lambda y: y["target"]))
    first = F.aggregate(
        F.filter(said, lambda x: F.size(x["found"]) > 0),
        F.expr("CAST(array() AS array<struct<target: string, sentence: string>>)"),
        lambda seen, x: F.concat(seen, F.transform(new(seen, x), lambda t: F.struct(t.alias("target"), x["sentence"].alias("sentence")))),
    )
    rows = rows.select("doc_id", "_asked", "text", first.alias("_first"))
    low, text = F.lower(plain(F.col("text"))), plain(F.col("text"))

    def context(word: Column) -> Column:
        said = F.filter("_first", lambda x: x["target"] == bare(word))
        longer = F.coalesce(F.when(F.contains(low, bare(word)), F.regexp_substr(low, F.concat(F.lit(r"(?U)\b\w*\Q"), bare(word), F.lit(r"\E\w*\b")))), F.lit(""))
        at = F.position(longer, low) - 1
        rest = F.when(longer != "", window(text, at, at)).otherwise(F.substring(strip(F.col("text")), 1, HEAD))
        return F.struct(word.alias("word"), F.when(F.size(said) > 0, strip(F.get(said, F.lit(0))["sentence"])).otherwise(rest).alias("context"))

    return hits.join(rows.select("doc_id", F.explode(F.transform("_asked", context)).alias("_x")).select("doc_id", "_x.word", "_x.context"), ["doc_id", "word"])


def by_offset(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits (doc_id, off from 0, length) with context: the first sentence whose first occurrence in the text covers the offset, else 60 characters about it."""
    text = F.coalesce("text", F.lit(""))
    sents = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", text.alias("text")).withColumn("_s", sentences(F.col("text")))
    placed = sents.select("doc_id", F.posexplode(F.expr("transform(_s, x -> struct(x AS sentence, instr(text, x) - 1 AS at))")).alias("no", "x")).select("doc_id", "no", "x.sentence", "x.at")
    asked = hits.select("doc_id", "off", "length").distinct()
    inside = (F.col("at") <= F.col("off")) & (F.col("off") < F.col("at") + F.length("sentence"))
    first = asked.join(placed, "doc_id").filter(inside).groupBy("doc_id", "off", "length").agg(F.min_by("sentence", "no").alias("sentence"))
    found = asked.join(first, ["doc_id", "off", "length"], "left").join(docs.select("doc_id", text.alias("text")), "doc_id", "left")
    context = F.coalesce(strip(F.col("sentence")), window(F.col("text"), F.col("off"), F.col("off") + F.col("length")))
    return hits.join(found.select("doc_id", "off", "length", context.alias("context")), ["doc_id", "off", "length"])


def around(docs: DataFrame, pattern: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, no, hit, context): every match of a Java pattern with the text about it."""
    text = F.coalesce("text", F.lit(""))
    hits = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern).alias("p"))
    hits = hits.filter("size(h) > 0").select("doc_id", "text", "h", "p", F.explode(F.sequence(F.lit(1), F.size("h"))).alias("no"))
    # what stands before a match: all parts and matches so far
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    start = size(F.slice("p", F.lit(1), F.col("no"))) + size(F.slice("h", F.lit(1), F.col("no") - 1))
    hit = F.element_at("h", F.col("no"))
    return hits.select("doc_id", "no", hit.alias("hit"), window(F.col("text"), start, start + F.length(hit), width).alias("context"))


def masked(text: Column, phrases: list[str], marker: str = "CUSTOMPHRASE") -> Column:
    """text with each phrase of a rule file replaced by the marker and its number, longest first, case kept, within words too."""
    out = F.coalesce(text, F.lit(""))
    for i, phrase in enumerate(sorted(phrases, key=len, reverse=True)):
        out = F.replace(out, F.lit(phrase), F.lit(f"{marker}{i}"))
    return out


def unique_errors(errors: DataFrame) -> DataFrame:
    """Of errors (word, context, ord, ...) with equal lower-case word and context the first."""
    w = Window.partitionBy("doc_id", F.lower("word"), "context").orderBy("ord")
    return errors.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def by_error_word(errors: DataFrame) -> DataFrame:
    """(word, types, suggestion, rules, n) of errors (word, type, suggestion, rule, ord): types and rules sorted, the first suggestion there is."""
    told = F.nullif("suggestion", F.lit(""))
    rule = F.when((F.col("type") == "flagged") & (F.col("rule") != ""), F.col("rule"))
    g = errors.groupBy("word").agg(
        F.sort_array(F.collect_set("type")).alias("types"),
        F.min_by(told, F.when(told.isNotNull(), F.col("ord"))).alias("suggestion"),
        F.sort_array(F.collect_set(rule)).alias("rules"),
        F.count("*").alias("n"),
    )
    return g.select("word", F.array_join("types", ", ").alias("types"), F.coalesce("suggestion", F.lit("")).alias("suggestion"), F.array_join("rules", ", ").alias("rules"), "n")


def first_contexts(hits: DataFrame, key: str, *order: str, most: int = MOST_CONTEXTS) -> DataFrame:
    """The first `most` hits of each key in the given order, numbered from 1 in `no`."""
    return hits.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("no") <= most)


def first_lines(lines: DataFrame, wanted: Callable[[Column], Column], most: int = MOST_CONTEXTS) -> DataFrame:
    """(token_lower, no, doc_id, line_no, line): the first `most` different lines (doc_id, line_no, line) of every wanted word.

    Words are ranked by places alone, and their lines fetched for the places
    that are left, so no line is copied for each of its words. Equal places
    share a rank; where texts share an id, lines are numbered once more.
    """
    words = F.array_distinct(F.transform(F.filter(token_array(F.col("line")), wanted), F.lower))
    at = lines.select(F.explode(words).alias("token_lower"), "doc_id", "line_no")
    rank = F.dense_rank().over(Window.partitionBy("token_lower").orderBy("doc_id", "line_no"))
    near = at.withColumn("_r", rank).filter(F.col("_r") <= most).select("token_lower", F.col("doc_id").alias("_d"), F.col("line_no").alias("_n")).distinct()
    found = near.join(lines, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_n") == F.col("line_no"))).filter(F.array_contains(words, F.col("token_lower")))
    found = found.select("token_lower", "doc_id", "line_no", "line").distinct()
    return first_contexts(found, "token_lower", "doc_id", "line_no", most=most).select("token_lower", "no", "doc_id", "line_no", "line")


def title_of(file_name: Column) -> Column:
    """A book's title from its file name: no suffix, _ and - as spaces, each run of letters with a first capital."""
    stem = F.trim(F.translate(F.regexp_replace(file_name, r"\.docx$", ""), "_-", "  "))
    parts = F.regexp_extract_all(F.lower(stem), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def duration(seconds: Column) -> Column:
    """M:SS, to the nearest even second of halves, never below 0."""
    total = F.bround(F.greatest(seconds, F.lit(0.0)), 0).cast("long")
    return F.format_string("%d:%02d", F.floor(total / 60), total % 60)


def stamp(at: Column) -> Column:
    """A report's time stamp."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def simile_keys(tokens: DataFrame, groups: DataFrame | None = None, skip: list[str] | None = None, ahead: int = 5) -> DataFrame:
    """(doc_id, token_no, phrase) of tagged tokens (doc_id, token_no, token, lemma, pos, chunk): every "like" with what it compares to.

    `chunk` is the lemma of the noun chunk's root where a chunk starts, else null.
    Without a chunk right after "like", the next `ahead` tokens are searched for
    a noun or pronoun, and adjectives, adverbs and determiners before it are kept.
    `groups` (phrase, key) merges phrases; phrases of `skip`, pronouns and
    demonstratives right after "like" are dropped.
    """
    w = Window.partitionBy("doc_id").orderBy("token_no")
    nxt = [F.lead(F.struct("token", "lemma", "pos", "chunk"), i).over(w) for i in range(1, ahead + 1)]
    like = tokens.withColumn("_next", F.array_compact(F.array(*nxt))).filter(F.lower("token") == "like")
    noun = lambda x: x["pos"].isin("NOUN", "PROPN", "PRON")
    at = F.expr("array_position(transform(_next, x -> x.pos IN ('NOUN', 'PROPN', 'PRON')), true)").cast("int")
    left = F.transform(F.filter(F.slice("_next", F.lit(1), at - 1), lambda x: x["pos"].isin("ADJ", "ADV", "DET")), lambda x: x["token"])
    found = F.when(F.exists("_next", noun), F.concat_ws(" ", F.lit("like"), left, F.element_at("_next", at)["lemma"]))
    chunk = F.get("_next", F.lit(0))["chunk"]
    phrase = F.when(chunk.isNotNull(), F.concat(F.lit("like "), F.lower(chunk))).otherwise(F.lower(found))
    out = like.select("doc_id", "token_no", phrase.alias("phrase"), F.get("_next", F.lit(0))["pos"].alias("_pos")).filter("phrase IS NOT NULL")
    if groups is not None:
        out = out.join(groups, "phrase", "left").select("doc_id", "token_no", F.coalesce("key", "phrase").alias("phrase"), "_pos")
    first = F.element_at(F.split("phrase", " "), 2)
    pronoun = (F.col("_pos") == "PRON") | first.isin("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them")
    out = out.filter(~F.coalesce(pronoun, F.lit(False)) & ~first.isin("this", "that", "these", "those"))
    return (out.filter(~F.col("phrase").isin(skip)) if skip else out).select("doc_id", "token_no", "phrase")


def simile_heads(phrases: DataFrame) -> DataFrame:
    """(head, n) of similes (phrase): what stands after "like"."""
    return phrases.select(F.regexp_replace("phrase", r"^like\s+", "").alias("head")).groupBy("head").agg(F.count("*").alias("n"))


def neighbours(tokens: DataFrame) -> DataFrame:
    """tagged tokens (doc_id, token_no, token, pos, ...) with the parts of speech before and after: prev and next, empty at the ends."""
    w = Window.partitionBy("doc_id").orderBy("token_no")
    return tokens.withColumn("prev", F.coalesce(F.lag("pos").over(w), F.lit(""))).withColumn("next", F.coalesce(F.lead("pos").over(w), F.lit("")))
