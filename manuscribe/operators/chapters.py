"""Chapters from paragraphs, and formatting artefacts of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
HEADING = r"(?i)^(?:rule|chapter)\s*(?:#\s*)?(\d+)\s*[:.\-–—.]?\s*(.*)$"
EPILOGUE = r"(?i)^\s*epilogue\b[:.\-–—.]?\s*(.*)$"
STYLES = ["Normal", "Body Text", "Heading 1", "Heading 2", "Heading 3", "Vellum Flush Left", "Vellum Text Conversation", "Vellum Chapter Title", "Vellum Verse", "Vellum Hidden Heading", "Vellum Element Subtitle", "Vellum Centered Text", "Vellum Inline Image", "Quote"]


def segments(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (book, para_idx, text) with heading, chapter (headings so far), number and title.

    Number 0 is what stands before the first heading; an epilogue has the last number plus 1.
    """
    head, epi = F.col("text").rlike(HEADING), F.col("text").rlike(EPILOGUE)
    w = Window.partitionBy("book").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    p = paragraphs.withColumn("heading", head | epi).withColumn("chapter", F.sum((head | epi).cast("int")).over(w))
    own = F.when(head, F.regexp_extract("text", HEADING, 1).cast("int"))
    p = p.withColumn("_n", own).withColumn("_last", F.coalesce(F.last("_n", True).over(w), F.lit(0)))
    epilogues = F.sum((epi & ~head).cast("int")).over(w)
    p = p.withColumn("_e", epilogues).withColumn("_e0", F.coalesce(F.last(F.when(head, F.col("_e")), True).over(w), F.lit(0)))
    title = F.when(head, F.regexp_extract("text", HEADING, 2)).when(epi, F.regexp_extract("text", EPILOGUE, 1))
    return p.withColumn("number", F.col("_last") + F.col("_e") - F.col("_e0")).withColumn("title", F.last(title, True).over(w)).drop("_n", "_last", "_e", "_e0")


def chapters(segmented: DataFrame) -> DataFrame:
    """(book, chapter, number, file_name, header, body, paragraphs): chapters with any body; of one number the last stays."""
    g = segmented.groupBy("book", "chapter").agg(
        F.max("number").alias("number"),
        F.max(F.when(F.col("heading"), F.col("text"))).alias("header"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("para_idx", "text")))), lambda x: x["text"]), "\n\n").alias("body"),
        F.count_if(~F.col("heading")).alias("paragraphs"),
    )
    head = F.when(F.col("header").rlike("[.!?]$"), F.col("header")).otherwise(F.concat("header", F.lit(".")))
    g = g.filter("paragraphs > 0").withColumn("header", head).withColumn("file_name", F.when(F.col("number") == 0, "preamble.txt").otherwise(F.format_string("chapter_%03d.txt", "number")))
    w = Window.partitionBy("book", "file_name").orderBy(F.desc("chapter"))
    return g.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def duplicate_numbers(segmented: DataFrame) -> DataFrame:
    """Headings whose number came before in the book."""
    h = segmented.filter("heading")
    w = Window.partitionBy("book", "number").orderBy("para_idx")
    return h.withColumn("_n", F.row_number().over(w)).filter("_n > 1").select("book", "para_idx", "number", "text")


def artefacts(runs: DataFrame, most: int = 50) -> DataFrame:
    """(type, book, para_idx, text, n, itemised) of runs (book, para_idx, run_idx, text, style, highlight, color, strike, underline).

    A type is itemised if it has at most `most` issues.
    """
    c = F.col
    t = c("text")
    rules = [
        ("unknown_style", ~c("style").isin(STYLES) & (c("run_idx") == 0)),
        ("highlight", c("highlight").isNotNull() & (F.upper("highlight") != "AUTO")),
        ("non_black_text", c("color").isNotNull() & ~F.upper("color").isin("000000", "AUTO")),
        ("square_brackets", t.rlike(r"[\[\]]")),
        ("strikethrough", F.coalesce("strike", F.lit(False))),
        ("underline", F.coalesce("underline", F.lit(False))),
        ("line_break", t.rlike("\\x0b")),
        ("straight_double_quote", F.contains(t, F.lit("\"")) & ~t.rlike("[“”]")),
        ("straight_single_quote", F.contains(t, F.lit("'")) & ~t.rlike("[‘’]")),
    ]
    hits = F.array(*[F.struct(F.lit(n).alias("type"), F.coalesce(h, F.lit(False)).alias("hit")) for n, h in rules])
    out = runs.select("book", "para_idx", "text", F.inline(F.filter(hits, lambda x: x["hit"]))).drop("hit")
    n = F.broadcast(out.groupBy("type").agg(F.count("*").alias("n")))  # a row for each of the nine rules
    return out.join(n, "type").select("type", "book", "para_idx", "text", "n", (F.col("n") <= most).alias("itemised"))
