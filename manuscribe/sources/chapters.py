"""Chapter files: one row per text file, in the order of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import docx


#: What a step does with bytes that are no UTF-8.
DECODE = ("strict", "replace", "ignore")


def chapters(spark: SparkSession, path: str, errors: str = "replace") -> DataFrame:
    """(book, chapter_name, doc_id, text) of path/<book>/chapters/*.txt or path/*.txt; doc_id counts from 0 within a book.

    Bytes that are no UTF-8 become U+FFFD (replace), go (ignore) or fail the read (strict).
    """
    if errors not in DECODE:
        raise ValueError(f"errors is one of {DECODE}, not {errors!r}")
    t = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    text = F.col("content").cast("string") if errors == "strict" else F.make_valid_utf8(F.col("content").cast("string"))
    if errors == "ignore":
        text = F.translate(text, "\ufffd", "")
    if errors == "strict":
        text = F.validate_utf8(text)
    t = t.select(F.col("path").alias("p"), text.alias("text"))
    parts = F.split("p", "/")
    t = t.select(F.regexp_replace(F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1)), "/chapters$", "").alias("dir"), F.element_at(parts, -1).alias("chapter_name"), "text")
    w = Window.partitionBy("dir").orderBy("chapter_name")
    return t.select(F.element_at(F.split("dir", "/"), -1).alias("book"), "chapter_name", (F.row_number().over(w) - 1).cast("long").alias("doc_id"), "text")


def loose_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): a manuscript's or a plain text's non-blank paragraphs joined by blank lines."""
    if path.endswith(".docx"):
        p = docx.paragraphs(docx.runs(spark, path)).filter(F.trim("text") != "").groupBy("book").agg(F.sort_array(F.collect_list(F.struct("para_idx", "text"))).alias("p"))
        return p.select(F.array_join(F.transform("p", lambda x: F.trim(x["text"])), "\n\n").alias("text"))
    t = spark.read.text(path, wholetext=True)
    return t.select(F.array_join(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n\n").alias("text"))
