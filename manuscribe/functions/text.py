"""Lines, paragraphs, sentences and tokens of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that ends a line.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
ASCII_NUMBER_WORD = r"[A-Za-z0-9]+(?:[’'][A-Za-z0-9]+)?"
UNICODE_WORD = r"(?U)\b[\w'-]+\b"
ASCII_WORD = r"[A-Za-z][A-Za-z'-]*"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def line_array(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_no from 1, line)."""
    return docs.select(id_col, F.posexplode(line_array(F.col(text_col))).alias("_p", "line")).select(id_col, (F.col("_p") + 1).alias("line_no"), "line")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, para_no from 1, paragraph): stripped, non-empty parts between blank lines."""
    parts = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), r"(?U)\n\s*\n"), strip), lambda x: x != "")
    return docs.select(id_col, F.posexplode(parts).alias("_p", "paragraph")).select(id_col, (F.col("_p") + 1).alias("para_no"), "paragraph")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z])")


def token_array(text: Column, pattern: str = ASCII_WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def white_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def tokens(rows: DataFrame, text_col: str, *keep: str, pattern: str = ASCII_WORD) -> DataFrame:
    """(keep..., token): one row per match of the pattern."""
    return rows.select(*keep, F.explode(token_array(F.col(text_col), pattern)).alias("token"))


def like_case(found: Column, wanted: Column) -> Column:
    """wanted in the case of found: all capitals, first capital and the rest small, or as given."""
    first = F.substring(found, 1, 1)
    return (
        F.when((found == F.upper(found)) & (found != F.lower(found)), F.upper(wanted))
        .when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(wanted, 1, 1)), F.lower(F.substring(wanted, 2, 1 << 20))))
        .otherwise(wanted)
    )
