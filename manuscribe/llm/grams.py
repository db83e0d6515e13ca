"""Word n-grams of whole texts with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_words(text: Column) -> Column:
    """Lower-case words: maximal runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_grams(words: Column, n: int) -> Column:
    """An array with a struct of n words for every place in the words."""
    m = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, i + 1, m).alias(f"w{i}") for i in range(n)])


def gram_rows(df: DataFrame, words: str, n: int, *keep: str) -> DataFrame:
    """(keep..., pos, gram): a row for every n-gram, pos from 0, gram a 64-bit hash of its words."""
    rows = df.select(*keep, F.posexplode(word_grams(F.col(words), n)).alias("pos", "_g"))
    fields = rows.schema["_g"].dataType.names
    return rows.select(*keep, "pos", F.xxhash64(*[F.col("_g").getField(f) for f in fields]).alias("gram"))
