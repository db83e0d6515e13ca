"""Chapters as a stream: each new or changed file is checked as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import structure


def chapter_stream(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of text files as they come; doc_id is a hash of the file's path."""
    return spark.readStream.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def watch(chapters: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the structural issues of every batch of chapters to a table at out; a batch replayed after a failure replaces itself."""

    def each(batch: DataFrame, epoch: int) -> None:
        structure.check(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return chapters.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
