"""Status of a run's steps, and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
CLEAN, WARNING, FAILED, INFO = "✅", "⚠️", "❌", "ℹ️"


def status(steps: DataFrame) -> DataFrame:
    """steps (step, rc, line) with icon: that of the line, failed where rc is not 0."""
    line = F.trim(F.coalesce("line", F.lit("")))
    icon = F.when(F.col("rc") != 0, FAILED).when(line.startswith(FAILED), FAILED).when(line.startswith("⚠"), WARNING).when(line.startswith(CLEAN), CLEAN).when(line.startswith("ℹ"), INFO).otherwise("")
    return steps.withColumn("icon", icon)


def gate(steps: DataFrame, info_only: list[str] | None = None) -> DataFrame:
    """(steps, failed, warnings, clean): clean if no step failed and no gating step warns."""
    s = status(steps)
    gating = ~F.col("step").isin(info_only) if info_only else F.lit(True)
    bad = (F.col("rc") != 0) | (gating & F.col("icon").isin(FAILED, WARNING))
    return s.agg(F.count("*").alias("steps"), F.count_if(F.col("icon") == FAILED).alias("failed"), F.count_if(F.col("icon") == WARNING).alias("warnings"), F.coalesce(~F.bool_or(bad), F.lit(True)).alias("clean"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """(type, n), most first."""
    return issues.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def status_line(issues: DataFrame, what: str) -> DataFrame:
    """(icon, line): one row that sums up a step's issues."""
    n = issues.agg(F.count("*").alias("n"))
    return n.select(F.when(F.col("n") == 0, CLEAN).otherwise(WARNING).alias("icon"), F.when(F.col("n") == 0, F.lit(f"{CLEAN} {what}: clean")).otherwise(F.format_string(f"{WARNING} {what}: %d", "n")).alias("line"))
