"""Diff sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritline.functions.text import newline_breaks

WORKTREE = "WORKTREE"


def read_diffs(spark: SparkSession, path: str, *, repo_id: int = 0, base: str = "origin/main", head: str = "") -> DataFrame:
    """One row per diff file: (repo_id, target, diff_text)."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(repo_id).cast("bigint").alias("repo_id"),
        target_label(F.lit(base), F.lit(head)).alias("target"),
        F.col("value").alias("diff_text"),
    )


def read_diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of diff files of any size: (diff, block, nth, piece, text).

    ``diff`` is the file; its lines are in order of the other three: where the file's part that a task read starts, the
    line's place among those the task read, and its place in a line that other line breaks cut further. Lines are
    for :func:`gritline.operators.diff_ranges.parse_diff_lines`.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("diff"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.split(newline_breaks(F.col("value")), "\n").alias("pieces"),
    )
    return read.select("diff", "block", "nth", F.posexplode("pieces").alias("piece", "text"))


DIFF_LINE_ORDER = ("block", "nth", "piece")


def target_label(base: Column, head: Column) -> Column:
    """``base...head``; an empty head is the working tree."""
    return F.concat_ws("...", base, F.coalesce(F.nullif(head, F.lit("")), F.lit(WORKTREE)))


def failed_diffs(diffs: DataFrame) -> DataFrame:
    """Error rows of diffs that could not be produced."""
    return diffs.where(F.col("diff_text").isNull()).select(
        "repo_id", F.lit("").alias("path"), F.lit("diff failed: no text").alias("error")
    )
