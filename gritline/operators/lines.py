"""Files to numbered lines and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions import text as tx


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line; every other column but ``content`` is carried along.

    Works inside the row, so it needs no shuffle. Files without content or with
    no lines give no rows.
    """
    keep = [c for c in files.columns if c != "content"]
    return (
        files.where(F.col("content") != "")
        .select(*keep, F.posexplode(tx.raw_lines(F.col("content"))).alias("_pos", "_line"))
        .select(
            *keep,
            (F.col("_pos") + 1).alias("line_no"),
            tx.end_trim_break(F.col("_line")).alias("text"),
        )
    )


def fold_lines(lines: DataFrame, key: list[str], text: Column | None = None, sep: str = "\n") -> DataFrame:
    """Lines back to one ``content`` per key, in ``line_no`` order.

    A file's text is one value by nature, so its lines meet in one task whatever their number.
    """
    text = F.col("text") if text is None else text
    folded = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("text")))).alias("_lines"))
    return folded.select(*key, F.array_join(F.col("_lines.text"), sep).alias("content"))


def file_stats(files: DataFrame) -> DataFrame:
    """Lines (newlines plus one) and bytes of every file."""
    return files.select(
        "repo_id",
        "path",
        tx.line_count(F.col("content")).alias("line_count"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


def line_classes(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_class", tx.line_class(F.col("text"), F.col("language")))
