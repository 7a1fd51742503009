"""Restricting work and findings to changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritline.vocab import FOCUS_SUMMARY_LINES


def _restrict(rows: DataFrame, focus: DataFrame, file: str, line: str) -> DataFrame:
    wanted = focus.select("repo_id", F.col("path").alias(file), F.col("line_no").cast("int").alias(line))
    return rows.withColumn(line, F.col(line).cast("int")).join(wanted, ["repo_id", file, line], "left_semi")


def restrict_lines(lines: DataFrame, focus: DataFrame) -> DataFrame:
    """Lines to scan: those in focus, and all lines of files without a focus.

    ``has_focus`` tells the two apart, so an empty focus keeps nothing. Line rules see one
    line at a time, which makes it safe to drop lines before the rules run.
    """
    if "has_focus" not in lines.columns:
        return _restrict(lines, focus, "path", "line_no")
    free = lines.where(~F.col("has_focus"))
    return free.unionByName(_restrict(lines.where("has_focus"), focus, "path", "line_no"))


def restrict_findings(findings: DataFrame, focus: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Findings in focus. ``units`` (repo_id, path, has_focus) names files without one."""
    kept = _restrict(findings, focus, "file", "line")
    if units is None:
        return kept
    free = units.where(~F.col("has_focus")).select("repo_id", F.col("path").alias("file"))
    return kept.unionByName(findings.join(free, ["repo_id", "file"], "left_semi"))


def focus_summary(focus: DataFrame, shown: int = FOCUS_SUMMARY_LINES) -> DataFrame:
    """Per file the first changed lines as text, with the number left out."""
    lines = focus.select("repo_id", "path", "line_no").distinct()
    in_file = Window.partitionBy("repo_id", "path").orderBy("line_no")
    head = (
        lines.withColumn("_n", F.row_number().over(in_file))
        .where(F.col("_n") <= shown)
        .groupBy("repo_id", "path")
        .agg(F.array_sort(F.collect_list("line_no")).alias("_head"))
    )
    counts = lines.groupBy("repo_id", "path").agg(F.count("*").alias("n_focus"))
    text = F.array_join(F.transform("_head", lambda n: n.cast("string")), ", ")
    more = F.concat(text, F.lit(", … (+"), (F.col("n_focus") - shown).cast("string"), F.lit(" more)"))
    return counts.join(head, ["repo_id", "path"]).select(
        "repo_id", "path", "n_focus", F.when(F.col("n_focus") > shown, more).otherwise(text).alias("summary")
    )
