"""Findings: normalisation, focus, confidence, order, cap and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritline.functions import severity as sv
from gritline.operators.skew import keyed_join, position_in_group
from gritline.vocab import ERRORS_SHOWN, MAX_FINDINGS_PER_FILE, SEVERITIES, SEVERITY_RANK


def normalize_findings(raw: DataFrame) -> DataFrame:
    """Bring loose findings into the closed vocabulary and valid ranges."""
    line = F.greatest(F.lit(1), F.coalesce(F.col("line").try_cast("int"), F.lit(1)))
    end_line = F.greatest(F.col("line"), F.coalesce(F.col("end_line").try_cast("int"), F.col("line")))
    return (
        raw.withColumns(
            {
                "severity": sv.coerce_severity(F.col("severity")),
                "category": sv.normalize_category(F.col("category")),
                "title": sv.normalize_title(F.col("title")),
                "line": line,
                "confidence": sv.clamp_confidence(F.col("confidence")),
            }
        )
        .withColumn("end_line", end_line)
        .withColumn(
            "rule_id",
            F.coalesce(F.nullif(F.col("rule_id"), F.lit("")), sv.rule_id(F.col("category"), F.col("title"))),
        )
    )


def rank_of(severity: str = "severity") -> Column:
    return sv.severity_rank(F.col(severity))


def report_order() -> list[Column]:
    """Rank, file, line and confidence; emission order settles the rest."""
    return [rank_of().desc(), F.col("file"), F.col("line"), F.col("confidence").desc(), F.col("emit_seq")]


def sort_findings(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Findings in report order, scan by scan (a range-partitioned sort)."""
    return findings.orderBy(*[F.col(c) for c in (by or ["repo_id"])], *report_order())


def number_findings(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Report position of every finding in its scan, however large the scan is."""
    return position_in_group(findings, by or ["repo_id"], report_order(), "position")


def cap_per_file(findings: DataFrame, cap: int = MAX_FINDINGS_PER_FILE) -> DataFrame:
    """The first findings of each file by rank, line and emission.

    Each task keeps at most ``cap`` rows per file before the shuffle.
    """
    in_file = Window.partitionBy("repo_id", "file").orderBy(rank_of().desc(), "line", "emit_seq")
    return findings.withColumn("_n", F.row_number().over(in_file)).where(F.col("_n") <= cap).drop("_n")


def min_confidence(findings: DataFrame, minimum: float) -> DataFrame:
    return findings.where(F.col("confidence") >= minimum) if minimum > 0 else findings


def policy_confidence(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Confidence filter with a threshold per repository; none means zero."""
    limits = policies.select("repo_id", F.col("min_confidence").alias("_min"))
    joined = keyed_join(findings, limits, ["repo_id"], ["file", "line"], "left")
    return joined.where(F.col("confidence") >= F.coalesce("_min", F.lit(0.0))).drop("_min")


def at_or_above(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(rank_of() >= SEVERITY_RANK[threshold])


def severity_counts(findings: DataFrame, scans: DataFrame | None = None, by: str = "repo_id") -> DataFrame:
    """Findings per severity and in total; scans without findings get zeros."""
    counted = findings.groupBy(by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total")
    )
    if scans is None:
        return counted
    return scans.select(by).distinct().join(counted, by, "left").na.fill(0, [*SEVERITIES, "total"])


def count_at_or_above(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.groupBy("repo_id").agg(
        F.count_if(rank_of() >= SEVERITY_RANK[threshold]).alias("n_at_or_above")
    )


def findings_by_file(findings: DataFrame) -> DataFrame:
    """One row per file: count, worst severity rank and its ``line:title`` list.

    Takes capped findings, so a file's list is bounded.
    """
    entry = F.struct((-rank_of()).alias("r"), "line", (-F.col("confidence")).alias("c"), "emit_seq", "title")
    listed = F.transform(
        F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["line"].cast("string"), x["title"])
    )
    return findings.groupBy("repo_id", "file").agg(
        F.count("*").alias("n_findings"),
        F.max(rank_of()).alias("worst_rank"),
        F.array_join(listed, "; ").alias("listing"),
    )


def file_order(findings: DataFrame) -> DataFrame:
    """Files of a scan by first appearance in the report: worst rank, then name."""
    worst = findings.groupBy("repo_id", "file").agg(F.max(rank_of()).alias("worst_rank"))
    return position_in_group(worst, ["repo_id"], [F.col("worst_rank").desc(), F.col("file")], "file_position")


def first_errors(errors: DataFrame, shown: int = ERRORS_SHOWN) -> DataFrame:
    """Per scan the number of errors and the first few of them, in path order."""
    in_scan = Window.partitionBy("repo_id").orderBy("path", "error")
    head = (
        errors.withColumn("_n", F.row_number().over(in_scan))
        .where(F.col("_n") <= shown)
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "error"))).alias("_head"))
    )
    counts = errors.groupBy("repo_id").agg(F.count("*").alias("n_errors"))
    return counts.join(head, "repo_id").select(
        "repo_id", "n_errors", F.array_join(F.col("_head.error"), "\n").alias("first_errors")
    )
