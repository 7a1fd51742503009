"""Saved reports: JSON documents back to scans, findings and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions import severity as sv
from gritline.functions import variants as vx
from gritline.operators.skew import once
from gritline.schemas import FINDING_COLUMNS


# --- fixed values: fields of a finding in a report ------------------------------------------
FINDING_FIELDS = (
    "file", "line", "end_line", "severity", "category", "title", "description", "suggestion", "confidence",
    "rule_id", "source", "code",
)


def parse_reports(reports: DataFrame) -> DataFrame:
    """(report_id, body) to (report_id, report, good); good means a JSON object."""
    parsed = once(reports.select("report_id", "body"), {"report": F.try_parse_json("body")})
    return once(parsed.drop("body"), {"good": vx.is_object(F.col("report"))})


def report_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("good")).select("report_id", F.lit("invalid JSON report").alias("error"))


def report_scans(parsed: DataFrame) -> DataFrame:
    """Scan headers; stored counts are ignored."""
    report = F.col("report")

    def or_default(name: str, default: str) -> Column:
        return F.coalesce(vx.truthy_text(vx.field(report, name)), F.lit(default))

    def texts(name: str) -> Column:
        found = F.try_variant_get(report, f"$.{name}", "array<string>")
        return F.coalesce(found, F.array().cast("array<string>"))

    files = vx.bounded(F.coalesce(vx.as_whole(vx.field(report, "files_scanned")), F.lit(0.0)), 2.0**53)
    return parsed.where("good").select(
        "report_id",
        or_default("target", "").alias("target"),
        or_default("mode", "ai").alias("mode"),
        or_default("model", "").alias("model"),
        files.cast("bigint").alias("files_scanned"),
        F.coalesce(vx.as_double(vx.field(report, "duration_s")), F.lit(0.0)).alias("duration_s"),
        texts("paths").alias("paths"),
        texts("errors").alias("errors"),
    )


def report_findings(parsed: DataFrame) -> DataFrame:
    """Findings of saved reports, normalised; items that are no objects are dropped.

    ``repo_id`` holds the report id.
    """
    items = (
        parsed.where("good")
        .select(
            F.col("report_id").alias("repo_id"),
            F.posexplode(F.try_variant_get("report", "$.findings", "array<variant>")).alias("_pos", "_item"),
        )
        .where(vx.is_object(F.col("_item")))
    )
    items = once(items, vx.fields(F.col("_item"), *FINDING_FIELDS)).drop("_item")

    def get(name: str) -> Column:
        return F.col(f"v_{name}")

    def text(name: str) -> Column:
        return F.coalesce(vx.as_text(get(name)), F.lit(""))

    line = F.greatest(F.lit(1), F.coalesce(vx.line_number(get("line")), F.lit(1)))
    end = F.greatest(F.col("line"), F.coalesce(vx.line_number(get("end_line")), F.col("line")))
    return (
        items.withColumns(
            {
                "file": text("file"),
                "line": line,
                "severity": sv.coerce_severity(vx.as_text(get("severity"))),
                "category": sv.normalize_category(vx.as_text(get("category"))),
                "title": sv.normalize_title(vx.truthy_text(get("title"))),
                "description": text("description"),
                "suggestion": text("suggestion"),
                "confidence": vx.confidence(get("confidence")),
                "source": F.when(get("source").isNull(), "ai").otherwise(text("source")),
                "code": text("code"),
                "emit_seq": F.col("_pos").cast("bigint"),
            }
        )
        .withColumns(
            {
                "end_line": end,
                "rule_id": F.coalesce(
                    vx.truthy_text(get("rule_id")), sv.rule_id(F.col("category"), F.col("title"))
                ),
            }
        )
        .select(*FINDING_COLUMNS)
    )
