"""Severity, category, title, line and confidence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritline.functions.text import strip
from gritline.vocab import (
    CATEGORIES,
    DEFAULT_CATEGORY,
    DEFAULT_SEVERITY,
    DEFAULT_TITLE,
    JUNK_CONFIDENCE,
    PRODUCT,
    SEVERITIES,
    SEVERITY_EMOJI,
    SEVERITY_RANK,
)

_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_NOT_FINITE = r"^(?i)[+-]?(?:nan|inf|infinity)$"


def _case(key: Column, table: dict, default) -> Column:
    out = None
    for value, result in table.items():
        out = F.when(key == value, F.lit(result)) if out is None else out.when(key == value, F.lit(result))
    return out.otherwise(default)


def severity_rank(severity: Column) -> Column:
    return _case(severity, SEVERITY_RANK, F.lit(None)).cast("int")


def coerce_severity(value: Column, default: str = DEFAULT_SEVERITY) -> Column:
    """Trim and lower-case; unknown or null becomes the default."""
    cleaned = F.lower(strip(value))
    return F.when(cleaned.isin(*SEVERITIES), cleaned).otherwise(F.lit(default))


def normalize_category(value: Column) -> Column:
    cleaned = F.lower(strip(value))
    return F.when(cleaned.isin(*CATEGORIES), cleaned).otherwise(F.lit(DEFAULT_CATEGORY))


def normalize_title(value: Column) -> Column:
    """Empty or null becomes the default title; a blank one becomes empty."""
    return strip(F.coalesce(F.nullif(value, F.lit("")), F.lit(DEFAULT_TITLE)))


def clamp_confidence(value: Column) -> Column:
    """Clamp to [0, 1]; NaN counts as 1 and null as the junk value."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(value.isNull(), F.lit(JUNK_CONFIDENCE)).otherwise(bounded)


def parse_number(text: Column) -> Column:
    """Double from text, null for anything that is not a plain number."""
    cleaned = strip(text)
    return F.when(
        cleaned.rlike(_NUMBER) | cleaned.rlike(_NOT_FINITE), cleaned.try_cast("double")
    )


def parse_integer(text: Column) -> Column:
    """Integral double from text, null for fractions and anything else."""
    cleaned = strip(text)
    return F.when(cleaned.rlike(r"^[+-]?[0-9]+$"), cleaned.try_cast("double"))


def rule_id(category: Column, title: Column) -> Column:
    """``<product>/<category>/<8 hex digits of the category and title>``."""
    digest = F.substring(F.sha2(F.lower(F.concat_ws(":", category, title)), 256), 1, 8)
    return F.concat_ws("/", F.lit(PRODUCT), category, digest)


def emoji(severity: Column) -> Column:
    return _case(severity, SEVERITY_EMOJI, F.lit(""))


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("critical", "high"), "error")
        .when(severity == "medium", "warning")
        .otherwise("note")
    )


def editor_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("critical", "high"), "Error")
        .when(severity == "medium", "Warning")
        .when(severity == "low", "Information")
        .otherwise("Hint")
    )


def location(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))


def span(line: Column, end_line: Column) -> Column:
    start = F.concat(F.lit("L"), line.cast("string"))
    return F.when(end_line == line, start).otherwise(
        F.concat(start, F.lit("-"), end_line.cast("string"))
    )


def round3(value: Column) -> Column:
    return F.bround(value, 3)
