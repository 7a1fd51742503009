"""Scan requests: JSON bodies to buffers to scan, and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions import paths as px
from gritline.functions import variants as vx
from gritline.operators.skew import once

DEFAULT_PATH = "buffer"


def validate_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``status``: ``ok``, ``invalid_json``, ``missing_content`` or ``bad_focus``.

    An empty body reads as an empty object; a body that is no object is invalid. A focus is bad if
    an element of the list is no whole number, nor text or a number that can be cut to one.
    """
    text = F.when(F.coalesce(body, F.lit("")) == "", "{}").otherwise(F.col(body))
    content = vx.field(F.col("request"), "content")
    status = (
        F.when(~vx.is_object(F.col("request")), "invalid_json")
        .when(content.isNull() | F.is_variant_null(content), "missing_content")
        .when(F.exists(_focus(F.col("request")), lambda x: vx.line_number(x).isNull() | vx.is_endless(x)), "bad_focus")
        .otherwise("ok")
    )
    return once(once(requests, {"request": F.try_parse_json(text)}), {"status": status})


def _focus(request: Column) -> Column:
    """The focus list as variants; null if there is none or it is no list."""
    listed = vx.field(request, "focus_lines")
    return F.when(vx.is_array(listed), F.try_variant_get(listed, "$", "array<variant>"))


def request_units(validated: DataFrame) -> DataFrame:
    """Buffers of valid requests: path, language, content, kind, focus and its flag.

    An empty focus list is a focus on nothing; no list means the whole file. The kind is
    ``diff`` only when some line is in focus.
    """
    request = F.col("request")
    focus = F.transform(_focus(request), vx.line_number)
    path = F.coalesce(vx.as_text(vx.field(request, "path")), F.lit(DEFAULT_PATH))
    language = F.coalesce(vx.truthy_text(vx.field(request, "language")), px.language_for(F.col("path")), F.lit("text"))
    kept = [c for c in validated.columns if c not in ("request", "status", "path", "body")]
    return (
        validated.where(F.col("status") == "ok")
        .withColumn("path", path)
        .select(
            *kept,
            "path",
            language.alias("language"),
            vx.as_text(vx.field(request, "content")).alias("content"),
            focus.isNotNull().alias("has_focus"),
            F.array_distinct(F.coalesce(focus, F.array().cast("array<int>"))).alias("focus_lines"),
            F.when(F.size(F.coalesce(focus, F.array().cast("array<int>"))) > 0, "diff").otherwise("file").alias("kind"),
        )
    )


def request_focus(units: DataFrame) -> DataFrame:
    return units.select("repo_id", "path", F.explode("focus_lines").alias("line_no"))
