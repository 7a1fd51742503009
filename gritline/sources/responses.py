"""Reviewer-model tables: request rows out, response rows back to findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions import severity as sv
from gritline.functions import text as tx
from gritline.functions import variants as vx
from gritline.operators.focus import focus_summary
from gritline.operators.skew import apart, counted, once, stage
from gritline.schemas import FINDING_COLUMNS
from gritline.vocab import CATEGORIES, DEFAULT_CATEGORY, DEFAULT_MAX_TOKENS, DEFAULT_MODEL, REVIEW_TOOL, SEVERITIES

# --- fixed values: request text ---------------------------------------------------------
SCOPE_TEXT = (
    "Review scope: this is part of a pull request. Focus ONLY on issues "
    "introduced or affected by the changed lines listed below; ignore "
    "pre-existing problems elsewhere in the file."
)
FOCUS_LABEL = "Changed lines (new-file numbering): "
CODE_LABEL = "Code (line numbers are authoritative):"
FENCE = "```"

# --- fixed values: fields of a response item -------------------------------------------------
ITEM_FIELDS = ("line", "end_line", "severity", "category", "title", "description", "suggestion", "confidence")


def request_text(focus: Column) -> Column:
    """User message of one file; ``focus`` is the focus summary or null."""
    scope = F.when(focus.isNotNull(), F.concat(F.lit(SCOPE_TEXT + "\n" + FOCUS_LABEL), focus))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), F.col("path")),
        F.concat(F.lit("Language: "), F.col("language")),
        scope,
        F.lit(""),
        F.lit(CODE_LABEL),
        F.lit(FENCE),
        tx.number_lines(F.col("content")),
        F.lit(FENCE),
    )


def build_requests(
    files: DataFrame,
    focus: DataFrame | None = None,
    *,
    model: str = DEFAULT_MODEL,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    temperature: float = 0.0,
) -> DataFrame:
    """One request row per file, with the scope paragraph where lines are in focus."""
    if focus is None:
        summed = files.withColumn("summary", F.lit(None).cast("string"))
    else:
        summed = files.join(focus_summary(focus).drop("n_focus"), ["repo_id", "path"], "left")
    return summed.select(
        "repo_id",
        "path",
        F.lit(model).alias("model"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
        F.lit(REVIEW_TOOL).alias("tool"),
        request_text(F.col("summary")).alias("prompt"),
    )


def response_tool() -> dict:
    """JSON schema that a reviewer's answer has to follow."""
    text, whole, number = {"type": "string"}, {"type": "integer"}, {"type": "number"}
    kinds = {"line": whole, "end_line": whole, "confidence": number}
    kinds["severity"] = {**text, "enum": list(SEVERITIES)}
    kinds["category"] = {**text, "enum": list(CATEGORIES)}
    finding = {name: kinds.get(name, text) for name in ITEM_FIELDS}
    required = [name for name in finding if name not in ("end_line", "confidence")]
    item = {"type": "object", "properties": finding, "required": required}
    findings = {"type": "array", "items": item}
    return {
        "name": REVIEW_TOOL,
        "input_schema": {"type": "object", "properties": {"findings": findings}, "required": ["findings"]},
    }


def request_bodies(requests: DataFrame, system: str = "") -> DataFrame:
    """The rows of :func:`build_requests` with ``body``, the whole request as JSON: settings, the system text that the caller
    gives, the answer's schema and the message. A null prompt gives a null body; other columns stay."""
    settings = F.to_json(F.struct("model", "max_tokens", "temperature", F.lit(system).alias("system")))
    message = F.to_json(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    tool = json.dumps(response_tool(), separators=(",", ":"))
    choice = json.dumps({"type": "tool", "name": REVIEW_TOOL}, separators=(",", ":"))
    fixed = f',"tools":[{tool}],"tool_choice":{choice},"messages":['
    whole = F.concat(F.substring(settings, F.lit(1), F.length(settings) - 1), F.lit(fixed), message, F.lit("]}"))
    return requests.withColumn("body", F.when(F.col("prompt").isNotNull(), whole))


def _report_input(message: Column) -> Column:
    """Input of the first report block of a message; a bare input is taken as it is."""
    blocks = F.try_variant_get(message, "$.content", "array<variant>")
    reports = F.filter(
        blocks,
        lambda b: (vx.as_text(vx.field(b, "type")) == "tool_use") & (vx.as_text(vx.field(b, "name")) == REVIEW_TOOL),
    )
    bare = F.when(vx.field(message, "findings").isNotNull(), message)
    return F.coalesce(vx.field(F.get(reports, F.lit(0)), "input"), bare)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses with ``items`` (array of variants) and ``good``.

    Good means: the call worked, the payload is JSON, the findings can be iterated and no
    item has an infinite line. A message without a report block is good and empty.
    """
    found = F.col("_found")
    broken = (vx.is_number(found) & (vx.as_double(found) != 0)) | ((vx.as_text(found) == "true") & ~vx.is_text(found))
    parsed = once(responses.select("repo_id", "path", "ok", "payload"), {"_message": F.try_parse_json("payload")})
    reported = once(parsed, {"_found": vx.field(_report_input(F.col("_message")), "findings")})
    items = F.try_variant_get(found, "$", "array<variant>")
    # Lists, the usual answer, aren't broken; the test would write out all that is in them.
    broken = F.when(items.isNull(), broken)

    def endless(item: Column) -> Column:
        ends = vx.is_endless(vx.field(item, "line")) | vx.is_endless(vx.field(item, "end_line"))
        return ends & vx.truthy_text(vx.field(item, "title")).isNotNull()

    # The text is searched first: hardly any answer has a number with a large exponent.
    suspect = F.col("payload").rlike(r"[0-9][eE]\+?[0-9]{3}|[0-9]{300}")
    lost = F.coalesce(suspect & F.exists(items, lambda i: vx.is_object(i) & endless(i)), F.lit(False))
    good = F.coalesce("ok", F.lit(False)) & vx.is_object(F.col("_message")) & ~F.coalesce(broken, F.lit(False)) & ~lost
    return once(reported, {"good": good}).select("repo_id", "path", items.alias("items"), "good")


def response_findings(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of good responses, lines clamped to the file's length.

    ``files`` has (repo_id, path, line_count). Items that are no objects or have no title are
    dropped.
    """
    items = (
        parsed.where("good")
        .join(apart(files.select("repo_id", "path", "line_count")), ["repo_id", "path"])
        .select("repo_id", "path", "line_count", F.posexplode("items").alias("_pos", "_item"))
        .where(vx.is_object(F.col("_item")))
    )
    items = once(items, vx.fields(F.col("_item"), *ITEM_FIELDS)).drop("_item")
    items = once(items, {"title": vx.truthy_text(F.col("v_title"))}).where(F.col("title").isNotNull())

    def get(name: str) -> Column:
        return F.col(f"v_{name}")

    last = F.col("line_count").cast("int")
    line = F.greatest(F.lit(1), F.least(F.coalesce(vx.line_number(get("line")), F.lit(1)), last))
    end = F.greatest(F.col("line"), F.least(F.coalesce(vx.line_number(get("end_line")), F.lit(1)), last))
    return (
        items.withColumns(
            {
                "file": F.col("path"),
                "line": line,
                "severity": sv.coerce_severity(vx.as_text(get("severity"))),
                "category": F.when(get("category").isNull(), F.lit(DEFAULT_CATEGORY)).otherwise(
                    sv.normalize_category(vx.as_text(get("category")))
                ),
                "title": sv.normalize_title(F.col("title")),
                "description": F.coalesce(vx.as_text(get("description")), F.lit("")),
                "suggestion": F.coalesce(vx.as_text(get("suggestion")), F.lit("")),
                "confidence": vx.confidence(get("confidence")),
                "source": F.lit("ai"),
                "code": F.lit(""),
                "emit_seq": F.col("_pos").cast("bigint"),
            }
        )
        .withColumns({"end_line": end, "rule_id": sv.rule_id(F.col("category"), F.col("title"))})
        .select(*FINDING_COLUMNS)
    )


def response_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("good")).select(
        "repo_id", "path", F.concat(F.col("path"), F.lit(": response failed")).alias("error")
    )


def without_response(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files that have no good response and are scanned with the rules instead.

    The keys of those files are worked out first, written down and counted: if they are few, as a rule,
    the contents stay where they are.
    """
    keys = ["repo_id", "path"]
    missing = stage(files.select(*keys).join(apart(parsed.where("good").select(*keys)), keys, "left_anti"))
    return files.join(counted(missing), keys, "left_semi")
