"""Whole scans: the operators put together."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gritline.operators import findings as fd
from gritline.operators import focus as fc
from gritline.operators.diffs import parse_diffs
from gritline.operators.lines import explode_lines, file_stats
from gritline.operators.rules import LINE_RULES, LineRule, line_findings
from gritline.operators.skew import apart, counted, stage
from gritline.operators.syntax import fact_findings, syntax_errors, syntax_facts
from gritline.sources import diffs as ds
from gritline.sources import files as fs
from gritline.sources import reports as rp
from gritline.sources import responses as rs
from gritline.vocab import DEFAULT_MODEL, MAX_BYTES, MAX_FINDINGS_PER_FILE, SEVERITIES


def scan_lines(
    lines: DataFrame, rules: Sequence[LineRule] = LINE_RULES, focus: DataFrame | None = None
) -> DataFrame:
    """Line rules over numbered lines; with a focus, only over the lines in it."""
    if focus is not None:
        lines = fc.restrict_lines(lines, focus)
    return line_findings(lines, rules)


def scan_files(
    files: DataFrame,
    *,
    focus: DataFrame | None = None,
    min_confidence: float = 0.0,
    policies: DataFrame | None = None,
    rules: Sequence[LineRule] = LINE_RULES,
    cap: int = MAX_FINDINGS_PER_FILE,
) -> DataFrame:
    """Line and syntax findings of files, in focus, confident enough, capped per file.

    ``files`` has repo_id, path, language and content, and may have ``has_focus``.
    """
    keep = [c for c in ("repo_id", "path", "language", "content", "has_focus") if c in files.columns]
    files = files.select(*keep)
    by_line = scan_lines(explode_lines(files), rules, focus)
    by_syntax = fact_findings(syntax_facts(files))
    if focus is not None:
        units = files.select("repo_id", "path", "has_focus") if "has_focus" in keep else None
        by_syntax = fc.restrict_findings(by_syntax, focus, units)
    found = fd.min_confidence(by_line.unionByName(by_syntax), min_confidence)
    if policies is not None:
        found = fd.policy_confidence(found, policies)
    return fd.cap_per_file(found, cap)


def run_scan(
    files: DataFrame, errors: DataFrame, *, scans: DataFrame | None = None, target: str = "repo/", **options
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Scan files and write the findings once: headers, findings, and totals that were observed while writing.

    Headers are those of :func:`scan_headers`, with the seconds that the scan took as ``duration_s``; they read the written
    findings, so the contents are scanned only once. The totals, ``total`` and one for each severity, come from that one
    pass and are complete when this returns. ``options`` are those of :func:`scan_files`.
    """
    seen = Observation()
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    found = scan_files(files, **options).observe(seen, F.count(F.lit(1)).alias("total"), *counts)
    started = time.monotonic()
    written = stage(found)
    seconds = round(time.monotonic() - started, 3)
    headers = scan_headers(files, written, errors, target=target, scans=scans)
    return headers.withColumn("duration_s", F.lit(seconds)), written, dict(seen.get)


def scan_buffers(files: DataFrame, **options) -> DataFrame:
    """Scan buffers: any path is accepted, unknown languages count as text."""
    return scan_files(fs.buffers(files), **options)


def changed_files(diffs: DataFrame, files: DataFrame, *, include=None, exclude=None, max_bytes: int = MAX_BYTES):
    """Current files that a diff touched, and their changed lines.

    Files that are gone, too large, not supported or filtered out take their lines with them.
    The changed lines are written down once, as they are used twice, and so are the names of their files; a short list
    of either goes to every task, so that no content is moved, and a long one doesn't. So are the files that
    a diff touched, as line rules, syntax rules and counts all read them; other contents are not copied.
    """
    focus = stage(parse_diffs(diffs.select("repo_id", "diff_text")))
    touched = stage(focus.select("repo_id", "path").distinct())
    known = fs.with_language(counted(touched)).where(F.col("language").isNotNull())
    known = known.where(fs.passes_globs(F.col("path"), include, exclude))
    current = fs.within_size(files.select("repo_id", "path", "content"), max_bytes)
    return stage(known.join(current, ["repo_id", "path"])), counted(focus)


def scan_diffs(diffs: DataFrame, files: DataFrame, *, include=None, exclude=None, max_bytes: int = MAX_BYTES, **options) -> DataFrame:
    """Findings on the lines that the diffs of a repository touched."""
    chosen, focus = changed_files(diffs, files, include=include, exclude=exclude, max_bytes=max_bytes)
    return scan_files(chosen, focus=focus, **options)


def scan_responses(
    files: DataFrame,
    responses: DataFrame,
    *,
    focus: DataFrame | None = None,
    min_confidence: float = 0.0,
    rules: Sequence[LineRule] = LINE_RULES,
) -> DataFrame:
    """Model findings, and rule findings for files without a good response.

    Model findings are not capped. The parsed answers are written down once, because both the
    findings and the list of files without an answer come from them. So are the files without an answer.
    ``responses`` may be those of :func:`gritline.sources.responses.parse_responses`, written down already.
    """
    parsed = responses if _is_parsed(responses) else stage(rs.parse_responses(responses))
    modelled = rs.response_findings(parsed, file_stats(files))
    if focus is not None:
        units = files.select("repo_id", "path", "has_focus") if "has_focus" in files.columns else None
        modelled = fc.restrict_findings(modelled, focus, units)
    modelled = fd.min_confidence(modelled, min_confidence)
    unanswered = stage(rs.without_response(files, parsed))  # line and syntax rules read them
    fallback = scan_files(unanswered, focus=focus, min_confidence=min_confidence, rules=rules)
    return modelled.unionByName(fallback)


def _is_parsed(responses: DataFrame) -> bool:
    return {"items", "good"} <= set(responses.columns) and "payload" not in responses.columns


def scan_errors(files: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Error rows (repo_id, path, error): unreadable files, failed parses, failed responses (parsed already, or not)."""
    parts = [fs.read_errors(files), syntax_errors(syntax_facts(files))]
    if responses is not None:
        parts.append(rs.response_errors(responses if _is_parsed(responses) else rs.parse_responses(responses)))
    return reduce(DataFrame.unionByName, parts)


def scan_headers(
    files: DataFrame,
    findings: DataFrame,
    errors: DataFrame,
    *,
    model: str = "",
    mode: str = "heuristic",
    target: str = "repo/",
    scans: DataFrame | None = None,
) -> DataFrame:
    """One row per scan: target, mode, model, files, errors, counts.

    ``scans`` lists the scans (repo_id, and target if they have names of their own). Without it they
    are those with a file or an error. A scan that read no file has a row like any other.
    """
    if scans is None:
        scans = files.select("repo_id").union(errors.select("repo_id"))
    if "target" not in scans.columns:
        scans = scans.withColumn("target", F.concat(F.lit(target), F.col("repo_id").cast("string")))
    scanned = files.groupBy("repo_id").agg(F.count("*").alias("files_scanned"))
    failed = errors.groupBy("repo_id").agg(F.count("*").alias("n_errors"))
    counts = fd.severity_counts(findings)
    return (
        scans.select("repo_id", "target").distinct()
        .join(apart(scanned), "repo_id", "left")
        .join(apart(failed), "repo_id", "left")
        .join(apart(counts), "repo_id", "left")
        .na.fill(0)
        .select(
            "repo_id", "target", F.lit(mode).alias("mode"), F.lit(model).alias("model"), "files_scanned", "n_errors",
            *[c for c in counts.columns if c != "repo_id"],
        )
    )


def diff_report(
    diffs: DataFrame, files: DataFrame, *, include=None, exclude=None, max_bytes: int = MAX_BYTES, **options
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Result of diff scans: headers, findings, paths and errors.

    ``diffs`` has repo_id, target and diff_text. A diff that failed (null text) gives a header with an
    error and no files.
    """
    chosen, focus = changed_files(diffs, files, include=include, exclude=exclude, max_bytes=max_bytes)
    found = scan_files(chosen, focus=focus, **options)
    errors = ds.failed_diffs(diffs)
    headers = scan_headers(chosen, found, errors, scans=diffs.select("repo_id", "target"))
    return headers, found, chosen.select("repo_id", "path"), errors


def reloaded(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Saved reports, parsed, as headers, findings, paths and errors to render again.

    Counts come from the findings, as stored ones may be wrong; the report id is the repository.
    """
    scans = rp.report_scans(parsed).withColumnRenamed("report_id", "repo_id")
    found = rp.report_findings(parsed)
    counts = fd.severity_counts(found)
    headers = (
        scans.select("repo_id", "target", "mode", "model", "files_scanned", F.size("errors").cast("bigint").alias("n_errors"))
        .join(apart(counts), "repo_id", "left")
        .na.fill(0)
    )
    paths = scans.select("repo_id", F.explode("paths").alias("path"))
    errors = scans.select("repo_id", F.lit("").alias("path"), F.explode("errors").alias("error"))
    return headers, found, paths, errors


def mode_of(responses: DataFrame | None) -> str:
    """``ai`` when a responses table is supplied, else ``heuristic``; one mode per scan."""
    return "heuristic" if responses is None else "ai"


def model_label(mode: str, model: str = DEFAULT_MODEL) -> str:
    return model if mode == "ai" else ""
