"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritline.functions import paths as px
from gritline.functions import severity as sv
from gritline.functions import text as tx
from gritline.operators import findings as fd
from gritline.operators import focus as fc
from gritline.operators import policy as pol
from gritline.operators import rules as rl
from gritline.operators import syntax_trees as trees
from gritline.operators.diff_ranges import parse_diff_lines
from gritline.operators.diffs import parse_diffs
from gritline.operators.lines import explode_lines, file_stats, line_classes
from gritline.operators.skew import position_in_group, shared_dir, spread, stage, stage_each
from gritline.operators.syntax import syntax_facts, syntax_findings
from gritline.plans import fixtures as fx
from gritline.plans import scans as sc
from gritline.sinks import documents as doc
from gritline.sinks import rows as rw
from gritline.schemas import FINDINGS
from gritline.sources import diffs as ds
from gritline.sources import files as fs
from gritline.sources import reports as rp
from gritline.sources import requests as rq
from gritline.sources import responses as rs
from gritline.streaming import saves as st
from gritline.vocab import EXTENSION_LANGUAGE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- files -------------------------------------------------------------------------------


@query
def language_detect(spark, sf):
    return fx.file_list(spark, sf).select("repo_id", "path", "language")


@query
def language_join(spark, sf):
    """The extension map as a dimension table (30 rows, so it is broadcast)."""
    dim = spark.createDataFrame(list(EXTENSION_LANGUAGE.items()), "ext string, language string")
    files = fx.file_list(spark, sf).select("repo_id", "path", px.extension(F.col("path")).alias("ext"))
    return files.join(F.broadcast(dim), "ext").groupBy("language", "ext").agg(F.count("*").alias("n_files"))


@query
def glob_filter(spark, sf):
    files = fx.file_list(spark, sf)
    keep = fs.passes_globs(F.col("path"), ["src/*", "*.ts", "m?[0-4].*"], ["**/vendor/**", "*.min.js"])
    return files.where(keep).select("repo_id", "path")


@query
def skip_dirs(spark, sf):
    return fx.file_list(spark, sf).where(~px.in_skipped_dir(F.col("path"))).select("repo_id", "path")


@query
def manifest_semi(spark, sf):
    """Files on the manifest; the listing names a file once per returned line."""
    listing = fx.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        (F.col("l_orderkey") % fx.N_REPOS).alias("repo_id"),
        F.concat(F.lit(" "), F.expr(fx.PATH_SQL)).alias("path"),
    )
    files = fx.file_list(spark, sf).drop("language")
    return fs.select_files(files, manifest=fs.manifest_entries(listing)).select("repo_id", "path", "language")


@query
def max_files(spark, sf):
    return fs.first_files(fx.file_list(spark, sf), 25).select("repo_id", "path")


@query
def size_filter(spark, sf):
    files = file_stats(fs.within_size(fx.code_files(spark, sf), 100))
    return files.select("repo_id", "path", "n_bytes")


@query
def file_stats_query(spark, sf):
    return file_stats(fx.code_files(spark, sf))


QUERIES["file_stats"] = QUERIES.pop("file_stats_query")


# --- lines ---------------------------------------------------------------------------------


@query
def explode_lines_query(spark, sf):
    return explode_lines(fx.code_files(spark, sf)).select("repo_id", "path", "language", "line_no", "text")


QUERIES["explode_lines"] = QUERIES.pop("explode_lines_query")


@query
def number_lines(spark, sf):
    files = fx.code_files(spark, sf)
    return files.select("repo_id", "path", tx.number_lines(F.col("content")).alias("numbered"))


@query
def line_class(spark, sf):
    classes = line_classes(fx.code_lines(spark, sf))
    return classes.groupBy("language", "line_class").agg(F.count("*").alias("n_lines"))


# --- rules -----------------------------------------------------------------------------------


def findings(spark, sf) -> DataFrame:
    """Capped findings of the line rules over F1."""
    return fd.cap_per_file(rl.line_findings(fx.code_lines(spark, sf)))


@query
def rule_catalogue(spark, sf):
    """The catalogue with the hits and files of each rule, rules without hits included."""
    hits = rl.line_hits(fx.code_lines(spark, sf)).groupBy("rule_idx").agg(F.count("*").alias("n_hits"))
    rules = rl.rule_table(spark).select("rule_idx", "rule_id", "severity", "category", "title", "confidence")
    return rules.join(hits, "rule_idx", "left").na.fill(0, ["n_hits"])


@query
def line_findings(spark, sf):
    return rl.line_findings(fx.code_lines(spark, sf))


@query
def secret_scan(spark, sf):
    rule = rl.LINE_RULES[2]
    lines = rl.with_folded(fx.code_lines(spark, sf))
    value = F.regexp_extract("text", rule.pattern, rule.value_group)
    columns = [F.col(c) for c in ("text", "language", "_folded", "_wide")]
    found = lines.where(rl.rule_matches(rule, *columns))
    return found.select("repo_id", "path", "line_no", value.alias("value"))


@query
def rule_hits(spark, sf):
    hits = rl.line_hits(fx.code_lines(spark, sf))
    return hits.groupBy("language", "rule_idx").agg(F.count("*").alias("n_hits"))


@query
def rule_theta_join(spark, sf):
    """Rules as a table, met by the lines without pairing them."""
    hits = rl.table_rule_hits(fx.code_lines(spark, sf), rl.rule_table(spark))
    return hits.groupBy("language", "rule_idx").agg(F.count("*").alias("n_hits"))


@query
def page_script_rules(spark, sf):
    found = sc.scan_files(fx.page_scripts(spark, sf))
    return found.select("repo_id", "file", "line", "rule_id", "code")


@query
def py_facts(spark, sf):
    return syntax_facts(fx.py_files(spark, sf)).select(
        "repo_id", "path", "walk_seq", "kind", "name", "line", "end_line", F.size("children").alias("n_children")
    )


@query
def syntax_findings_query(spark, sf):
    return syntax_findings(fx.py_files(spark, sf)).select(
        "repo_id", "file", "line", "end_line", "severity", "category", "title", "confidence", "rule_id", "code"
    )


QUERIES["syntax_findings"] = QUERIES.pop("syntax_findings_query")


@query
def syntax_patterns(spark, sf):
    """The syntax rules as rows of tree patterns."""
    found = trees.pattern_findings(fx.py_files(spark, sf), trees.tree_steps(spark), trees.tree_texts(spark))
    return found.select(
        "repo_id", "file", "line", "end_line", "severity", "category", "title", "confidence", "rule_id", "code"
    )


@query
def tree_shapes(spark, sf):
    """Nodes by kind, of those kinds that the syntax rules look at."""
    kinds = ["ExceptHandler", "Pass", "FunctionDef", "AsyncFunctionDef", "Compare", "Eq", "NotEq", "None", "List", "Dict", "Set"]
    return trees.tree_shapes(fx.py_files(spark, sf)).where(F.col("kind").isin(kinds))


# --- findings --------------------------------------------------------------------------------


def loose_findings(spark, sf) -> DataFrame:
    """Findings as a sloppy producer would write them, one per order line."""
    k = F.col("l_partkey")
    return fx.raw_lines(spark, sf).select(
        "repo_id",
        F.col("path").alias("file"),
        F.col("line_no").alias("own_line"),
        F.when(k % 4 == 0, -2).when(k % 4 == 1, F.lit(None)).otherwise(F.col("line_no")).alias("line"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, 0).otherwise(F.col("line_no") + 5).alias("end_line"),
        F.when(k % 5 == 0, "\tHIGH ").when(k % 5 == 1, "urgent").when(k % 5 == 2, F.lit(None))
        .when(k % 5 == 3, "Info ").otherwise("critical").alias("severity"),
        F.when(k % 6 == 0, "Security").when(k % 6 == 1, "").when(k % 6 == 2, F.lit(None))
        .when(k % 6 == 3, " docs\n").otherwise("other").alias("category"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, F.lit(None)).when(k % 7 == 2, "   ").otherwise("  A title ").alias("title"),
        F.when(k % 8 == 0, 1.5).when(k % 8 == 1, -0.5).when(k % 8 == 2, F.lit(None))
        .when(k % 8 == 3, F.lit(float("nan"))).otherwise(0.25).alias("confidence"),
        F.when(k % 9 == 0, "own/rule").when(k % 9 == 1, "").otherwise(F.lit(None)).alias("rule_id"),
    )


@query
def normalize_findings(spark, sf):
    return fd.normalize_findings(loose_findings(spark, sf))


@query
def rule_id(spark, sf):
    ids = findings(spark, sf).withColumn("derived", sv.rule_id(F.col("category"), F.col("title")))
    return ids.groupBy("category", "title", "rule_id", "derived").agg(F.count("*").alias("n_findings"))


@query
def severity_rank(spark, sf):
    ranked = findings(spark, sf).withColumn("rank", fd.rank_of())
    return ranked.groupBy("repo_id", "severity", "rank").agg(F.count("*").alias("n_findings"))


@query
def severity_counts(spark, sf):
    repos = fx.file_list(spark, sf).select("repo_id")
    return fd.severity_counts(findings(spark, sf), repos)


@query
def severity_threshold(spark, sf):
    found = findings(spark, sf)
    kept = fd.at_or_above(found, "high").groupBy("repo_id").agg(F.count("*").alias("n_kept"))
    return fd.count_at_or_above(found, "medium").join(kept, "repo_id", "left")


@query
def sorted_findings(spark, sf):
    placed = fd.number_findings(findings(spark, sf))
    return placed.select("repo_id", "position", "file", "line", "severity", "title", "emit_seq")


@query
def min_confidence(spark, sf):
    kept = fd.min_confidence(findings(spark, sf), 0.6)
    return kept.select("repo_id", "file", "line", "rule_id", "confidence")


def large_files(spark, sf) -> DataFrame:
    """F1 as one very large JavaScript file per repository."""
    lines = fx.code_lines(spark, sf, known=False).select("repo_id", "file_id", F.col("line_no").alias("own_no"), "text")
    placed = position_in_group(lines, ["repo_id"], [F.col("file_id"), F.col("own_no")], "line_no")
    return placed.select(
        "repo_id",
        F.concat(F.lit("r"), F.col("repo_id").cast("string"), F.lit(".js")).alias("path"),
        F.lit("javascript").alias("language"),
        F.col("line_no").cast("int").alias("line_no"),
        "text",
    )


@query
def cap_per_file(spark, sf):
    kept = fd.cap_per_file(rl.line_findings(large_files(spark, sf)))
    return kept.select("repo_id", "file", "line", "severity", "rule_id", "emit_seq")


@query
def file_order(spark, sf):
    return fd.file_order(findings(spark, sf))


@query
def finding_location(spark, sf):
    return findings(spark, sf).select(
        "repo_id", "rule_id", sv.location(F.col("file"), F.col("line")).alias("location")
    )


@query
def findings_by_file(spark, sf):
    return fd.findings_by_file(findings(spark, sf))


# --- focus and diffs ---------------------------------------------------------------------------


@query
def focus_semi(spark, sf):
    """Lines of three files in four are restricted to their returned lines."""
    flags = fx.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        (F.col("l_orderkey") % fx.N_REPOS).alias("repo_id"),
        F.expr(fx.PATH_SQL).alias("path"),
        F.col("l_linenumber").alias("line_no"),
    )
    lines = fx.code_lines(spark, sf).withColumn("has_focus", F.col("file_id") % 4 != 0)
    return sc.scan_lines(lines, focus=flags).select("repo_id", "file", "line", "rule_id")


@query
def focus_summary(spark, sf):
    return fc.focus_summary(large_files(spark, sf))


@query
def diff_lines(spark, sf):
    return parse_diffs(fx.diffs(spark, sf))


@query
def diff_lines_ranged(spark, sf):
    """The same diffs, with their lines as rows."""
    return parse_diff_lines(fx.diff_line_rows(spark, sf), ["repo_id", "diff_id", "part"], ["file_id", "at"])


@query
def diff_one_ranged(spark, sf):
    """One diff of all lines there are."""
    return parse_diff_lines(fx.diff_line_rows(spark, sf), [], ["repo_id", "diff_id", "part", "file_id", "at"])


@query
def diff_scan(spark, sf):
    """Current files start with the lines before the hunk; the lib folder is gone."""
    lead = F.expr("repeat(chr(10), cast(file_id % 50 as int))")
    files = fx.code_files(spark, sf, known=False).where(~F.col("path").startswith("lib/"))
    current = files.withColumn("content", F.concat(lead, F.col("content")))
    found = sc.scan_diffs(fx.diffs(spark, sf), current, exclude=["*.min.js"])
    return found.select("repo_id", "file", "line", "rule_id", "code")


@query
def diff_scan_bucketed(spark, sf):
    """The same scan over contents that lie in buckets of their files."""
    lead = F.expr("repeat(chr(10), cast(file_id % 50 as int))")
    files = fx.code_files(spark, sf, known=False).where(~F.col("path").startswith("lib/"))
    current = files.select("repo_id", "path", F.concat(lead, F.col("content")).alias("content"))
    table = fs.save_contents(current, f"contents_{uuid.uuid4().hex}", buckets=8)
    found = sc.scan_diffs(fx.diffs(spark, sf), table, exclude=["*.min.js"])
    return found.select("repo_id", "file", "line", "rule_id", "code")


def _diff_report(spark, sf):
    lead = F.expr("repeat(chr(10), cast(file_id % 50 as int))")
    files = fx.code_files(spark, sf, known=False).where(~F.col("path").startswith("lib/"))
    current = files.withColumn("content", F.concat(lead, F.col("content")))
    head = F.when(F.col("repo_id") % 2 == 1, F.concat(F.lit("h"), F.col("repo_id").cast("string"))).otherwise("")
    diffs = fx.diffs(spark, sf).select(
        "repo_id",
        ds.target_label(F.lit("origin/main"), head).alias("target"),
        F.when(F.col("repo_id") != 3, F.col("diff_text")).alias("diff_text"),
    )
    return sc.diff_report(diffs, current, exclude=["*.min.js"])


@query
def diff_report(spark, sf):
    """Headers of one diff scan per repository; the diffs of repository 3 failed."""
    return _diff_report(spark, sf)[0]


@query
def diff_report_rows(spark, sf):
    """Findings, paths and errors of the same scans."""
    _, found, paths, errors = _diff_report(spark, sf)
    parts = [
        found.select(F.lit("finding").alias("kind"), "repo_id", F.col("file").alias("path"), "line", F.col("rule_id").alias("detail")),
        paths.select(F.lit("path").alias("kind"), "repo_id", "path", F.lit(0).alias("line"), F.lit("").alias("detail")),
        errors.select(F.lit("error").alias("kind"), "repo_id", "path", F.lit(0).alias("line"), F.col("error").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- whole scans ---------------------------------------------------------------------------------


@query
def repo_scan(spark, sf):
    files = fs.select_files(fx.code_files(spark, sf).drop("language"), exclude=["tests/*"])
    found = sc.scan_files(fs.within_size(files), min_confidence=0.5)
    return found.drop("description", "suggestion")


@query
def content_scan(spark, sf):
    """Buffers of any name; those without a known extension count as text."""
    buffers = fx.code_files(spark, sf, known=False).drop("language")
    found = sc.scan_buffers(buffers)
    return found.select("repo_id", "file", "line", "rule_id", "source")


@query
def folder_scan(spark, sf):
    """Findings in the files of folders, none of them over 300 bytes, and an error for each that can't be read."""
    files = stage_each(spark, (fs.read_repository(spark, folder, max_bytes=300) for folder in fx.code_folders(spark, sf)))
    found = sc.scan_files(files).select(F.lit("finding").alias("kind"), F.col("file").alias("path"), "line", F.col("rule_id").alias("detail"))
    errors = fs.read_errors(files).select(F.lit("error").alias("kind"), "path", F.lit(0).alias("line"), F.col("error").alias("detail"))
    return found.unionByName(errors)


@query
def mixed_scan(spark, sf):
    """Python files in which both line and syntax rules find something, one with more than the cap."""
    found = sc.scan_files(fx.mixed_files(spark, sf))
    return found.select("repo_id", "file", "line", "severity", "title", "rule_id")


@query
def user_rule_scan(spark, sf):
    """Rules of a user over the lines of all documents, conversations and pages."""
    rules = spark.createDataFrame(fx.USER_RULES, rl.rule_table(spark).schema)
    hits = rl.table_rule_hits(explode_lines(fx.text_files(spark, sf)), rules)
    return hits.groupBy("repo_id", "rule_idx").agg(F.count("*").alias("n_hits"), F.countDistinct("path").alias("n_files"))


@query
def user_rule_index(spark, sf):
    """2,002 rules over the lines of all documents, conversations and pages, which are read once."""
    files = spread(fx.text_files(spark, sf))  # each line costs much time, and a table of few row groups has few tasks
    hits = rl.table_rule_hits(explode_lines(files), fx.word_rules(spark, sf))
    return hits.groupBy("repo_id", "rule_idx").agg(F.count("*").alias("n_hits"), F.countDistinct("path").alias("n_files"))


@query
def scan_errors(spark, sf):
    files = fx.file_list(spark, sf).withColumn("content", F.when(F.col("file_id") % 13 != 0, "x = 1"))
    errors = sc.scan_errors(files, fx.responses(spark, sf))
    return fd.first_errors(errors)


@query
def scan_header(spark, sf):
    """Repository 7 has no readable file, and the last one no file at all."""
    files = fx.file_list(spark, sf).where(F.col("language").isNotNull())
    gone = (F.col("file_id") % 13 == 0) | (F.col("repo_id") == 7)
    readable = files.withColumn("content", F.when(~gone, "x = 1"))
    return sc.scan_headers(
        readable.where(F.col("content").isNotNull()), findings(spark, sf).where("repo_id <> 7"), fs.read_errors(readable),
        scans=spark.range(fx.N_REPOS + 1).withColumnRenamed("id", "repo_id"),
    )


@query
def scan_header_ai(spark, sf):
    """Scans with a reviewer model: failed calls are errors, and rules stand in for them."""
    files, answers = stage(fx.code_files(spark, sf)), fx.responses(spark, sf)  # rules, errors and counts all read the files
    mode = sc.mode_of(answers)
    parsed = stage(rs.parse_responses(answers))
    found = sc.scan_responses(files, parsed)
    errors = stage(sc.scan_errors(files, parsed.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")))
    return sc.scan_headers(files, found, errors, mode=mode, model=sc.model_label(mode))


# --- policies ----------------------------------------------------------------------------------------


def policies(spark, sf) -> DataFrame:
    layers = fx.policy_layers(spark, sf)
    return pol.resolve_policies(layers, layers)


@query
def policy_resolve(spark, sf):
    joined = policies(spark, sf)
    return joined.withColumns(
        {"include": F.array_join("include", "|"), "exclude": F.array_join("exclude", "|")}
    )


@query
def policy_globs(spark, sf):
    return pol.filter_by_policy(fx.file_list(spark, sf), policies(spark, sf)).select("repo_id", "path")


@query
def policy_size(spark, sf):
    """Files within the size limit of their repository's policy."""
    return file_stats(fs.within_policy_size(fx.code_files(spark, sf), policies(spark, sf))).select("repo_id", "path", "n_bytes")


@query
def gate(spark, sf):
    return pol.gate(findings(spark, sf), policies(spark, sf))


@query
def policy_confidence(spark, sf):
    kept = fd.policy_confidence(findings(spark, sf), policies(spark, sf))
    return kept.select("repo_id", "file", "line", "rule_id", "confidence")


# --- reviewer model -----------------------------------------------------------------------------------


@query
def review_requests(spark, sf):
    """Requests for all files; those a diff touched name their changed lines."""
    focus = stage(parse_diffs(fx.diffs(spark, sf)).select("repo_id", "path", "line_no"))
    return rs.build_requests(fx.code_files(spark, sf), focus)


@query
def request_bodies(spark, sf):
    """Whole requests as JSON, with a system text."""
    requests = rs.build_requests(fx.code_files(spark, sf))
    return rs.request_bodies(requests, 'Review "this".').select("repo_id", "path", "body")


def model_findings(spark, sf) -> DataFrame:
    parsed = rs.parse_responses(fx.responses(spark, sf))
    return rs.response_findings(parsed, file_stats(fx.code_files(spark, sf)))


@query
def response_findings(spark, sf):
    return model_findings(spark, sf)


@query
def finding_span(spark, sf):
    found = model_findings(spark, sf)
    return found.select(
        "repo_id", "file", "emit_seq", sv.span(F.col("line"), F.col("end_line")).alias("span")
    )


@query
def response_fallback(spark, sf):
    files = fx.code_files(spark, sf)
    found = sc.scan_responses(files, fx.responses(spark, sf), min_confidence=0.5)
    return found.select("repo_id", "file", "line", "title", "confidence", "source")


# --- reports ---------------------------------------------------------------------------------------------


@query
def summary_text(spark, sf):
    repos = fx.policy_layers(spark, sf).select("repo_id")
    return rw.summary_text(fd.severity_counts(findings(spark, sf), repos))


@query
def diagnostics(spark, sf):
    return rw.diagnostics(findings(spark, sf), "/work/space/")


@query
def sarif_rules(spark, sf):
    return rw.sarif_rules(findings(spark, sf)).drop("neg_confidence")


@query
def sarif_results(spark, sf):
    return rw.sarif_results(findings(spark, sf)).drop("neg_rank", "neg_confidence", "file")


@query
def sarif_integrity(spark, sf):
    return rw.sarif_integrity(findings(spark, sf))


def _report_inputs(spark, sf):
    listed = stage(fx.file_list(spark, sf))  # headers, paths and errors read it
    files = listed.where(F.col("language").isNotNull())
    unread = listed.where(F.col("language").isNull()).withColumn("content", F.lit(None).cast("string"))
    errors = fs.read_errors(unread)
    found = stage(findings(spark, sf))
    return sc.scan_headers(files, found, errors), found, files.select("repo_id", "path"), errors


@query
def report_json(spark, sf):
    return doc.json_parts(*_report_inputs(spark, sf))


@query
def report_markdown(spark, sf):
    headers, found, _, _ = _report_inputs(spark, sf)
    return doc.markdown_parts(headers, found)


@query
def report_sarif(spark, sf):
    headers, found, _, _ = _report_inputs(spark, sf)
    return doc.sarif_parts(headers, found)


def _file_scans(spark, sf):
    """Every file of F1 as a scan of its own: the file id stands in for the repository."""
    lines = fx.code_lines(spark, sf).withColumn("repo_id", F.col("file_id"))
    files = fx.file_list(spark, sf).where(F.col("language").isNotNull()).withColumn("repo_id", F.col("file_id"))
    return files, fd.cap_per_file(rl.line_findings(lines))


@query
def report_reload(spark, sf):
    """File reports written, every nineteenth cut short, and read back."""
    files, found = _file_scans(spark, sf)
    bodies = doc.file_reports(files, found)
    cut = F.when(F.col("repo_id") % 19 == 0, F.substring("body", 1, 30)).otherwise(F.col("body"))
    parsed = rp.parse_reports(bodies.select(F.col("repo_id").alias("report_id"), cut.alias("body")))
    return rp.report_findings(parsed)


def _reparsed(spark, sf):
    files, found = _file_scans(spark, sf)
    bodies = doc.file_reports(files, found)
    cut = F.when(F.col("repo_id") % 19 == 0, F.substring("body", 1, 30)).otherwise(F.col("body"))
    return rp.parse_reports(bodies.select(F.col("repo_id").alias("report_id"), cut.alias("body")))


@query
def report_errors(spark, sf):
    return rp.report_errors(_reparsed(spark, sf))


@query
def report_files(spark, sf):
    """Reports of all kinds, written to compressed files and read back line by line."""
    inputs = _report_inputs(spark, sf)
    parts = []
    for kind in ("json", "markdown", "sarif"):
        folder = shared_dir(spark)
        doc.write_documents(doc.report_parts(kind, *inputs), folder, "gzip")
        parts.append(doc.read_documents(spark, folder).select(F.lit(kind).alias("kind"), "repo_id", "line_no", "text"))
    return reduce(DataFrame.unionByName, parts)


@query
def report_rerender(spark, sf):
    """Saved reports, rendered again as Markdown."""
    return _rerendered(spark, sf, "markdown")


@query
def report_rerender_json(spark, sf):
    return _rerendered(spark, sf, "json")


@query
def report_rerender_sarif(spark, sf):
    return _rerendered(spark, sf, "sarif")


def _rerendered(spark, sf, kind):
    headers, found, paths, errors = sc.reloaded(stage(_reparsed(spark, sf)))
    return doc.report_parts(kind, headers, stage(found), paths, errors).select("repo_id", "section", "body")


@query
def report_gate(spark, sf):
    """Gate over saved reports."""
    headers, found, _, _ = sc.reloaded(_reparsed(spark, sf))
    return pol.render_gate(found, headers, "high")


@query
def findings_table(spark, sf):
    """The findings table written and read back."""
    folder = shared_dir(spark)
    doc.write_findings(findings(spark, sf), folder)
    read = spark.read.schema(FINDINGS).parquet(folder)
    return read.select("repo_id", "file", "line", "severity", "rule_id", "emit_seq")


@query
def scan_response(spark, sf):
    files, found = _file_scans(spark, sf)
    return doc.scan_responses_json(files, found)


# --- streams ------------------------------------------------------------------------------------------------


@query
def stream_save_scan(spark, sf):
    folder = shared_dir(spark)
    st.scan_saves(fx.save_stream(spark, sf), f"{folder}/findings", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.schema(st.VERSIONED).parquet(f"{folder}/findings")
    return found.select("version", "file", "line", "rule_id", "code")


@query
def stream_latest_findings(spark, sf):
    folder = shared_dir(spark)
    st.maintain_findings(fx.save_stream(spark, sf), f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return st.current_findings(spark, f"{folder}/state").select("version", "file", "line", "rule_id")


@query
def request_validation(spark, sf):
    events = fx.table(spark, sf, "events").select(F.col("event_id").alias("repo_id"), F.expr(fx.BODY_SQL).alias("body"))
    return rq.validate_requests(events).select("repo_id", "status")


@query
def request_scan(spark, sf):
    """Findings of valid requests, within the focus each one asks for."""
    events = fx.table(spark, sf, "events").select(F.col("event_id").alias("repo_id"), F.expr(fx.BODY_SQL).alias("body"))
    units = rq.request_units(rq.validate_requests(events))
    found = sc.scan_files(units, focus=rq.request_focus(units))
    return found.select("repo_id", "file", "line", "rule_id")


@query
def request_stream(spark, sf):
    """Request bodies as a stream: findings of valid ones, and the rejects."""
    folder = shared_dir(spark)
    bodies = fx.event_stream(spark, sf).select(F.col("event_id").alias("repo_id"), F.expr(fx.BODY_SQL).alias("body"))
    st.scan_requests(bodies, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.schema(FINDINGS).parquet(f"{folder}/out/findings").select("repo_id", F.col("rule_id").alias("outcome"))
    rejects = spark.read.schema("repo_id bigint, status string").parquet(f"{folder}/out/rejects")
    return found.union(rejects.select("repo_id", "status"))


