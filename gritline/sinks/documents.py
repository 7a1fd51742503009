"""Report documents: JSON, Markdown and SARIF.

A scan may hold any number of findings, so its document is never put together in one
row. It is a table of *parts* with an order; sorting by it and writing the bodies
one below the other gives the document. The sort is range-partitioned, so a large scan is
written by many tasks into consecutive files. Scans of a single file are bounded by the
cap per file and do come as one document per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritline.functions import severity as sv
from gritline.functions import text as tx
from gritline.operators.skew import apart, counted, stage
from gritline.sinks.rows import KEY_COLUMNS, given, report_key, sarif_results, sarif_rules
from gritline.vocab import INFORMATION_URI, PRODUCT, PRODUCT_VERSION, SEVERITIES

ORDER = ("section", *KEY_COLUMNS, "sub")
_JSON = {"ignoreNullFields": "false"}
_NO_KEY = {"neg_rank": 0, "file": "", "line": 0, "neg_confidence": 0.0, "emit_seq": 0}
_KEY_TYPES = dict(zip(KEY_COLUMNS, ("int", "string", "int", "double", "bigint")))


def _parts(df: DataFrame, section: int, body: Column, sub: int = 0, key: dict[str, Column] | None = None) -> DataFrame:
    columns = {name: F.lit(value) for name, value in _NO_KEY.items()} | (key or {})
    return df.select(
        "repo_id",
        F.lit(section).alias("section"),
        *[columns[name].cast(_KEY_TYPES[name]).alias(name) for name in KEY_COLUMNS],
        F.lit(sub).alias("sub"),
        body.alias("body"),
    )


def _own_key() -> dict[str, Column]:
    return {name: F.col(name) for name in KEY_COLUMNS}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _with_commas(items: DataFrame) -> DataFrame:
    """Put a comma before every part but the first of its scan and section.

    The first part is the smallest key, a partial aggregate; it is matched back on the
    whole key, so no scan meets in one task. The first keys are written down and counted: those of a few
    scans go to every task, those of many are met by moving both.
    """
    first = items.groupBy("repo_id").agg(F.min(F.struct(*KEY_COLUMNS)).alias("_first"))
    first = stage(first.select("repo_id", "_first.*", F.lit("").alias("_comma")))
    joined = items.join(counted(first), ["repo_id", *KEY_COLUMNS], "left")
    body = F.concat(F.coalesce("_comma", F.lit(",")), F.col("body"))
    return joined.select("repo_id", *ORDER, body.alias("body"))


def _text_items(df: DataFrame, section: int, column: str) -> DataFrame:
    """JSON strings in the order of their text. A one-element array is cut to its element.

    Repeated texts stay; their number in the row of equal texts tells them apart.
    """
    counted = df.groupBy("repo_id", column).agg(F.count("*").alias("_n"))
    df = counted.select("repo_id", column, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    quoted = F.to_json(F.array(F.col(column)))
    body = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return _with_commas(_parts(df, section, body, key={"file": F.col(column), "emit_seq": F.col("_i") - 1}))


def finding_json() -> Column:
    """JSON object of one finding, confidence rounded to three digits."""
    return F.to_json(
        F.struct(
            "file", "line", "end_line", "severity", "category", "title", "description", "suggestion",
            sv.round3(F.col("confidence")).alias("confidence"), "rule_id", "source", "code",
        ),
        _JSON,
    )


def _open_object(fields: Column) -> Column:
    """JSON object without its closing brace."""
    text = F.to_json(fields, _JSON)
    return F.substring(text, F.lit(1), F.length(text) - 1)


def json_parts(headers: DataFrame, findings: DataFrame, paths: DataFrame, errors: DataFrame) -> DataFrame:
    """JSON report parts: header and counts, then paths, errors and findings.

    ``headers`` comes from :func:`gritline.plans.scans.scan_headers`. It has one row per scan and
    is written down once, so that its counts are not computed again for every section. Its ``duration_s``, if it has
    one (:func:`gritline.plans.scans.run_scan`), is the scan's; without, it is 0.
    """
    headers = stage(headers)
    seconds = F.col("duration_s") if "duration_s" in headers.columns else F.lit(0.0).alias("duration_s")
    head = F.struct(
        "target", "model", "mode", "files_scanned", seconds,
        F.col("total").alias("total_findings"), F.struct(*SEVERITIES).alias("counts"),
    )
    return _union(
        [
            _parts(headers, 0, F.concat(_open_object(head), F.lit(',"paths":['))),
            _text_items(paths.select("repo_id", "path").distinct(), 1, "path"),
            _parts(headers, 2, F.lit('],"errors":[')),
            _text_items(errors, 3, "error"),
            _parts(headers, 4, F.lit('],"findings":[')),
            _with_commas(_parts(findings.withColumns(_key()), 5, finding_json(), key=_own_key())),
            _parts(headers, 6, F.lit("]}")),
        ]
    )


def _key() -> dict[str, Column]:
    return dict(zip(KEY_COLUMNS, report_key()))


def markdown_finding() -> Column:
    bullet = F.concat(
        F.lit("- "), sv.emoji(F.col("severity")), F.lit(" **"), F.col("severity"), F.lit(" · "), F.col("category"),
        F.lit("** — "), tx.escape_pipe(F.col("title")), F.lit(" _("), sv.span(F.col("line"), F.col("end_line")), F.lit(")_"),
    )
    description = F.concat(F.lit("  "), tx.escape_pipe(given("description")))
    suggestion = F.concat(F.lit("  💡 "), tx.escape_pipe(given("suggestion")))
    return F.concat_ws("\n", bullet, description, suggestion)


def markdown_file_headers(findings: DataFrame) -> DataFrame:
    """Files that get a heading, per rank: (repo_id, neg_rank, file).

    A heading is due where the file changes in report order. Within a rank files are
    sorted, so each file has one run per rank; only the first run of a rank can continue
    the file that ended the rank before. That needs the smallest and largest file per rank,
    at most five rows per scan, and no pass over the sorted findings.
    """
    runs = findings.select("repo_id", report_key()[0], "file").distinct()
    ends = runs.groupBy("repo_id", "neg_rank").agg(F.min("file").alias("first"), F.max("file").alias("last"))
    per_scan = ends.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("neg_rank", "first", "last"))).alias("r"))
    neighbours = per_scan.select("repo_id", F.posexplode("r").alias("i", "now"), "r").where(F.col("i") > 0)
    continued = neighbours.where(F.col("now.first") == F.get("r", F.col("i") - 1)["last"]).select(
        "repo_id", F.col("now.neg_rank").alias("neg_rank"), F.col("now.first").alias("file")
    )
    return runs.join(apart(continued), ["repo_id", "neg_rank", "file"], "left_anti")


def markdown_parts(headers: DataFrame, findings: DataFrame) -> DataFrame:
    """Markdown report parts: header, severity table, findings under file headings."""
    headers = stage(headers)
    label = F.coalesce(given("model"), F.lit("heuristics"))
    facts = F.concat(
        F.lit("**Mode:** "), F.col("mode"), F.lit(" · **Model:** `"), label, F.lit("` · **Files scanned:** "),
        F.col("files_scanned").cast("string"), F.lit(" · **Findings:** "), F.col("total").cast("string"),
    )
    title = F.concat_ws("\n", F.lit(f"## 🤖 {PRODUCT} report"), F.lit(""), facts, F.lit(""))
    rows = [
        F.when(
            F.col(s) > 0,
            F.concat(F.lit("| "), sv.emoji(F.lit(s)), F.lit(f" {s} | "), F.col(s).cast("string"), F.lit(" |")),
        )
        for s in SEVERITIES
    ]
    table = F.concat_ws("\n", F.lit("| Severity | Count |"), F.lit("| --- | --- |"), *rows, F.lit(""))
    clean = F.lit("✅ No issues found in the analyzed code.")
    heading = F.concat(F.lit("### `"), F.col("file"), F.lit("`"))
    return _union(
        [
            _parts(headers, 0, title),
            _parts(headers, 1, F.when(F.col("total") > 0, table).otherwise(clean)),
            _parts(
                markdown_file_headers(findings), 2, heading,
                key={"neg_rank": F.col("neg_rank"), "file": F.col("file"), "neg_confidence": F.lit(-2.0)},
            ),
            _parts(findings.withColumns(_key()), 2, markdown_finding(), sub=1, key=_own_key()),
        ]
    )


def sarif_rule_json() -> Column:
    def text(column: str) -> Column:
        return F.struct(F.col(column).alias("text"))

    return F.to_json(
        F.struct(
            F.col("rule_id").alias("id"),
            "name",
            text("short_description").alias("shortDescription"),
            text("full_description").alias("fullDescription"),
            F.struct("level").alias("defaultConfiguration"),
            F.struct("category", F.array("category").alias("tags")).alias("properties"),
        ),
        _JSON,
    )


def sarif_result_json() -> Column:
    place = F.struct(
        F.struct(F.col("uri").alias("uri")).alias("artifactLocation"),
        F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region"),
    )
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            "level",
            F.struct(F.col("message").alias("text")).alias("message"),
            F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
            F.struct("severity", "confidence", "source").alias("properties"),
        ),
        _JSON,
    )


# --- fixed values: SARIF envelope ------------------------------------------------------
SARIF_HEAD = (
    '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'
    f'{{"name":"{PRODUCT}","informationUri":"{INFORMATION_URI}","version":"{PRODUCT_VERSION}","rules":['
)
SARIF_RESULTS = ']}},"results":['
SARIF_TAIL = "]}]}"


def sarif_parts(headers: DataFrame, findings: DataFrame) -> DataFrame:
    """SARIF report parts: envelope, rules in order of first appearance, results."""
    headers = stage(headers)
    return _union(
        [
            _parts(headers, 0, F.lit(SARIF_HEAD)),
            _with_commas(_parts(sarif_rules(findings), 1, sarif_rule_json(), key=_own_key())),
            _parts(headers, 2, F.lit(SARIF_RESULTS)),
            _with_commas(_parts(sarif_results(findings), 3, sarif_result_json(), key=_own_key())),
            _parts(headers, 4, F.lit(SARIF_TAIL)),
        ]
    )


def report_parts(kind: str, headers: DataFrame, findings: DataFrame, paths: DataFrame, errors: DataFrame) -> DataFrame:
    """Parts of a ``json``, ``markdown`` or ``sarif`` report."""
    if kind == "json":
        return json_parts(headers, findings, paths, errors)
    if kind == "markdown":
        return markdown_parts(headers, findings)
    if kind == "sarif":
        return sarif_parts(headers, findings)
    raise ValueError(f"unknown report kind: {kind}")


def write_documents(parts: DataFrame, path: str, compression: str | None = None) -> None:
    """Write one folder per scan; its files, in name order, are the document.

    ``compression`` is a codec of Spark's text files, such as ``gzip``; without one they are plain. Either can be read back.
    """
    ordered = parts.orderBy("repo_id", *ORDER).select("repo_id", "body")
    ordered.write.partitionBy("repo_id").mode("overwrite").text(path, compression=compression or "none")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the documents that :func:`write_documents` wrote: (repo_id, line_no, text).

    A document's files are in name order. Lines are numbered where they are read: a line's number is its place in its block
    of a file and the lines of the blocks before, so no line is moved and a document of any length will do. The lines are
    written once, because blocks must not change between their two uses. Only what a finished job published is read.
    """
    lines = spark.read.schema("value string, repo_id bigint").text(path).select(
        "repo_id", F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"),
    )
    placed = stage(lines, "zstd")
    blocks = placed.groupBy("repo_id", "file", "block").agg(F.min("nth").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("repo_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    blocks = blocks.select(
        F.col("repo_id").alias("_repo_id"), F.col("file").alias("_file"), F.col("block").alias("_block"),
        (before - F.col("_first") + 1).alias("_shift"),
    )
    # Null is a scan like any other.
    same = F.col("repo_id").eqNullSafe(F.col("_repo_id")) & (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    joined = placed.join(counted(stage(blocks)), same)
    return joined.select("repo_id", (F.col("nth") + F.col("_shift")).alias("line_no"), "text")


def write_findings(findings: DataFrame, path: str) -> None:
    """The findings table, one partition per scan.

    Ranges of scan and file go to one task each: small scans share a task, and a large scan
    is spread over several, without a file per task and scan.
    """
    findings.repartitionByRange("repo_id", "file").write.partitionBy("repo_id").mode("overwrite").parquet(path)


def _file_items(findings: DataFrame) -> DataFrame:
    """Per file its findings as a JSON array and its counts. Takes capped findings."""
    entry = F.struct(*report_key(), finding_json().alias("body"))
    items = F.array_sort(F.collect_list(entry))
    return findings.groupBy("repo_id", F.col("file").alias("path")).agg(
        F.array_join(F.transform(items, lambda x: x["body"]), ",").alias("items"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        F.count("*").alias("total"),
    )


def file_reports(files: DataFrame, findings: DataFrame, *, mode: str = "heuristic", model: str = "") -> DataFrame:
    """JSON report of every file scanned on its own, clean files included."""
    joined = files.select("repo_id", "path").join(apart(_file_items(findings)), ["repo_id", "path"], "left")
    filled = joined.na.fill("", ["items"]).na.fill(0, [*SEVERITIES, "total"])
    head = F.struct(
        F.col("path").alias("target"), F.lit(model).alias("model"), F.lit(mode).alias("mode"),
        F.lit(1).alias("files_scanned"), F.lit(0.0).alias("duration_s"), F.col("total").alias("total_findings"),
        F.struct(*SEVERITIES).alias("counts"), F.array("path").alias("paths"),
        F.array().cast("array<string>").alias("errors"),
    )
    body = F.concat(_open_object(head), F.lit(',"findings":['), F.col("items"), F.lit("]}"))
    return filled.select("repo_id", "path", "total", body.alias("body"))


def scan_responses_json(units: DataFrame, findings: DataFrame, *, mode: str = "heuristic", model: str = "") -> DataFrame:
    """Answer to every scan request: mode, model, errors and sorted findings."""
    joined = units.select("repo_id", "path").join(
        apart(_file_items(findings).select("repo_id", "path", "items")), ["repo_id", "path"], "left"
    )
    head = F.struct(
        F.lit(mode).alias("mode"), F.lit(model).alias("model"), F.array().cast("array<string>").alias("errors")
    )
    body = F.concat(_open_object(head), F.lit(',"findings":['), F.coalesce("items", F.lit("")), F.lit("]}"))
    return joined.select("repo_id", "path", body.alias("body"))
