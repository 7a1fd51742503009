"""Report documents: written, put together, read back."""

import json
from pathlib import Path

import pytest

from gritline.operators import findings as fd
from gritline.plans.scans import reloaded, scan_headers
from gritline.schemas import FINDINGS
from gritline.sinks import documents as doc
from gritline.sinks import rows as rw
from gritline.sources import reports as rp


def finding(repo, file, line, severity, title, description="", suggestion="", category="security", confidence=0.85, seq=0, end=None):
    return (repo, file, line, end or line, severity, category, title, description, suggestion, confidence, f"r/{title}", "ai", "", seq)


@pytest.fixture()
def inputs(spark):
    found = spark.createDataFrame(
        [
            finding(1, "a.py", 10, "critical", "SQL injection", 'User "input" | é', "Use parameters."),
            finding(1, "a.py", 2, "low", "Minor nit", category="style"),
            finding(1, "b.py", 3, "low", "Minor nit", category="style", end=7),
            finding(1, "b.py", 3, "info", "Note", "d", category="docs", confidence=0.12345),
            finding(1, "./c.py", 1, "info", "Note", "d", category="docs", seq=1),
        ],
        FINDINGS,
    )
    files = spark.createDataFrame([(1, "a.py"), (1, "b.py"), (2, "z.py")], "repo_id long, path string")
    errors = spark.createDataFrame([(2, "q.py", "q.py: gone")], "repo_id long, path string, error string")
    return scan_headers(files, found, errors, model="m", mode="ai"), found, files, errors


def assemble(path: Path) -> dict[int, str]:
    return {
        int(folder.name.split("=")[1]): "".join(p.read_text() for p in sorted(folder.glob("part-*")))
        for folder in path.glob("repo_id=*")
    }


def test_json_documents(inputs, tmp_path):
    headers, found, files, errors = inputs
    doc.write_documents(doc.json_parts(headers, found, files, errors), str(tmp_path / "out"))
    docs = {k: json.loads(v) for k, v in assemble(tmp_path / "out").items()}
    one, two = docs[1], docs[2]
    assert one["total_findings"] == 5 and one["files_scanned"] == 2 and one["mode"] == "ai"
    assert one["counts"] == {"critical": 1, "high": 0, "medium": 0, "low": 2, "info": 2}
    assert one["paths"] == ["a.py", "b.py"] and one["errors"] == []
    assert [(f["file"], f["line"], f["severity"]) for f in one["findings"]] == [
        ("a.py", 10, "critical"), ("a.py", 2, "low"), ("b.py", 3, "low"), ("./c.py", 1, "info"), ("b.py", 3, "info"),
    ]
    assert one["findings"][0]["description"] == 'User "input" | é'
    assert one["findings"][4]["confidence"] == 0.123
    assert two["findings"] == [] and two["errors"] == ["q.py: gone"]


def test_markdown_documents(inputs, tmp_path):
    headers, found, _, _ = inputs
    doc.write_documents(doc.markdown_parts(headers, found), str(tmp_path / "out"))
    docs = assemble(tmp_path / "out")
    lines = docs[1].splitlines()
    assert lines[0] == "## 🤖 gritline report"
    assert lines[2] == "**Mode:** ai · **Model:** `m` · **Files scanned:** 2 · **Findings:** 5"
    assert lines[4:9] == ["| Severity | Count |", "| --- | --- |", "| 🔴 critical | 1 |", "| 🔵 low | 2 |", "| ⚪ info | 2 |"]
    # a.py continues from the first rank into the second: one heading; b.py returns: a second one.
    assert [x for x in lines if x.startswith("###")] == ["### `a.py`", "### `b.py`", "### `./c.py`", "### `b.py`"]
    assert "- 🔴 **critical · security** — SQL injection _(L10)_" in lines
    assert '  User "input" \\| é' in lines and "  💡 Use parameters." in lines
    assert "- 🔵 **low · style** — Minor nit _(L3-7)_" in lines
    assert "No issues" in docs[2]


def test_sarif_documents(inputs, tmp_path):
    headers, found, _, _ = inputs
    doc.write_documents(doc.sarif_parts(headers, found), str(tmp_path / "out"))
    run = json.loads(assemble(tmp_path / "out")[1])["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r/SQL injection", "r/Minor nit", "r/Note"]
    assert run["tool"]["driver"]["rules"][1]["fullDescription"]["text"] == "Minor nit"
    assert [r["level"] for r in run["results"]] == ["error", "note", "note", "note", "note"]
    first = run["results"][0]
    assert first["message"]["text"].endswith("\n\nSuggestion: Use parameters.")
    assert run["results"][3]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "c.py"
    assert run["results"][4]["properties"]["confidence"] == 0.12345
    assert json.loads(assemble(tmp_path / "out")[2])["runs"][0]["results"] == []


def test_large_scan_is_written_by_many_tasks(spark, tmp_path):
    rows = [finding(1, f"f{i % 50:02}.py", i, "low", "T", seq=i) for i in range(4000)]
    found = spark.createDataFrame(rows, FINDINGS).repartition(8)
    files = found.selectExpr("repo_id", "file as path").distinct()
    errors = spark.createDataFrame([], "repo_id long, path string, error string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        doc.write_documents(doc.json_parts(scan_headers(files, found, errors), found, files, errors), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "repo_id=1").glob("part-*"))) > 4
    got = json.loads(assemble(tmp_path / "out")[1])["findings"]
    assert [(f["file"], f["line"]) for f in got] == sorted((r[1], r[2]) for r in rows)


def test_reload_is_tolerant(spark):
    bodies = [
        (1, json.dumps({
            "target": "t", "mode": None, "files_scanned": "3", "counts": {"critical": 99}, "paths": ["p"],
            "findings": [
                {"file": "a", "line": "7", "severity": " HIGH ", "category": "Security", "title": " T ", "confidence": 2},
                {"line": 12.7, "end_line": "x", "title": None, "confidence": None, "extra": 1},
                {"line": -4, "end_line": 9, "title": "   ", "confidence": "0.25", "rule_id": "own", "source": "heuristic"},
                "junk", 5, None,
                {"line": "12.7", "severity": "odd", "confidence": "1d"},
            ],
        })),
        (2, "{broken"),
        (3, "[1]"),
        (4, "{}"),
    ]
    parsed = rp.parse_reports(spark.createDataFrame(bodies, "report_id long, body string"))
    assert {r["report_id"] for r in rp.report_errors(parsed).collect()} == {2, 3}
    scan = rp.report_scans(parsed).orderBy("report_id").collect()
    assert (scan[0]["target"], scan[0]["mode"], scan[0]["files_scanned"], scan[0]["paths"]) == ("t", "ai", 3, ["p"])
    assert scan[1]["report_id"] == 4 and scan[1]["errors"] == []
    rows = rp.report_findings(parsed).orderBy("emit_seq").collect()
    got = [(r["file"], r["line"], r["end_line"], r["severity"], r["category"], r["title"], r["confidence"], r["source"]) for r in rows]
    assert got == [
        ("a", 7, 7, "high", "security", "T", 1.0, "ai"),
        ("", 12, 12, "medium", "maintainability", "Code quality issue", 0.5, "ai"),
        ("", 1, 9, "medium", "maintainability", "", 0.25, "heuristic"),
        ("", 1, 1, "medium", "maintainability", "Code quality issue", 0.5, "ai"),
    ]
    assert rows[2]["rule_id"] == "own"


def test_summary_and_order(inputs):
    _, found, files, _ = inputs
    counts = fd.severity_counts(found, files)
    text = {r["repo_id"]: r["summary"] for r in rw.summary_text(counts).collect()}
    assert text == {1: "Summary: 1 critical  2 low  2 info  (5 total)", 2: "Summary: 0 findings  (0 total)"}
    order = [(r["file"], r["line"]) for r in fd.sort_findings(found).collect()]
    assert order == [("a.py", 10), ("a.py", 2), ("b.py", 3), ("./c.py", 1), ("b.py", 3)]
    placed = {(r["file"], r["severity"]): r["position"] for r in fd.number_findings(found).collect()}
    assert placed[("b.py", "info")] == 5 and placed[("a.py", "critical")] == 1


def test_numbers_beyond_the_limits_end_no_job(spark):
    bodies = [(1, '{"files_scanned": 1e300, "findings": [{"line": 1e12, "title": "a"}, {"line": 1e999, "end_line": -1e999, "title": "b"}]}')]
    parsed = rp.parse_reports(spark.createDataFrame(bodies, "report_id long, body string"))
    assert [r["line"] for r in rp.report_findings(parsed).orderBy("emit_seq").collect()] == [2147483647, 2147483647]
    assert rp.report_scans(parsed).first()["files_scanned"] == 2**53


def test_repeated_errors_stay(spark, tmp_path):
    errors = spark.createDataFrame([(1, "a", "a: lost"), (1, "a", "a: lost"), (1, "b", "b: lost")], "repo_id long, path string, error string")
    files = spark.createDataFrame([], "repo_id long, path string")
    found = spark.createDataFrame([], FINDINGS)
    parts = doc.json_parts(scan_headers(files, found, errors), found, files, errors)
    doc.write_documents(parts, str(tmp_path / "out"))
    got = json.loads(assemble(tmp_path / "out")[1])
    assert got["errors"] == ["a: lost", "a: lost", "b: lost"] and got["files_scanned"] == 0


def test_confidence_is_rounded_in_json(spark, tmp_path):
    found = spark.createDataFrame([finding(1, "a.py", 1, "low", "T", confidence=c, seq=k) for k, c in enumerate((0.12345, 0.6785, 1 / 3))], FINDINGS)
    files = found.selectExpr("repo_id", "file as path").distinct()
    errors = spark.createDataFrame([], "repo_id long, path string, error string")
    doc.write_documents(doc.json_parts(scan_headers(files, found, errors), found, files, errors), str(tmp_path / "out"))
    got = [f["confidence"] for f in json.loads(assemble(tmp_path / "out")[1])["findings"]]
    assert sorted(got) == [0.123, 0.333, 0.678]


def test_saved_reports_are_rendered_again(spark, tmp_path):
    body = json.dumps({"target": "t", "mode": "ai", "model": "m", "files_scanned": 2, "paths": ["a.py", "b.py"], "errors": ["x: lost"],
                       "findings": [{"file": "a.py", "line": 3, "severity": "high", "title": "T"}]})
    parsed = rp.parse_reports(spark.createDataFrame([(5, body)], "report_id long, body string"))
    doc.write_documents(doc.json_parts(*reloaded(parsed)), str(tmp_path / "out"))
    got = json.loads(assemble(tmp_path / "out")[5])
    assert (got["target"], got["mode"], got["files_scanned"], got["total_findings"]) == ("t", "ai", 2, 1)
    assert got["errors"] == ["x: lost"] and got["counts"]["high"] == 1
