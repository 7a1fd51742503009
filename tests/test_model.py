"""Reviewer-model tables, scan requests and streams."""

import json

import pytest

from gritline.operators.lines import file_stats
from gritline.plans.scans import scan_responses
from gritline.sources import requests as rq
from gritline.sources import responses as rs
from gritline.sources.files import with_language
from gritline.streaming import saves as st


def message(*items, first=None):
    blocks = [{"type": "text", "text": "hm"}, {"type": "tool_use", "name": "report_findings", "input": {"findings": list(items)}}]
    return json.dumps({"content": ([first] if first else []) + blocks})


def respond(spark, payload, ok=True, content="a\nb\nc\n"):
    files = spark.createDataFrame([(1, "a.py", "python", content)], "repo_id long, path string, language string, content string")
    responses = spark.createDataFrame([(1, "a.py", ok, payload)], "repo_id long, path string, ok boolean, payload string")
    parsed = rs.parse_responses(responses)
    return parsed.first()["good"], rs.response_findings(parsed, file_stats(files)).orderBy("emit_seq").collect()


@pytest.mark.parametrize(
    "line, end, want",
    [
        (2, None, (2, 2)), ("3", None, (3, 3)), (" 2 ", None, (2, 2)), ("2.7", None, (1, 1)), (2.7, None, (2, 2)),
        (99, 100, (4, 4)), (-5, 2, (1, 2)), (None, None, (1, 1)), (True, "x", (1, 1)), ([], {}, (1, 1)), (3, 1, (3, 3)),
        (1, "3", (1, 3)), (10**12, None, (4, 4)),
    ],
)
def test_lines_are_clamped(spark, line, end, want):
    good, rows = respond(spark, message({"title": "T", "line": line, "end_line": end}))
    assert good and (rows[0]["line"], rows[0]["end_line"]) == want


@pytest.mark.parametrize(
    "given, want",
    [({}, 0.85), ({"confidence": None}, 0.5), ({"confidence": "x"}, 0.5), ({"confidence": "1d"}, 0.5), ({"confidence": 3}, 1.0),
     ({"confidence": "0.4"}, 0.4), ({"confidence": -1}, 0.0), ({"confidence": "nan"}, 1.0), ({"confidence": []}, 0.5)],
)
def test_confidence(spark, given, want):
    _, rows = respond(spark, message({"title": "T", **given}))
    assert rows[0]["confidence"] == want


def test_items_without_title_are_dropped(spark):
    titles = ["", None, 0, False, [], "  ", "ok", 5]
    _, rows = respond(spark, message(*[{"title": t} for t in titles], {"line": 1}, "x", 3, None))
    assert [(r["title"], r["emit_seq"]) for r in rows] == [("", 5), ("ok", 6), ("5", 7)]


def test_first_report_block_wins(spark):
    block = {"type": "tool_use", "name": "report_findings", "input": {"findings": [{"title": "first"}]}}
    _, rows = respond(spark, message({"title": "second"}, first=block))
    assert [r["title"] for r in rows] == ["first"]


@pytest.mark.parametrize(
    "payload, good",
    [("{bad", False), (None, False), ("[]", False), ("{}", True), ('{"content":[]}', True), ('{"findings":5}', False),
     ('{"findings":null}', True), ('{"findings":"text"}', True), ('{"findings":[]}', True),
     ('{"findings":[{"title":"T","line":Infinity}]}', False)],
)
def test_good_responses(spark, payload, good):
    got, rows = respond(spark, payload)
    assert got is good and rows == []


def test_fallback(spark, files):
    units = with_language(files({"a.js": "eval(x)", "b.js": "eval(x)", "c.js": "eval(x)"}))
    rows = [(1, "a.js", True, message({"title": "T", "severity": "Low", "category": None})), (1, "b.js", False, message({"title": "U"}))]
    responses = spark.createDataFrame(rows, "repo_id long, path string, ok boolean, payload string")
    got = scan_responses(units, responses).orderBy("file").collect()
    assert [(r["file"], r["source"], r["severity"]) for r in got] == [
        ("a.js", "ai", "low"), ("b.js", "heuristic", "high"), ("c.js", "heuristic", "high"),
    ]
    focus = spark.createDataFrame([(1, "a.js", 5)], "repo_id long, path string, line_no int")
    assert scan_responses(units, responses, focus=focus).count() == 0


def test_request_text(spark, files):
    focus = spark.createDataFrame([(1, "a.py", n) for n in range(20, 0, -1)], "repo_id long, path string, line_no int")
    rows = rs.build_requests(with_language(files({"a.py": "x\ny", "b.py": ""})), focus, model="m").orderBy("path").collect()
    text = rows[0]["prompt"].split("\n")
    assert text[:2] == ["File: a.py", "Language: python"]
    assert text[3] == "Changed lines (new-file numbering): 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, … (+8 more)"
    assert text[4:] == ["", "Code (line numbers are authoritative):", "```", "1| x", "2| y", "```"]
    assert rows[1]["prompt"] == "File: b.py\nLanguage: python\n\nCode (line numbers are authoritative):\n```\n1| \n```"
    assert rs.response_tool()["input_schema"]["required"] == ["findings"]


BODIES = [
    (1, '{"path":"a.js","content":"eval(x)\\nvar y"}', "ok"), (2, "{", "invalid_json"), (3, "", "missing_content"),
    (4, '{"content":null}', "missing_content"), (5, "[]", "invalid_json"), (6, '{"content":"","focus_lines":[]}', "ok"),
    (7, '{"content":"eval(x)","language":"python","focus_lines":[1,1]}', "ok"),
    (8, '{"path":"b.js","content":"eval(x)","focus_lines":[]}', "ok"),
]


def requests(spark):
    return spark.createDataFrame([b[:2] for b in BODIES], "repo_id long, body string")


def test_requests(spark):
    checked = rq.validate_requests(requests(spark))
    assert [r["status"] for r in checked.orderBy("repo_id").collect()] == [b[2] for b in BODIES]
    units = {r["repo_id"]: r for r in rq.request_units(checked).collect()}
    assert (units[7]["path"], units[7]["language"], units[7]["kind"], units[7]["focus_lines"]) == ("buffer", "python", "diff", [1])
    assert (units[8]["kind"], units[8]["has_focus"]) == ("file", True)
    assert (units[1]["language"], units[1]["has_focus"]) == ("javascript", False)


def test_request_stream(spark, tmp_path):
    requests(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo_id long, body string").parquet(str(tmp_path / "in"))
    st.scan_requests(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/findings/batch_id=*"))
    assert {(r["repo_id"], r["line"]) for r in found.collect()} == {(1, 1), (1, 2), (7, 1)}
    rejects = spark.read.parquet(str(tmp_path / "out/rejects/batch_id=*"))
    assert {r["repo_id"] for r in rejects.collect()} == {2, 3, 4, 5}


SAVE = "path string, version long, ts timestamp, content string"


def test_latest_findings_over_batches(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def arrive(*rows):
        data = [(p, v, None, c) for p, v, c in rows]
        spark.createDataFrame(data, SAVE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SAVE).parquet(source)
        st.maintain_findings(stream, state, str(tmp_path / "cp")).awaitTermination()
        return sorted((r["file"], r["version"], r["line"]) for r in st.current_findings(spark, state).collect())

    assert arrive(("a.js", 1, "eval(x)"), ("a.js", 2, "\neval(x)"), ("b.js", 1, "eval(x)")) == [("a.js", 2, 2), ("b.js", 1, 1)]
    # A clean save clears b.js; a late older version of a.js changes nothing.
    assert arrive(("b.js", 3, "ok"), ("a.js", 1, "eval(x)")) == [("a.js", 2, 2)]
    assert arrive(("c.py", 1, "def f(a=[]):\n    pass")) == [("a.js", 2, 2), ("c.py", 1, 1)]
    st.compact(spark, state)
    again = st.current_findings(spark, state).collect()
    assert sorted((r["file"], r["version"]) for r in again) == [("a.js", 2), ("c.py", 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"f{i}.{'py' if i % 2 else 'js'}", i, None, "var x = eval(y)\n# TODO\n") for i in range(20)]
    saves = spark.createDataFrame(rows, SAVE)
    saves.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAVE).parquet(str(tmp_path / "in"))
    st.scan_saves(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = ["version", "file", "line", "rule_id"]
    got = spark.read.schema(st.VERSIONED).parquet(str(tmp_path / "out")).select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, st.scan_save_batch(saves).select(*key).collect()))


@pytest.mark.parametrize("item, lost", [('{"title": "T", "line": 1e999}', True), ('{"title": "T", "end_line": -1e999}', True), ('{"line": 1e999}', False), ('{"title": "T", "line": 1e12}', False)])
def test_an_infinite_line_fails_the_answer(spark, item, lost):
    payload = '{"content": [{"type": "tool_use", "name": "report_findings", "input": {"findings": [%s]}}]}' % item
    assert respond(spark, payload)[0] is not lost


def test_bad_focus_is_rejected(spark):
    bodies = ['{"content": "x", "focus_lines": [1, "x"]}', '{"content": "x", "focus_lines": [1, "2", 3.7, true]}',
              '{"content": "x", "focus_lines": [null]}', '{"content": "x", "focus_lines": 5}', '{"content": "x", "focus_lines": [1e999]}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "repo_id long, body string")
    checked = rq.validate_requests(rows)
    assert [r["status"] for r in checked.orderBy("repo_id").collect()] == ["bad_focus", "ok", "bad_focus", "ok", "bad_focus"]
    units = {r["repo_id"]: r for r in rq.request_units(checked).collect()}
    assert units[1]["focus_lines"] == [1, 2, 3] and not units[3]["has_focus"]


def test_saves_are_scanned_like_files(spark):
    """A save with many hits is capped, and one that arrives twice counts once."""
    rows = [("a.js", 1, "// TODO\n" * 100), ("a.js", 1, "// TODO\n" * 100), ("b.js", 2, "eval(x)")]
    saves = spark.createDataFrame(rows, "path string, version long, content string")
    got = st.scan_save_batch(saves).groupBy("file").count().collect()
    assert {r["file"]: r["count"] for r in got} == {"a.js": 80, "b.js": 1}
    assert st.latest_saves(saves).count() == 2


def test_snapshots_are_read(spark, tmp_path):
    """Readers go on from a snapshot, also when the batches it covers are gone."""
    import shutil

    target = str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "path string, version long, content string")
    st._write_batch(make([("a.js", 1, "eval(x)"), ("b.js", 1, "eval(x)")]), 0, target)
    st._write_batch(make([("a.js", 2, "let x = 1"), ("c.js", 2, "eval(x)")]), 1, target)
    want = {("b.js", 1), ("c.js", 2)}
    state = lambda: {(r["file"], r["version"]) for r in st.current_findings(spark, target).collect()}
    assert state() == want
    st.compact(spark, target)
    st._write_batch(make([("b.js", 3, "let y = 1"), ("a.js", 1, "eval(x)")]), 2, target)
    shutil.rmtree(tmp_path / "state" / "findings" / "batch_id=0")
    shutil.rmtree(tmp_path / "state" / "versions" / "batch_id=0")
    assert state() == {("c.js", 2)}
    st.compact(spark, target)
    assert state() == {("c.js", 2)}
