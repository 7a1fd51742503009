"""Physical plans: what must and must not be in them."""

from pyspark.sql import functions as F

from gritline.operators import findings as fd
from gritline.operators.diffs import parse_diffs
from gritline.operators.lines import explode_lines
from gritline.operators.rules import line_findings
from gritline.plans import fixtures as fx
from gritline.plans import scans as sc
from gritline.plans.queries import QUERIES
from gritline.plans.scans import scan_lines
from gritline.sinks import documents as doc
from gritline.sources import files as fs
from gritline.sources import responses as rs
from gritline.sources.files import first_files, with_language

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of(files):
    return explode_lines(with_language(files({"a.js": "eval(x)"})))


def test_line_rules_need_no_shuffle_and_no_python(files):
    text = plan(line_findings(lines_of(files)))
    assert "Exchange hashpartitioning" not in text and "SinglePartition" not in text
    assert "Python" not in text and "MapInArrow" not in text
    assert "BroadcastHashJoin" in text


def test_rule_patterns_run_once(files):
    optimized = line_findings(lines_of(files))._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("AKIA[0-9A-Z]{16}") == 1


def test_caps_are_pushed_below_the_shuffle(spark, files):
    capped = plan(fd.cap_per_file(line_findings(lines_of(files))))
    assert "WindowGroupLimit" in capped and "Partial" in capped
    assert "WindowGroupLimit" in plan(first_files(files({"a.js": "x"}), 5))


def test_diffs_are_parsed_without_a_window(spark):
    diffs = spark.createDataFrame([(1, "x")], "repo_id long, diff_text string")
    text = plan(parse_diffs(diffs))
    assert "Window" not in text and "Python" not in text
    assert text.count("Exchange") == 1  # the distinct


def test_scans_read_only_their_columns(spark):
    text = plan(QUERIES["rule_hits"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint>" in text
    assert "Window" not in text  # line numbers are not needed for counts


def test_counts_are_partial(spark):
    text = plan(fd.severity_counts(line_findings(fx.code_lines(spark, SF))))
    assert "partial_count" in text


def test_no_cross_joins(spark):
    for name in ("rule_theta_join", "policy_globs", "gate", "report_json", "focus_semi", "diff_scan"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_focus_is_applied_before_the_rules(spark, files):
    focus = spark.createDataFrame([(1, "a.js", 1)], "repo_id long, path string, line_no int")
    text = plan(scan_lines(lines_of(files), focus=focus))
    assert text.index("rule_idx") < text.index("LeftSemi")  # plans print the last step first


def test_bucketed_contents_are_not_moved(spark, files):
    """A diff meets contents bucket by bucket: only the short list of changed files is dealt."""
    rows = files({f"src/m{k}.py": f"x = {k}  # TODO\n" for k in range(50)} | {"a.md": "x", None: "null path"}).withColumn("extra", F.lit(1))
    table = fs.save_contents(rows, "contents_of_test", buckets=4)
    assert sorted(map(str, table.collect())) == sorted(map(str, rows.collect()))
    changed = spark.createDataFrame([(1, f"src/m{k}.py") for k in range(0, 50, 7)], "repo_id long, path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = changed.join(fs.within_size(table.select("repo_id", "path", "content")), ["repo_id", "path"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert plan[plan.index("Exchange") :].split("Scan")[1].startswith(" ExistingRDD")  # the changed files
        assert joined.count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_run_observes_its_scan(spark, files):
    """Totals and time come from the pass that writes the findings."""
    from gritline.plans import scans as sc
    from gritline.sinks import documents as doc
    units = files({"a.py": "x = 1  # TODO\ntry:\n    pass\nexcept:\n    pass\n", "b.py": "y = eval(z)\n", "c.py": None}).withColumn("language", F.lit("python"))
    errors = fs.read_errors(units)
    headers, found, totals = sc.run_scan(units.where("content IS NOT NULL"), errors)
    header = headers.first()
    plain = sc.scan_headers(units.where("content IS NOT NULL"), sc.scan_files(units), errors).first()
    assert header["duration_s"] > 0 and {c: header[c] for c in plain.asDict()} == plain.asDict()
    assert totals["total"] == header["total"] == found.count() == 4
    assert {s: totals[s] for s in ("high", "medium", "info")} == {s: header[s] for s in ("high", "medium", "info")}
    parts = doc.json_parts(headers, found, units.select("repo_id", "path"), errors)
    assert f'"duration_s":{header["duration_s"]}' in parts.where("section = 0").first()["body"]


def test_documents_are_read_back(spark, files, tmp_path):
    rows = [(r, s, 0, "", n, 0.0, 0, 0, f"r{r} s{s} n{n}\nnext") for r in (1, 2) for s in range(3) for n in range(400)]
    parts = spark.createDataFrame(rows, "repo_id long, section int, neg_rank int, file string, line int, neg_confidence double, emit_seq long, sub int, body string")
    doc.write_documents(parts.repartition(5), f"{tmp_path}/d")
    got = doc.read_documents(spark, f"{tmp_path}/d").orderBy("repo_id", "line_no").collect()
    want = [(r, t) for r in (1, 2) for s in range(3) for n in range(400) for t in (f"r{r} s{s} n{n}", "next")]
    assert [(r["repo_id"], r["text"]) for r in got] == want
    assert [r["line_no"] for r in got] == [*range(1, 2401)] * 2


def test_answers_and_diffs_are_not_gone_through_to_tell_their_kind(spark):
    """Objects are told by their fields, lists aren't written out as text, and hunks are looked for without cutting."""
    from gritline.functions import variants as vx
    from gritline.operators.diffs import _starts_without_hunk
    texts = ["{}", '{"a":{"b":[1]}}', "[]", '[{"a":1}]', "null", "1", '"x"', "true", "bad", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vx.is_object(F.try_parse_json("t")).alias("is"))
    assert [r["t"] for r in rows.collect() if r["is"]] == ["{}", '{"a":{"b":[1]}}']
    assert "schema_of_variant" not in plan(rows).lower()
    pieces = ["+++ b/a\n+x\n@@ -1 +1 @@", "+++ b/a\n@@ -1 +1 @@\n+x", "+++ b/a\n+x", "+++ /dev/null\n+x", "+++ b/a\n-x\n", "+++ b/a"]
    early = spark.createDataFrame([(p,) for p in pieces], "p string").select(_starts_without_hunk(F.col("p")).alias("e"))
    assert [r["e"] for r in early.collect()] == [True, False, True, False, False, False]
    assert "exists" not in plan(early).lower()


def test_compressed_documents_are_read_back_without_moving_lines(spark, tmp_path):
    from gritline.sinks import documents as doc
    rows = [(r, 0, 0, "", n, 0.0, 0, 0, f"r{r} n{n}\nnext") for r in (1, 2, None) for n in range(500)]
    parts = spark.createDataFrame(rows, "repo_id long, section int, neg_rank int, file string, line int, neg_confidence double, emit_seq long, sub int, body string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        doc.write_documents(parts.repartition(5), f"{tmp_path}/z", "gzip")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    written = [p.name for p in (tmp_path / "z").rglob("part-*")]
    assert len(written) > 3 and all(name.endswith(".txt.gz") for name in written)
    found = doc.read_documents(spark, f"{tmp_path}/z")
    assert "Exchange range" not in found._jdf.queryExecution().toString() and "SortMergeJoin" not in found._jdf.queryExecution().toString()
    got = sorted((r["repo_id"] or 0, r["line_no"], r["text"]) for r in found.collect())
    texts = {r: [t for n in range(500) for t in (f"r{r or None} n{n}", "next")] for r in (0, 1, 2)}
    assert got == [(r, k + 1, t) for r in (0, 1, 2) for k, t in enumerate(texts[r])]


def test_rules_of_a_scan_go_by_few_rows(spark):
    """Rows that can't be a rule's first go before the aggregate; ties, nulls and NaN stay as Spark orders them."""
    import random

    import pyarrow as pa

    from gritline.sinks import rows as rw
    pick = random.Random(4)
    rows = [
        (pick.choice([1, 2, None]), pick.choice(["a", "b", None]), pick.choice(["low", "high"]), pick.choice(["f", "é", "F", None]), pick.choice([3, 20, None]),
         pick.choice([0.5, float("nan"), None, 0.0, -0.0, 0.9]), pick.choice([0, 1]), f"t{k % 7}", "", "bug")
        for k in range(3000)
    ]
    schema = "repo_id long, rule_id string, severity string, file string, line int, confidence double, emit_seq long, title string, description string, category string"
    found = spark.createDataFrame(rows, schema).repartition(3)
    texts = ["title", "description", "category", "severity"]
    first = F.min(F.struct(*rw.report_key(), *texts)).alias("first")
    want = found.groupBy("repo_id", "rule_id").agg(first).select("repo_id", "rule_id", "first.*")
    columns = ["repo_id", "rule_id", *rw.KEY_COLUMNS, "category"]
    rules = rw.sarif_rules(found)
    assert sorted(map(str, rules.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert "MapInArrow" in rules._jdf.queryExecution().toString()
    flat = found.select("repo_id", "rule_id", *rw.report_key(), *texts).toArrow()
    few = pa.Table.from_batches(list(rw._early_rows(flat.to_batches(max_chunksize=100))), flat.schema)
    assert 9 <= few.num_rows < 600 and list(rw._early_rows(iter(flat.slice(0, 0).to_batches()))) == []


def test_answers_are_parsed_and_files_made_once(spark, monkeypatch):
    """Headers of scans with a model need files, findings and errors; all of them read what is written down."""
    calls = []
    parse = rs.parse_responses
    monkeypatch.setattr(rs, "parse_responses", lambda answers: calls.append(1) or parse(answers))
    found = QUERIES["scan_header_ai"](spark, SF)
    assert len(calls) == 1 and "lineitem" not in plan(found) and "l_orderkey" not in plan(found)
    assert found.agg(F.sum("n_errors")).first()[0] > 0
