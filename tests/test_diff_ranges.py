"""Diffs as rows give what diffs as texts give, wherever ranges of rows begin."""

import random

import pytest

from gritline.operators.diff_ranges import changed_in_ranges, parse_diff_lines
from gritline.operators.diffs import changed_lines
from gritline.plans import fixtures as fx
from gritline.sources.diffs import DIFF_LINE_ORDER, read_diff_lines


@pytest.fixture()
def ranges(spark):
    """Keep even few rows in many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def made(pick, length):
    """A diff's lines in any order, so that headers, hunks and lines come in all combinations."""
    kinds = [
        "+++ b/a.py", "+++ a/c/d.py", "+++ /dev/null", "+++   x y ", "--- a/old", "@@ -1 +5 @@", "@@ -2,3 +70,2 @@ f", "@@ broken", "@@ -1 +3 @@ +9 @@",
        "+new", "+", "+ more", "-old", " same", "", "\\ No newline at end of file", "+++b", "++ b", "@@ -0 +99999999999999999999 @@", "diff --git a b",
    ]
    weights = [1] * 9 + [8, 2, 2, 4, 4, 1, 1, 1, 1, 0.2, 1]
    return pick.choices(kinds, weights, k=length)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_lines(ranges, seed):
    pick = random.Random(seed)
    diffs = [(k, made(pick, pick.choice([0, 1, 5, 40, 300]))) for k in range(30)] + [(None, made(pick, 60))]
    texts = ranges.createDataFrame([(k, "\n".join(x)) for k, x in diffs if k is not None], "diff_id long, diff_text string")
    rows = [(k, at, text, "x") for k, x in diffs for at, text in enumerate(x)]
    pick.shuffle(rows)
    lines = ranges.createDataFrame(rows, "diff_id long, at int, text string, path string")
    got = changed_in_ranges(lines, ["diff_id"], ["at"])
    assert got.columns == ["diff_id", "path", "line_no", "text"]
    want = rows_of(changed_lines(texts))
    assert sorted(r for r in map(tuple, got.collect()) if r[0] is not None) == want and len(want) > 100
    named = lines.where("diff_id IS NULL").fillna({"diff_id": -1})
    assert got.where("diff_id IS NULL").count() == changed_in_ranges(named, ["diff_id"], ["at"]).count()


def test_one_long_diff(ranges):
    lines = made(random.Random(3), 3000)
    rows = ranges.createDataFrame(list(enumerate(lines)), "at int, text string").repartition(7)
    whole = ranges.createDataFrame([(1, "\n".join(lines))], "diff_id long, diff_text string")
    got = changed_in_ranges(rows, [], ["at"])
    assert rows_of(got) == [r[1:] for r in rows_of(changed_lines(whole))]
    used = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in used and "Python" not in used


def test_no_lines(spark):
    none = spark.createDataFrame([], "at int, text string")
    assert parse_diff_lines(none, [], ["at"]).collect() == []


def test_one_diff_spreads(ranges):
    """All lines are one diff, and yet no task holds half of them."""
    lines = fx.diff_line_rows(ranges, "/root/testdata/sf0.001")
    order = ["repo_id", "diff_id", "part", "file_id", "at"]
    parts = lines.repartitionByRange(*order).groupBy().count().first()[0]
    dealt = lines.repartitionByRange(*order).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(dealt) == parts and max(dealt) < parts / 4


def test_diff_files(spark, tmp_path):
    text = "+++ b/x\n@@ -1 +5 @@\n+a\x0b b\n+c\r\n+d\n--- a/y\n+++ b/y\n@@ -0 +1 @@\n+e"
    (tmp_path / "one.diff").write_bytes(text.encode())
    (tmp_path / "two.diff").write_bytes(b"+++ b/z\n@@ -1 +2 @@\n+q\n")
    lines = read_diff_lines(spark, str(tmp_path))
    got = {(r["path"], r["line_no"]) for r in parse_diff_lines(lines, ["diff"], DIFF_LINE_ORDER).collect()}
    whole = spark.createDataFrame([(1, text)], "diff_id long, diff_text string")
    assert got == {(r["path"], r["line_no"]) for r in changed_lines(whole).collect()} | {("z", 2)}


def test_lines_are_dealt_twice_and_not_met_by_a_shuffle(ranges):
    """What a range leaves to the next goes to every task, and lines bring their headers along."""
    found = changed_in_ranges(ranges.createDataFrame([(0, "+++ b/x"), (1, "@@ -0 +1 @@"), (2, "+a")], "at int, text string"), [], ["at"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    rows = fx.diff_line_rows(ranges, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Scan parquet") == plan.count("Exchange") == plan.count("Sort [") == 1


def test_a_diff_goes_on_over_many_ranges(ranges):
    """Files, starts and moves reach ranges that say nothing of them, and end with the diff."""
    ranges.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        texts = {1: ["+++ b/a", "@@ -0 +5 @@", *["+x", " y", "-z"] * 60], 2: ["+b"] * 40, 3: ["+++ b/c", "+d", "@@ -1 +9 @@", *["+e"] * 30]}
        rows = [(k, at, t) for k, x in texts.items() for at, t in enumerate(x)]
        lines = ranges.createDataFrame(rows, "diff_id int, at int, text string")
        whole = ranges.createDataFrame([(k, "\n".join(x)) for k, x in texts.items()], "diff_id int, diff_text string")
        assert rows_of(changed_in_ranges(lines, ["diff_id"], ["at"])) == rows_of(changed_lines(whole))
    finally:
        ranges.conf.set("spark.sql.shuffle.partitions", "8")
