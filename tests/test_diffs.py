"""Diff parsing, against literal expectations and diffs generated with known answers."""

import random

from gritline.operators.diffs import parse_diffs
from gritline.plans.scans import diff_report, scan_diffs
from gritline.sources.diffs import read_diffs

DIFF = """diff --git a/shop/cart.py b/shop/cart.py
index 0a1b2c3..4d5e6f7 100644
--- a/shop/cart.py
+++ b/shop/cart.py
@@ -0,0 +1,3 @@
+from shop import tax
+
+auth_token = "t0ken-of-cart"
@@ -40,2 +43,1 @@ class Cart:
-    total = 0
-    count = 0
+    total = None
diff --git a/shop/legacy.py b/shop/legacy.py
deleted file mode 100755
--- a/shop/legacy.py
+++ /dev/null
@@ -1,1 +0,0 @@
-import cgi
"""


def parse(spark, text):
    diffs = spark.createDataFrame([(1, text)], "repo_id long, diff_text string")
    out = {}
    for row in parse_diffs(diffs).collect():
        out.setdefault(row["path"], set()).add(row["line_no"])
    return out


def test_added_lines_and_deleted_file(spark):
    assert parse(spark, DIFF) == {"shop/cart.py": {1, 2, 3, 43}}


def test_empty(spark):
    assert parse(spark, "") == {}


def test_header_on_the_first_line(spark):
    assert parse(spark, "+++ b/x\n@@ -1 +5 @@\n+a") == {"x": {5}}


def test_context_deletions_and_notes(spark):
    text = "+++ x.py\n@@ -1,3 +10,4 @@\n ctx\n-old\n+new\n\\ No newline at end of file\n ctx\n+last\n"
    assert parse(spark, text) == {"x.py": {11, 13}}


def test_unreadable_hunk_counts_from_zero(spark):
    assert parse(spark, "+++ b/x\n@@ broken\n+a\n+b\n") == {"x": {0, 1}}


def test_greedy_hunk_start(spark):
    assert parse(spark, "+++ b/x\n@@ -1 +3 @@ f +7 @@\n+a\n") == {"x": {7}}


def test_cursor_survives_a_file_header(spark):
    text = "+++ b/x\n@@ -1 +5 @@\n+a\n+++ b/y\n+b\n+++ /dev/null\n+c\n@@ -1 +9 @@\n+d\n+++ b/z\n+e\n"
    assert parse(spark, text) == {"x": {5}, "y": {6}, "z": {9}}


def test_hunk_before_any_file(spark):
    assert parse(spark, "@@ -1 +4 @@\n+lost\n+++ b/x\n+a\n") == {"x": {4}}


def test_repeated_headers_unite(spark):
    text = "+++ b/x\n@@ -1 +5 @@\n+a\n+++ b/x\n@@ -1 +5,2 @@\n+a\n+b\n"
    assert parse(spark, text) == {"x": {5, 6}}


def test_added_line_that_reads_as_a_header(spark):
    assert parse(spark, "+++ b/x\n@@ -1 +5 @@\n+a\n+++ y\n+b\n") == {"x": {5}, "y": {6}}


def test_other_line_breaks(spark):
    assert parse(spark, "+++ b/x\r\n@@ -1 +5 @@\r\n+a\x0cb\r\n+c\r\n") == {"x": {5, 7}}


def test_generated_diffs(spark):
    rng = random.Random(7)
    for _ in range(4):
        text, want = [], {}
        for f in range(rng.randint(1, 6)):
            path = f"d{rng.randint(0, 3)}/f{f}.py"
            text += [f"diff --git a/{path} b/{path}", "index 1..2", f"--- a/{path}", f"+++ b/{path}"]
            at = 1
            for _ in range(rng.randint(1, 5)):
                at += rng.randint(1, 50)
                text.append(f"@@ -{at},3 +{at},9 @@ def x():")
                for _ in range(rng.randint(1, 12)):
                    kind = rng.choice("+- \\")
                    text.append(kind + rng.choice(["x", "", "@@ -1 +1 @@", "- y"]))
                    if kind == "+":
                        want.setdefault(path, set()).add(at)
                    at += kind in "+ "
        assert parse(spark, "\n".join(text)) == want


def test_scan_of_a_diff(spark, files, tmp_path):
    (tmp_path / "one.diff").write_text(DIFF)
    diffs = read_diffs(spark, str(tmp_path / "one.diff"), repo_id=1)
    assert diffs.first()["target"] == "origin/main...WORKTREE"
    current = files({"shop/cart.py": 'from shop import tax\n\nauth_token = "t0ken-of-cart"\nx = eval(y)\n', "other.py": "eval(x)\n"})
    rows = scan_diffs(diffs, current).collect()
    assert [(r["file"], r["line"], r["title"]) for r in rows] == [("shop/cart.py", 3, "Possible hardcoded secret")]
    assert scan_diffs(diffs, current, exclude=["shop/c*"]).count() == 0
    assert scan_diffs(diffs, current, max_bytes=10).count() == 0


def test_endless_hunk_numbers_end_no_job(spark):
    text = "+++ b/x\n@@ -1 +3000000000 @@\n+a\n@@ -1 +99999999999999999999 @@\n+b\n@@ -1 +4 @@\n+c\n"
    assert parse(spark, text) == {"x": {4}}


def test_report_of_failed_and_empty_diffs(spark, files):
    rows = [(1, "a...b", DIFF), (2, "a...WORKTREE", None), (3, "a...c", "")]
    diffs = spark.createDataFrame(rows, "repo_id long, target string, diff_text string")
    current = files({"shop/cart.py": 'from shop import tax\n\nauth_token = "t0ken-of-cart"\n'})
    headers, found, paths, errors = diff_report(diffs, current)
    got = {r["repo_id"]: (r["target"], r["files_scanned"], r["n_errors"], r["total"]) for r in headers.collect()}
    assert got == {1: ("a...b", 1, 0, 1), 2: ("a...WORKTREE", 0, 1, 0), 3: ("a...c", 0, 0, 0)}
    assert [r["path"] for r in paths.collect()] == ["shop/cart.py"] and errors.count() == found.count() == 1
