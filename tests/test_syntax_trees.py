"""Syntax trees as tables, and tree patterns against the parser's own walk."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gritline.operators import syntax_trees as trees
from gritline.operators.syntax import child_fields, syntax_findings, walk

STEPS = "rule_idx int, step int, base int, axis string, roles array<string>, kinds array<string>, quant string, longer_than int, reports boolean"
SOURCE = """
def outer(a, b=[], *, c={}, d=None, e=lambda x=[]: x):
    try:
        for i in a:
            if i == None != b:
                return
    except:
        pass
    except (ValueError, KeyError):
        pass; x = 1
    class Inner:
        async def deep(self, q={1}):
            while True:
                eval(q)
"""


@pytest.fixture()
def python(files):
    return lambda contents: files(contents).withColumn("language", F.lit("python"))


def test_numbers_of_nodes():
    rows = trees.file_nodes(SOURCE)
    tree = ast.parse(SOURCE)
    some = [n for n in ast.walk(tree) if not isinstance(n, (ast.Load, ast.Store, ast.Del))]
    assert len(rows) == len(some)
    by_number = {r[0]: r for r in rows}
    for number, last, parent, depth, *_ in rows:
        assert number <= last < len(rows)
        if parent is None:
            assert number == depth == 0
        else:
            above = by_number[parent]
            assert above[0] < number <= last <= above[1] and depth == above[3] + 1
    below = {r[0]: sum(1 for x in rows if r[0] < x[0] <= r[1]) for r in rows}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            number = next(r[0] for r in rows if r[8] == node.name and r[7] == "FunctionDef")
            assert below[number] == sum(not isinstance(n, (ast.Load, ast.Store, ast.Del)) for n in ast.walk(node)) - 1


def columns(df):
    names = ["file", "line", "end_line", "severity", "category", "title", "description", "suggestion", "confidence", "rule_id", "code"]
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_rules_as_rows(spark, python):
    """The usual rules as patterns find what they find as expressions, on the library's own modules, too."""
    contents = {"a.py": SOURCE, "broken.py": "def (", "empty.py": "", "none.py": None}
    contents |= {p.name: p.read_text(errors="replace") for p in sorted(Path(ast.__file__).parent.glob("*.py"))[:60]}
    files = python(contents)
    got = trees.pattern_findings(files, trees.tree_steps(spark), trees.tree_texts(spark))
    want = columns(syntax_findings(files))
    assert columns(got) == want and len(want) > 100
    assert len({r[5][:12] for r in want}) == 5
    assert got.select("emit_seq", "file").distinct().count() == len(want)


def matches(spark, files, steps):
    found = trees.match_trees(files, spark.createDataFrame(steps, STEPS)).collect()
    return sorted((r["rule_idx"], r["line"], r["name"]) for r in found)


def test_axes_and_quantifiers(spark, python):
    files = python({"a.py": SOURCE})
    steps = [
        # calls of eval anywhere below a function
        (10, 0, None, "self", None, ["FunctionDef", "AsyncFunctionDef"], "some", None, True),
        (10, 1, 0, "descendant", ["func"], ["Name"], "some", None, False),
        # functions without a loop below them, and without any return
        (11, 0, None, "self", None, ["FunctionDef", "AsyncFunctionDef", "Lambda"], "some", None, True),
        (11, 1, 0, "descendant", None, ["For", "While"], "none", None, False),
        # handlers, all of whose statements are a pass
        (12, 0, None, "self", None, ["ExceptHandler"], "some", None, True),
        (12, 1, 0, "child", ["body"], ["Pass"], "all", None, False),
        # each return in a function
        (13, 0, None, "self", None, ["FunctionDef"], "some", None, False),
        (13, 1, 0, "descendant", None, ["Return"], "some", None, True),
        # a kind that isn't there
        (14, 0, None, "self", None, ["Match"], "some", None, True),
        (15, 0, None, "self", None, ["FunctionDef", "AsyncFunctionDef"], "some", 3, True),
    ]
    assert matches(spark, files, steps) == [
        (10, 2, "outer"), (10, 12, "deep"), (11, 2, None), (12, 7, None), (13, 6, None), (15, 2, "outer"),
    ]


def test_empty_tables(spark, python):
    assert trees.match_trees(python({"a.py": ""}), trees.tree_steps(spark)).count() == 0
    assert trees.match_trees(python({"a.py": SOURCE}), trees.tree_steps(spark).limit(0)).count() == 0
    shapes = {r["kind"]: (r["n_nodes"], r["max_depth"]) for r in trees.tree_shapes(python({"a.py": "x = 1\ny = 2"})).collect()}
    assert shapes == {"Module": (1, 0), "Assign": (2, 1), "Name": (2, 2), "Constant": (2, 2)}


def test_few_nodes_leave_the_parser(python):
    """Of roles that only matter below some kinds, nodes elsewhere stay behind, and shapes are added up where files are parsed."""
    long = "def f():\n" + "    y = 1\n" * 50 + "try:\n    pass\nexcept E:\n    pass\n"
    whole = trees.file_nodes(long)
    some = trees.file_nodes(long, frozenset(["Try"]), frozenset(["args"]), frozenset([("body", "ExceptHandler")]))
    assert [(r[5], r[7]) for r in some] == [("args", "arguments"), ("body", "Try"), ("body", "Pass")]
    assert set(some) <= set(whole) and sum(r[5] == "body" for r in whole) == 54
    seen = {}
    for row in whole:
        n, depth = seen.get(row[7], (0, 0))
        seen[row[7]] = (n + 1, max(depth, row[3]))
    assert trees.file_shapes(long) == seen
    files = python({"a.py": long, "b.py": long, "c.py": "def ("})
    shapes = trees.tree_shapes(files)
    assert {r["kind"]: (r["n_nodes"], r["max_depth"]) for r in shapes.collect()} == {k: (2 * n, d) for k, (n, d) in seen.items()}
    plan = shapes._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "node_id" not in plan


def test_walk_is_that_of_the_library():
    for text in (SOURCE, "", "x = {**a, 1: None}\nglobal q\nmatch v:\n    case {'k': [1, *r], **z} | C(p=2): pass\n"):
        tree = ast.parse(text)
        assert list(map(id, walk(tree))) == list(map(id, ast.walk(tree)))
    assert child_fields(ast.Constant) == () and child_fields(ast.Name) == ("ctx",)
    assert child_fields(ast.Compare) == ("left", "ops", "comparators")
