"""Python syntax trees as tables, and rules as tree patterns that are rows.

A node's number is its place in a walk that goes down first, and ``last`` is the number of its last descendant, so that a
node is below another one if its number is within the other's range: containment is a join, not a walk.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritline.functions.severity import rule_id
from gritline.operators import syntax as sx
from gritline.operators.skew import stage
from gritline.schemas import FINDING_COLUMNS
from gritline.vocab import LONG_FUNCTION_LINES, SNIPPET_CHARS

FILE = ("repo_id", "path")
NODES = (
    "repo_id bigint, path string, node_id int, last int, parent_id int, depth int, walk_seq int, role string, place int, "
    "kind string, name string, line int, end_line int, code string"
)
NODES_PER_BATCH = 5000
_NAMES = ("name", "id", "attr", "arg")
_CONTEXTS = frozenset((ast.Load, ast.Store, ast.Del))
SHAPES = "repo_id bigint, kind string, n_nodes bigint, max_depth int"
_ARROW = pa.schema([
    ("repo_id", pa.int64()), ("path", pa.string()), *((c, pa.int32()) for c in ("node_id", "last", "parent_id", "depth", "walk_seq")),
    ("role", pa.string()), ("place", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()),
    ("end_line", pa.int32()), ("code", pa.string()),
])

# --- tree patterns -------------------------------------------------------------------------
# A pattern is some steps. Step 0 is the node that a rule is about; another one looks from the node of an earlier step
# (``base``) along an axis: child, descendant, or beside (children of the same parent with the same place among those of
# their role). ``quant`` says whether some of the nodes with a role there must be of the kinds, none, or all and at least
# one. ``reports`` marks the step whose nodes are reported; without one it is step 0, once.
STEPS = (
    "rule_idx int, step int, base int, axis string, roles array<string>, kinds array<string>, quant string, "
    "longer_than int, reports boolean"
)
FUNCTIONS = ["FunctionDef", "AsyncFunctionDef"]
TREE_STEPS = [
    (0, 0, None, "self", None, ["ExceptHandler"], "some", None, True),
    (0, 1, 0, "child", ["type"], None, "none", None, False),
    (1, 0, None, "self", None, ["ExceptHandler"], "some", None, True),
    (1, 1, 0, "child", ["body"], ["Pass"], "all", None, False),
    (2, 0, None, "self", None, FUNCTIONS, "some", None, False),
    (2, 1, 0, "child", ["args"], None, "some", None, False),
    (2, 2, 1, "child", ["defaults", "kw_defaults"], ["List", "Dict", "Set"], "some", None, True),
    (3, 0, None, "self", None, FUNCTIONS, "some", LONG_FUNCTION_LINES, True),
    (4, 0, None, "self", None, ["Compare"], "some", None, True),
    (4, 1, 0, "child", ["ops"], ["Eq", "NotEq"], "some", None, False),
    (4, 2, 1, "beside", ["comparators"], ["None"], "some", None, False),
]
TREE_TEXTS = [sx.BARE_EXCEPT, sx.SWALLOWED, sx.MUTABLE_DEFAULT, sx.LONG_FUNCTION, sx.NONE_COMPARISON]


def _tree(content: str) -> ast.AST | None:
    """The tree of a file, none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def file_nodes(
    content: str, kinds: frozenset[str] | None = None, roles: frozenset[str] = frozenset(), below_kinds: frozenset[tuple] = frozenset()
) -> list[tuple]:
    """Rows of one file's tree, from ``node_id`` on; none if it does not parse.

    With ``kinds``, only nodes of those, or of ``roles``, or whose role and parent's kind are a pair of ``below_kinds``.
    """
    tree = _tree(content)
    if tree is None:
        return []
    walked: dict[int, int] = {}
    for seq, node in enumerate(sx.walk(tree)):
        walked.setdefault(id(node), seq)
    lines = content.splitlines()
    above: list[int] = []  # the parent of each node
    sorts: list[str] = []  # and the kind of each
    rows: list[list] = []
    todo: list[tuple[ast.AST, int | None, int, str, int]] = [(tree, None, 0, "", 0)]
    while todo:
        node, parent, depth, role, place = todo.pop()
        number = len(above)
        above.append(parent)
        kind = sx._kind(node)
        sorts.append(kind)
        if kinds is None or kind in kinds or role in roles or (parent is not None and (role, sorts[parent]) in below_kinds):
            line = getattr(node, "lineno", None)
            code = lines[line - 1].strip()[:SNIPPET_CHARS] if line and line <= len(lines) else ""
            names = (getattr(node, field, None) for field in _NAMES)
            name = next((n for n in names if isinstance(n, str)), None)
            end = getattr(node, "end_lineno", None)
            rows.append([number, number, parent, depth, walked[id(node)], role, place, kind, name, line, end, code])
        below = []
        for field in sx.child_fields(type(node)):
            value = getattr(node, field, None)
            if isinstance(value, list):
                below += [(c, number, depth + 1, field, k) for k, c in enumerate(value) if isinstance(c, ast.AST)]
            elif isinstance(value, ast.AST) and type(value) not in _CONTEXTS:
                below.append((value, number, depth + 1, field, 0))
        below.reverse()
        todo += below
    last = list(range(len(above)))
    for number in range(len(above) - 1, 0, -1):
        if last[number] > last[above[number]]:
            last[above[number]] = last[number]
    for row in rows:
        row[1] = last[row[0]]
    return [tuple(row) for row in rows]


def file_shapes(content: str) -> dict[str, tuple[int, int]]:
    """Number and greatest depth of the nodes of each kind in one file's tree, taken level by level."""
    tree = _tree(content)
    counts: dict[str, int] = {}
    deepest: dict[str, int] = {}
    depth, level = 0, [] if tree is None else [tree]
    while level:
        below = []
        for node in level:
            kind = sx._kind(node)
            counts[kind] = counts.get(kind, 0) + 1
            deepest[kind] = depth
            for field in sx.child_fields(type(node)):
                value = getattr(node, field, None)
                if isinstance(value, list):
                    below += [c for c in value if isinstance(c, ast.AST)]
                elif isinstance(value, ast.AST) and type(value) not in _CONTEXTS:
                    below.append(value)
        depth, level = depth + 1, below
    return {kind: (n, deepest[kind]) for kind, n in counts.items()}


def syntax_nodes(
    files: DataFrame, kinds: Sequence[str] | None = None, roles: Sequence[str] | None = None, below_kinds: Sequence[tuple] = ()
) -> DataFrame:
    """A row for each node of each Python file that parses (context markers left out).

    With ``kinds`` or ``roles``, only nodes with one of either leave the parser, and those whose role and parent's kind are a
    pair of ``below_kinds``. Trees go in batches of bounded size, one
    file's at a time.
    """
    some_kinds = None if kinds is None and roles is None else frozenset(kinds or ())
    some_roles, some_below = frozenset(roles or ()), frozenset(below_kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for cells in zip(*batch.columns):
                nodes = file_nodes(cells[2].as_py(), some_kinds, some_roles, some_below)
                if nodes:
                    file = (cells[0].as_py(), cells[1].as_py())
                    rows += [(*file, *node) for node in nodes]
                while len(rows) >= NODES_PER_BATCH:
                    yield _batch(rows[:NODES_PER_BATCH])
                    del rows[:NODES_PER_BATCH]
        yield _batch(rows)

    python = files.where((F.col("language") == "python") & F.col("content").isNotNull())
    return python.select("repo_id", "path", "content").mapInArrow(run, NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, _ARROW)], schema=_ARROW)


def tree_steps(spark: SparkSession) -> DataFrame:
    """The five usual rules as pattern rows."""
    return spark.createDataFrame(TREE_STEPS, STEPS)


def _of_kind(kind: Column, kinds: Column) -> Column:
    return kinds.isNull() | F.array_contains(kinds, kind)


def match_trees(files: DataFrame, steps: DataFrame) -> DataFrame:
    """``rule_idx``, the file, the root's ``walk_seq`` and the reported node's columns, for each match of each pattern.

    Patterns have the size of a program and are broadcast; a step is one join for each axis and quantifier in use, however
    many rules there are. Nodes that no step speaks of don't leave the parser. Of a root, each reported node comes once.
    """
    rows = steps.collect()
    wanted_kinds = sorted({k for r in rows for k in (r["kinds"] or ())})
    # Roles of nodes that matter whatever their kind: of any, or none of which may be there, or all of which count.
    # A child of a node whose kinds are known only matters below one of them.
    base_kinds = {(r["rule_idx"], r["step"]): r["kinds"] for r in rows}
    wanted_roles: set[str] = set()
    below_kinds: set[tuple] = set()
    for r in rows:
        if r["step"] and (not r["kinds"] or r["quant"] != "some"):
            above = base_kinds.get((r["rule_idx"], r["base"])) if r["axis"] == "child" else None
            if above is None:
                wanted_roles.update(r["roles"] or ())
            else:
                below_kinds.update((role, kind) for role in (r["roles"] or ()) for kind in above)
    free = any(not r["kinds"] and not r["roles"] for r in rows)
    nodes = syntax_nodes(files) if free else syntax_nodes(files, wanted_kinds, sorted(wanted_roles), sorted(below_kinds))
    shape = F.struct("node_id", "last", "parent_id", "place", "name", "line", "end_line", "code").alias("node")
    nodes = stage(nodes.select(*FILE, "walk_seq", "role", "kind", shape))  # files are parsed once
    first = F.broadcast(steps.where("step = 0").select("rule_idx", F.col("kinds").alias("_kinds"), F.col("longer_than").alias("_long")))
    long = F.col("_long").isNull() | (F.col("node.end_line") - F.col("node.line") > F.col("_long"))
    found = nodes.join(first, _of_kind(F.col("kind"), F.col("_kinds")) & long)
    found = found.select("rule_idx", *FILE, F.col("walk_seq").alias("root_seq"), F.array("node").alias("bound"))
    report = {r["rule_idx"]: r["step"] for r in sorted(rows, key=lambda r: r["step"]) if r["reports"]}
    for number in range(1, max((r["step"] for r in rows), default=0) + 1):
        here = [r for r in rows if r["step"] == number]
        ways = sorted({(r["axis"], r["quant"]) for r in here})
        busy = [r["rule_idx"] for r in here]
        parts = [found.where(~F.col("rule_idx").isin(busy))]
        for axis, quant in ways:
            some = [r["rule_idx"] for r in here if (r["axis"], r["quant"]) == (axis, quant)]
            near = _concerned(nodes, [r for r in here if (r["axis"], r["quant"]) == (axis, quant)], quant)
            parts.append(_step(found.where(F.col("rule_idx").isin(some)), near, steps.where(F.col("step") == number), axis, quant))
        found = reduce(DataFrame.unionByName, parts)
    at = F.create_map(*[F.lit(x) for pair in report.items() for x in pair]) if report else F.create_map().cast("map<int,int>")
    node = F.get(F.col("bound"), F.coalesce(F.element_at(at, F.col("rule_idx")), F.lit(0)))
    reported = found.select("rule_idx", *FILE, "root_seq", F.col("bound")[0]["node_id"].alias("root_id"), node.alias("node"))
    return reported.distinct().select("rule_idx", *FILE, "root_seq", "root_id", "node.*")


def _concerned(nodes: DataFrame, steps: Sequence, quant: str) -> DataFrame:
    """Nodes of which some of the steps may speak; others aren't moved for the join."""
    if all(r["roles"] is not None for r in steps):
        nodes = nodes.where(F.col("role").isin(sorted({x for r in steps for x in r["roles"]})))
    if quant != "all" and all(r["kinds"] is not None for r in steps):
        nodes = nodes.where(F.col("kind").isin(sorted({k for r in steps for k in r["kinds"]})))
    return nodes


def _step(found: DataFrame, nodes: DataFrame, steps: DataFrame, axis: str, quant: str) -> DataFrame:
    """Matches so far that a step of one axis and quantifier lets through, with the step's node bound."""
    rules = steps.select("rule_idx", F.col("base").alias("_base"), F.col("roles").alias("_roles"), F.col("kinds").alias("_kinds"))
    held = found.join(F.broadcast(rules), "rule_idx").withColumn("_from", F.get(F.col("bound"), F.col("_base")))
    near = nodes.select(*[F.col(c).alias(f"_of_{c}") for c in FILE], F.col("role").alias("_role"), F.col("kind").alias("_kind"), F.col("node").alias("_node"))
    same = (F.col("repo_id") == F.col("_of_repo_id")) & (F.col("path") == F.col("_of_path"))
    if axis == "child":
        same &= F.col("_node.parent_id") == F.col("_from.node_id")
    elif axis == "beside":
        same &= (F.col("_node.parent_id") == F.col("_from.parent_id")) & (F.col("_node.place") == F.col("_from.place"))
    else:
        same &= (F.col("_node.node_id") > F.col("_from.node_id")) & (F.col("_node.node_id") <= F.col("_from.last"))
    same &= F.col("_roles").isNull() | F.array_contains("_roles", F.col("_role"))
    fits = _of_kind(F.col("_kind"), F.col("_kinds"))
    columns = ["rule_idx", *FILE, "root_seq"]
    if quant == "none":
        kept = held.join(near, same & fits, "left_anti")
        return kept.select(*columns, F.array_append("bound", F.lit(None).cast(_node_type(found))).alias("bound"))
    if quant == "all":
        kept = held.join(near, same, "left_semi").join(near, same & ~fits, "left_anti")
        return kept.select(*columns, F.array_append("bound", F.lit(None).cast(_node_type(found))).alias("bound"))
    return held.join(near, same & fits).select(*columns, F.array_append("bound", F.col("_node")).alias("bound"))


def _node_type(found: DataFrame):
    return found.schema["bound"].dataType.elementType


def pattern_findings(files: DataFrame, steps: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings of tree patterns. ``texts`` has rule_idx, severity, category, title, description, suggestion, confidence.

    In a title, ``%s`` stands for the node's name, and a second one for its length in lines. Findings of a file come in the order
    of the roots, and of one root in that of the reported nodes and the rules.
    """
    length = (F.col("end_line") - F.col("line")).cast("string")
    long = F.col("title").contains("%s")
    # The parts of a title around its first two marks.
    parts = F.split("title", "%s")
    rest = F.array_join(F.slice(parts, 3, 1 << 20), "%s")
    filled = F.concat(F.get(parts, F.lit(0)), F.coalesce("name", F.lit("")), F.get(parts, F.lit(1)), F.when(F.size(parts) > 2, F.concat(length, rest)).otherwise(""))
    listed = sorted(r["rule_idx"] for r in texts.select("rule_idx").collect())  # as many as a program has
    nth = F.array_position(F.array(*map(F.lit, listed)).cast("array<int>"), F.col("rule_idx")) - 1
    found = match_trees(files, steps).join(F.broadcast(texts), "rule_idx")
    order = F.lit(sx.SYNTAX_EMIT_BASE) + F.col("root_seq").cast("bigint") * sx.FINDINGS_PER_NODE + (
        (F.col("node_id") - F.col("root_id")).cast("bigint") * len(listed) + nth
    )
    return found.select(
        "repo_id", F.col("path").alias("file"), "line", F.when(long, F.col("end_line")).otherwise(F.col("line")).alias("end_line"),
        "severity", "category", F.when(long, filled).otherwise(F.col("title")).alias("title"), "description", "suggestion", "confidence",
        F.lit("heuristic").alias("source"), "code", order.alias("emit_seq"),
    ).withColumn("rule_id", rule_id(F.col("category"), F.col("title"))).select(*FINDING_COLUMNS)


def tree_texts(spark: SparkSession) -> DataFrame:
    rows = [(k, *texts) for k, texts in enumerate(TREE_TEXTS)]
    return spark.createDataFrame(rows, "rule_idx int, severity string, category string, title string, description string, suggestion string, confidence double")


def _shapes_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes of the files of a task, added up for each repository and kind; they are handed on before they get many."""
    schema = pa.schema([("repo_id", pa.int64()), ("kind", pa.string()), ("n_nodes", pa.int64()), ("max_depth", pa.int32())])
    totals: dict[tuple, tuple[int, int]] = {}

    def handed_on() -> pa.RecordBatch:
        rows = [(*key, *total) for key, total in totals.items()]
        totals.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for cells in zip(*batch.columns):
            repo_id = cells[0].as_py()
            for kind, (n, depth) in file_shapes(cells[1].as_py()).items():
                before = totals.get((repo_id, kind), (0, 0))
                totals[repo_id, kind] = (before[0] + n, max(before[1], depth))
            if len(totals) >= NODES_PER_BATCH:
                yield handed_on()
    yield handed_on()


def tree_shapes(files: DataFrame) -> DataFrame:
    """How often each kind of node comes in a repository's Python files, and how deep at most.

    Nodes are counted where they are parsed, so that no row is made for each of them.
    """
    python = files.where((F.col("language") == "python") & F.col("content").isNotNull())
    shapes = python.select("repo_id", "content").mapInArrow(_shapes_of_batches, SHAPES)
    return shapes.groupBy("repo_id", "kind").agg(F.sum("n_nodes").alias("n_nodes"), F.max("max_depth").alias("max_depth"))
