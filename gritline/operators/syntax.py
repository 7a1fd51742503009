"""Syntax rules for Python files: a fact table from the parser, rules as expressions."""

from __future__ import annotations

import ast
import functools
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gritline.functions.severity import rule_id
from gritline.schemas import FINDING_COLUMNS, SYNTAX_FACTS
from gritline.vocab import LONG_FUNCTION_LINES, SNIPPET_CHARS

# Syntax findings are emitted after all line findings of a file.
SYNTAX_EMIT_BASE = 1 << 62
FINDINGS_PER_NODE = 1 << 31
FACTS_PER_BATCH = 5000

# --- fixed values: severity, category, title, description, suggestion, confidence -----
BARE_EXCEPT = (
    "medium", "bug", "Bare 'except:' clause",
    "A bare except catches everything, including KeyboardInterrupt/SystemExit, and hides bugs.",
    "Catch a specific exception type, e.g. 'except ValueError:'.", 0.8,
)
SWALLOWED = (
    "medium", "bug", "Exception silently swallowed",
    "The except body is just 'pass', discarding the error and any context.",
    "Log the exception or handle it; re-raise if it cannot be handled here.", 0.75,
)
MUTABLE_DEFAULT = (
    "medium", "bug", "Mutable default argument",
    "A mutable default is shared across all calls and accumulates state between them.",
    "Default to None and create the container inside the function body.", 0.85,
)
LONG_FUNCTION = (
    "low", "complexity", "Long function '%s' (%s lines)",
    "Very long functions are hard to test and reason about.",
    "Extract cohesive blocks into smaller, named helper functions.", 0.6,
)
NONE_COMPARISON = (
    "low", "style", "Comparison to None with == / !=",
    "Identity comparison is the correct and faster way to test for None.",
    "Use 'is None' / 'is not None'.", 0.7,
)

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOKED_AT = frozenset((ast.ExceptHandler, ast.Compare, *_FUNCTIONS))
_PLAIN = (str, int, object, str | None, int | None, list[str])


@functools.cache
def child_fields(kind: type) -> tuple[str, ...]:
    """Fields of a kind of node that may hold nodes: all but those the grammar gives plain values, where it is known."""
    types = getattr(kind, "_field_types", {})
    return tuple(field for field in kind._fields if types.get(field) not in _PLAIN)


def walk(tree: ast.AST) -> list[ast.AST]:
    """All nodes of a tree in the order of ``ast.walk``."""
    found = [tree]
    for node in found:
        for field in child_fields(type(node)):
            value = getattr(node, field, None)
            if isinstance(value, ast.AST):
                found.append(value)
            elif value and isinstance(value, list):
                found += [c for c in value if isinstance(c, ast.AST)]
    return found


def _node_facts(node: ast.AST) -> tuple:
    """(name, has_type, children as (role, node)) of a node that some rule looks at."""
    if isinstance(node, ast.ExceptHandler):
        return None, node.type is not None, [("body", b) for b in node.body]
    if isinstance(node, _FUNCTIONS):
        given = [*node.args.defaults, *(d for d in node.args.kw_defaults if d is not None)]
        return node.name, None, [("default", d) for d in given]
    return None, None, [(type(op).__name__, c) for op, c in zip(node.ops, node.comparators)]


def _kind(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        return "None" if node.value is None else "Constant"
    return type(node).__name__


def file_facts(content: str) -> list[tuple]:
    """Facts of one file: none if it does not parse, one ``error`` fact if parsing fails otherwise."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except SyntaxError:
        return []
    except (ValueError, RecursionError, MemoryError) as exc:
        return [(0, "error", f"{type(exc).__name__}: {exc}", None, None, None, None, None)]
    chosen = [(seq, node) for seq, node in enumerate(walk(tree)) if type(node) in _LOOKED_AT]
    lines = content.splitlines() if chosen else []

    def code(number: int) -> str:
        return lines[number - 1].strip()[:SNIPPET_CHARS] if number <= len(lines) else ""

    facts = []
    for seq, node in chosen:
        name, has_type, children = _node_facts(node)
        nested = [(role, _kind(c), c.lineno, code(c.lineno)) for role, c in children]
        facts.append(
            (seq, type(node).__name__, name, node.lineno, node.end_lineno, code(node.lineno), has_type, nested)
        )
    return facts


_ARROW_SCHEMA = to_arrow_schema(SYNTAX_FACTS)
_CHILD_COLUMNS = ("role", "kind", "line", "code")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_ARROW_SCHEMA)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, _ARROW_SCHEMA)], schema=_ARROW_SCHEMA
    )


def _facts_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts in batches of bounded size, one file's text in memory at a time."""
    rows: list[tuple] = []
    for batch in batches:
        for cells in zip(*batch.columns):
            facts = file_facts(cells[2].as_py())
            if facts:
                file = (cells[0].as_py(), cells[1].as_py())
            for *node, children in facts:
                nested = None if children is None else [dict(zip(_CHILD_COLUMNS, c)) for c in children]
                rows.append((*file, *node, nested))
            if len(rows) >= FACTS_PER_BATCH:
                yield _batch(rows)
                rows = []
    yield _batch(rows)


def syntax_facts(files: DataFrame) -> DataFrame:
    """Syntax facts of the Python files. Only they, and only three columns, go to Python."""
    python = files.where((F.col("language") == "python") & F.col("content").isNotNull())
    return python.select("repo_id", "path", "content").mapInArrow(_facts_of_batches, SYNTAX_FACTS)


def _finding(rule: tuple, line: Column, code: Column, sub: Column, end: Column | None = None, title: Column | None = None) -> Column:
    severity, category, text, description, suggestion, confidence = rule
    return F.struct(
        line.alias("line"),
        (line if end is None else end).alias("end_line"),
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        (F.lit(text) if title is None else title).alias("title"),
        F.lit(description).alias("description"),
        F.lit(suggestion).alias("suggestion"),
        F.lit(confidence).alias("confidence"),
        code.alias("code"),
        sub.cast("bigint").alias("sub"),
    )


def fact_findings(facts: DataFrame) -> DataFrame:
    """The five syntax rules over the fact table; no shuffle."""
    kind, line, end, code = F.col("kind"), F.col("line"), F.col("end_line"), F.col("code")
    children = F.col("children")
    handler = kind == "ExceptHandler"
    function = kind.isin("FunctionDef", "AsyncFunctionDef")

    bare = F.when(handler & ~F.col("has_type"), _finding(BARE_EXCEPT, line, code, F.lit(0)))
    only_pass = (F.size(children) > 0) & F.forall(children, lambda c: c["kind"] == "Pass")
    swallowed = F.when(handler & only_pass, _finding(SWALLOWED, line, code, F.lit(1)))
    length = (end - line).cast("string")
    title = F.format_string(LONG_FUNCTION[2], F.col("name"), length)
    long_function = F.when(
        function & ((end - line) > LONG_FUNCTION_LINES),
        _finding(LONG_FUNCTION, line, code, F.lit(FINDINGS_PER_NODE - 1).cast("bigint"), end, title),
    )
    none_operand = F.exists(children, lambda c: c["role"].isin("Eq", "NotEq") & (c["kind"] == "None"))
    comparison = F.when((kind == "Compare") & none_operand, _finding(NONE_COMPARISON, line, code, F.lit(0)))
    defaults = F.transform(
        children,
        lambda c, i: F.when(
            function & c["kind"].isin("List", "Dict", "Set"),
            _finding(MUTABLE_DEFAULT, c["line"], c["code"], i),
        ),
    )
    found = F.filter(F.concat(F.array(bare, swallowed, long_function, comparison), defaults), F.isnotnull)
    return (
        facts.where(kind != "error")
        .select("repo_id", F.col("path").alias("file"), "walk_seq", F.inline(found))
        .withColumns(
            {
                "rule_id": rule_id(F.col("category"), F.col("title")),
                "source": F.lit("heuristic"),
                "emit_seq": F.lit(SYNTAX_EMIT_BASE)
                + F.col("walk_seq").cast("bigint") * FINDINGS_PER_NODE
                + F.col("sub"),
            }
        )
        .select(*FINDING_COLUMNS)
    )


def syntax_findings(files: DataFrame) -> DataFrame:
    return fact_findings(syntax_facts(files))


def syntax_errors(facts: DataFrame) -> DataFrame:
    """Files whose parse failed in another way than a syntax error."""
    return facts.where(F.col("kind") == "error").select(
        "repo_id", "path", F.concat_ws(": ", "path", "name").alias("error")
    )
