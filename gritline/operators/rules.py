"""Line rules: the catalogue, and matching it against lines in one pass.

Patterns are written in a form that Java and RE2 read alike. Word boundaries and
word characters cover all letters and digits, and white space covers all Unicode
space, whatever the engine's own idea of them is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritline.functions import text as tx
from gritline.operators.rule_index import indexed_hits
from gritline.schemas import FINDING_COLUMNS
from gritline.vocab import PRODUCT

_W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"
_B0 = rf"(?:^|{_NOT_W})"
_B1 = rf"(?:$|{_NOT_W})"
_S = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

SCRIPT = ("javascript", "typescript")

# emit_seq = line * INTS + rule number; both are below 2**31, so no two of them meet.
INTS = 1 << 31
RULES_PER_PASS = 40


@dataclass(frozen=True)
class LineRule:
    """One line rule.

    ``needles`` are texts one of which every matching line contains, and ``folded`` the
    same for the lower-cased line; testing for them first is cheap and saves most
    regex calls. With ``value_group`` set, the rule holds only if that group of the
    first match is not a placeholder.
    """

    pattern: str
    severity: str
    category: str
    title: str
    description: str
    suggestion: str
    confidence: float
    languages: tuple[str, ...] | None = None
    needles: tuple[str, ...] = ()
    value_group: int = 0
    folded: tuple[str, ...] = ()

    @property
    def rule_id(self) -> str:
        digest = hashlib.sha256(f"{self.category}:{self.title}".lower().encode()).hexdigest()
        return f"{PRODUCT}/{self.category}/{digest[:8]}"


# --- fixed values: placeholder values of a secret -----------------------------------
PLACEHOLDER = (
    r"(?i)(?:example|your[_-]?|changeme|placeholder|xxxx|<.*>|\{\{?.*\}?\}|\$\{"
    r"|os\.environ|getenv|process\.env)"
)
MASKED = r"^[*xX.]*$"

# --- fixed values: the line rules, in emission order ----------------------------------
LINE_RULES: tuple[LineRule, ...] = (
    LineRule(
        r"AKIA[0-9A-Z]{16}",
        "critical", "security", "Hardcoded AWS access key id",
        "An AWS access key id appears to be committed in source.",
        "Remove the credential, rotate it immediately, and load it from a secret manager or environment variable.",
        0.97, None, ("AKIA",),
    ),
    LineRule(
        r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
        "critical", "security", "Private key committed to source",
        "A private key block is embedded in the file.",
        "Remove the key from the repository, rotate it, and store secrets outside version control.",
        0.97, None, ("-----BEGIN ",),
    ),
    LineRule(
        rf"(?i){_B0}[a-z0-9_]*(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token"
        rf"|client[_-]?secret)[a-z0-9_]*{_S}*[:=]{_S}*[\"']([^\"']{{6,}})[\"']",
        "high", "security", "Possible hardcoded secret",
        "A credential-like value appears to be hardcoded as a string literal.",
        "Move the value to an environment variable or secret manager and reference it at runtime.",
        0.8, None, ('"', "'"), 1, ("passw", "secret", "api", "token"),
    ),
    LineRule(
        rf"{_B0}(?:eval|exec){_S}*\(",
        "high", "security", "Dynamic code execution (eval/exec)",
        "eval/exec executes arbitrary code and is a common injection sink.",
        "Replace with explicit parsing/dispatch (e.g. a lookup table, json.loads, ast.literal_eval).",
        0.7, ("python", *SCRIPT), ("eval", "exec"),
    ),
    LineRule(
        rf"hashlib\.(?:md5|sha1){_S}*\(|createHash\({_S}*['\"](?:md5|sha1)['\"]",
        "medium", "security", "Weak hash algorithm (MD5/SHA-1)",
        "MD5 and SHA-1 are cryptographically broken and unsuitable for security use.",
        "Use SHA-256 or stronger; for passwords use bcrypt/scrypt/argon2.",
        0.75, None, ("hashlib.", "createHash("),
    ),
    LineRule(
        rf"\.innerHTML{_S}*=",
        "medium", "security", "Assignment to innerHTML (XSS risk)",
        "Writing untrusted data to innerHTML can introduce cross-site scripting.",
        "Use textContent, or sanitize/escape the value before insertion.",
        0.6, SCRIPT, (".innerHTML",),
    ),
    LineRule(
        rf"document\.write{_S}*\(",
        "medium", "security", "Use of document.write",
        "document.write can enable XSS and blocks parsing.",
        "Build DOM nodes explicitly or set textContent instead.",
        0.6, SCRIPT, ("document.write",),
    ),
    LineRule(
        rf"(?:^|[^.\p{{L}}\p{{N}}_])console\.(?:log|debug|info){_S}*\(",
        "info", "style", "Leftover console logging",
        "Console logging is often debug residue and noisy in production.",
        "Remove the statement or route it through a configurable logger.",
        0.5, SCRIPT, ("console.",),
    ),
    LineRule(
        rf"(?:^|{_S})var{_S}+[A-Za-z_$]",
        "low", "maintainability", "Use of 'var'",
        "'var' is function-scoped and error-prone.",
        "Prefer 'const' (or 'let' when reassignment is required).",
        0.5, SCRIPT, ("var",),
    ),
    LineRule(
        rf"(?i){_B0}(?:TODO|FIXME|HACK|XXX){_B1}",
        "info", "maintainability", "Unresolved TODO/FIXME marker",
        "An unresolved task marker remains in the code.",
        "Resolve the item or track it in an issue and remove the marker.",
        0.45, None, (), 0, ("todo", "fixme", "hack", "xxx"),
    ),
)


def _java(pattern: str) -> str:
    """Case-insensitive patterns fold all letters, not only ASCII ones."""
    return "(?iu)" + pattern[4:] if pattern.startswith("(?i)") else pattern


def looks_like_placeholder(value: Column) -> Column:
    return value.rlike(_java(PLACEHOLDER)) | value.rlike(MASKED)


def _contains_any(text: Column, needles: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needles])


def rule_matches(rule: LineRule, text: Column, language: Column, folded: Column, wide: Column) -> Column:
    """Condition of one rule, cheapest tests first.

    ``folded`` is the lower-cased text. Lower case settles ``rule.folded`` for ASCII text only,
    so ``wide`` lines (with other characters) always go to the regex.
    """
    tests: list[Column] = []
    if rule.languages is not None:
        tests.append(language.isin(*rule.languages) if rule.languages else F.lit(False))
    if rule.needles:
        tests.append(_contains_any(text, rule.needles))
    if rule.folded:
        tests.append(wide | _contains_any(folded, rule.folded))
    pattern = _java(rule.pattern)
    tests.append(text.rlike(pattern))
    if rule.value_group:
        tests.append(~looks_like_placeholder(F.regexp_extract(text, pattern, rule.value_group)))
    return reduce(and_, tests)


def with_folded(lines: DataFrame) -> DataFrame:
    """Add the columns that :func:`rule_matches` needs besides text and language."""
    wide = F.octet_length("text") != F.length("text")
    return lines.withColumns({"_folded": F.lower("text"), "_wide": wide})


def line_hits(lines: DataFrame, rules: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """One row per line and matching rule: the lines' columns and ``rule_idx``.

    All rules are evaluated in one pass over the lines, each as its own expression
    with a literal pattern, which a task compiles once. The marks are a column of
    their own, so that the pass is generated code and runs once per line.
    """
    columns = [F.col(c) for c in ("text", "language", "_folded", "_wide")]
    marks = [F.when(rule_matches(r, *columns), F.lit(i)).otherwise(F.lit(-1)) for i, r in enumerate(rules)]
    marked = with_folded(lines).select(*lines.columns, F.array(*marks).cast("array<int>").alias("_marks"))
    return marked.select(*lines.columns, F.explode(F.array_remove("_marks", -1)).alias("rule_idx"))


def rule_table(spark: SparkSession, rules: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """The catalogue as rows."""
    table = pa.table(
        {
            "rule_idx": pa.array(range(len(rules)), pa.int32()),
            "rule_id": [r.rule_id for r in rules],
            "pattern": [r.pattern for r in rules],
            "severity": [r.severity for r in rules],
            "category": [r.category for r in rules],
            "title": [r.title for r in rules],
            "description": [r.description for r in rules],
            "suggestion": [r.suggestion for r in rules],
            "confidence": [r.confidence for r in rules],
            "languages": pa.array([r.languages for r in rules], pa.list_(pa.string())),
            "value_group": pa.array([r.value_group for r in rules], pa.int32()),
        }
    )
    return spark.createDataFrame(table)


def hit_findings(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits with the texts of their rule."""
    texts = rules.select(
        "rule_idx", "rule_id", "severity", "category", "title", "description", "suggestion", "confidence"
    )
    return (
        hits.join(texts, "rule_idx")
        .withColumns(
            {
                "file": F.col("path"),
                "line": F.col("line_no").cast("int"),
                "end_line": F.col("line_no").cast("int"),
                "source": F.lit("heuristic"),
                "code": tx.snippet(F.col("text")),
                "emit_seq": F.col("line_no").cast("bigint") * INTS + F.col("rule_idx"),
            }
        )
        .select(*FINDING_COLUMNS)
    )


def line_findings(lines: DataFrame, rules: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """Findings of the line rules. No shuffle: the rules come from a list, so their texts are broadcast."""
    return hit_findings(line_hits(lines, rules), F.broadcast(rule_table(lines.sparkSession, rules)))


def user_rules(rules: DataFrame) -> list[tuple[int, LineRule]]:
    """Number and rule of every row of a rule table (columns as in :func:`rule_table`), in order.

    Rules are written by people, so their list has the size of a program, not of the data.
    """
    rows = sorted(rules.toLocalIterator(), key=lambda r: r["rule_idx"])
    return [
        (
            r["rule_idx"],
            LineRule(
                r["pattern"], r["severity"], r["category"], r["title"], r["description"], r["suggestion"],
                r["confidence"], None if r["languages"] is None else tuple(r["languages"]),
                value_group=r["value_group"] or 0,
            ),
        )
        for r in rows
    ]


def table_rule_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of user rules kept in a table.

    Up to ``RULES_PER_PASS`` rules become literal patterns, as in :func:`line_hits`. Of more rules, a line
    meets those of which it holds a text that their matches contain (:mod:`gritline.operators.rule_index`), and all
    that have none. Either way the lines are read once, and no line is paired with all rules. A null
    ``value_group`` is none.
    """
    known = user_rules(rules)
    if len(known) <= RULES_PER_PASS:
        index = F.array(*[F.lit(number) for number, _ in known]).cast("array<int>")
        hits = line_hits(lines, [rule for _, rule in known])
        return hits.withColumn("rule_idx", F.get(index, F.col("rule_idx")))
    checks = lines.sparkSession.createDataFrame(
        pa.table(
            {
                "place": pa.array(range(len(known)), pa.int32()),
                "_pattern": [_java(rule.pattern) for _, rule in known],
                "_languages": pa.array([rule.languages for _, rule in known], pa.list_(pa.string())),
                "_group": pa.array([rule.value_group for _, rule in known], pa.int32()),
                "_idx": pa.array([number for number, _ in known], pa.int32()),
            }
        )
    )
    value = F.expr("regexp_extract(text, _pattern, _group)")
    matches = (
        (F.col("_languages").isNull() | F.array_contains("_languages", F.col("language")))
        & (F.col("_fixed") | F.rlike(F.col("text"), F.col("_pattern")))
        & ((F.col("_group") == 0) | ~looks_like_placeholder(value))
    )
    columns = [F.col(c) for c in ("text", "language", "_folded", "_wide")]

    def mark(place: int) -> Column:
        return F.when(rule_matches(known[place][1], *columns), F.lit(place)).otherwise(F.lit(-1))

    hits = indexed_hits(with_folded(lines), checks, [rule.pattern for _, rule in known], mark, matches)
    return hits.select(*lines.columns, F.col("_idx").alias("rule_idx"))
