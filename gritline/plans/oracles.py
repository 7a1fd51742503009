"""SQL counterparts of the registered queries, for an independent engine.

Where the fixtures allow it, the expected rows come from the template that wrote a line
(its number is ``l_partkey % 18``), not from matching the rules again.
"""

from __future__ import annotations

import json

from gritline.operators.rules import LINE_RULES, MASKED, PLACEHOLDER
from gritline.operators import syntax as sx
from gritline.plans import fixtures as fx
from gritline.sinks import documents as doc
from gritline.sources import responses as rs
from gritline.vocab import EXTENSION_LANGUAGE, PRODUCT, SEVERITIES, SEVERITY_EMOJI, SEVERITY_RANK, SKIP_DIRS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    def cell(value) -> str:
        if value is None:
            return "NULL"
        return _q(value) if isinstance(value, str) else f"{value}"

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


_ORDER = ", ".join(fx.LINE_ORDER)

# Which rules a template hits: template number -> rule index.
_TEMPLATE_HITS = [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8), (10, 9), (16, 3), (16, 8), (16, 9)]

_RULES = _values(
    [
        (
            i, r.rule_id, r.severity, SEVERITY_RANK[r.severity], r.category, r.title, r.description, r.suggestion,
            r.confidence, None if r.languages is None else ",".join(r.languages),
        )
        for i, r in enumerate(LINE_RULES)
    ]
)

_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in SEVERITY_RANK.items()) + " END"
_LEVEL = "CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
_EMOJI = "CASE severity " + " ".join(f"WHEN '{s}' THEN '{e}'" for s, e in SEVERITY_EMOJI.items()) + " END"

# At most 80 findings per file, the worst first.
_CAP = "QUALIFY row_number() OVER (PARTITION BY repo_id, file ORDER BY rank DESC, line, emit_seq) <= 80"

_CTES = {
    "lang": f"SELECT * FROM {_values(list(EXTENSION_LANGUAGE.items()))} AS t(ext, language)",
    "raw": f"""SELECT l_orderkey AS file_id, l_orderkey % 40 AS repo_id, {fx.PATH_SQL} AS path,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS INTEGER) AS line_no,
        l_partkey, l_linenumber, l_returnflag, {fx.TEXT_SQL} AS text FROM lineitem""",
    "files": r"""SELECT file_id, repo_id, path, language FROM (
        SELECT DISTINCT l_orderkey AS file_id, l_orderkey % 40 AS repo_id, """ + fx.PATH_SQL + r""" AS path FROM lineitem)
        LEFT JOIN lang ON ext = lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))""",
    "lines": "SELECT raw.*, files.language FROM raw JOIN files USING (file_id) WHERE language IS NOT NULL",
    "contents": """SELECT file_id, raw.repo_id, raw.path, any_value(language) AS language,
        string_agg(text, chr(10) ORDER BY line_no) AS content, CAST(count(*) AS INTEGER) AS line_count
        FROM raw JOIN files USING (file_id) GROUP BY file_id, raw.repo_id, raw.path""",
    # Findings of the files within the size limit; a diff's files have up to 49 empty lines more.
    "found_small": "SELECT found_all.* FROM found_all SEMI JOIN (SELECT file_id FROM contents WHERE strlen(content) <= 200000) USING (file_id)",
    "found_diff": "SELECT found_all.* FROM found_all SEMI JOIN (SELECT file_id FROM contents WHERE strlen(content) + file_id % 50 <= 200000) USING (file_id)",
    "rules": f"""SELECT rule_idx, rule_id, severity, rank, category, title, description, suggestion,
        CAST(confidence AS DOUBLE) AS confidence, languages FROM {_RULES}
        AS t(rule_idx, rule_id, severity, rank, category, title, description, suggestion, confidence, languages)""",
    "template": f"SELECT * FROM {_values(_TEMPLATE_HITS)} AS t(template, rule_idx)",
    "hits": """SELECT lines.file_id, lines.repo_id, path, language, line_no, text, rules.*
        FROM lines JOIN template ON l_partkey % 18 = template JOIN rules USING (rule_idx)
        WHERE languages IS NULL OR list_contains(string_split(languages, ','), language)""",
    "found_all": """SELECT file_id, repo_id, path AS file, line_no AS line, line_no AS end_line, severity, rank, category, title,
        description, suggestion, confidence, rule_id, 'heuristic' AS source, substr(trim(text), 1, 200) AS code,
        CAST(line_no AS BIGINT) * 2147483648 + rule_idx AS emit_seq FROM hits""",
    "found": f"SELECT * FROM found_all {_CAP}",
    "counts": "SELECT repo_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
    + ", count(*) AS total FROM found GROUP BY repo_id",
    "big": """SELECT repo_id, 'r' || cast(repo_id as string) || '.js' AS path, l_partkey,
        CAST(row_number() OVER (PARTITION BY repo_id ORDER BY file_id, line_no) AS INTEGER) AS line_no FROM raw""",
    "layers": f"""SELECT c_custkey AS repo_id, {fx.SEGMENT_SQL} AS seg, {fx.ENV_SQL} AS env, {fx.FLAG_SQL} AS flag,
        c_custkey AS k FROM customer""",
    "policies": """SELECT repo_id,
        CASE WHEN flag = 'none' THEN NULL WHEN flag IS NOT NULL THEN flag
             WHEN env = 'medium' THEN 'medium' WHEN env = 'bogus' THEN 'high'
             WHEN seg = 'low' THEN 'low' WHEN seg = ' Critical ' THEN 'critical' ELSE 'high' END AS fail_on,
        CAST(CASE WHEN k % 10 = 0 THEN 0.75 WHEN k % 3 = 0 THEN 0.6 ELSE 0 END AS DOUBLE) AS min_confidence,
        CAST(CASE WHEN k % 9 = 0 THEN 500 WHEN k % 4 = 0 THEN greatest(1, k - 100) ELSE 200000 END AS BIGINT) AS max_bytes,
        CASE WHEN k % 7 = 0 THEN '*.js' WHEN k % 2 = 0 THEN 'src/*|*.ts' END AS include,
        CASE WHEN k % 5 = 0 THEN '*[02468].[jt]s' WHEN k % 3 = 1 THEN '**/vendor/**|m?.*' END AS exclude,
        CASE WHEN k % 8 = 0 THEN 'env-model' WHEN k % 6 = 0 THEN 'file-model' ELSE 'reviewer-model' END AS model,
        CAST(CASE WHEN k % 4 = 1 THEN 1024 ELSE 4096 END AS INTEGER) AS max_tokens,
        CAST(CASE WHEN k % 12 = 0 THEN 3 WHEN k % 4 = 2 THEN 1 ELSE 8 END AS INTEGER) AS max_workers,
        k % 13 = 0 OR k % 11 = 0 AS no_ai FROM layers""",
    # What the response items say, by the arm that wrote them.
    "items": """SELECT lines.file_id, lines.repo_id, lines.path AS file, l_partkey % 10 AS arm, line_no, line_count
        FROM lines JOIN contents USING (file_id) WHERE lines.file_id % 11 <> 0 AND l_partkey % 10 <> 5""",
    "modelled": """SELECT repo_id, file,
        CAST(CASE arm WHEN 6 THEN 1 WHEN 7 THEN line_count WHEN 9 THEN 1 ELSE line_no END AS INTEGER) AS line,
        CAST(CASE arm WHEN 6 THEN 1 WHEN 7 THEN line_count WHEN 9 THEN least(2, line_count) ELSE line_no END AS INTEGER) AS end_line,
        CASE arm WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 3 THEN 'low' WHEN 4 THEN 'info' WHEN 6 THEN 'critical'
          WHEN 9 THEN 'low' ELSE 'medium' END AS severity,
        CASE arm WHEN 0 THEN 'bug' WHEN 1 THEN 'bug' WHEN 2 THEN 'style' WHEN 4 THEN 'security' WHEN 6 THEN 'performance'
          WHEN 7 THEN 'testing' WHEN 8 THEN 'complexity' ELSE 'maintainability' END AS category,
        'T' || cast(arm as string) AS title,
        CASE WHEN arm IN (0, 1) THEN 'd' ELSE '' END AS description, CASE WHEN arm = 0 THEN 's' ELSE '' END AS suggestion,
        CAST(CASE arm WHEN 0 THEN 0.9 WHEN 1 THEN 1 WHEN 2 THEN 0.25 WHEN 3 THEN 0 WHEN 4 THEN 0.5 WHEN 6 THEN 0.5
          WHEN 9 THEN 0.5 ELSE 0.85 END AS DOUBLE) AS confidence,
        'ai' AS source, '' AS code, CAST(line_no - 1 AS BIGINT) AS emit_seq FROM items""",
    # Changed lines of the diffs.
    "changed": """SELECT repo_id, CAST(floor(file_id / 400) AS BIGINT) AS diff_id, CAST((line_no - 1) // 1000 AS INTEGER) AS part, file_id, path,
        CAST(file_id % 50 + line_no AS INTEGER) AS line_no FROM raw WHERE file_id % 5 <> 0""",
    "headers": """SELECT s.repo_id, 'repo/' || cast(s.repo_id as string) AS target, 'heuristic' AS mode, '' AS model,
        files_scanned, coalesce(n_errors, 0) AS n_errors, """
    + ", ".join(f"coalesce({s}, 0) AS {s}" for s in SEVERITIES)
    + """, coalesce(total, 0) AS total FROM
        (SELECT repo_id, count(*) AS files_scanned FROM files WHERE language IS NOT NULL GROUP BY 1) s
        LEFT JOIN (SELECT repo_id, count(*) AS n_errors FROM files WHERE language IS NULL GROUP BY 1) e USING (repo_id)
        LEFT JOIN counts USING (repo_id)""",
    "sarif_first": f"""SELECT repo_id, rule_id, category, title, description, {_LEVEL} AS level,
        -rank AS neg_rank, file, line, -confidence AS neg_confidence, emit_seq FROM found
        QUALIFY row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY rank DESC, file, line, confidence DESC, emit_seq) = 1""",
    "result_rows": f"""SELECT *, {_LEVEL} AS level, description || chr(10) || chr(10) || 'Suggestion: ' || suggestion AS message
        FROM found""",
    "saves": f"""SELECT event_id AS version, {fx.SAVE_PATH_SQL} AS path, event_id % 4 AS arm FROM events""",
    "save_hits": """SELECT version, path AS file, line, rule_idx FROM saves JOIN
        (VALUES (0, 1, 3), (0, 2, 8), (1, 1, 7), (3, 1, 9), (3, 2, 6), (3, 3, 5)) AS t(arm, line, rule_idx) USING (arm)""",
}

_NEEDS = {
    "files": ["lang"],
    "lines": ["raw", "files"],
    "contents": ["raw", "files"],
    "hits": ["lines", "template", "rules"],
    "found_all": ["hits"],
    "found": ["found_all"],
    "found_small": ["found_all", "contents"],
    "found_diff": ["found_all", "contents"],
    "counts": ["found"],
    "big": ["raw"],
    "policies": ["layers"],
    "items": ["lines", "contents"],
    "modelled": ["items"],
    "changed": ["raw"],
    "headers": ["files", "counts"],
    "sarif_first": ["found"],
    "result_rows": ["found"],
    "save_hits": ["saves"],
}


def _with(needs: str, select: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in ordered)
    return f"WITH {ctes}\n{select}" if ordered else select


def _rule_condition(index: int) -> str:
    rule = LINE_RULES[index]
    condition = f"regexp_matches(text, {_q(rule.pattern)})"
    if rule.value_group:
        value = f"regexp_extract(text, {_q(rule.pattern)}, {rule.value_group})"
        condition += f" AND NOT regexp_matches({value}, {_q(PLACEHOLDER)}) AND NOT regexp_matches({value}, {_q(MASKED)})"
    return condition


_ANY_RULE = "CASE rule_idx " + " ".join(f"WHEN {i} THEN {_rule_condition(i)}" for i in range(len(LINE_RULES))) + " END"
_GATED = "(languages IS NULL OR list_contains(string_split(languages, ','), language))"
_MATCHED = f"lines JOIN rules ON {_GATED} AND {_ANY_RULE}"

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_FINDING_COLUMNS = (
    "repo_id, file, line, end_line, severity, category, title, description, suggestion, confidence, rule_id, source, code, emit_seq"
)
_DIGEST = "substr(sha256(lower(category || ':' || title)), 1, 8)"
_DERIVED = f"'{PRODUCT}/' || category || '/' || {_DIGEST}"
_REPORT_ORDER = "rank DESC, file, line, confidence DESC, emit_seq"


def _json_text(column: str) -> str:
    return f"cast(to_json({column}) as string)"


_FINDING_JSON = (
    "'{\"file\":' || " + _json_text("file") + " || ',\"line\":' || line || ',\"end_line\":' || end_line || "
    "',\"severity\":\"' || severity || '\",\"category\":\"' || category || '\",\"title\":' || " + _json_text("title")
    + " || ',\"description\":' || " + _json_text("description") + " || ',\"suggestion\":' || " + _json_text("suggestion")
    + " || ',\"confidence\":' || confidence || ',\"rule_id\":\"' || rule_id || '\",\"source\":\"' || source || '\",\"code\":' || "
    + _json_text("code") + " || '}'"
)

_NO_KEY = "CAST(0 AS INTEGER) AS neg_rank, '' AS file, CAST(0 AS INTEGER) AS line, CAST(0 AS DOUBLE) AS neg_confidence, CAST(0 AS BIGINT) AS emit_seq"
_KEY = "CAST(-rank AS INTEGER) AS neg_rank, file, line, -confidence AS neg_confidence, emit_seq"


def _part(section: int, body: str, source: str, key: str = _NO_KEY, sub: int = 0) -> str:
    return (
        f"SELECT repo_id, CAST({section} AS INTEGER) AS section, {key}, CAST({sub} AS INTEGER) AS sub, {body} AS body FROM {source}"
    )


def _comma(order: str) -> str:
    return f"CASE WHEN row_number() OVER (PARTITION BY repo_id ORDER BY {order}) = 1 THEN '' ELSE ',' END || "


def _text_part(section: int, text: str, source: str) -> str:
    key = _NO_KEY.replace("'' AS file", f"{text} AS file")
    return _part(section, _comma(text) + _json_text(text), source, key)


def _report_json() -> str:
    counts = " || ',' || ".join(f"'\"{s}\":' || {s}" for s in SEVERITIES)
    head = (
        "'{\"target\":\"' || target || '\",\"model\":\"' || model || '\",\"mode\":\"' || mode || '\",\"files_scanned\":' || files_scanned"
        " || ',\"duration_s\":0.0,\"total_findings\":' || total || ',\"counts\":{' || " + counts + " || '},\"paths\":['"
    )
    return "\nUNION ALL ".join(
        [
            _part(0, head, "headers"),
            _text_part(1, "path", "files WHERE language IS NOT NULL"),
            _part(2, "'],\"errors\":['", "headers"),
            _text_part(3, "error", "(SELECT repo_id, path || ': unreadable' AS error FROM files WHERE language IS NULL)"),
            _part(4, "'],\"findings\":['", "headers"),
            _part(5, _comma(_REPORT_ORDER) + _FINDING_JSON, "found", _KEY),
            _part(6, "']}'", "headers"),
        ]
    )


def _report_markdown() -> str:
    nl = " || chr(10) || "
    title = (
        f"'## 🤖 {PRODUCT} report'" + nl + "''" + nl + "'**Mode:** heuristic · **Model:** `heuristics` · **Files scanned:** ' || "
        "files_scanned || ' · **Findings:** ' || total" + nl + "''"
    )
    rows = " || ".join(
        f"CASE WHEN {s} > 0 THEN '| {SEVERITY_EMOJI[s]} {s} | ' || {s} || ' |' || chr(10) ELSE '' END" for s in SEVERITIES
    )
    table = f"CASE WHEN total > 0 THEN '| Severity | Count |' || chr(10) || '| --- | --- |' || chr(10) || {rows} ELSE '✅ No issues found in the analyzed code.' END"
    bullet = (
        f"'- ' || {_EMOJI} || ' **' || severity || ' · ' || category || '** — ' || title || ' _(L' || line || ')_'"
        + nl + "'  ' || description" + nl + "'  💡 ' || suggestion"
    )
    heads = f"""(SELECT repo_id, rank, file FROM (
        SELECT repo_id, rank, file, lag(file) OVER (PARTITION BY repo_id ORDER BY {_REPORT_ORDER}) AS before FROM found)
        WHERE before IS DISTINCT FROM file)"""
    head_key = _NO_KEY.replace("CAST(0 AS INTEGER) AS neg_rank, '' AS file", "CAST(-rank AS INTEGER) AS neg_rank, file").replace(
        "CAST(0 AS DOUBLE) AS neg", "CAST(-2 AS DOUBLE) AS neg"
    )
    return "\nUNION ALL ".join(
        [
            _part(0, title, "headers"),
            _part(1, table, "headers"),
            _part(2, "'### `' || file || '`'", heads, head_key),
            _part(2, bullet, "found", _KEY, 1),
        ]
    )


def _report_sarif() -> str:
    rule = (
        "'{\"id\":\"' || rule_id || '\",\"name\":\"' || upper(category[1]) || category[2:] || '\",\"shortDescription\":{\"text\":' || "
        + _json_text("title") + " || '},\"fullDescription\":{\"text\":' || " + _json_text("description")
        + " || '},\"defaultConfiguration\":{\"level\":\"' || level || '\"},\"properties\":{\"category\":\"' || category"
        " || '\",\"tags\":[\"' || category || '\"]}}'"
    )
    result = (
        "'{\"ruleId\":\"' || rule_id || '\",\"level\":\"' || level || '\",\"message\":{\"text\":' || " + _json_text("message")
        + " || '},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":' || " + _json_text("file")
        + " || '},\"region\":{\"startLine\":' || line || ',\"endLine\":' || end_line || '}}}],\"properties\":{\"severity\":\"' || severity"
        " || '\",\"confidence\":' || confidence || ',\"source\":\"' || source || '\"}}'"
    )
    first_order = "neg_rank, file, line, neg_confidence, emit_seq"
    return "\nUNION ALL ".join(
        [
            _part(0, _q(doc.SARIF_HEAD), "headers"),
            _part(1, _comma(first_order) + rule, "sarif_first", "CAST(neg_rank AS INTEGER) AS neg_rank, file, line, neg_confidence, emit_seq"),
            _part(2, _q(doc.SARIF_RESULTS), "headers"),
            _part(3, _comma(_REPORT_ORDER) + result, "result_rows", _KEY),
            _part(4, _q(doc.SARIF_TAIL), "headers"),
        ]
    )


def _document_lines() -> str:
    """The lines of whole documents: their parts in order, with a line feed between them."""
    order = "section, neg_rank, file, line, neg_confidence, emit_seq, sub"
    kinds = {"json": _report_json(), "markdown": _report_markdown(), "sarif": _report_sarif()}
    texts = "\nUNION ALL ".join(
        f"SELECT '{kind}' AS kind, repo_id, string_agg(body, chr(10) ORDER BY {order}) AS text FROM ({parts}) GROUP BY repo_id"
        for kind, parts in kinds.items()
    )
    return f"""SELECT kind, CAST(repo_id AS BIGINT) AS repo_id, CAST(line_no AS BIGINT) AS line_no, lines[line_no] AS text FROM (
        SELECT kind, repo_id, lines, unnest(range(1, len(lines) + 1)) AS line_no FROM (
            SELECT kind, repo_id, string_split(text, chr(10)) AS lines FROM ({texts})))"""


def _rerendered(parts: str) -> str:
    """A report's parts for each file on its own; every nineteenth report is broken."""
    whole = "file_id % 19 <> 0"
    views = {
        "file_found": f"SELECT * REPLACE (file_id AS repo_id) FROM found WHERE {whole}",
        "file_headers": "SELECT files.file_id AS repo_id, any_value(files.path) AS target, 'heuristic' AS mode, '' AS model, 1 AS files_scanned, "
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
        + f", count(found.file_id) AS total FROM files LEFT JOIN found USING (file_id) WHERE language IS NOT NULL AND files.{whole} GROUP BY 1",
        "file_sarif_first": _CTES["sarif_first"].replace("FROM found", "FROM file_found"),
        "file_result_rows": _CTES["result_rows"].replace("FROM found", "FROM file_found"),
    }
    for name in ("found", "headers", "sarif_first", "result_rows"):
        parts = parts.replace(f"FROM {name}", f"FROM file_{name}")
    parts = parts.replace("FROM files WHERE language IS NOT NULL", f"FROM (SELECT file_id AS repo_id, path FROM files WHERE language IS NOT NULL AND {whole})")
    parts = parts.replace("FROM files WHERE language IS NULL", "FROM files WHERE false")
    named = ", ".join(f"{name} AS ({select})" for name, select in views.items())
    return _with("files found", f"SELECT repo_id, section, body FROM (WITH {named} {parts})")


def _syntax_rows() -> str:
    """Expected syntax findings of F6, by the arm that wrote the module."""

    def row(rule: tuple, line: int, code: str, end: int | None = None) -> str:
        severity, category, title, _, _, confidence = rule
        title_sql = _q(title) if "%s" not in title else "'Long function ''long_' || cast(o_orderkey as string) || ''' (80 lines)'"
        return (
            f"SELECT o_orderkey, CAST({line} AS INTEGER) AS line, CAST({end or line} AS INTEGER) AS end_line, "
            f"'{severity}' AS severity, '{category}' AS category, {title_sql} AS title, CAST({confidence} AS DOUBLE) AS confidence, {code} AS code FROM orders"
        )

    function = "'def f(a, b=[], *, c={}):'"
    rows = [
        row(sx.MUTABLE_DEFAULT, 1, function) + " WHERE o_orderkey % 6 = 0",
        row(sx.MUTABLE_DEFAULT, 1, function) + " WHERE o_orderkey % 6 = 0",
        row(sx.BARE_EXCEPT, 3, "'except:'") + " WHERE o_orderkey % 6 = 1",
        row(sx.SWALLOWED, 3, "'except:'") + " WHERE o_orderkey % 6 = 1",
        row(sx.SWALLOWED, 3, "'except ValueError:'") + " WHERE o_orderkey % 6 = 2",
        row(sx.NONE_COMPARISON, 2, "'return x == None'") + " WHERE o_orderkey % 6 = 3",
        row(sx.LONG_FUNCTION, 1, "'def long_' || cast(o_orderkey as string) || '():'", 81) + " WHERE o_orderkey % 6 = 5",
    ]
    union = " UNION ALL ".join(rows)
    return f"""SELECT o_orderkey % 40 AS repo_id, 'o' || cast(o_orderkey as string) || '.py' AS file, line, end_line, severity,
        category, title, confidence, {_DERIVED} AS rule_id, code FROM ({union})"""


def _loose() -> str:
    """Expected outcome of the loose findings, arm by arm."""
    return f"""SELECT repo_id, file, own_line, line, greatest(line, coalesce(end_given, line)) AS end_line, severity, category, title,
        confidence, CASE WHEN k % 9 = 0 THEN 'own/rule' ELSE {_DERIVED} END AS rule_id FROM (
        SELECT repo_id, path AS file, line_no AS own_line, l_partkey AS k,
          CAST(CASE WHEN l_partkey % 4 IN (0, 1) THEN 1 ELSE line_no END AS INTEGER) AS line,
          CAST(CASE l_partkey % 3 WHEN 1 THEN 0 WHEN 2 THEN line_no + 5 END AS INTEGER) AS end_given,
          CASE l_partkey % 5 WHEN 0 THEN 'high' WHEN 3 THEN 'info' WHEN 4 THEN 'critical' ELSE 'medium' END AS severity,
          CASE l_partkey % 6 WHEN 0 THEN 'security' WHEN 3 THEN 'docs' ELSE 'maintainability' END AS category,
          CASE WHEN l_partkey % 7 IN (0, 1) THEN 'Code quality issue' WHEN l_partkey % 7 = 2 THEN '' ELSE 'A title' END AS title,
          CAST(CASE l_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0.5 WHEN 3 THEN 1 ELSE 0.25 END AS DOUBLE) AS confidence
        FROM raw)"""


# Facts of the F6 modules: arm, walk order, kind, name, line, end line, children.
_FACTS = [
    (0, 1, "FunctionDef", "f", 1, 2, 2),
    (1, 3, "ExceptHandler", None, 3, 4, 1),
    (2, 3, "ExceptHandler", None, 3, 4, 1),
    (3, 1, "FunctionDef", "g", 1, 2, 0),
    (3, 5, "Compare", None, 2, 2, 1),
    (4, 1, "FunctionDef", "h", 1, 2, 0),
    (4, 5, "Compare", None, 2, 2, 1),
    (5, 1, "FunctionDef", "long_", 1, 81, 0),
]

# Order kind, node kind, how often, how deep at most.
_SHAPES = [
    (0, "FunctionDef", 1, 1), (0, "List", 1, 3), (0, "Dict", 1, 3), (1, "Pass", 2, 3), (1, "ExceptHandler", 1, 2), (2, "Pass", 2, 3), (2, "ExceptHandler", 1, 2),
    (3, "FunctionDef", 1, 1), (3, "Compare", 1, 3), (3, "Eq", 1, 4), (3, "None", 1, 4), (4, "FunctionDef", 1, 1), (4, "Compare", 1, 3), (4, "Eq", 1, 4),
    (4, "None", 1, 4), (5, "FunctionDef", 1, 1),
]

_NUMBERED = """string_agg(lpad(cast(line_no as string), cast(length(cast(n as string)) as integer), ' ') || '| ' || text, chr(10) ORDER BY line_no)"""

_SCRIPT_SQL = r"""SELECT page_id, i - 1 AS n, scripts[i] AS content FROM (
    SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS scripts FROM pages),
    unnest(range(1, len(scripts) + 1)) AS u(i)"""


def oracle_sql() -> dict[str, str]:
    skip = ", ".join(_q(d) for d in SKIP_DIRS)
    listing = "repo_id, file, line, rule_id, confidence"
    return {
        # files
        "language_detect": _with("files", "SELECT repo_id, path, language FROM files"),
        "language_join": _with(
            "files", "SELECT lang.language, lang.ext, count(*) AS n_files FROM files JOIN lang ON "
            r"lang.ext = lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) GROUP BY 1, 2",
        ),
        "glob_filter": _with(
            "files", f"SELECT repo_id, path FROM files WHERE (path LIKE 'src/%' OR path LIKE '%.ts' OR regexp_matches({_NAME}, '^m.[0-4]\\..*$'))"
            " AND NOT (path LIKE '%/vendor/%' OR path LIKE '%.min.js')",
        ),
        "skip_dirs": _with("files", f"SELECT repo_id, path FROM files WHERE NOT list_has_any(string_split(path, '/')[:-2], [{skip}])"),
        "manifest_semi": _with(
            "files", "SELECT repo_id, path, language FROM files WHERE language IS NOT NULL AND file_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
        ),
        "max_files": _with("files", "SELECT repo_id, path FROM files QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 25"),
        "size_filter": _with(
            "contents", "SELECT repo_id, path, CAST(strlen(content) AS BIGINT) AS n_bytes FROM contents WHERE language IS NOT NULL AND strlen(content) <= 100",
        ),
        "file_stats": _with(
            "contents", "SELECT repo_id, path, line_count, CAST(strlen(content) AS BIGINT) AS n_bytes FROM contents WHERE language IS NOT NULL",
        ),
        # lines
        # A last empty line has no line break of its own, so it is not a line of the file.
        "explode_lines": _with(
            "lines", "SELECT repo_id, path, language, line_no, text FROM lines "
            "QUALIFY NOT (text = '' AND line_no = max(line_no) OVER (PARTITION BY file_id))",
        ),
        "number_lines": _with(
            "lines", "SELECT repo_id, path, " + _NUMBERED + " AS numbered FROM ("
            "SELECT *, CAST(max(line_no) OVER (PARTITION BY file_id) AS INTEGER) AS n FROM ("
            "SELECT * FROM lines QUALIFY NOT (text = '' AND line_no = max(line_no) OVER (PARTITION BY file_id) AND line_no > 1))) GROUP BY file_id, repo_id, path",
        ),
        "line_class": _with(
            "lines", "SELECT language, CASE WHEN text = '' THEN 'blank' WHEN language = 'python' AND l_partkey % 18 = 10 THEN 'comment' ELSE 'code' END AS line_class,"
            " count(*) AS n_lines FROM lines GROUP BY 1, 2",
        ),
        # rules
        "rule_catalogue": _with(
            "hits", "SELECT rule_idx, rule_id, severity, category, title, confidence, count(file_id) AS n_hits FROM rules "
            "LEFT JOIN (SELECT rule_idx, file_id FROM hits) USING (rule_idx) GROUP BY ALL",
        ),
        "line_findings": _with("found_all", f"SELECT {_FINDING_COLUMNS} FROM found_all"),
        "secret_scan": _with(
            "lines", f"SELECT repo_id, path, line_no, regexp_extract(text, {_q(LINE_RULES[2].pattern)}, 1) AS value FROM lines WHERE {_rule_condition(2)}",
        ),
        "rule_hits": _with("lines rules", f"SELECT language, CAST(rule_idx AS INTEGER) AS rule_idx, count(*) AS n_hits FROM {_MATCHED} GROUP BY 1, 2"),
        "rule_theta_join": _with("hits", "SELECT language, CAST(rule_idx AS INTEGER) AS rule_idx, count(*) AS n_hits FROM hits GROUP BY 1, 2"),
        "page_script_rules": _with(
            "rules", f"""SELECT repo_id, file, line, rule_id, code FROM (
            SELECT page_id AS repo_id, 'page/' || cast(page_id as string) || '-' || cast(n as string) || '.js' AS file,
              CAST(line AS INTEGER) AS line, rule_id, substr(trim(text, chr(9) || chr(13) || ' '), 1, 200) AS code, rank, rule_idx FROM (
              SELECT page_id, n, i AS line, parts[i] AS text, 'javascript' AS language FROM (
                SELECT page_id, n, string_split(content, chr(10)) AS parts FROM ({_SCRIPT_SQL})), unnest(range(1, len(parts) + 1)) AS u(i))
            JOIN rules ON {_GATED} AND {_ANY_RULE})
            QUALIFY row_number() OVER (PARTITION BY repo_id, file ORDER BY rank DESC, line, rule_idx) <= 80""",
        ),
        "py_facts": f"""SELECT o_orderkey % 40 AS repo_id, 'o' || cast(o_orderkey as string) || '.py' AS path, walk_seq, kind,
            CASE WHEN name = 'long_' THEN name || cast(o_orderkey as string) ELSE name END AS name, line, end_line, n_children
            FROM orders JOIN {_values(_FACTS)} AS t(arm, walk_seq, kind, name, line, end_line, n_children) ON o_orderkey % 6 = arm""",
        "syntax_findings": _syntax_rows(),
        "syntax_patterns": _syntax_rows(),
        "tree_shapes": f"""SELECT o_orderkey % 40 AS repo_id, kind, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(max(depth) AS INTEGER) AS max_depth
            FROM orders JOIN {_values(_SHAPES)} AS t(arm, kind, n, depth) ON o_orderkey % 6 = arm GROUP BY 1, 2""",
        # findings
        "normalize_findings": _with("raw", _loose()),
        "rule_id": _with("found", f"SELECT category, title, rule_id, {_DERIVED} AS derived, count(*) AS n_findings FROM found GROUP BY ALL"),
        "severity_rank": _with("found", "SELECT repo_id, severity, CAST(rank AS INTEGER) AS rank, count(*) AS n_findings FROM found GROUP BY ALL"),
        "severity_counts": _with(
            "files counts", "SELECT repo_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*SEVERITIES, "total"])
            + " FROM (SELECT DISTINCT repo_id FROM files) LEFT JOIN counts USING (repo_id)",
        ),
        "severity_threshold": _with(
            "found", "SELECT repo_id, count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS n_at_or_above, "
            "count(*) FILTER (severity IN ('critical', 'high')) AS n_kept FROM found GROUP BY 1",
        ),
        "sorted_findings": _with(
            "found", f"SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY {_REPORT_ORDER}) AS position, file, line, severity, title, emit_seq FROM found",
        ),
        "min_confidence": _with("found", f"SELECT {listing} FROM found WHERE confidence >= 0.6"),
        "cap_per_file": _with(
            "big template rules", "SELECT repo_id, path AS file, line_no AS line, severity, rule_id, CAST(line_no AS BIGINT) * 2147483648 + rule_idx AS emit_seq "
            "FROM big JOIN template ON l_partkey % 18 = template JOIN rules USING (rule_idx) "
            "QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY rank DESC, line_no, rule_idx) <= 80",
        ),
        "file_order": _with(
            "found", f"SELECT repo_id, file, CAST(worst AS INTEGER) AS worst_rank, row_number() OVER (PARTITION BY repo_id ORDER BY first) AS file_position FROM ("
            f"SELECT repo_id, file, max(rank) AS worst, min(position) AS first FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_REPORT_ORDER}) AS position FROM found) GROUP BY 1, 2)",
        ),
        "finding_location": _with("found", "SELECT repo_id, rule_id, file || ':' || cast(line as string) AS location FROM found"),
        "findings_by_file": _with(
            "found", "SELECT repo_id, file, count(*) AS n_findings, CAST(max(rank) AS INTEGER) AS worst_rank, "
            "string_agg(cast(line as string) || ':' || title, '; ' ORDER BY rank DESC, line, confidence DESC, emit_seq) AS listing FROM found GROUP BY 1, 2",
        ),
        # focus and diffs
        "focus_semi": _with(
            "found_all", "SELECT repo_id, file, line, rule_id FROM found_all WHERE file_id % 4 = 0 OR (file_id, line) IN "
            "(SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')",
        ),
        "focus_summary": _with(
            "big", "SELECT repo_id, path, n_focus, summary || CASE WHEN n_focus > 12 THEN ', … (+' || cast(n_focus - 12 as string) || ' more)' ELSE '' END AS summary FROM ("
            "SELECT repo_id, path, count(*) AS n_focus, string_agg(cast(line_no as string), ', ' ORDER BY line_no) FILTER (line_no <= 12) AS summary FROM big GROUP BY 1, 2)",
        ),
        "diff_lines": _with("changed", "SELECT repo_id, diff_id, part, path, line_no FROM changed"),
        "diff_lines_ranged": _with("changed", "SELECT repo_id, diff_id, part, path, line_no FROM changed"),
        "diff_one_ranged": _with("changed", "SELECT DISTINCT path, line_no FROM changed"),
        "diff_scan": _with(
            "found_diff", "SELECT repo_id, file, CAST(line + file_id % 50 AS INTEGER) AS line, rule_id, code FROM found_diff "
            f"WHERE file_id % 5 <> 0 AND file NOT LIKE '%.min.js' AND file NOT LIKE 'lib/%' {_CAP}",
        ),
        "diff_scan_bucketed": _with(
            "found_diff", "SELECT repo_id, file, CAST(line + file_id % 50 AS INTEGER) AS line, rule_id, code FROM found_diff "
            f"WHERE file_id % 5 <> 0 AND file NOT LIKE '%.min.js' AND file NOT LIKE 'lib/%' {_CAP}",
        ),
        # whole scans
        "repo_scan": _with(
            "found_small", f"SELECT repo_id, file, line, end_line, severity, category, title, confidence, rule_id, source, code, emit_seq FROM found_small "
            f"WHERE confidence >= 0.5 AND file NOT LIKE 'tests/%' AND NOT list_has_any(string_split(file, '/')[:-2], [{skip}]) {_CAP}",
        ),
        # An empty file has nothing whose checksum could be wrong.
        "folder_scan": _with(
            "found_small contents", "SELECT kind, cast(repo_id as string) || '/' || path AS path, CAST(line AS INTEGER) AS line, "
            "CASE kind WHEN 'error' THEN cast(repo_id as string) || '/' || path || ': unreadable' ELSE rule_id END AS detail FROM ("
            f"SELECT 'finding' AS kind, * FROM (SELECT f.*, file AS path FROM found_small f WHERE true {_CAP}) WHERE file_id % 17 <> 3 AND file_id IN (SELECT file_id FROM contents WHERE strlen(content) <= 300) "
            "UNION ALL BY NAME SELECT 'error' AS kind, repo_id, path, 0 AS line FROM contents WHERE language IS NOT NULL AND strlen(content) BETWEEN 1 AND 300 AND file_id % 17 = 3) "
            f"WHERE NOT list_has_any(string_split(path, '/')[:-2], [{skip}])",
        ),
        "content_scan": _with(
            "files raw template rules", "SELECT raw.repo_id, raw.path AS file, line_no AS line, rule_id, 'heuristic' AS source FROM raw JOIN files USING (file_id) "
            "JOIN template ON l_partkey % 18 = template JOIN rules USING (rule_idx) "
            "WHERE (languages IS NULL OR list_contains(string_split(languages, ','), coalesce(files.language, 'text'))) "
            "QUALIFY row_number() OVER (PARTITION BY raw.repo_id, raw.path ORDER BY rank DESC, line_no, rule_idx) <= 80",
        ),
        "scan_errors": _with(
            "files", "SELECT repo_id, n AS n_errors, string_agg(error, chr(10) ORDER BY i) AS first_errors FROM ("
            "SELECT repo_id, error, count(*) OVER (PARTITION BY repo_id) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY path, error) AS i FROM ("
            "SELECT repo_id, path, path || ': unreadable' AS error FROM files WHERE file_id % 13 = 0 UNION ALL "
            "SELECT repo_id, path, path || ': response failed' FROM files WHERE file_id % 11 = 0)) WHERE i <= 10 GROUP BY 1, 2",
        ),
        "scan_header": _with(
            "files counts", "SELECT repo_id, 'repo/' || cast(repo_id as string) AS target, 'heuristic' AS mode, '' AS model, files_scanned, n_errors, "
            + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*SEVERITIES, "total"])
            + " FROM (SELECT r AS repo_id, count(path) FILTER (file_id % 13 <> 0 AND r <> 7) AS files_scanned, count(path) FILTER (file_id % 13 = 0 OR r = 7) AS n_errors"
            " FROM range(41) AS s(r) LEFT JOIN files ON repo_id = r AND language IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT * FROM counts WHERE repo_id <> 7) USING (repo_id)",
        ),
        "scan_header_ai": _with(
            "files modelled found_all", "SELECT repo_id, 'repo/' || cast(repo_id as string) AS target, 'ai' AS mode, 'reviewer-model' AS model, files_scanned, n_errors, "
            + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*SEVERITIES, "total"])
            + " FROM (SELECT repo_id, count(*) AS files_scanned, count(*) FILTER (file_id % 11 = 0) AS n_errors FROM files WHERE language IS NOT NULL GROUP BY 1)"
            " LEFT JOIN (SELECT repo_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
            + f", count(*) AS total FROM (SELECT repo_id, severity FROM modelled UNION ALL (SELECT repo_id, severity FROM found_all WHERE file_id % 11 = 0 {_CAP})) GROUP BY 1) USING (repo_id)",
        ),
        "mixed_scan": f"""SELECT repo_id, file, line, severity, title, {_DERIVED} AS rule_id FROM (
            SELECT o_orderkey % 40 AS repo_id, 'o' || cast(o_orderkey as string) || '.py' AS file, CAST(line AS INTEGER) AS line, severity, category, title
            FROM orders JOIN (SELECT 0 AS arm, 1 AS line, 'medium' AS severity, 'bug' AS category, 'Mutable default argument' AS title
              UNION ALL VALUES (0, 2, 'info', 'maintainability', 'Unresolved TODO/FIXME marker'), (0, 3, 'high', 'security', 'Dynamic code execution (eval/exec)'),
                (1, 2, 'high', 'security', 'Dynamic code execution (eval/exec)'), (1, 3, 'medium', 'bug', 'Bare ''except:'' clause'),
                (1, 3, 'medium', 'bug', 'Exception silently swallowed'), (2, 101, 'medium', 'bug', 'Mutable default argument')
              UNION ALL SELECT 2, i, 'info', 'maintainability', 'Unresolved TODO/FIXME marker' FROM range(1, 80) AS u(i)) ON o_orderkey % 3 = arm)""",
        "user_rule_scan": """WITH f AS (SELECT 1 AS repo_id, cast(doc_id as string) AS path, text AS content FROM documents
            UNION ALL SELECT 2, cast(conv_id as string) || '-' || cast(turn as string), text FROM conversations
            UNION ALL SELECT 3, cast(page_id as string), html FROM pages),
          l AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line FROM f),
          h AS (SELECT repo_id, path, unnest([
              CASE WHEN regexp_matches(line, 'token = "[[:xdigit:]]{40}"') THEN 0 END,
              CASE WHEN repo_id < 3 AND regexp_matches(line, 'Licensed under the [[:upper:]]') THEN 7 END,
              CASE WHEN list_contains(list_transform(regexp_extract_all(line, '[0-9]+'), lambda n: len(n)), 16) THEN 2048 END,
              CASE WHEN repo_id = 3 AND regexp_matches(lower(line), '<h[1-6]( |>)') THEN 2049 END]) AS rule_idx FROM l)
          SELECT CAST(repo_id AS BIGINT) AS repo_id, CAST(rule_idx AS INTEGER) AS rule_idx, count(*) AS n_hits, count(DISTINCT path) AS n_files
          FROM h WHERE rule_idx IS NOT NULL GROUP BY 1, 2""",
        "user_rule_index": """WITH f AS (SELECT 1 AS repo_id, cast(doc_id as string) AS path, text AS content FROM documents
            UNION ALL SELECT 2, cast(conv_id as string) || '-' || cast(turn as string), text FROM conversations
            UNION ALL SELECT 3, cast(page_id as string), html FROM pages),
          l AS (SELECT row_number() OVER () AS id, * FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line FROM f)),
          n AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS word FROM documents) GROUP BY 1),
          r AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS rule_idx FROM n ORDER BY n DESC, word LIMIT 2000),
          t AS (SELECT id, repo_id, path, 0 AS kind, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS word FROM l
            UNION ALL SELECT id, repo_id, path, 1, lower(rtrim(unnest(regexp_extract_all(line, '[A-Za-z]+[.,]')), '.,')) FROM l
            UNION ALL SELECT id, repo_id, path, 2, rtrim(unnest(regexp_extract_all(line, '[A-Za-z]+, ')), ', ') FROM l
            UNION ALL SELECT id, repo_id, path, 3, regexp_extract(line, '([A-Za-z]+)[.]$', 1) FROM l),
          h AS (SELECT DISTINCT id, repo_id, path, rule_idx FROM t JOIN r ON kind = rule_idx % 4 AND (repo_id < 3 OR rule_idx % 3 <> 0)
              AND (t.word = CASE kind WHEN 1 THEN lower(r.word) ELSE r.word END OR kind = 2 AND t.word = 'zz' || r.word)
            UNION ALL SELECT id, repo_id, path, 5000 FROM l WHERE regexp_matches(line, '[0-9]{6}')
            UNION ALL SELECT id, repo_id, path, 5001 FROM l WHERE repo_id = 3 AND regexp_matches(line, '<[a-z][a-z0-9]?>'))
          SELECT CAST(repo_id AS BIGINT) AS repo_id, CAST(rule_idx AS INTEGER) AS rule_idx, count(*) AS n_hits, count(DISTINCT path) AS n_files
          FROM h GROUP BY 1, 2""",
        "diff_report": _with(
            "files contents found_diff raw", "SELECT r AS repo_id, 'origin/main...' || CASE WHEN r % 2 = 1 THEN 'h' || cast(r as string) ELSE 'WORKTREE' END AS target, "
            "'heuristic' AS mode, '' AS model, coalesce(files_scanned, 0) AS files_scanned, coalesce(n_errors, 0) AS n_errors, "
            + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*SEVERITIES, "total"])
            + " FROM (SELECT DISTINCT repo_id AS r FROM files) LEFT JOIN (SELECT repo_id AS r, count(*) AS files_scanned FROM contents WHERE language IS NOT NULL "
            "AND file_id % 5 <> 0 AND path NOT LIKE '%.min.js' AND path NOT LIKE 'lib/%' AND strlen(content) + file_id % 50 <= 200000 AND repo_id <> 3 GROUP BY 1) USING (r) "
            "LEFT JOIN (SELECT repo_id AS r, count(DISTINCT (file_id // 400, (line_no - 1) // 1000)) AS n_errors FROM raw WHERE repo_id = 3 GROUP BY 1) USING (r) "
            "LEFT JOIN (SELECT repo_id AS r, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
            + ", count(*) AS total FROM (SELECT * FROM found_diff WHERE file_id % 5 <> 0 AND file NOT LIKE '%.min.js' AND file NOT LIKE 'lib/%' AND repo_id <> 3 "
            f"{_CAP}) GROUP BY 1) USING (r)",
        ),
        "diff_report_rows": _with(
            "files contents found_diff raw", "SELECT 'finding' AS kind, repo_id, file AS path, CAST(line + file_id % 50 AS INTEGER) AS line, rule_id AS detail FROM ("
            f"SELECT * FROM found_diff WHERE file_id % 5 <> 0 AND file NOT LIKE '%.min.js' AND file NOT LIKE 'lib/%' AND repo_id <> 3 {_CAP}) "
            "UNION ALL SELECT 'path', repo_id, path, CAST(0 AS INTEGER), '' FROM contents WHERE language IS NOT NULL "
            "AND file_id % 5 <> 0 AND path NOT LIKE '%.min.js' AND path NOT LIKE 'lib/%' AND strlen(content) + file_id % 50 <= 200000 AND repo_id <> 3 "
            "UNION ALL SELECT 'error', repo_id, '', CAST(0 AS INTEGER), 'diff failed: no text' FROM ("
            "SELECT DISTINCT repo_id, file_id // 400, (line_no - 1) // 1000 FROM raw WHERE repo_id = 3)",
        ),
        "policy_size": _with(
            "contents policies", "SELECT contents.repo_id, path, CAST(strlen(content) AS BIGINT) AS n_bytes FROM contents LEFT JOIN policies USING (repo_id) "
            "WHERE language IS NOT NULL AND strlen(content) <= coalesce(max_bytes, 200000)",
        ),
        "report_files": _with("headers found sarif_first result_rows", _document_lines()),
        "report_rerender": _rerendered(_report_markdown()),
        "report_rerender_json": _rerendered(_report_json()),
        "report_rerender_sarif": _rerendered(_report_sarif()),
        "report_gate": _with(
            "files found", "SELECT files.file_id AS repo_id, 'high' AS fail_on, count(*) FILTER (severity IN ('critical', 'high')) AS n_at_or_above, "
            "CASE WHEN count(*) FILTER (severity IN ('critical', 'high')) > 0 THEN 'fail' ELSE 'pass' END AS gate "
            "FROM files LEFT JOIN found USING (file_id) WHERE language IS NOT NULL AND files.file_id % 19 <> 0 GROUP BY 1",
        ),
        "findings_table": _with("found", "SELECT repo_id, file, line, severity, rule_id, emit_seq FROM found"),
        "request_stream": _with(
            "rules", "SELECT event_id AS repo_id, rule_id AS outcome FROM events JOIN rules ON (event_id % 6 = 0 AND rule_idx = 8) OR (event_id % 6 = 1 AND rule_idx = 3) "
            "UNION ALL SELECT event_id, CASE WHEN event_id % 6 < 5 THEN 'missing_content' ELSE 'invalid_json' END FROM events WHERE event_id % 6 > 2",
        ),
        # policies
        "policy_resolve": _with("policies", "SELECT * FROM policies"),
        "policy_globs": _with(
            "files policies", f"""SELECT repo_id, path FROM files LEFT JOIN policies USING (repo_id) WHERE
            (include IS NULL OR (include = '*.js' AND path LIKE '%.js') OR (include LIKE 'src%' AND (path LIKE 'src/%' OR path LIKE '%.ts')))
            AND NOT coalesce((exclude LIKE '%vendor%' AND (path LIKE '%/vendor/%' OR regexp_matches({_NAME}, '^m.\\..*$')))
              OR (exclude LIKE '*[%' AND regexp_matches(path, '[02468]\\.[jt]s$')), false)""",
        ),
        "gate": _with(
            "policies found", f"""SELECT repo_id, fail_on, count(reached) AS n_at_or_above, CASE WHEN count(reached) > 0 THEN 'fail' ELSE 'pass' END AS gate FROM (
            SELECT p.repo_id, p.fail_on, CASE WHEN rank >= {_RANK.replace('CASE severity', 'CASE p.fail_on')} THEN 1 END AS reached
            FROM policies p LEFT JOIN found USING (repo_id)) GROUP BY 1, 2""",
        ),
        "policy_confidence": _with(
            "policies found", "SELECT repo_id, file, line, rule_id, confidence FROM found LEFT JOIN policies USING (repo_id) WHERE confidence >= coalesce(min_confidence, 0)",
        ),
        # reviewer model
        "request_bodies": _with(
            "lines", f"""SELECT repo_id, path, {_q('{"model":"reviewer-model","max_tokens":4096,"temperature":0.0,"system":"Review ' + chr(92) + '"this' + chr(92) + '".","tools":[')}
            || {_q(json.dumps(rs.response_tool(), separators=(",", ":")))} || '],"tool_choice":{{"type":"tool","name":"report_findings"}},"messages":[{{"role":"user","content":' || {_json_text("prompt")} || '}}]}}' AS body
            FROM (SELECT lines.repo_id, lines.path, 'File: ' || lines.path || chr(10) || 'Language: ' || language || chr(10)
            || chr(10) || {_q(rs.CODE_LABEL)} || chr(10) || '```' || chr(10) || {_NUMBERED} || chr(10) || '```' AS prompt
            FROM (SELECT *, CAST(max(line_no) OVER (PARTITION BY file_id) AS INTEGER) AS n FROM (SELECT * FROM lines QUALIFY NOT (text = '' AND line_no = max(line_no) OVER (PARTITION BY file_id) AND line_no > 1))) lines
            GROUP BY file_id, lines.repo_id, lines.path, language)""",
        ),
        "review_requests": _with(
            "lines changed", f"""SELECT lines.repo_id, lines.path, 'reviewer-model' AS model, CAST(4096 AS INTEGER) AS max_tokens, CAST(0 AS DOUBLE) AS temperature,
            'report_findings' AS tool, 'File: ' || lines.path || chr(10) || 'Language: ' || language || chr(10)
            || CASE WHEN any_value(f.focus) IS NULL THEN '' ELSE {_q(rs.SCOPE_TEXT)} || chr(10) || {_q(rs.FOCUS_LABEL)} || any_value(f.focus) || chr(10) END
            || chr(10) || {_q(rs.CODE_LABEL)} || chr(10) || '```' || chr(10) || {_NUMBERED} || chr(10) || '```' AS prompt
            FROM (SELECT *, CAST(max(line_no) OVER (PARTITION BY file_id) AS INTEGER) AS n FROM (SELECT * FROM lines QUALIFY NOT (text = '' AND line_no = max(line_no) OVER (PARTITION BY file_id) AND line_no > 1))) lines
            LEFT JOIN (SELECT file_id, string_agg(cast(line_no as string), ', ' ORDER BY line_no) FILTER (i <= 12)
              || CASE WHEN count(*) > 12 THEN ', … (+' || cast(count(*) - 12 as string) || ' more)' ELSE '' END AS focus
              FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS i FROM changed) GROUP BY 1) f USING (file_id)
            GROUP BY file_id, lines.repo_id, lines.path, language""",
        ),
        "response_findings": _with(
            "modelled", f"SELECT repo_id, file, line, end_line, severity, category, title, description, suggestion, confidence, {_DERIVED} AS rule_id, source, code, emit_seq FROM modelled",
        ),
        "finding_span": _with(
            "modelled", "SELECT repo_id, file, emit_seq, 'L' || cast(line as string) || CASE WHEN end_line > line THEN '-' || cast(end_line as string) ELSE '' END AS span FROM modelled",
        ),
        "response_fallback": _with(
            "modelled found_all", "SELECT repo_id, file, line, title, confidence, source FROM modelled WHERE confidence >= 0.5 UNION ALL "
            f"(SELECT repo_id, file, line, title, confidence, source FROM found_all WHERE confidence >= 0.5 AND file_id % 11 = 0 {_CAP})",
        ),
        # reports
        "summary_text": _with(
            "layers counts", "SELECT repo_id, 'Summary: ' || CASE WHEN coalesce(total, 0) = 0 THEN '0 findings' ELSE concat_ws('  ', "
            + ", ".join(f"CASE WHEN {s} > 0 THEN cast({s} as string) || ' {s}' END" for s in SEVERITIES)
            + ") END || '  (' || cast(coalesce(total, 0) as string) || ' total)' AS summary FROM layers LEFT JOIN counts USING (repo_id)",
        ),
        "diagnostics": _with(
            "found", f"""SELECT repo_id, '/work/space/' || file AS file, line - 1 AS start_line, end_line - 1 AS end_line,
            title || '  [' || severity || ' · ' || category || ']' || chr(10) || description || chr(10) || '💡 ' || suggestion AS message,
            CASE severity WHEN 'critical' THEN 'Error' WHEN 'high' THEN 'Error' WHEN 'medium' THEN 'Warning' WHEN 'low' THEN 'Information' ELSE 'Hint' END AS level,
            '{PRODUCT}' AS source, rule_id AS code, emit_seq FROM found""",
        ),
        "sarif_rules": _with(
            "sarif_first", "SELECT repo_id, rule_id, upper(category[1]) || category[2:] AS name, title AS short_description, description AS full_description, "
            "level, category, CAST(neg_rank AS INTEGER) AS neg_rank, file, line, emit_seq FROM sarif_first",
        ),
        "sarif_results": _with(
            "result_rows", "SELECT repo_id, rule_id, level, message, file AS uri, line AS start_line, end_line, severity, confidence, source, line, emit_seq FROM result_rows",
        ),
        "sarif_integrity": _with(
            "found", "SELECT repo_id, count(*) AS n_results, count(DISTINCT rule_id) AS n_rules, CAST(0 AS BIGINT) AS n_unmatched FROM found GROUP BY 1",
        ),
        "report_json": _with("headers found", _report_json()),
        "report_markdown": _with("headers found", _report_markdown()),
        "report_sarif": _with("headers sarif_first result_rows", _report_sarif()),
        "report_reload": _with(
            "found", "SELECT file_id AS repo_id, file, line, end_line, severity, category, title, description, suggestion, confidence, rule_id, source, code, "
            f"row_number() OVER (PARTITION BY file_id ORDER BY {_REPORT_ORDER}) - 1 AS emit_seq FROM found WHERE file_id % 19 <> 0",
        ),
        "report_errors": _with("files", "SELECT file_id AS report_id, 'invalid JSON report' AS error FROM files WHERE language IS NOT NULL AND file_id % 19 = 0"),
        "scan_response": _with(
            "files found", "SELECT files.file_id AS repo_id, path, '{\"mode\":\"heuristic\",\"model\":\"\",\"errors\":[],\"findings\":[' || coalesce(any_value(items), '') || ']}' AS body "
            f"FROM files LEFT JOIN (SELECT file_id, string_agg({_FINDING_JSON}, ',' ORDER BY {_REPORT_ORDER}) AS items FROM found GROUP BY 1) USING (file_id) "
            "WHERE language IS NOT NULL GROUP BY 1, 2",
        ),
        # streams
        "stream_save_scan": _with(
            "save_hits rules", "SELECT version, file, CAST(line AS INTEGER) AS line, rule_id, CASE rule_idx WHEN 3 THEN 'eval(x)' WHEN 8 THEN 'var a = 1' "
            "WHEN 7 THEN 'console.log(' || cast(version as string) || ')' WHEN 9 THEN '// TODO' WHEN 6 THEN 'document.write(x)' ELSE 'el.innerHTML = y' END AS code "
            "FROM save_hits JOIN rules USING (rule_idx)",
        ),
        "stream_latest_findings": _with(
            "save_hits rules", "SELECT version, file, CAST(line AS INTEGER) AS line, rule_id FROM save_hits JOIN rules USING (rule_idx) "
            "WHERE (file, version) IN (SELECT path, max(version) FROM saves GROUP BY 1)",
        ),
        "request_validation": "SELECT event_id AS repo_id, CASE WHEN event_id % 6 < 3 THEN 'ok' WHEN event_id % 6 < 5 THEN 'missing_content' ELSE 'invalid_json' END AS status FROM events",
        "request_scan": _with(
            "rules", "SELECT event_id AS repo_id, CASE WHEN event_id % 6 = 0 THEN 'u' || cast(user_id as string) || '.js' ELSE 'a.js' END AS file, "
            "CAST(1 AS INTEGER) AS line, rule_id FROM events JOIN rules ON (event_id % 6 = 0 AND rule_idx = 8) OR (event_id % 6 = 1 AND rule_idx = 3)",
        ),
    }
