"""Fixed vocabulary shared by every operator.

The values in this module are part of the output contract: reports, rule ids
and filters are only comparable between tools when they agree on them.
"""

from __future__ import annotations

PRODUCT = "gritline"
PRODUCT_VERSION = "0.1.0"
INFORMATION_URI = "https://example.org/gritline"

# --- fixed values: severities, highest first, with their rank ---------------
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
SEVERITIES = tuple(SEVERITY_RANK)
DEFAULT_SEVERITY = "medium"
SEVERITY_EMOJI = {
    "critical": "🔴",
    "high": "🟠",
    "medium": "🟡",
    "low": "🔵",
    "info": "⚪",
}

# --- fixed values: finding categories ----------------------------------------
CATEGORIES = (
    "security",
    "bug",
    "performance",
    "maintainability",
    "complexity",
    "style",
    "docs",
    "testing",
)
DEFAULT_CATEGORY = "maintainability"
DEFAULT_TITLE = "Code quality issue"

# --- fixed values: file extension -> language ---------------------------------
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".rb": "ruby",
    ".php": "php",
    ".c": "c",
    ".h": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".swift": "swift",
    ".scala": "scala",
    ".sh": "shell",
    ".bash": "shell",
    ".sql": "sql",
    ".tf": "terraform",
    ".yaml": "yaml",
    ".yml": "yaml",
}

# --- fixed values: directories skipped when no manifest is given ---------------
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", ".tox", "venv", ".venv", "env",
    "dist", "build", "out", "target", ".next", ".nuxt", "coverage",
    ".idea", ".vscode", "vendor", "site-packages", ".gradle", "bin", "obj",
)

# --- fixed values: limits and defaults -------------------------------------------
MAX_BYTES = 200_000
MAX_FINDINGS_PER_FILE = 80
LONG_FUNCTION_LINES = 70
SNIPPET_CHARS = 200
DEFAULT_CONFIDENCE = 0.85
JUNK_CONFIDENCE = 0.5
DEFAULT_FAIL_ON = "high"
DEFAULT_MODEL = "reviewer-model"
DEFAULT_MAX_WORKERS = 8
DEFAULT_MAX_TOKENS = 4096
MIN_MAX_TOKENS = 1024
FOCUS_SUMMARY_LINES = 12
ERRORS_SHOWN = 10
REVIEW_TOOL = "report_findings"

# --- fixed values: character sets of Python's str.strip and str.splitlines ------
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
