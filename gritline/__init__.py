"""Source-quality analytics on Spark: files, diffs and model answers to ranked findings and reports."""

from gritline.operators.diffs import parse_diffs
from gritline.operators.findings import cap_per_file, normalize_findings, severity_counts, sort_findings
from gritline.operators.lines import explode_lines
from gritline.operators.policy import gate, resolve_policies
from gritline.plans.scans import scan_buffers, scan_diffs, scan_files, scan_lines, scan_responses
from gritline.sources.files import read_repository, select_files, with_language
from gritline.sources.responses import build_requests
from gritline.vocab import PRODUCT_VERSION as __version__

__all__ = [
    "__version__",
    "build_requests",
    "cap_per_file",
    "explode_lines",
    "gate",
    "normalize_findings",
    "parse_diffs",
    "read_repository",
    "resolve_policies",
    "scan_buffers",
    "scan_diffs",
    "scan_files",
    "scan_lines",
    "scan_responses",
    "select_files",
    "severity_counts",
    "sort_findings",
    "with_language",
]
