"""The driver contract holds without what only some queries need."""

import subprocess
import sys
from pathlib import Path

from gritline.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_a_missing_library_takes_only_its_queries_away():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names, with_sql = (line.split() for line in done.stdout.splitlines())
    assert names == with_sql == sorted(QUERIES)
