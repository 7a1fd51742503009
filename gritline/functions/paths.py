"""Path expressions: language, globs, skipped directories, report locations."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritline.vocab import EXTENSION_LANGUAGE, SKIP_DIRS


def extension(path: Column) -> Column:
    """Lower-cased last suffix of the file name with its dot, empty for dot-files."""
    name = F.substring_index(path, "/", -1)
    suffix = F.substring_index(name, ".", -1)
    has_one = (F.length(suffix) > 0) & (F.length(suffix) < F.length(name) - 1)
    return F.when(has_one, F.concat(F.lit("."), F.lower(suffix))).otherwise(F.lit(""))


def language_for(path: Column) -> Column:
    """Language of a path, null when the extension is not known."""
    pairs = ", ".join(f"'{ext}', '{language}'" for ext, language in EXTENSION_LANGUAGE.items())
    return F.try_element_at(F.expr(f"map({pairs})"), extension(path))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _glob_set(members: str, negated: bool) -> str:
    """Character class of a bracket's members; a range that runs backwards has none."""
    parts = []
    for part in re.findall(r"(?s).-.|.", members):
        if len(part) == 3:
            if part[0] <= part[2]:
                parts.append(f"{_literal(part[0])}-{_literal(part[2])}")
        else:
            parts.append(_literal(part))
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def _literal(char: str) -> str:
    return char if char.isalnum() or char in "_/ " or not char.isascii() else "\\" + char


def glob_regex(glob: str) -> str:
    """Anchored regex of a shell glob; ``*`` and ``?`` also match a slash, a lone bracket itself."""
    out = []
    for token in re.findall(r"(?s)\[!?\]?[^\]]*\]|.", glob):
        if token == "*":
            out.append(".*")
        elif token == "?":
            out.append(".")
        elif len(token) > 1:
            negated = token[1] == "!"
            out.append(_glob_set(token[1 + negated : -1], negated))
        else:
            out.append(_literal(token))
    return f"(?s)^(?:{''.join(out)})\\z"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """True when any glob matches the whole path or the base name."""
    name = base_name(path)
    hit = F.lit(False)
    for regex in map(glob_regex, globs):
        hit = hit | path.rlike(regex) | name.rlike(regex)
    return hit


@F.pandas_udf(T.StringType())
def globs_regex(globs: pd.Series) -> pd.Series:
    """One regex for an array of globs, null for a null or empty array.

    Compute it once per policy row, before the policy meets the files.
    """
    return globs.map(lambda gs: "|".join(glob_regex(g) for g in gs if g is not None) if gs is not None and len(gs) else None)


def matches_regex(path: Column, regex: Column) -> Column:
    """True when a :func:`globs_regex` matches the whole path or the base name."""
    return F.regexp_like(path, regex) | F.regexp_like(base_name(path), regex)


def in_skipped_dir(path: Column) -> Column:
    """True when a directory segment (not the file name) is on the skip list."""
    segments = F.split(path, "/")
    dirs = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS]))


def relative_to(path: Column, root: str) -> Column:
    """Drop a leading root directory; other paths stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def under_root(path: Column, root: str) -> Column:
    """Absolute path of a finding below a workspace root."""
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), path)
    )


def strip_diff_prefix(target: Column) -> Column:
    return F.regexp_replace(target, r"^[ab]/", "")


def sarif_uri(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
