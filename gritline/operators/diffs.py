"""Unified diffs to changed lines, inside the row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions.paths import strip_diff_prefix
from gritline.functions.text import newline_breaks, strip

# --- fixed values: diff line formats ---------------------------------------------------
FILE_HEADER = "+++ "
HUNK = r"^@@ .*\+([0-9]+)(?:,[0-9]+)? @@"
NO_FILE = "/dev/null"

_AT_FILE = r"\n(?=\+\+\+ )"
_AT_HUNK = r"\n(?=@@)"
_ALL = 1 << 30


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _target(piece: Column) -> Column:
    return strip(F.substring(_first_line(piece), len(FILE_HEADER) + 1, _ALL))


def _hunk_start(hunk: Column) -> Column:
    """New-file start line of a hunk header, 0 when it cannot be read."""
    found = F.nullif(F.regexp_extract(_first_line(hunk), HUNK, 1), F.lit(""))
    # Far below the end of the numbers, so that adding positions can't overflow.
    far = F.lit(1 << 60)
    start = F.least(F.coalesce(found.try_cast("bigint"), far), far)
    return F.when(found.isNotNull(), start).otherwise(F.lit(0).cast("bigint"))


def _advancing(hunk: Column) -> Column:
    """Lines after the first that move the new-file cursor by one: added and context lines.

    Removed lines, old-file headers and "no newline" notes do not move it.
    """
    rest = F.slice(F.split(hunk, "\n"), 2, _ALL)
    moving = F.filter(rest, lambda x: ~(x.startswith("-") | x.startswith("\\")))
    # Most hunks of new files have none of the others.
    return F.when(hunk.contains("\n-") | hunk.contains("\n\\"), moving).otherwise(rest)


def _starts_without_hunk(piece: Column) -> Column:
    """True when a piece adds lines before its first hunk header."""
    added, hunk = F.instr(piece, "\n+"), F.instr(piece, "\n@@")
    return (added > 0) & ((hunk == 0) | (added < hunk)) & (_target(piece) != NO_FILE)


def _entry_cursors(preamble: Column, pieces: Column) -> Column:
    """Cursor at the start of every piece: hunk headers set it, lines of a file move it."""

    def after(hunks: Column, before: Column, moved: Column) -> Column:
        base = F.when(F.size(hunks) > 1, _hunk_start(F.element_at(hunks, -1))).otherwise(before)
        return base + moved

    def step(state: Column, piece: Column) -> Column:
        hunks = F.split(piece, _AT_HUNK)
        moved = F.when(_target(piece) == NO_FILE, F.lit(0)).otherwise(F.size(_advancing(F.element_at(hunks, -1))))
        return F.struct(
            after(hunks, state["cursor"], moved.cast("bigint")).alias("cursor"),
            F.array_append(state["entries"], state["cursor"]).alias("entries"),
        )

    zero = F.lit(0).cast("bigint")
    start = F.struct(
        after(F.split(preamble, _AT_HUNK), zero, zero).alias("cursor"),
        F.array().cast("array<bigint>").alias("entries"),
    )
    return F.aggregate(pieces, start, step, lambda state: state["entries"])


def changed_lines(diffs: DataFrame, text: str = "diff_text") -> DataFrame:
    """Every added line of every diff: the diff's other columns, ``path``, ``line_no``, ``text``.

    A diff is cut at its file headers and each piece at its hunk headers. Within a hunk
    every line that counts moves the cursor by one, so the number of a line is the
    hunk's start plus its position among those lines. Only a piece that adds lines
    before its first hunk header needs the cursor the piece before has left; diffs with
    such a piece get a running cursor over their pieces. Lines beyond the numbers that a
    file can have are left out. A diff is parsed in one row, so it is one unit of work.
    """
    keys = [c for c in diffs.columns if c != text]
    # The leading newline lets a header on the first line be seen as one.
    body = F.concat(F.lit("\n"), newline_breaks(F.col(text)))
    cut = diffs.select(*keys, F.split(body, _AT_FILE).alias("_all")).select(
        *keys, F.get("_all", F.lit(0)).alias("_preamble"), F.slice("_all", 2, _ALL).alias("_pieces")
    )
    entries = F.when(
        F.exists("_pieces", _starts_without_hunk), _entry_cursors(F.col("_preamble"), F.col("_pieces"))
    )
    pieces = (
        cut.select(*keys, entries.alias("_entries"), F.posexplode("_pieces").alias("_p", "_piece"))
        .where(_target(F.col("_piece")) != NO_FILE)
        .select(
            *keys,
            strip_diff_prefix(_target(F.col("_piece"))).alias("path"),
            F.coalesce(F.get("_entries", F.col("_p")), F.lit(0).cast("bigint")).alias("_entry"),
            F.split("_piece", _AT_HUNK).alias("_hunks"),
        )
    )
    hunks = pieces.select(*keys, "path", "_entry", F.posexplode("_hunks").alias("_h", "_hunk"))
    start = F.when(F.col("_h") == 0, F.col("_entry")).otherwise(_hunk_start(F.col("_hunk")))
    lines = hunks.select(
        *keys, "path", start.alias("_start"), F.posexplode(_advancing(F.col("_hunk"))).alias("_i", "_line")
    )
    return lines.where(F.col("_line").startswith("+")).select(
        *keys,
        "path",
        (F.col("_start") + F.col("_i")).try_cast("int").alias("line_no"),
        F.substring("_line", 2, _ALL).alias("text"),
    ).where(F.col("line_no").isNotNull())


def parse_diffs(diffs: DataFrame, text: str = "diff_text") -> DataFrame:
    """The set of changed lines of every diff: its other columns, ``path`` and ``line_no``."""
    return changed_lines(diffs, text).drop("text").distinct()
