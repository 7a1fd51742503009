"""Unified diffs whose lines are rows, so that one diff of any length spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritline.functions.paths import strip_diff_prefix
from gritline.functions.text import strip
from gritline.operators.diffs import FILE_HEADER, HUNK, NO_FILE
from gritline.operators.skew import stage

_FAR = 1 << 60  # no start is beyond, so that adding positions can't overflow


def _marked(lines: DataFrame, text: str) -> DataFrame:
    """What each line does: names a file (null for none), starts a hunk, moves the cursor, adds a line."""
    line = F.col(text)
    header, old = line.startswith(FILE_HEADER), line.startswith("--- ")
    hunk = line.startswith("@@")
    target = strip(F.substring(line, len(FILE_HEADER) + 1, _FAR >> 30))
    name = F.when(target != NO_FILE, strip_diff_prefix(target))
    number = F.nullif(F.regexp_extract(line, HUNK, 1), F.lit(""))
    start = F.when(number.isNotNull(), F.least(F.coalesce(number.try_cast("bigint"), F.lit(_FAR)), F.lit(_FAR))).otherwise(F.lit(0))
    moves = ~header & ~old & ~hunk & ~line.startswith("-") & ~line.startswith("\\")
    return lines.withColumns(
        {
            "_file": F.when(header, F.struct(name.alias("path"))),
            "_start": F.when(hunk & ~header, start.cast("bigint")),
            "_moves": moves.cast("bigint"),
            "_adds": moves & line.startswith("+"),
        }
    )


def _within(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each line's state as far as the lines before it in its range tell.

    ``_known`` is the file named last, ``_base`` the start of the last hunk, ``_if_file`` and ``_sure`` how far lines
    since that hunk moved the cursor: those before the first header of the range, which count if the range starts in a
    file, and those behind it in a file.
    """
    own = Window.partitionBy(*keys, "_part").orderBy("_seq")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    named = marked.withColumn("_known", F.last("_file", ignorenulls=True).over(so_far))
    counted = named.withColumns(
        {
            "_p": F.when(F.col("_known").isNull(), F.col("_moves")).otherwise(F.lit(0)),
            "_r": F.when(F.col("_known.path").isNotNull(), F.col("_moves")).otherwise(F.lit(0)),
        }
    )
    sums = counted.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_p", "_r")} | {"_own_p": F.col("_p"), "_own_r": F.col("_r")})
    at_hunk = F.when(F.col("_start").isNotNull(), F.struct("_start", "_p", "_r"))
    hunks = sums.withColumn("_hunk", F.last(at_hunk, ignorenulls=True).over(so_far))
    return hunks.withColumns(
        {
            "_base": F.col("_hunk._start"),
            "_if_file": F.col("_p") - F.coalesce("_hunk._p", F.lit(0)),
            "_sure": F.col("_r") - F.coalesce("_hunk._r", F.lit(0)),
        }
    )


def _entries(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """File and cursor with which a range begins that goes on with the diff of the range before.

    Such a diff has the last line of the range before, so what matters is the state behind the last line of each range, one row
    for each. That row holds a range's effect: the last file it names, the last start it sets, and how far it moves the cursor if
    a file is open at its begin or not. Effects go together in any grouping, so windows over these rows are enough.
    """
    last = ends.groupBy("_part").agg(F.max("_seq").alias("_seq"))
    last = last.withColumn("_next", F.lead("_part").over(Window.orderBy("_part")))
    effects = ends.drop("_part").join(F.broadcast(last), "_seq").where("_next IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("_part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = effects.withColumns(
        {"_open": F.last("_known", ignorenulls=True).over(before), "_in_file": F.last("_known", ignorenulls=True).over(so_far)}
    )
    if_file, sure = F.col("_if_file") + F.col("_own_p"), F.col("_sure") + F.col("_own_r")
    moved = opened.withColumn("_move", F.when(F.col("_open.path").isNotNull(), if_file).otherwise(F.lit(0)) + sure).withColumn(
        "_run", F.sum(F.when(F.col("_base").isNull(), F.col("_move")).otherwise(F.lit(0))).over(so_far)
    )
    # A start that a range sets, less all moves until then, is what later moves are added to.
    anchor = F.when(F.col("_base").isNotNull(), F.col("_base") + F.col("_move") - F.col("_run"))
    cursor = F.coalesce(F.last(anchor, ignorenulls=True).over(so_far), F.lit(0)) + F.col("_run")
    return moved.withColumn("_in_cursor", cursor).select(*keys, F.col("_next").alias("_part"), "_in_file", "_in_cursor")


def _changed(lines: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, texts: bool) -> DataFrame:
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    # Lines are read before they are dealt: only what the state needs travels, and texts of added lines if they are asked for.
    kept = [F.when(F.col("_adds"), F.substring(text, 2, _FAR >> 30)).alias("_text")] if texts else []
    names = dict.fromkeys([*keys, *order])
    marked = _marked(lines, text).select(*names, "_file", "_start", "_moves", "_adds", *kept)
    dealt = marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_seq", F.monotonically_increasing_id())
    narrow = dealt.withColumn("_part", F.shiftright("_seq", 33)).drop(*[c for c in order if c not in keys])
    own = Window.partitionBy(*keys, "_part").orderBy("_seq")
    states = _within(narrow, keys).withColumn("_ends", F.lead("_seq").over(own).isNull()).where("_adds OR _ends")
    columns = ["_part", "_seq", "_adds", "_ends", "_known", "_base", "_if_file", "_sure", "_own_p", "_own_r"]
    states = stage(states.select(*keys, *columns, *(["_text"] if texts else [])))
    entries = _entries(states.where("_ends"), keys).withColumnsRenamed({c: f"_of_{c}" for c in (*keys, "_part")})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_part")])
    joined = states.where("_adds").join(F.broadcast(entries), same, "left")
    file = F.coalesce(F.col("_known"), F.col("_in_file"))
    inside: Column = F.when(F.col("_in_file.path").isNotNull(), F.col("_if_file")).otherwise(F.lit(0)) + F.col("_sure")
    number = F.coalesce(F.col("_base"), F.col("_in_cursor"), F.lit(0)) + inside
    shown = [F.col("_text").alias("text")] if texts else []
    found = joined.select(*keys, file["path"].alias("path"), number.try_cast("int").alias("line_no"), *shown)
    return found.where("path IS NOT NULL AND line_no IS NOT NULL")


def changed_in_ranges(lines: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """Every added line of diffs that come as rows: ``keys``, ``path``, ``line_no`` and ``text``.

    ``keys`` name a diff, ``order`` its lines' order; equal rows in both are in any order. The answer is that of
    :func:`gritline.operators.diffs.changed_lines` for the diffs' texts, but neither a diff nor a file of it has to fit a
    task: lines are dealt by ranges of (keys, order), each range is read from its own begin, and what it leaves to
    the next one, a file name and a cursor, is handed on in one small row for each range, which goes to every task. What the ranges
    tell is written once, because ranges must not change between its two uses.
    """
    return _changed(lines, keys, order, text, True)


def parse_diff_lines(lines: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """The set of changed lines of diffs that come as rows: ``keys``, ``path`` and ``line_no``."""
    return _changed(lines, keys, order, text, False).distinct()
