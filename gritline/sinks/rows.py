"""Findings as rows of other tools: SARIF rules and results, editor diagnostics, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions import paths as px
from gritline.functions import severity as sv
from gritline.operators.findings import rank_of
from gritline.vocab import PRODUCT, SEVERITIES


def given(text: str) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(F.col(text), F.lit(""))


def report_key() -> list[Column]:
    """Report order as ascending columns."""
    return [
        (-rank_of()).cast("int").alias("neg_rank"),
        F.col("file"),
        F.col("line"),
        (-F.col("confidence")).alias("neg_confidence"),
        F.col("emit_seq"),
    ]


KEY_COLUMNS = ("neg_rank", "file", "line", "neg_confidence", "emit_seq")


GATHERED = 1 << 14  # rows among which early ones are looked for at a time


def _early(rows: pa.Table) -> pa.Table:
    """The rows that no other row of their scan and rule precedes by rank, file and line; nulls come first."""
    group, key = ["repo_id", "rule_id"], ["neg_rank", "file", "line"]
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in group + key], null_placement="at_start")
    rows = rows.take(order).combine_chunks()
    if not rows.num_rows:
        return rows
    codes = {c: rows[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in group + key}
    begins = np.append(True, np.any([codes[c][1:] != codes[c][:-1] for c in group], axis=0))
    first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    return rows.filter(pa.array(np.all([codes[c] == codes[c][first] for c in key], axis=0)))


def _early_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield from _early(pa.Table.from_batches(held)).to_batches()
            held = []
    if held:
        yield from _early(pa.Table.from_batches(held)).to_batches()


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Rules of every scan, described by their first finding in report order.

    The smallest (order, texts) struct is a partial aggregate, so a scan with very many findings sends few rows per task. As
    its texts make Spark sort what it aggregates, rows that can't be first go before, in batches of ``GATHERED``.
    """
    texts = ["title", "description", "category", "severity"]
    rows = findings.select("repo_id", "rule_id", *report_key(), *texts)
    first = F.min(F.struct(*KEY_COLUMNS, *texts))
    one = rows.mapInArrow(_early_rows, rows.schema).groupBy("repo_id", "rule_id").agg(first.alias("_first")).select("repo_id", "rule_id", "_first.*")
    return one.select(
        "repo_id",
        "rule_id",
        F.initcap("category").alias("name"),
        F.substring("title", 1, 120).alias("short_description"),
        F.substring(F.coalesce(given("description"), F.col("title")), 1, 1000).alias("full_description"),
        sv.sarif_level(F.col("severity")).alias("level"),
        "category",
        *KEY_COLUMNS,
    )


def message(text: Column) -> Column:
    return F.when(given("suggestion").isNull(), text).otherwise(
        F.concat(text, F.lit("\n\nSuggestion: "), F.col("suggestion"))
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding, flat."""
    return findings.select(
        "repo_id",
        F.col("rule_id").alias("rule_id"),
        sv.sarif_level(F.col("severity")).alias("level"),
        message(F.coalesce(given("description"), F.col("title"))).alias("message"),
        px.sarif_uri(F.col("file")).alias("uri"),
        F.col("line").alias("start_line"),
        "end_line",
        "severity",
        "confidence",
        "source",
        *[c for c in report_key()],
    )


def sarif_integrity(findings: DataFrame) -> DataFrame:
    """Per scan: results, rules, and results whose rule is missing (always none)."""
    rules = sarif_rules(findings).select("repo_id", "rule_id", F.lit(1).alias("_known"))
    per_rule = findings.groupBy("repo_id", "rule_id").agg(F.count("*").alias("n"))
    matched = per_rule.join(rules, ["repo_id", "rule_id"], "left")
    return matched.groupBy("repo_id").agg(
        F.sum("n").alias("n_results"),
        F.count("_known").alias("n_rules"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("n_unmatched"),
    )


def diagnostics(findings: DataFrame, root: str) -> DataFrame:
    """Editor diagnostics: absolute file, 0-based line range, message and level."""
    start = F.greatest(F.lit(0), F.col("line") - 1)
    end = F.greatest(start, F.coalesce(F.col("end_line"), F.col("line")) - 1)
    head = F.concat(F.col("title"), F.lit("  ["), F.col("severity"), F.lit(" · "), F.col("category"), F.lit("]"))
    hint = F.concat(F.lit("💡 "), given("suggestion"))
    return findings.select(
        "repo_id",
        px.under_root(F.col("file"), root).alias("file"),
        start.alias("start_line"),
        end.alias("end_line"),
        F.concat_ws("\n", head, given("description"), hint).alias("message"),
        sv.editor_level(F.col("severity")).alias("level"),
        F.lit(PRODUCT).alias("source"),
        F.col("rule_id").alias("code"),
        "emit_seq",
    )


def summary_text(counts: DataFrame) -> DataFrame:
    """One line per scan: the severities that occur, and the total."""
    parts = [F.when(F.col(s) > 0, F.concat_ws(" ", F.col(s).cast("string"), F.lit(s))) for s in SEVERITIES]
    body = F.coalesce(F.nullif(F.concat_ws("  ", *parts), F.lit("")), F.lit("0 findings"))
    return counts.select(
        "repo_id",
        F.concat(F.lit("Summary: "), body, F.lit("  ("), F.col("total").cast("string"), F.lit(" total)")).alias("summary"),
    )
