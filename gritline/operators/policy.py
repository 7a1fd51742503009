"""Per-repository settings: layered overrides, path policies and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions import paths as px
from gritline.functions import severity as sv
from gritline.operators.skew import apart, keyed_join
from gritline.vocab import (
    DEFAULT_FAIL_ON,
    DEFAULT_MAX_TOKENS,
    DEFAULT_MAX_WORKERS,
    DEFAULT_MODEL,
    MAX_BYTES,
    MIN_MAX_TOKENS,
    SEVERITIES,
)

NEVER = "none"


def _given_text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _layered_severity(value: Column) -> Column:
    """Severity of the file or environment layer; anything unknown reads as the default."""
    return F.when(value.isNotNull(), sv.coerce_severity(value, DEFAULT_FAIL_ON))


def resolve_policies(repos: DataFrame, layers: DataFrame) -> DataFrame:
    """Effective settings: default, then file, then environment, then flag.

    ``fail_on`` is null where the gate is off, which only the flag can do. ``layers`` has
    at most one row per repository.
    """
    c = F.col
    flag = c("flag_fail_on")
    configured = F.coalesce(
        _layered_severity(_given_text(c("env_fail_on"))), _layered_severity(c("file_fail_on")), F.lit(DEFAULT_FAIL_ON)
    )
    fail_on = (
        F.when(flag.isNull(), configured).when(flag == NEVER, F.lit(None)).otherwise(sv.coerce_severity(flag))
    )
    env_off = F.lower(F.coalesce("env_no_ai", F.lit(""))).isin("1", "true", "yes")

    def globs(kind: str) -> Column:
        own = c(f"file_{kind}")
        return F.coalesce(c(f"flag_{kind}"), F.when(F.size(own) > 0, own))

    joined = repos.select("repo_id").distinct().join(apart(layers), "repo_id", "left")
    return joined.select(
        "repo_id",
        fail_on.alias("fail_on"),
        F.coalesce("flag_min_confidence", "file_min_confidence", F.lit(0.0)).alias("min_confidence"),
        F.coalesce(
            "flag_max_bytes",
            F.when(c("file_max_bytes").isNotNull(), F.greatest(F.lit(1), c("file_max_bytes"))),
            F.lit(MAX_BYTES),
        ).cast("bigint").alias("max_bytes"),
        globs("include").alias("include"),
        globs("exclude").alias("exclude"),
        F.coalesce(
            _given_text(c("flag_model")), _given_text(c("env_model")), c("file_model"), F.lit(DEFAULT_MODEL)
        ).alias("model"),
        F.coalesce(
            "flag_max_tokens",
            F.when(c("file_max_tokens").isNotNull(), F.greatest(F.lit(MIN_MAX_TOKENS), c("file_max_tokens"))),
            F.lit(DEFAULT_MAX_TOKENS),
        ).cast("int").alias("max_tokens"),
        F.coalesce(
            "flag_max_workers",
            F.when(c("file_max_workers").isNotNull(), F.greatest(F.lit(1), c("file_max_workers"))),
            F.lit(DEFAULT_MAX_WORKERS),
        ).cast("int").alias("max_workers"),
        (F.coalesce("flag_no_ai", F.lit(False)) | env_off | F.coalesce("file_no_ai", F.lit(False))).alias("no_ai"),
    )


def filter_by_policy(files: DataFrame, policies: DataFrame) -> DataFrame:
    """Files that pass the include and exclude globs of their repository.

    The globs of a policy become one regex per kind before the join; the join is salted
    because one repository may hold much of the files, unless there are few policies.
    """
    regexes = policies.select(
        "repo_id", px.globs_regex(F.col("include")).alias("_in"), px.globs_regex(F.col("exclude")).alias("_out")
    )
    joined = keyed_join(files, regexes, ["repo_id"], ["path"], "left")
    path = F.col("path")
    return joined.where(
        F.coalesce(px.matches_regex(path, F.col("_in")), F.lit(True))
        & ~F.coalesce(px.matches_regex(path, F.col("_out")), F.lit(False))
    ).drop("_in", "_out")


def gate(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Pass or fail per repository: fail when a finding reaches its ``fail_on``.

    A null ``fail_on`` never fails. Repositories without findings pass.
    """
    counts = findings.groupBy("repo_id").agg(
        *[F.count_if(sv.severity_rank(F.col("severity")) >= sv.severity_rank(F.lit(s))).alias(s) for s in SEVERITIES]
    )
    joined = policies.select("repo_id", "fail_on").join(counts, "repo_id", "left")
    reached = F.coalesce(
        F.coalesce(*[F.when(F.col("fail_on") == s, F.col(s)) for s in SEVERITIES]), F.lit(0).cast("bigint")
    )
    return joined.select(
        "repo_id",
        "fail_on",
        reached.alias("n_at_or_above"),
        F.when(reached > 0, "fail").otherwise("pass").alias("gate"),
    )


def render_gate(findings: DataFrame, scans: DataFrame, fail_on: str | None) -> DataFrame:
    """Gate of re-rendered reports: only when a threshold is asked for."""
    asked = None if fail_on in (None, NEVER) else fail_on
    threshold = F.lit(asked).cast("string")
    return gate(
        findings, scans.select("repo_id").distinct().withColumn("fail_on", F.when(threshold.isNotNull(), sv.coerce_severity(threshold)))
    )
